"""End to end: sources to facts, metrics, evidence, scores and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import facts as extract
from ..functions import policy
from ..operators import clones, evidence, graph, metrics, mining, resolve, rules, scoring
from ..operators.shared import cut
from ..sources.files import WorkspaceConfiguration, is_test_source


@dataclass
class Analysis:
    """The tables of one run."""

    facts: DataFrame
    observations: DataFrame
    summary: DataFrame
    findings: DataFrame
    blocks: DataFrame
    items: DataFrame
    evidence: DataFrame
    diagnostics: DataFrame
    complete: bool
    #: Roll-ups by file, and one row of totals (see ``evidence.by_strategy`` and ``evidence.summary``).
    aggregations: DataFrame | None = None
    totals: DataFrame | None = None


def type_references(fragments: DataFrame) -> DataFrame:
    """(ref_id, module, name, scopes, imports, source, path, line, column): a row for each name that
    a fragment refers to; enclosing scopes from the inside."""
    refs = fragments.select(
        F.concat_ws(".", "module", "name").alias("source"), "module", F.col("imported_modules").alias("imports"), F.split("name", r"\.").alias("__parts"), "path", "line", "column",
        F.explode(F.array_distinct("referenced_types")).alias("ref"),
    )
    scopes = F.transform(F.sequence(F.lit(0), F.size("__parts") - 1), lambda k: F.array_join(F.slice("__parts", 1, F.size("__parts") - k), "."))
    return refs.withColumn("scopes", scopes).withColumn("ref_id", F.concat_ws("|", "path", F.col("line").cast("string"), F.col("column").cast("string"), "source", "ref")).withColumnRenamed("ref", "name").drop("__parts")


def type_edges(fragments: DataFrame, types: DataFrame) -> DataFrame:
    """(source, target, name, confidence, kind, file, line, column): an edge for each reference;
    references to the type itself are left out, those that don't resolve keep their name."""
    # A file may declare a type twice at one place only by extension of the same name: one reference.
    refs = type_references(fragments.join(types.select("module", "name"), ["module", "name"], "left_semi")).dropDuplicates(["ref_id"])
    got = resolve.resolve_types(refs, types, "ref_id").select("ref_id", "outcome", F.concat_ws(".", "module", "name").alias("__target"))
    full = refs.join(got, "ref_id")
    target = F.when(F.col("outcome") == resolve.RESOLVED, F.concat(F.lit("type:"), "__target"))
    out = full.select(
        F.concat(F.lit("type:"), "source").alias("source"), target.alias("target"), F.when(F.col("outcome") != resolve.RESOLVED, F.col("name")).alias("name"), F.col("outcome").alias("confidence"),
        F.lit("typeReference").alias("kind"), F.col("path").alias("file"), "line", "column",
    )
    return out.filter(F.col("target").isNull() | (F.col("target") != F.col("source")))


def couplings(fragments: DataFrame, types: DataFrame) -> DataFrame:
    """Undirected edges between types whose names are referenced (resolved in an enclosing scope, in
    the module, by dotted name or by a unique import)."""
    resolved = type_edges(fragments, types).filter("confidence = 'resolved'")
    return metrics.coupling_edges(resolved.select(F.substring_index("source", ":", -1).alias("source"), F.substring_index("target", ":", -1).alias("target")))


def clone_lines(found: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    lines = extract.table(found, "lines")
    return lines.select(F.col("path").alias("file"), "number", "signature", (F.row_number().over(Window.partitionBy("path").orderBy("number")) - 1).cast("long").alias("ord"))


ITEM = ["item_key", "item_id", "display_name", "level", *evidence.PLACE]


def callable_items(functions: DataFrame) -> DataFrame:
    """Functions as items: one for each declaration, whatever its name."""
    module = F.when(F.col("owner").isNotNull(), F.col("module")).otherwise(F.substring_index("name", ".", 1))
    named = functions.withColumn("item_id", F.concat(F.lit("callable:"), "name")).withColumn("display_name", F.col("name")).withColumn("level", F.lit("callable"))
    return named.withColumn("module", module).withColumn("file", F.col("path")).withColumn("item_key", evidence.item_key("callable"))


def type_items(types: DataFrame, fragments: DataFrame, functions: DataFrame) -> DataFrame:
    """Types as items at their one base declaration, with what is measured of them."""
    base = fragments.filter(~F.col("is_extension")).select("module", "name", F.col("path").alias("file"), "line", "column")
    own = functions.groupBy("module", F.col("owner").alias("name")).agg(
        F.count_if(F.col("kind") == "method").alias("method_count"), F.sum("complexity").alias("wmcc"), F.slice(F.array_sort(F.collect_list(F.col("name"))), 1, 5).alias("callable_names"),
    )
    rows = types.join(base, ["module", "name"]).join(own, ["module", "name"], "left").fillna(0, ["method_count", "wmcc"])
    rows = rows.withColumn("property_count", F.size("fields")).withColumn("callable_names", F.coalesce("callable_names", F.array().cast("array<string>")))
    return rows.withColumn("display_name", F.concat_ws(".", "module", "name")).withColumn("item_id", F.concat(F.lit("type:"), "display_name")).withColumn("level", F.lit("type")).withColumn("item_key", F.col("item_id"))


def file_items(files: DataFrame, lines: DataFrame, types: DataFrame, callables: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Parsed files as items at their first code line.  ``types``, ``callables``: items."""
    first = lines.groupBy("file").agg(F.min("number").alias("line"))
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name))
    rows = files.filter("valid").select(F.col("path").alias("file"), "module", "code_lines")
    for other in (first, count(types, "type_count"), count(callables, "callable_count"), duplicates):
        rows = rows.join(other, "file", "left")
    rows = rows.fillna(0, ["type_count", "callable_count", "duplicate_lines"]).fillna(1, ["line"]).withColumn("column", F.lit(1).cast("long"))
    return rows.withColumn("display_name", F.col("file")).withColumn("item_id", F.concat(F.lit("file:"), "file")).withColumn("level", F.lit("file")).withColumn("item_key", F.col("item_id"))


def module_items(files: DataFrame, types: DataFrame, callables: DataFrame) -> DataFrame:
    """Modules as items at their first file.  All arguments are items."""
    rows = files.groupBy("module").agg(F.sum("code_lines").alias("code_lines"), F.count("*").alias("file_count"), F.min(F.struct("file", "line", "column")).alias("at"))
    for df, name in ((types, "type_count"), (callables, "callable_count")):
        rows = rows.join(df.groupBy("module").agg(F.count("*").alias(name)), "module", "left")
    rows = rows.fillna(0, ["type_count", "callable_count"]).select("*", "at.file", "at.line", "at.column")
    return rows.withColumn("display_name", F.col("module")).withColumn("item_id", F.concat(F.lit("module:"), "module")).withColumn("level", F.lit("module")).withColumn("item_key", F.col("item_id"))


def located_observations(types: DataFrame, type_rows: DataFrame, functions: DataFrame, edges: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(metric, entity, file, line, column, value): all ten metrics where they were measured."""
    place = ["file", "line", "column"]
    degree = metrics.nocc(edges).select(F.col("entity").alias("display_name"), F.col("value").alias("nocc"))
    at_type = type_rows.join(degree, "display_name", "left").fillna(0, ["nocc"]).select(
        F.col("display_name").alias("entity"), *place, F.expr("stack(5, 'LOCC', cast(code_lines as long), 'WMCC', cast(wmcc as long), 'NOMC', cast(method_count as long), 'NOGC', cast(property_count as long), 'NOCC', cast(nocc as long)) as (metric, value)"),
    )
    own = metrics.noav(types, functions).select(F.col("name").alias("entity"), F.col("path").alias("file"), "line", "column", F.lit("NOAV").alias("metric"), "value")
    free = functions.select(F.col("name").alias("entity"), F.col("path").alias("file"), "line", "column", F.expr("stack(3, 'LOCF', cast(code_lines as long), 'CCF', cast(complexity as long), 'NOPF', cast(parameters as long)) as (metric, value)"))
    at = lambda k, o, n: lines.select(F.col("file").alias(f"file{k}"), F.col("ord").alias(o), F.col("number").alias(n))
    told = blocks.withColumn("stop2", F.col("start2") + F.col("lines") - 1).join(at(1, "start1", "n1"), ["file1", "start1"]).join(at(2, "start2", "n2"), ["file2", "start2"]).join(at(2, "stop2", "e2"), ["file2", "stop2"])
    clones_ = told.select(F.concat(F.lit("duplicate of "), "file2", F.lit(":"), F.col("n2").cast("string"), F.lit("-"), F.col("e2").cast("string")).alias("entity"), F.col("file1").alias("file"), F.col("n1").alias("line"), F.lit(1).cast("long").alias("column"), F.lit("DC").alias("metric"), F.col("lines").cast("long").alias("value"))
    out = at_type
    for other in (own, free, clones_):
        out = out.unionByName(other)
    return out.select("metric", "entity", *place, "value")


def analyze(sources: DataFrame, config: WorkspaceConfiguration | None = None, entries: DataFrame | None = None, commits: DataFrame | None = None, reference: str | None = None, unreadable: str | None = None) -> Analysis:
    """Everything about (path, module, content).  Sources are parsed once; the facts are cut from
    their lineage and each table reads its kind.

    ``entries``: records of a coverage report (``sources.lcov.records``), or ``unreadable``, the
    reason why a wanted report can't be read; without either there is no coverage evidence.
    ``commits`` (path, sha, author_token, ts, subject) and the ``reference`` time make the history
    evidence, which is there in any case, as unavailable if need be."""
    config = config or WorkspaceConfiguration()
    found = cut(extract.extract(sources))
    fragments, functions = extract.table(found, "fragments"), extract.table(found, "functions")
    types = cut(metrics.merged_types(fragments, config.type_scope))
    edges = couplings(fragments, types)
    lines = clone_lines(found)
    blocks = cut(clones.blocks(lines, config.minimum_duplicate_lines, config.maximum_duplicate_comparisons))
    type_rows = type_items(types, fragments, functions)
    observed = cut(located_observations(types, type_rows, functions, edges, blocks, lines))
    limits = policy.THRESHOLDS | config.thresholds
    diagnostics = extract.diagnostics(found, config.strict_syntax)
    complete = diagnostics.filter("severity = 'error'").isEmpty()
    # Scalar totals that Table I needs: one row.
    files = extract.table(found, "files")
    total = metrics.totals(files, types, functions).first()
    duplicates = clones.duplicated_lines(blocks).count()
    summary = metrics.table_scores(metrics.summary(observed, config.thresholds), F.lit(total.methods), F.lit(total.class_variables), F.lit(total.parameters), F.lit(duplicates), F.lit(total.code_lines), config.scoring, F.lit(complete))
    callables = callable_items(functions)
    file_rows = file_items(files, lines, type_rows, callables, clones.physical_lines_per_file(blocks, lines))
    module_rows = module_items(file_rows, type_rows, callables)
    items = cut(callables.select(*ITEM).unionByName(type_rows.select(*ITEM)).unionByName(file_rows.select(*ITEM)).unionByName(module_rows.select(*ITEM)))
    rows = evidence.structural(callables, policy.CALLABLE_EVIDENCE).unionByName(evidence.structural(type_rows, policy.TYPE_EVIDENCE)).unionByName(evidence.oversized(type_rows))
    rows = rows.unionByName(evidence.structural(file_rows, policy.FILE_EVIDENCE)).unionByName(evidence.structural(module_rows, policy.MODULE_EVIDENCE))
    rows = rows.unionByName(evidence.attach(items, evidence.functional(functions, extract.table(found, "effects"), extract.table(found, "compositions"), extract.table(found, "risks"))))
    rows = rows.unionByName(evidence.attach_contexts(items, graph.context(graph_edges(found, types))))
    provided = evidence.history_evidence(items, commits, reference)
    if entries is not None or unreadable:
        provided = provided.unionByName(evidence.coverage_evidence(items, entries, unreadable))
    rows = cut(rows.unionByName(evidence.merge(items, provided)))
    scored = scoring.composite_scores(rows, ["item_key"]).select("item_key", "score")
    told = evidence.explained(items.join(scored, "item_key", "left"), evidence.breakdown(rows))
    told = cut(told.withColumn("priority", scoring.priority(F.col("score"), config.preset)).withColumnRenamed("item_id", "id"))
    shown, rolled = evidence.by_strategy(told, told.withColumnRenamed("id", "item_id"), rows, config.aggregation, config.preset)
    return Analysis(found, observed, summary, metrics.findings(observed, limits), blocks, shown, rows, diagnostics, complete, rolled, evidence.summary(told, shown, rolled))


def graph_edges(found: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(source, target, name, confidence, kind, file, line, column, is_test): type references, calls
    and dependencies between modules."""
    functions, calls, fragments = (extract.table(found, k) for k in ("functions", "calls", "fragments"))
    types = metrics.merged_types(fragments) if types is None else types
    ids = F.concat(F.lit("callable:"), F.col("name"), F.lit("@"), F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string")))
    callables = functions.select(ids.alias("callable_id"), F.col("name").alias("full_name"), "path", F.col("line").alias("of_line"), F.col("column").alias("of_column"), F.concat_ws(".", "module", "owner").alias("__type"), F.col("owner").isNotNull().alias("__owned"), "module")
    sites = calls.drop("module", "function").join(callables.select(F.col("callable_id").alias("caller"), "path", "of_line", "of_column", "module", F.when(F.col("__owned"), F.col("__type")).otherwise(F.col("module")).alias("owner")), ["path", "of_line", "of_column"])
    sites = sites.withColumn("call_id", F.concat_ws("|", "caller", F.col("line").cast("string"), F.col("column").cast("string"))).dropDuplicates(["call_id"])
    got = sites.join(resolve.resolve_calls(sites, callables), "call_id")
    called = got.select(F.col("caller").alias("source"), F.col("callable_id").alias("target"), F.when(F.col("outcome") != resolve.RESOLVED, F.concat(F.substring_index("callee", ".", -1), F.lit("("), F.col("labels"), F.lit(")"))).alias("name"), F.col("outcome").alias("confidence"), F.lit("call").alias("kind"), F.col("path").alias("file"), "line", "column")
    typed = cut(type_edges(fragments, types))
    module_of = lambda c: F.substring_index(F.substring_index(c, ":", -1), ".", 1)
    across = typed.filter("confidence = 'resolved'").withColumn("a", module_of("source")).withColumn("b", module_of("target")).filter("a <> b")
    modules = across.select(F.concat(F.lit("module:"), "a").alias("source"), F.concat(F.lit("module:"), "b").alias("target"), F.lit(None).cast("string").alias("name"), F.lit("resolved").alias("confidence"), F.lit("moduleDependency").alias("kind"), "file", "line", "column").distinct()
    every = typed.unionByName(called).unionByName(modules)
    return every.withColumn("__module", module_of("source")).withColumn("is_test", is_test_source("file", "__module")).drop("__module")


def dependency_graph(found: DataFrame) -> dict[str, DataFrame]:
    """All edges with confidence, coupling, contexts, neighbours and statistics."""
    edges = graph_edges(found)
    return {"edges": edges, "coupling": graph.coupling(edges.filter("target is not null"), "is_test"), "context": graph.context(edges), "neighbours": graph.neighbours(edges), "statistics": graph.statistics(edges)}


def repository_rules(found: DataFrame) -> dict[str, object]:
    """Data clumps and repeated switches over all sources."""
    clumps = extract.table(found, "clumps")
    units = clumps.select(F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"), "display_name").alias("unit"), F.transform("elements", lambda e: F.concat_ws(":", e["name"], e["type"])).alias("items"))
    switches = extract.table(found, "switches")
    place = switches.withColumn("place", F.struct("path", "line", "column"))
    return {"clumps": mining.closed_itemsets(units), "switches": mining.repeated_shapes(place, ["scope", "discriminator", "case_shape"], 2, "place"), "switches_complete": not mining.conditional_issues(switches)}


def rule_results(found: DataFrame, known: list[str]) -> DataFrame:
    """(rule, source, outcome, detections): every rule of every source commits by itself."""
    files = extract.table(found, "files").select(F.col("path").alias("source"), "valid")
    grid = files.select("source", "valid", F.explode(F.array(*map(F.lit, known))).alias("rule"))
    n = extract.table(found, "detections").groupBy(F.col("path").alias("source"), "rule").agg(F.count("*").alias("detections"))
    return grid.join(n, ["source", "rule"], "left").select("rule", "source", F.when(F.col("valid"), "committed").otherwise("parseFailed").alias("outcome"), F.coalesce("detections", F.lit(0)).alias("detections"))


#: The ten built-in rules, in order.
BUILT_IN = [
    rules.Rule("codeledger", "force-try"), rules.Rule("codeledger.concurrency", "unchecked-sendable", severity="info"), rules.Rule("codeledger.concurrency", "actor-nonisolated-unsafe", severity="info"), rules.Rule("codeledger.concurrency", "actor-state-across-await", severity="info"),
    rules.Rule("codeledger.code-smell", "force-cast"), rules.Rule("codeledger.code-smell", "empty-catch"), rules.Rule("codeledger.refactoring", "long-function"), rules.Rule("codeledger.refactoring", "long-parameter-list"), rules.Rule("codeledger.refactoring", "global-data"), rules.Rule("codeledger.refactoring", "large-class"),
]


def run_rules(sources: DataFrame, custom: list[rules.Rule]) -> DataFrame:
    """(rule, source, outcome, line, column, message) of user-defined rules: ``detect(text)``
    yields (line, column, message); a rule that raises fails for that source only."""
    from ..packaging import ship

    ship(sources.sparkSession)
    known = list(rules.registered(custom).items())

    def run(batches):
        import pyarrow as pa

        names = ["rule", "source", "outcome", "line", "column", "message"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for identity, rule in known:
                    try:
                        hits = sorted(rule.detect(content or ""))
                        out += [(identity, path, "committed", *h) for h in hits] or [(identity, path, "committed", None, None, None)]
                    except NotImplementedError as e:
                        out.append((identity, path, "unsupported", None, None, str(e)))
                    except Exception as e:
                        out.append((identity, path, "failed", None, None, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return sources.select("path", "content").mapInArrow(run, "rule string, source string, outcome string, line long, column long, message string")


def workspace(spark: SparkSession, units: list[tuple[str, str, str]], config: WorkspaceConfiguration | None = None) -> Analysis:
    from ..sources.files import in_memory

    return analyze(in_memory(spark, units), config)
