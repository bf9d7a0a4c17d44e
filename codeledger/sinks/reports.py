"""Report texts, as DataFrames of lines in order (``ord``, ``line``), and how they are written.

Formatting is native and every row is written: lines are put in order by a range sort, and
:func:`write_text` writes them as part files in order."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("text", "json", "csv", "html", "markdown", "compact", "dot")


def csv_cell(value: Column) -> Column:
    """A quoted cell; what a spreadsheet would run as a formula gets an apostrophe first."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[\t\r]") | text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def html_text(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def single_line(value: Column) -> Column:
    """Control characters as spaces."""
    return F.regexp_replace(value.cast("string"), r"\p{Cntrl}", " ")


def _score(places: int = 1) -> Column:
    """A score rounded half to even, then printed; a null score is a dash."""
    return F.when(F.col("score").isNotNull(), F.format_string(f"%.{places}f", F.bround("score", places))).otherwise(F.lit("-"))


def ordered(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(ord, line) of ``rows`` sorted by ``keys``.  Numbers grow along the order but leave gaps: each
    range of the sort numbers its own rows, so no task sees all of them."""
    return rows.withColumn("__line", line).orderBy(*keys).select(F.monotonically_increasing_id().alias("ord"), F.col("__line").alias("line"))


def _numbered(items: DataFrame, line: Column) -> DataFrame:
    return ordered(items.withColumn("__none", F.col("score").isNull()).withColumn("__down", -F.col("score")), ["__none", "__down", "id"], line)


def render(items: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """(ord, line) of ranked items (id, display_name, level, file, line, score, priority,
    category) in one of FORMATS: all of them, or the first ``limit``."""
    top = items if limit is None else items.orderBy(F.col("score").desc_nulls_last(), "id").limit(limit)
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    prio = F.coalesce("priority", F.lit("unscored"))
    if kind == "text":
        return _numbered(top, F.format_string("%s %s %s (%s)", _score(), prio, single_line(F.col("display_name")), place))
    if kind == "compact":
        return _numbered(top, F.format_string("%s\t%s\t%s", "id", _score(), prio))
    if kind == "json":
        return _numbered(top, F.to_json(F.struct(*sorted(top.columns))))
    if kind == "csv":
        cells = ["id", "level", "file", "line", "score", "priority", "category"]
        body = _numbered(top, F.concat_ws(",", *[csv_cell(F.when(F.col("score").isNotNull(), F.format_string("%.4f", F.bround("score", 4))) if c == "score" else F.col(c)) for c in cells]))
        return _with_frame(body, ",".join(cells), None)
    if kind == "html":
        row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_text(c), F.lit("</td>")) for c in (F.col("display_name"), place, _score(), prio)], F.lit("</tr>"))
        return _with_frame(_numbered(top, row), "<!doctype html><table>", "</table>")
    if kind == "markdown":
        row = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace(single_line(F.col("display_name")), F.lit("|"), F.lit(r"\|")), place, _score(), prio), F.lit(" |"))
        return _with_frame(_numbered(top, row), "| item | place | score | priority |\n| --- | --- | --- | --- |", None)
    if kind == "dot":
        esc = F.replace(F.replace(F.col("display_name"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return _with_frame(_numbered(top, F.concat(F.lit('  "'), "id", F.lit('" [label="'), esc, F.lit('"];'))), "digraph debt {", "}")
    raise ValueError(f"unknown format {kind!r}")


def _with_frame(lines: DataFrame, first: str, last: str | None) -> DataFrame:
    spark = lines.sparkSession
    rows = [(-1, first)] + ([((1 << 62), last)] if last else [])
    return lines.unionByName(spark.createDataFrame(rows, "ord long, line string"))


def diagnostics_text(diagnostics: DataFrame) -> DataFrame:
    """(ord, line) of all diagnostics (severity, message, path, line, column)."""
    line = F.format_string("%s:%s:%s: %s: %s", "path", F.col("line").cast("string"), F.col("column").cast("string"), "severity", single_line(F.col("message")))
    return ordered(diagnostics, ["path", "line", "column", "message"], line)


_HEAD = "<!doctype html><meta charset='utf-8'><title>{title}</title><input id='q' placeholder='filter'><select id='p'><option value=''>any priority</option></select><table id='t'></table><pre id='x'></pre><h2>Graph</h2><ul id='g'></ul><h2>Changes</h2><ul id='c'></ul>"
_SCRIPT = (
    "const $=i=>document.getElementById(i),read=i=>JSON.parse($(i).textContent),rows=read('d'),edges=read('e'),changes=read('h');"
    "const list=(at,xs,say)=>$(at).replaceChildren(...xs.map(x=>{const e=document.createElement('li');e.textContent=say(x);return e}));"
    "for(const p of [...new Set(rows.map(r=>r.priority??'unscored'))]){const o=document.createElement('option');o.value=o.textContent=p;$('p').append(o)}"
    "function open(r){$('x').textContent=[r.display_name,r.explanation??'',r.recommendation??'',...(r.kinds??[])].join('\\n');list('g',edges.filter(e=>e.source.includes(r.display_name)||(e.target??'').includes(r.display_name)),e=>e.source+' \u2192 '+(e.target??'unresolved:'+e.name)+' ('+e.kind+')')}"
    "function draw(){const q=$('q').value.toLowerCase(),p=$('p').value;$('t').replaceChildren(...rows.filter(r=>(!p||(r.priority??'unscored')===p)&&JSON.stringify(r).toLowerCase().includes(q)).map(r=>{const e=document.createElement('tr');e.onclick=()=>open(r);"
    "for(const k of ['display_name','file','score','priority']){const c=document.createElement('td');c.textContent=r[k]??'';e.append(c)}return e}))}$('q').oninput=$('p').oninput=draw;draw();"
    "list('c',changes,c=>c.status+' '+c.id+(c.score_delta==null?'':' '+c.score_delta))"
)


def dashboard_lines(items: DataFrame, title: str = "Evidence", edges: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """(ord, line) of a self-contained page over all items: a filter, an item's evidence and its
    edges, and what a comparison changed.  ``edges``: source, target, name, kind; ``changes``: id,
    status, score_delta.  The data stand in it as JSON, without ``<``."""
    spark = items.sparkSession
    out = spark.createDataFrame([(0, 0, _HEAD.format(title=title.replace("<", "&lt;")))], "part int, at long, line string")
    keys = {"d": ["__none", "__down", "id"], "e": ["source", "kind"], "h": ["id"]}
    for k, (name, rows) in enumerate((("d", items), ("e", edges), ("h", changes))):
        base = 1 + 3 * k
        first, last = f"<script id='{name}' type='application/json'>[", "]</script>"
        frame = spark.createDataFrame([(base, 0, first), (base + 2, 0, last)], "part int, at long, line string")
        out = out.unionByName(frame)
        if rows is not None:
            data = rows.withColumn("__none", F.col("score").isNull()).withColumn("__down", -F.col("score")) if name == "d" else rows
            body = ordered(data, keys[name], F.replace(F.to_json(F.struct(*rows.columns)), F.lit("<"), F.lit("\\u003c")))
            start = body.agg(F.min("ord").alias("__first"))  # one row
            comma = F.when(F.col("ord") == F.col("__first"), F.col("line")).otherwise(F.concat(F.lit(","), "line"))
            out = out.unionByName(body.crossJoin(F.broadcast(start)).select(F.lit(base + 1).alias("part"), F.col("ord").alias("at"), comma.alias("line")))
    out = out.unionByName(spark.createDataFrame([(99, 0, f"<script>{_SCRIPT}</script>")], "part int, at long, line string"))
    return ordered(out, ["part", "at"], F.col("line"))


def dashboard(items: DataFrame, title: str = "Evidence", limit: int = 2_000) -> str:
    """The page of the first ``limit`` items as one text, to be shown at once."""
    top = items.orderBy(F.col("score").desc_nulls_last(), "id").limit(limit)
    return "\n".join(r.line for r in dashboard_lines(top, title).orderBy("ord").collect())


def write_text(lines: DataFrame, path: str) -> None:
    """Lines in order in the part files of a new directory (one file if they are few); the write is
    committed as a whole and fails if the path is there already."""
    lines.orderBy("ord").select("line").write.mode("errorifexists").text(path)


def append_once(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key isn't stored yet; returns how many were new.  A second run of the same
    rows writes nothing.  Writers exclude each other by a lock file beside the table, which the store
    makes in one step; a writer that finds it raises.  For a plain folder; a
    :class:`~codeledger.sinks.versioned.VersionedTable` takes several writers and leaves no lock."""
    with _locked(rows.sparkSession, f"{path.rstrip('/')}.lock"):
        return _append(rows, path, key)


@contextlib.contextmanager
def _locked(spark: SparkSession, lock: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lock)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.createNewFile(where):
        raise RuntimeError(f"{lock} is held by another writer")
    try:
        yield
    finally:
        store.delete(where, False)


def _append(rows: DataFrame, path: str, key: str) -> int:
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti").select(*rows.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def check_outputs(outputs: list[str], protected: list[str]) -> None:
    """An output must not be a source, another output or protected."""
    norm = [o.rstrip("/") for o in outputs]
    taken = {p.rstrip("/") for p in protected}
    for o in norm:
        if o in taken or norm.count(o) > 1 or o.endswith(".swift"):
            raise ValueError(f"output {o!r} would overwrite an input or another output")
