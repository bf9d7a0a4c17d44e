"""Name resolution: prioritised candidate keys, three-valued outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED, AMBIGUOUS, UNRESOLVED = "resolved", "ambiguous", "unresolved"


def type_candidates(scopes: str, name: str, module: str, imports: str) -> Column:
    """Candidates (prio, module, name) of a reference: each enclosing scope from the inside,
    the same module, ``Module.Name``, then the imports (one priority for all of them)."""
    enclosing = F.transform(F.col(scopes), lambda s, i: F.struct(i.cast("int").alias("prio"), F.col(module).alias("module"), F.concat_ws(".", s, F.col(name)).alias("name")))
    own = F.array(F.struct(F.lit(1000).alias("prio"), F.col(module).alias("module"), F.col(name).alias("name")))
    dotted = F.when(
        F.instr(F.col(name), ".") > 0,
        F.array(F.struct(F.lit(1001).alias("prio"), F.substring_index(F.col(name), ".", 1).alias("module"), F.expr(f"substring({name}, instr({name}, '.') + 1)").alias("name"))),
    ).otherwise(F.expr("cast(array() as array<struct<prio:int,module:string,name:string>>)"))
    imported = F.transform(F.col(imports), lambda m: F.struct(F.lit(1002).alias("prio"), m.alias("module"), F.col(name).alias("name")))
    return F.concat(enclosing, own, dotted, imported)


def resolve_types(references: DataFrame, types: DataFrame, ref: str = "ref_id", scopes: str = "scopes", name: str = "name", module: str = "module", imports: str = "imports", bare_fallback: bool = True) -> DataFrame:
    """(ref, outcome, module, name, candidates): the first candidate that exists wins; several
    of equal priority are ambiguous.  With ``bare_fallback`` a name that no candidate finds is
    ambiguous if several types anywhere bear it, else unresolved."""
    wanted = references.select(ref, F.col(name).alias("__bare"), F.explode(type_candidates(scopes, name, module, imports)).alias("c")).select(ref, "__bare", "c.prio", F.col("c.module").alias("module"), F.col("c.name").alias("name"))
    known = types.select("module", "name").distinct()
    hits = wanted.join(known, ["module", "name"]).groupBy(ref, "prio").agg(F.count("*").alias("n"), F.min("module").alias("module"), F.min("name").alias("name"))
    best = hits.groupBy(ref).agg(F.min_by(F.struct("n", "module", "name"), "prio").alias("b")).select(ref, "b.n", "b.module", "b.name")
    bare = known.groupBy(F.col("name").alias("__bare")).agg(F.count("*").alias("__anywhere"))
    full = references.select(ref, F.col(name).alias("__bare")).join(best, ref, "left").join(bare, "__bare", "left")
    n = F.coalesce("n", F.lit(0))
    elsewhere = F.coalesce("__anywhere", F.lit(0)) > 1 if bare_fallback else F.lit(False)
    outcome = F.when(n == 1, RESOLVED).when(n > 1, AMBIGUOUS).when(elsewhere, AMBIGUOUS).otherwise(UNRESOLVED)
    found = F.when(n == 1, F.col("module")), F.when(n == 1, F.col("name"))
    return full.select(ref, outcome.alias("outcome"), found[0].alias("module"), found[1].alias("name"), F.when(n > 0, n).otherwise(F.when(elsewhere, F.col("__anywhere")).otherwise(0)).cast("long").alias("candidates"))


def resolve_by_key(references: DataFrame, definitions: DataFrame, ref: str, keys: list[str], target: str, exclude_self: str | None = None) -> DataFrame:
    """(ref, outcome, target, candidates) over plain keys: one match resolves, several are
    ambiguous, none is unresolved.  ``exclude_self``: a column of ``references`` that a match
    must not equal (a call never resolves to its caller)."""
    hits = references.join(definitions.select(*keys, target), keys)
    if exclude_self:
        hits = hits.filter(F.col(target) != F.col(exclude_self))
    per = hits.groupBy(ref).agg(F.count("*").alias("n"), F.min(target).alias("t"))
    full = references.select(ref).join(per, ref, "left")
    n = F.coalesce("n", F.lit(0))
    return full.select(ref, F.when(n == 1, RESOLVED).when(n > 1, AMBIGUOUS).otherwise(UNRESOLVED).alias("outcome"), F.when(n == 1, F.col("t")).alias(target), n.cast("long").alias("candidates"))


def call_candidates(callee: str, labels: str, owner: str) -> Column:
    """Full names that a call may mean: on its own type for ``self.``/``Self.`` and bare names,
    as written for dotted ones; labels in brackets."""
    tail = F.concat(F.lit("("), F.coalesce(F.col(labels), F.lit("")), F.lit(")"))
    name = F.col(callee)
    own = F.concat_ws(".", F.col(owner), F.regexp_replace(name, "^(self|Self)\\.", ""))
    on_self = name.rlike("^(self|Self)\\.")
    dotted = F.instr(name, ".") > 0
    names = F.when(on_self, F.array(own)).when(dotted, F.array(name)).otherwise(F.filter(F.array(F.when(F.col(owner).isNotNull(), own), name), lambda x: x.isNotNull()))
    return F.transform(names, lambda x: F.concat(x, tail))


def resolve_calls(calls: DataFrame, callables: DataFrame, call: str = "call_id", caller: str = "caller", callee: str = "callee", labels: str = "labels", owner: str = "owner") -> DataFrame:
    """(call, outcome, callable_id, candidates).  ``callables``: callable_id, full_name."""
    wanted = calls.select(call, caller, F.explode(F.array_distinct(call_candidates(callee, labels, owner))).alias("full_name"))
    hits = wanted.join(callables.select("callable_id", "full_name"), "full_name").filter(F.col("callable_id") != F.col(caller)).select(call, "callable_id").distinct()
    per = hits.groupBy(call).agg(F.count("*").alias("n"), F.min("callable_id").alias("t"))
    n = F.coalesce("n", F.lit(0))
    return calls.select(call).join(per, call, "left").select(call, F.when(n == 1, RESOLVED).when(n > 1, AMBIGUOUS).otherwise(UNRESOLVED).alias("outcome"), F.when(n == 1, F.col("t")).alias("callable_id"), n.cast("long").alias("candidates"))
