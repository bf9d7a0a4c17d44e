"""Spans of regular-expression matches, with DataFrame functions only.

``split`` gives what stands between the matches and ``regexp_extract_all`` the matches, both
leftmost and non-overlapping; the lengths of the two, added up, are the positions (code points,
end exclusive).  Sums run in blocks whose arrays are joined at the end, so a text with very many
matches stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = "array<struct<start:int,end:int,hit:string>>"
_BLOCK = 128


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with one array column (start, end, hit) for each entry of ``patterns``: its name,
    the pattern (no match of length zero) and a condition outside of which it has no spans."""
    parts = df.select(
        "*",
        *[F.when(on, F.split(text, p, -1)).alias(f"__cl_between_{n}") for n, (p, on) in patterns.items()],
        *[F.when(on, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias(f"__cl_hits_{n}") for n, (p, on) in patterns.items()],
    )
    spans = [F.expr(_positions(f"__cl_between_{n}", f"__cl_hits_{n}")).alias(n) for n in patterns]
    return parts.select(*df.columns, *spans)


def _positions(between: str, hits: str) -> str:
    """SQL for the spans from the two arrays; an empty array where there are no hits."""
    size = f"size({hits})"
    step = f"(length({between}[j]) + length({hits}[j]))"
    block = f"sequence(b * {_BLOCK}, least((b + 1) * {_BLOCK}, {size}) - 1)"
    inner = (
        f"aggregate({block}, named_struct('at', acc.at, 'out', cast(array() as {_SPAN})), (a, j) -> named_struct("
        f"'at', a.at + {step}, 'out', array_append(a.out, named_struct('start', a.at + length({between}[j]), 'end', a.at + {step}, 'hit', {hits}[j]))))"
    )
    outer = (
        f"aggregate(sequence(0, int(({size} - 1) div {_BLOCK})), named_struct('at', 0, 'out', cast(array() as array<{_SPAN}>)), "
        f"(acc, b) -> transform(array({inner}), x -> named_struct('at', x.at, 'out', array_append(acc.out, x.out)))[0], acc -> flatten(acc.out))"
    )
    return f"case when {size} > 0 then {outer} else cast(array() as {_SPAN}) end"


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs with those fields, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, rank: int, kind: str) -> Column:
    """The spans as structs (start, rank, kind, end), which sort by start and then rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def count_of(spans: str, kind: str) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: str) -> str:
    """SQL for ``text`` with every span of ``spans`` (sorted by start) replaced by its kind in
    brackets; overlapping spans become one."""
    return (
        f"aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> case "
        f"when s.start >= a.at then named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), concat('[', s.kind, ']')))) "
        f"when s.end > a.at then named_struct('at', s.end, 'out', a.out) else a end, "
        f"a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"
    )
