"""Conversation repair: fault flags by windows, then the cheapest edits by a fold in Spark SQL.

1. A window over each conversation, in the order of its turns, flags blank, repeated and truncated
   rows and adjacent roles that don't follow one another.
2. The rows are collected as sorted structs, and ``aggregate`` carries four (cost, audit) structs
   over them, one for each state that the role initials can be in: nothing yet, after ``s``, after
   ``u``, after ``a``.  ``least`` over structs takes the cheapest, ties by the least audit.
3. The audit is split at its row letters, and the repaired lines are made from it.

From each state only one role may follow, so an audit fixes the states it passes.  Of two audits
that have met the same rows neither begins the other unless they are equal, so what is least stays
least however it goes on, and the fold is exact.  Audits are kept in pieces of ``BLOCK`` rows: a
state holds the letters of its own block and the rank of what stood before it, so a conversation
costs time in proportion to its rows.

Only DataFrame functions are used.  The result has one row, one audit and one digest for each
conversation, so its rows meet in one task, as its texts must for the digest.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are
ordered by role and text; null keys are one conversation; a conversation of no rows, or of none
that is left, has zeros, an empty audit and the digest of the empty string; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: More than any conversation can cost: what isn't allowed.
_NEVER = 1_000_000_000_000
BLOCK = 128
_STATES = ("st", "sy", "u", "a")
_SPACES = r"\x20\x09-\x0D"
#: Rows that ``damage`` has dropped are marked so; they keep their conversation in the result.
GONE = "__cl_gone"


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, ``GONE``): rows dropped, emptied, without sentence ends, repeated or
    with the role user, as the CRC-32 of ``key:turn`` has it (nulls: one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    rows = turns.select(key, F.col(turn).cast("long").alias(turn), F.when(hit == 4, "user").otherwise(space(role)).alias(role), said.alias(text), (hit == 0).alias(GONE), hit.alias("__cl_hit"))
    return rows.withColumn("__cl_copy", F.explode(F.when(F.col("__cl_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__cl_hit", "__cl_copy")


def flagged(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, pos, turn, role, text, gone, blank, duplicate, truncated, illegal), spread by ``key``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col(GONE), F.lit(False)) if GONE in turns.columns else F.lit(False)
    rows = turns.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), gone.alias("gone"))
    # Rows that are gone stand behind all others, so no row has one of them before it.
    ordered = Window.partitionBy("key").orderBy("gone", "turn", "role", "text")
    equal = Window.partitionBy("key", "gone", "role", "text").orderBy("turn")
    rows = rows.repartition("key").withColumn("seen", F.row_number().over(equal) > 1)  # one shuffle serves both windows and the fold
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("pos", F.row_number().over(ordered)).withColumn("before", F.lag(initial).over(ordered))
    last = F.regexp_extract("text", rf"([^{_SPACES}])[{_SPACES}]*\z", 1)
    blank = last == ""
    truncated = ~blank & ~F.col("seen") & ~last.isin(".", "!", "?")
    illegal = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    return rows.select("key", "pos", "turn", "role", "text", "gone", blank.alias("blank"), (~blank & F.col("seen")).alias("duplicate"), truncated.alias("truncated"), illegal.alias("illegal"))


def _as_row() -> Column:
    """A row as the fold takes it: what it costs, and the letter, to let it be an s, a u or an a."""
    must, initial = F.col("blank") | F.col("duplicate"), F.substring("role", 1, 1)
    late = F.when(F.col("truncated"), F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")
    never = F.lit(_NEVER).cast("long")
    cost = lambda c: F.when(must, never).when(initial == c, late).otherwise(late + REROLE)
    letter = lambda c: F.when(initial == c, "K").otherwise("R")
    return F.struct("pos", "role", "text", F.when(must | (initial != "s"), never).otherwise(late).alias("s_cost"), cost("u").alias("u_cost"), letter("u").alias("u_letter"), cost("a").alias("a_cost"), letter("a").alias("a_letter"))


def _state(cost: str, rank: str, audit: str) -> str:
    return f"named_struct('cost', cast({cost} as bigint), 'rank', cast({rank} as int), 'audit', {audit})"


def _edit(of: str, cost: str, letter: str) -> str:
    return _state(f"{of}.cost + {cost}", f"{of}.rank", f"concat({of}.audit, {letter})")


def _states(st: str, sy: str, u: str, a: str) -> str:
    return f"named_struct('st', {st}, 'sy', {sy}, 'u', {u}, 'a', {a})"


def _inserted(acc: str) -> str:
    """The four states of ``acc`` when rows may be inserted there."""
    new = lambda x: _edit(x, str(INSERT), "'I'")
    u = f"least({acc}.u, {new(acc + '.st')}, {new(acc + '.sy')}, {new(acc + '.a')})"
    return f"transform(array({_states(f'{acc}.st', f'{acc}.sy', u, f'{acc}.a')}), i -> {_states('i.st', 'i.sy', 'i.u', f'least(i.a, {new("i.u")})')})[0]"


def _met(acc: str, x: str) -> str:
    """The four states of ``acc`` after the row ``x``, with inserted rows before it."""
    gone = lambda s: _edit(f"c.{s}", str(DELETE), "'D'")
    to = lambda s, what: _edit(f"c.{s}", f"{x}.{what}_cost", f"{x}.{what}_letter")
    first = _edit("c.st", f"{x}.s_cost", "'K'")
    made = _states(gone("st"), f"least({gone('sy')}, {first})", f"least({gone('u')}, {to('st', 'u')}, {to('sy', 'u')}, {to('a', 'u')})", f"least({gone('a')}, {to('u', 'a')})")
    return f"transform(array({_inserted(acc)}), c -> {made})[0]"


def fold(rows: str) -> str:
    """SQL for the (cost, audit) of the cheapest edits of an array of rows."""
    start = _states(*[_state("0" if k == 0 else str(_NEVER), str(k), "''") for k in range(4)])
    inner = f"aggregate(slice({rows}, b * {BLOCK} + 1, {BLOCK}), acc.now, (n, x) -> {_met('n', 'x')})"
    # The letters of the block move to what stands before it, kept once for each rank.
    each = ", ".join(f"named_struct('rank', e.now.{s}.rank, 'audit', e.now.{s}.audit, 'state', {k})" for k, s in enumerate(_STATES))
    begun = _states(*[_state(f"f.now.{s}.cost", f"array_position(transform(f.sorted, o -> o.state), {k}) - 1", "''") for k, s in enumerate(_STATES)])
    done = "transform(f.sorted, o -> array_append(f.done[o.rank], o.audit))"
    block = (
        f"transform(transform(array(named_struct('now', {inner}, 'done', acc.done)), e -> named_struct('now', e.now, 'done', e.done, 'sorted', array_sort(array({each})))), "
        f"f -> named_struct('now', {begun}, 'done', {done}))[0]"
    )
    nothing = "array_repeat(cast(array() as array<string>), 4)"
    end = f"transform(array({_inserted('z.now')}), e -> least(e.st, e.a))[0]"
    best = f"transform(array(named_struct('best', {end}, 'done', z.done)), y -> named_struct('cost', y.best.cost, 'audit', concat(array_join(y.done[y.best.rank], ''), y.best.audit)))[0]"
    return f"case when size({rows}) = 0 then named_struct('cost', 0L, 'audit', '') else aggregate(sequence(0, int((size({rows}) - 1) div {BLOCK})), named_struct('now', {start}, 'done', {nothing}), (acc, b) -> {block}, z -> {best}) end"


def lines(rows: str, audit: str) -> str:
    """SQL for the repaired ``role:text`` lines: the audit, cut behind each row's letter, has one
    piece for each row; what isn't deleted alternates between user and assistant."""
    pieces = f"regexp_extract_all({audit}, 'I*[KRD]|I+', 0)"
    new = "array_repeat(named_struct('letter', 'I', 'role', '', 'text', ''), length(p) - if(right(p, 1) = 'I', 0, 1))"
    old = f"if(right(p, 1) in ('K', 'R'), array(named_struct('letter', right(p, 1), 'role', {rows}[k].role, 'text', {rows}[k].text)), array())"
    # A last piece of inserts alone has no row.
    kept = f"flatten(transform({pieces}, (p, k) -> if(right(p, 1) = 'I', array_repeat(named_struct('letter', 'I', 'role', '', 'text', ''), length(p)), concat({new}, {old}))))"
    role = "case when x.letter = 'K' then x.role when (j + if(g[0].letter = 'K' and left(g[0].role, 1) = 's', 1, 0)) % 2 = 0 then 'user' else 'assistant' end"
    return f"transform(array({kept}), g -> transform(g, (x, j) -> concat({role}, ':', x.text)))[0]"


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each
    conversation; ``repaired`` has its ``role:text`` lines.  Rows with ``GONE`` true are left out."""
    rows = flagged(turns, key, turn, role, text)
    here = ~F.col("gone")
    count = lambda c: F.count_if(here & F.col(c)).alias(c)
    distinct = F.count_if(here & F.col("turn").isNotNull() & F.col("first_of_turn"))
    rows = rows.withColumn("first_of_turn", F.row_number().over(Window.partitionBy("key", "gone", "turn").orderBy("pos")) == 1)
    gaps = F.coalesce(F.max(F.when(here, F.col("turn"))) - F.min(F.when(here, F.col("turn"))) + 1 - distinct, F.lit(0)).cast("long")
    told = rows.groupBy("key").agg(
        gaps.alias("gaps"), *[count(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.when(here, _as_row()))).alias("rows"),
    )
    told = told.withColumn("best", F.expr(fold("rows")))
    return told.select(F.col("key").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.expr(lines("rows", "best.audit")).alias("repaired"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(turns))
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
