"""Repair of conversations: the cheapest edits that make the roles fit system?(user assistant)+, by a Viterbi pass.

Grammar states: 0 at the start, 1 after a system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
A layer holds for each state the least (cost, audit) that leads there; audits are the initials of the edits in order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import skew, textops

Layer = list[tuple[int, str] | None]

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITTING = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
RIGHT = {"su", "ua", "au"}
RUN = 4096
SPACE, MARKS = " \t\n\v\f\r", (".", "!", "?")
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of a table of turns, damaged by crc32(`conv_id:turn`) mod 20; nulls are one space.

    0 drops a row (it stays with present false), 1 empties its text, 2 takes its marks of sentence ends, 3 repeats it,
    4 makes it a user's.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text, role = or_space("text"), or_space("role")
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    if layer[state] is None or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """The layer with inserts; more than two in a row never pay, as two lead from any state back to it or to 3."""
    for _ in range(2):
        for state, at in enumerate(list(layer)):
            if at is not None:
                _offer(layer, FITTING[state][1], at[0] + 5, at[1] + "I")
    return layer


def step(layer: Layer, initial: str, fault: str) -> Layer:
    """The layer after one more row of this role initial and fault (blank, duplicate, truncated or empty)."""
    new: Layer = [None] * 4
    for state, at in enumerate(layer):
        if at is None:
            continue
        cost, audit = at
        _offer(new, state, cost + 2, audit + "D")
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault else 0
        to = NEXT[state].get(initial)
        if to is not None:
            _offer(new, to, cost + more, audit + "K")
        _offer(new, FITTING[state][1], cost + 1 + more, audit + "R")
    return closed(new)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that an audit makes of rows from a state on."""
    lines, k = [], 0
    for edit in audit:
        role = FITTING[state][0]
        if edit != "I":
            role, text = (roles[k] if edit == "K" else role), texts[k]
            k += 1
            if edit == "D":
                continue
        else:
            text = ""
        lines.append(f"{role}:{text}")
        state = NEXT[state][role[:1]]
    return lines


def _flaw(text: str) -> str:
    said = text.rstrip(SPACE)
    return "" if said[-1:] in MARKS else "truncated" if said else "blank"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `most` rows."""
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, make, ddl: str, most: int = 1000) -> DataFrame:
    """df's partitions through `make`, which takes and gives rows as tuples."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _batches(make(_rows(batches)), schema, most), ddl)


def _whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One result for each conversation of rows that are sorted by conversation and order."""
    for conv, group in groupby(rows, itemgetter(0)):
        live = [r for r in group if r[4]]
        roles, texts, turns = [r[2] for r in live], [r[3] for r in live], [r[1] for r in live if r[1] is not None]
        seen, layer, faults = set(), closed([(0, ""), None, None, None]), Counter()
        for role, text in zip(roles, texts, strict=True):
            flaw = _flaw(text)
            if flaw != "blank" and (role, text) in seen:
                flaw = "duplicate"
            seen.add((role, text))
            faults[flaw] += 1
            layer = step(layer, role[:1], flaw)
        cost, audit = min(at for at in (layer[0], layer[3]) if at is not None)
        illegal = sum(a[:1] + b[:1] not in RIGHT for a, b in zip(roles, roles[1:], strict=False))
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        lines = "\n".join(replay(audit, 0, roles, texts))
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def _segment(rows: Iterator[tuple]) -> Iterator[tuple]:
    """For each run of rows of a conversation: the least (cost, audit) between any two states, and what gaps and illegal pairs need."""
    for (conv, segment), group in groupby(rows, itemgetter(0, 1)):
        live = list(group)
        initials, turns = [r[4] for r in live], [r[3] for r in live if r[3] is not None]
        flaws = ["duplicate" if r[6] and r[5] != "blank" else r[5] for r in live]
        costs, audits = [], []
        for start in range(4):
            layer: Layer = [None] * 4
            layer[start] = (0, "")
            for initial, flaw in zip(initials, flaws, strict=True):
                layer = step(layer, initial, flaw)
            costs += [at and at[0] for at in layer]
            audits += [at and at[1] for at in layer]
        illegal = sum(a + b not in RIGHT for a, b in zip(initials, initials[1:], strict=False))
        yield conv, segment, costs, audits, flaws.count("blank"), flaws.count("duplicate"), flaws.count("truncated"), illegal, initials[0], initials[-1], *((turns[0], turns[-1]) if turns else (None, None)), len(set(turns))


def _united(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The segments of each conversation put together: a row for each segment with the state it starts in and its part of
    the audit, and a row (segment -1) with the conversation's counts, cost and audit."""
    for conv, group in groupby(rows, itemgetter(0)):
        layer = closed([(0, ""), None, None, None])
        lead, ways, names, last, before = [at and at[1] for at in layer], [], [], None, None
        blank = duplicate = truncated = illegal = gaps = 0
        for _, segment, costs, audits, n_blank, n_duplicate, n_truncated, n_illegal, initial, final, low, high, distinct in group:
            new: Layer = [None] * 4
            way: list = [None] * 4
            for a in range(4):
                for b in range(4):
                    if layer[a] is not None and costs[4 * a + b] is not None:
                        at = (layer[a][0] + costs[4 * a + b], layer[a][1] + audits[4 * a + b])
                        if new[b] is None or at < new[b]:
                            new[b], way[b] = at, (a, audits[4 * a + b])
            layer = new
            ways.append(way)
            names.append(segment)
            blank, duplicate, truncated = blank + n_blank, duplicate + n_duplicate, truncated + n_truncated
            illegal += n_illegal + (last is not None and last + initial not in RIGHT)
            last = final
            if low is not None:
                gaps += high - low + 1 - distinct + (max(0, low - before - 1) if before is not None else 0)
                before = high
        (cost, audit), state = min((layer[k], k) for k in (0, 3) if layer[k] is not None)
        parts = []
        for segment, way in zip(reversed(names), reversed(ways), strict=True):
            start, part = way[state]
            parts.append((segment, start, part))
            state = start
        segment, _, part = parts[-1]
        parts[-1] = (segment, 0, lead[state] + part)  # inserts before the first row
        none = (0, 0, 0, 0, 0, 0)
        yield from ((conv, *p, *none) for p in parts)
        yield conv, -1, 0, audit, gaps, blank, duplicate, truncated, illegal, cost


def _lines(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired lines of each segment, null if none is left. A segment's first row holds its state and audit."""
    for (conv, segment), group in groupby(rows, itemgetter(0, 1)):
        _, _, _, audit, state = next(group)
        live = list(group)
        lines = replay(audit, int(state), [r[3] for r in live], [r[4] for r in live])
        yield conv, segment, "\n".join(lines) if lines else None


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The hash of each conversation's lines, taken segment by segment as they come in order."""
    for conv, group in groupby(rows, itemgetter(0)):
        state, some = hashlib.sha256(), False
        for _, _, lines in group:
            if lines is not None:
                state.update((("\n" if some else "") + lines).encode())
                some = True
        yield conv, state.hexdigest()


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _long(rows: DataFrame, home: str, run: int) -> DataFrame:
    """Conversations that no task should hold: sorted over all partitions, cut into runs of rows, put together by state."""
    rows = skew.in_order(rows, "conv", _order(), f"{home}/sorted", "conv", "turn", "role", "text")
    rows = rows.withColumn("segment", F.floor(F.col("pos") / run).cast("bigint"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flaw = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    firsts = rows.groupBy("conv", "role", "text").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("again"))
    slim = rows.select("conv", "segment", "pos", "turn", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), flaw.alias("flaw")).join(firsts, "pos", "left").select("conv", "segment", "pos", "turn", "initial", "flaw", F.coalesce("again", F.lit(True)).alias("again"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_by = lambda df, by, order: df.repartition(n, *by).sortWithinPartitions(*by, *order)
    segments = _mapped(sorted_by(slim, ["conv", "segment"], ["pos"]), _segment, "conv bigint, segment bigint, costs array<bigint>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, distinct bigint", 1)
    parts = _mapped(sorted_by(segments, ["conv"], ["segment"]), _united, "conv bigint, segment bigint, start bigint, part string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint", 1)
    parts = textops.stored(parts, f"{home}/parts")
    leads = parts.where("segment >= 0").select("conv", "segment", F.lit(-1).cast("bigint").alias("pos"), F.col("part").alias("role"), F.col("start").cast("string").alias("text"))
    lines = _mapped(sorted_by(leads.unionByName(rows.select("conv", "segment", "pos", "role", "text")), ["conv", "segment"], ["pos"]), _lines, "conv bigint, segment bigint, lines string", 1)
    digests = _mapped(sorted_by(lines, ["conv"], ["segment"]), _digests, "conv bigint, repaired_sha256 string")
    totals = parts.where("segment < 0").withColumnRenamed("part", "audit").drop("segment", "start")
    return totals.join(digests.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, most_rows: int = 10_000, most_chars: int = 16_000_000, run: int = RUN) -> DataFrame:
    """One row for each conversation: its gaps, faults, illegal pairs, and the cheapest repair with cost, audit and hash.

    Rows go by turn (null first), then role and text. Null roles and texts are empty, so they can't be kept as they are.
    Rows whose column `present` is not true only name their conversation. A null conversation is one of its own; repeated
    rows are duplicates; an empty table gives no rows; other columns are ignored. A conversation of at most most_rows
    rows and most_chars characters is repaired by one task. Longer ones are sorted over many tasks and cut into runs of
    `run` rows; a run's layers from each of the four states are then put together, so that the result is the same. What
    one task holds of them is the audit, a character for each edit; the hash is taken line by line.
    """
    spark = turns.sparkSession
    home = textops.shared_dir(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), empty(role).alias("role"), empty(text).alias("text"), (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"))
    sizes = rows.where("present").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("role") + F.length("text")).alias("chars"))
    long = textops.stored(sizes.where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv").alias("of")), f"{home}/long")
    many = long.count()
    short, rest = rows, None
    if many:
        if many <= 100_000:
            long = F.broadcast(long)
        same = F.col("conv").eqNullSafe(F.col("of"))
        short, rest = rows.join(long, same, "left_anti"), rows.where("present").join(long, same, "left_semi")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = ["conv", *[f.split()[0] for f in RESULT.split(", ")]]
    out = _mapped(short.repartition(n, "conv").sortWithinPartitions("conv", *_order()), _whole, f"conv bigint, {RESULT}")
    if rest is not None:
        out = out.unionByName(_long(rest, home, run).select(*fields))
    return out.withColumnRenamed("conv", conv)
