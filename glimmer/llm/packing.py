"""Operator 10, best-fit packing: a linear grouping scheme on the histogram of lengths.

Only texts longer than a sequence are cut, into full pieces; the first piece may be shorter. Full pieces are
sequences of their own, so what is packed are pieces of 1 to capacity - 1 tokens, and a plan needs nothing
but how many there are of each length: a table of at most `capacity` rows, whatever the corpus.

The plan. Large lengths are ranked and cut into groups of equal cardinality; a group's lengths are rounded up to
its largest. For these few sizes the fractional configuration problem is solved by column generation (a dense
simplex with a knapsack as pricing) and rounded down. Then actual pieces take the places of the rounded
ones, rank by rank, which leaves more room than planned. What rounding left over and all small pieces go, longest
first, each into the fullest sequence that still holds it, whole runs of equal sequences at a time.

The plan is a list of runs: pieces lo..hi by rank go to sequences from `start`, `per` to each. A piece finds its run
by binary search on its rank, and the rank comes from a distributed sort of the pieces (not of their tokens).

Defined results: a null text is an empty one and has the end token alone; repeated rows are packed each; an empty
table gives no rows; a null id is kept and sorts first; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glimmer.llm import shared
from glimmer.llm.tokens import encoder_for, files

CAPACITY, END_ID = 2048, 0
#: Lengths above capacity / LARGE are large. The plan of the fewest sequences is taken: a high threshold leaves
#: little to rounding and much to best fit, a low one is better where there are few small pieces.
LARGE, GROUPS = (2, 4, 8), 40


@dataclass(frozen=True)
class Plan:
    """Ascending lo: ranks from lo[i] go to sequence start[i] + (rank - lo[i]) // per[i]."""

    lo: np.ndarray
    start: np.ndarray
    per: np.ndarray
    n_sequences: int

    def sequence(self, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.lo, rank, "right") - 1
        return self.start[i] + (rank - self.lo[i]) // self.per[i]


def _best_column(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest value: an unbounded knapsack over capacities."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(size.min()), capacity + 1):
        fits = size <= c
        gain = np.where(fits, value + best[c - np.where(fits, size, 0)], -1.0)
        i = int(np.argmax(gain))
        best[c], choice[c] = (gain[i], i) if gain[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    column, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= int(size[choice[c]])
    return float(best[capacity]), column


def configurations(size: np.ndarray, need: np.ndarray, capacity: int, most: int = 400) -> list[tuple[np.ndarray, int]]:
    """(number of each size in a sequence, how many such sequences): the fractional optimum rounded down."""
    k = len(size)
    if not k:
        return []
    columns = np.diag(capacity // size).astype(float)
    for _ in range(most):
        inverse = np.linalg.inv(columns)
        amount, price = np.maximum(inverse @ need, 0.0), inverse.sum(axis=0)
        value, column = _best_column(price, size, capacity)
        if value <= 1 + 1e-7:
            break
        enter = inverse @ column
        ratio = np.where(enter > 1e-9, amount / np.where(enter > 1e-9, enter, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        columns[:, int(np.argmin(ratio))] = column
    amount = np.maximum(np.linalg.solve(columns, need), 0.0)
    return [(columns[:, i].round().astype(np.int64), int(amount[i] + 1e-9)) for i in range(k) if amount[i] + 1e-9 >= 1]


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Of the plans for each threshold the first of those with the fewest sequences."""
    return min((make_plan(counts, capacity, large, GROUPS) for large in LARGE), key=lambda p: p.n_sequences)


def make_plan(counts: np.ndarray, capacity: int, large: int, groups: int) -> Plan:
    """The plan for counts[n] pieces of n tokens, ranked by length, longest first."""
    counts = np.asarray(counts, np.int64)
    lengths = np.arange(capacity, 0, -1)
    per_length = counts[lengths]
    ends = np.cumsum(per_length)
    begin = dict(zip(lengths.tolist(), (ends - per_length).tolist()))
    length_at = lambda rank: lengths[np.searchsorted(ends, rank, "right")]
    runs: list[tuple[int, int, int]] = []
    full = int(counts[capacity])
    used = full
    if full:
        runs.append((0, 0, 1))
    n_large = int(counts[capacity // large + 1 : capacity].sum())
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of sequences with that room: (first, how many)
    left: list[tuple[int, int, int]] = []  # (length, first rank, how many)
    if n_large:
        cuts = np.unique(full + (n_large * np.arange(groups + 1)) // groups)
        firsts, sizes = cuts[:-1], length_at(cuts[:-1])
        joint = np.r_[True, sizes[1:] != sizes[:-1]]  # groups of one size are one
        firsts, sizes = firsts[joint], sizes[joint]
        stops = np.r_[firsts[1:], full + n_large]
        at = firsts.copy()
        for column, amount in configurations(sizes, (stops - firsts).astype(float), capacity):
            # A place beyond a group's last piece would stay empty: fewer sequences instead.
            amount = min([amount, *[int((stops[g] - at[g]) // column[g]) for g in np.flatnonzero(column)]])
            if not amount:
                continue
            marks = {0, amount}
            for g in np.flatnonzero(column):
                inner = ends[(ends > at[g]) & (ends < at[g] + amount * column[g])]
                for t in range(int(column[g])):
                    marks.update(np.unique(-(-(inner - at[g] - t) // column[g])).tolist())
            marks = np.array(sorted(m for m in marks if 0 <= m <= amount))
            filled = sum(length_at(at[g] + marks[:-1] * column[g] + t) for g in np.flatnonzero(column) for t in range(int(column[g])))
            for m, n, f in zip(marks[:-1].tolist(), np.diff(marks).tolist(), filled.tolist()):
                room[capacity - f].append((used + m, n))
            for g in np.flatnonzero(column):
                runs.append((int(at[g]), used, int(column[g])))
                at[g] += amount * column[g]
            used += amount
        for a, b in zip(at.tolist(), stops.tolist()):
            while a < b:
                n = int(length_at(np.int64(a)))
                take = min(b, begin[n] + int(counts[n])) - a
                left.append((n, a, take))
                a += take
    left += [(n, begin[n], int(counts[n])) for n in range(capacity // large, 0, -1) if counts[n]]
    rooms = sorted(r for r in room if r)
    for n, rank, many in sorted(left, key=lambda x: (-x[0], x[1])):
        while many:
            i = bisect_left(rooms, n)
            if i == len(rooms):  # new sequences
                r, per = capacity, capacity // n
                first, have = used, -(-many // per)
                used += have
            else:
                r = rooms[i]
                per = r // n
                first, have = room[r].pop()
                if not room[r]:
                    rooms.pop(i)
            whole = min(have, many // per)
            rest = 0 if whole == have else min(per, many - whole * per)
            for f, h, p in ((first, whole, per), (first + whole, 1 if rest else 0, rest)):
                if h:
                    runs.append((rank, f, p))
                    rank, many = rank + h * p, many - h * p
                    if r - p * n:
                        if not room[r - p * n]:
                            insort(rooms, r - p * n)
                        room[r - p * n].append((f, h))
            f = first + whole + (1 if rest else 0)
            if f < first + have:
                if not room[r]:
                    insort(rooms, r)
                room[r].append((f, first + have - f))
    runs.sort()
    lo, start, per = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return Plan(lo, start, per, used)


def _cut(path: str, ranks_path: str | None, capacity: int, end_id: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(path, ranks_path), np.array([end_id], "<u4")
        for batch in batches:
            for part in shared.portions(batch, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                got = encoder.encode(texts)
                row, number, begin, size, crc, ids = [], [], [], [], [], []
                for i in range(len(texts)):
                    own = np.concatenate([got.ids[got.edges[i] : got.edges[i + 1]].astype("<u4"), end])
                    first = (len(own) - 1) % capacity + 1
                    for k, a in enumerate([0, *range(first, len(own), capacity)]):
                        some = own[a : first if not k else a + capacity]
                        row.append(i)
                        number.append(k)
                        begin.append(a)
                        size.append(len(some))
                        crc.append(zlib.crc32(some.tobytes()))
                        if with_ids:
                            ids.append(some.astype(np.int32))
                columns = [part.column("id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (begin, size, crc)]]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    return run


def _assigned(plan: Plan, before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("place").to_numpy(), np.int64)
            part = place >> 33
            base = np.zeros(len(place), np.int64)
            for p in np.unique(part):
                base[part == p] = before[int(p)]
            rank = base + (place & ((1 << 33) - 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "place"], pa.array(rank), pa.array(plan.sequence(rank))], [*[c for c in batch.schema.names if c != "place"], "rank", "sequence_id"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece, and ids (array<int>) if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    cut = shared.settled(rows.mapInArrow(_cut(*files(path, ranks_path), capacity, end_id, with_ids), schema))
    ranked = shared.settled(cut.orderBy(F.desc("length"), "id", "piece", "ids_crc32").withColumn("place", F.monotonically_increasing_id()))
    # One row for each length, at most `capacity`, and one for each partition of the sort.
    lengths = ranked.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        counts[r["length"]] = r["count"]
    parts = sorted((r[0], r[1]) for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    before, total = {}, 0
    for p, n in parts:
        before[p] = total
        total += n
    placed = ranked.mapInArrow(_assigned(best_plan(counts, capacity), before), f"{schema}, rank bigint, sequence_id bigint")
    ahead = F.sum("length").over(W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(ahead, F.lit(0)).cast("long"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
