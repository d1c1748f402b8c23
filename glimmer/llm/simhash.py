"""Operator 6, SimHash near-dedup: segment-popcount embedding and a grid range-join.

A fingerprint's 32 segments of two bits become a vector of 32 bit counts (0 to 2). Changing one bit changes
one count by one, so the Manhattan distance of two vectors is at most the fingerprints' Hamming distance. Of
two fingerprints within 4 bits, one half of the vectors (16 counts) is within Manhattan distance 2, and then
some grid point is within 1 of both halves: each fingerprint is dealt to the grid points within 1 of either
half, about 50, and meets there all that can be near. A meeting is tested by the Manhattan bound and
then by the fingerprints themselves.

How it scales. Texts are hashed once; equal fingerprints are one class from then on, so that copies, however
many, are one row. A grid point's members are compared in numpy and only a spanning forest of verified links
leaves the task; components are found by star rounds on that forest. A crowded point costs comparisons, never
rows: its members are dealt once more, to grid points within 1 of either quarter of the other half (of two within 4
bits one quarter is within Manhattan distance 2), and only what meets there is compared. What is crowded still are
fingerprints alike but for a few bits, most of them linked, which are searched breadth first.

Defined results: a null text is an empty one, its fingerprint is zero and linked like any other; repeated
rows are members of the same class; a null id is never a component's id while another id is in it; an empty
table gives no rows; other columns are left out.

One fingerprint catches most copies of 95 % similarity and few of 85 %. Where that isn't enough (the pipeline) a text has
several, and is linked to another by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm import shared
from glimmer.operators.graph import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: For the pipeline: the shingle sizes of a text's fingerprints, of which any may be near another text's; a size that
#: is named again stands for another, independent view of the same shingles.
STAGE = (5,) * 9
CROWD = 2048


def view_hashes(hashes: np.ndarray, view: int) -> np.ndarray:
    """The hashes of a view: those given for view 0, else a bijection of them that is independent of the others."""
    return shared.mixed(hashes ^ shared.mixed(np.array([view], np.uint64))) if view else hashes


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED, views: int = 1) -> np.ndarray:
    """The SimHash of each text: a bit is 1 if it is set in over half of the hashes of its shingles.

    With several views a text has as many fingerprints, by independent hashes of the same shingles: an array of
    len(texts) by views.
    """
    import xxhash

    data = shared.lowered(data)
    starts, ends, before = shared.words(data, offsets)
    data, starts, ends = shared.joined(data, starts, ends)
    n_words = np.diff(before)
    # A text of fewer words is one shingle.
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    at = shared.windows_within(before, shingle)
    text = np.searchsorted(before, at, "right") - 1
    firsts, lasts, owner = starts[at], ends[at + shingle - 1] if len(at) else at, text
    if len(short):
        firsts, lasts, owner = np.r_[firsts, starts[before[short]]], np.r_[lasts, ends[before[short + 1] - 1]], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        firsts, lasts, owner = firsts[order], lasts[order], owner[order]
    shape = (len(n_words), views) if views > 1 else len(n_words)
    if not len(owner):
        return np.zeros(shape, np.uint64)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((views, len(n_words), 64), np.int64)
    for a in range(0, len(owner), 1 << 16):
        part = slice(a, a + (1 << 16))
        hashes = np.array([digest(raw[s:e], seed) for s, e in zip(firsts[part].tolist(), lasts[part].tolist())], "<u8")
        own = owner[part]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for k in range(views):
            bits = np.unpackbits(view_hashes(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k, own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    over = counts * 2 > np.bincount(owner, minlength=len(n_words))[:, None]
    return np.packbits(over, axis=2, bitorder="little").view("<u8")[:, :, 0].T.reshape(shape)


def _fingerprinted(shingles: tuple[int, ...]):
    sizes, views = sorted(set(shingles)), len(shingles)
    # Columns come by size; this puts them in the order asked for.
    order = np.argsort(np.argsort(np.array(shingles), kind="stable"), kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.portions(batch, "text", 1 << 20):
                text = shared.utf8(part.column("text"))
                prints = np.concatenate([text_fingerprints(*text, n, SEED, shingles.count(n)).reshape(part.num_rows, -1) for n in sizes], axis=1)
                prints = np.ascontiguousarray(prints[:, order]).view(np.int64)
                more = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * (views - 1), pa.int32()), pa.array(prints[:, 1:].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints[:, 0]), more], ["id", "fp", "more"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingles: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """(id, fp, more): each row's SimHash over its word shingles, as a signed long, and those of its other views."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprinted(shingles), f"id {kind}, fp bigint, more array<bigint>")


_ODD = np.uint64(0x5555555555555555)


def _embedded(prints: np.ndarray) -> np.ndarray:
    """The 32 bit counts of each fingerprint, two bits each."""
    return (prints & _ODD) + ((prints >> np.uint64(1)) & _ODD)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of embedded vectors, all lanes at once: |x - y| is the odd-bit sum of lane differences."""
    high = np.uint64(0xAAAAAAAAAAAAAAAA)
    x1, x0, y1, y0 = a & high, a & _ODD, b & high, b & _ODD
    one = (x0 ^ y0) & _ODD  # a lane differs by one exactly where its parity does
    two = ((x1 ^ y1) >> np.uint64(1)) & _ODD & ~one
    return np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two)


def grid_points(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grid point, index of the fingerprint): all points within 1 of either half of its vector."""
    vectors, keys, owners = _embedded(prints), [], []
    for half in (0, 1):
        own = (vectors >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        keys.append(own | tag)
        owners.append(np.arange(len(prints)))
        for lane in range(16):
            unit = np.uint64(1 << (2 * lane))
            value = (own >> np.uint64(2 * lane)) & np.uint64(3)
            for fits, moved in ((value < 2, own + unit), (value > 0, own - unit)):
                at = np.flatnonzero(fits)
                keys.append(moved[at] | tag)
                owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, views = np.asarray(batch.column("fp").to_numpy(), np.int64), np.asarray(batch.column("seen").to_numpy(), np.int64)
        for a in range(0, len(prints), 1 << 14):
            part = prints[a : a + (1 << 14)]
            keys, owner = grid_points(part.view(np.uint64))
            keys = keys | (views[a : a + (1 << 14)][owner].astype(np.uint64) << np.uint64(33))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[owner])], ["point", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node) with the components of the given links."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints are near: the Manhattan bound first, then the bits."""
    near = _manhattan(_embedded(a), _embedded(b)) <= radius
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
    return near


def _spread(prints: np.ndarray, radius: int) -> tuple[list, list]:
    """Links among fingerprints, breadth first: what is reached is not compared again."""
    left, rows, cols = prints, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                new = left[near]
                rows.append(np.full(len(new), at, np.uint64))
                cols.append(new)
                queue.extend(new)
                left = left[~near]
    return rows, cols


def _crowded(prints: np.ndarray, half: int, radius: int, crowd: int) -> tuple[list, list]:
    """Links of one crowded point of a half, by the quarters of the other half."""
    vectors = (_embedded(prints) >> np.uint64(32 * (1 - half))) & np.uint64(0xFFFFFFFF)
    rows, cols = [], []
    for quarter in (0, 1):
        own = (vectors >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        keys, owners = [own], [np.arange(len(prints))]
        for lane in range(8):
            unit, value = np.uint64(1 << (2 * lane)), (own >> np.uint64(2 * lane)) & np.uint64(3)
            for fits, moved in ((value < 2, own + unit), (value > 0, own - unit)):
                at = np.flatnonzero(fits)
                keys.append(moved[at])
                owners.append(at)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        keys, members = keys[order], prints[owners[order]]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        for at in np.flatnonzero(size > crowd):
            r, c = _spread(members[first[at] : first[at] + size[at]], radius)
            rows += r
            cols += c
        few = np.repeat((size <= crowd) & (size > 1), size)
        r, c = _stepped(keys[few], members[few], radius)
        rows += r
        cols += c
    return rows, cols


def _stepped(points: np.ndarray, prints: np.ndarray, radius: int) -> tuple[list, list]:
    """Links among fingerprints that share a point, each compared with those at 1, 2, 3, ... places from it."""
    rows, cols, step, at = [], [], 1, np.arange(len(points))
    while True:
        at = at[at + step < len(points)]
        at = at[points[at] == points[at + step]]
        if not len(at):
            return rows, cols
        near = at[_near(prints[at], prints[at + step], radius)]
        rows.append(prints[near])
        cols.append(prints[near + step])
        step += 1


def links(points: np.ndarray, prints: np.ndarray, radius: int = RADIUS, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among fingerprints that share a grid point; points must be grouped."""
    first = np.flatnonzero(np.r_[True, points[1:] != points[:-1]]) if len(points) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(points)])
    rows, cols = [], []
    for at in np.flatnonzero(size > crowd):
        r, c = _crowded(np.unique(prints[first[at] : first[at] + size[at]]), int(points[first[at]] >> 32) & 1, radius, crowd)
        rows += r
        cols += c
    few = np.repeat((size <= crowd) & (size > 1), size)
    r, c = _stepped(points[few], prints[few], radius)
    rows += r
    cols += c
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(cols)


def _forests(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Star links with the components of the links found, reduced whenever there are many."""
    gathered, n = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*gathered)))

    for a, b in found:
        if len(a):
            gathered.append((a, b))
            n += len(a)
        if n > most:
            gathered = [reduced()]
            n = len(gathered[0][0])
            if n > most:
                yield pa.RecordBatch.from_arrays([*map(pa.array, gathered[0])], ["a", "b"])
                gathered, n = [], 0
    if gathered:
        yield pa.RecordBatch.from_arrays([*map(pa.array, reduced())], ["a", "b"])


def _met(radius: int, crowd: int):
    """Links within each grid point of a partition sorted by point; the last point waits for the next batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        point, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        done = lambda points, fps: tuple(x.view(np.int64) for x in links(points, fps, radius, crowd))
        for batch in batches:
            point = np.r_[point, np.asarray(batch.column("point").to_numpy(), np.int64)]
            prints = np.r_[prints, np.asarray(batch.column("fp").to_numpy(), np.int64).view(np.uint64)]
            whole = int(np.searchsorted(point, point[-1])) if len(point) else 0
            if whole > 1 << 16:
                yield done(point[:whole], prints[:whole])
                point, prints = point[whole:], prints[whole:]
        yield done(point, prints)

    return lambda batches: _forests(found(batches))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node is tied to the roots that it has in any partition; star links of what that joins."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            roots = batch.column("roots")
            sizes = np.diff(np.asarray(roots.offsets))
            yield np.repeat(np.asarray(batch.column("a").to_numpy(), np.int64), sizes), np.asarray(roots.flatten().to_numpy(), np.int64)

    return _forests(found())


def near_links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between fingerprints (columns fp and seen, the view; distinct) with the components of all pairs of a
    view within radius. A fingerprint that links in many partitions, in each to that one's root, is brought down to
    one row (it visits some 50 points, so it has 50 roots at most) before anything is joined."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the grid reaches {RADIUS} bits")
    dealt = prints.select("fp", F.col("seen").cast("long").alias("seen")).mapInArrow(_dealt, "point bigint, fp bigint")
    found = dealt.repartition("point").sortWithinPartitions("point").mapInArrow(_met(radius, crowd), "a bigint, b bigint")
    return found.groupBy("a").agg(F.collect_set("b").alias("roots")).mapInArrow(_joined, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingles: tuple[int, ...] = (SHINGLE,), radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over links, its own included.

    With several shingle sizes two rows are linked if their fingerprints of any of them are within radius.
    """
    rows = shared.settled(fingerprints(docs, id_col, text_col, shingles))
    classes = rows.groupBy("fp", "more").agg(F.min("id").alias("least"))
    if len(shingles) == 1:
        found = connected_components(near_links(classes.select("fp", F.lit(0).alias("seen")), radius), "a", "b")
    else:
        classes = shared.settled(classes)
        every = classes.select(F.col("fp").alias("first"), F.posexplode(F.concat(F.array("fp"), "more")).alias("seen", "fp"))
        # Links are contracted to one row a fingerprint first. Then a class is tied to the components of its views, and
        # classes meet at the smallest class of each component; what only one class has ties nothing.
        near = connected_components(near_links(every.select("fp", "seen").distinct(), radius), "a", "b")
        views = every.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("component", "fp").alias("view"))
        views = shared.settled(views)
        hubs = views.groupBy("view").agg(F.min("first").alias("hub"), F.max("first").alias("last")).where("hub < last").select("view", "hub", F.xxhash64("view").alias("h"))
        ties = views.withColumn("h", F.xxhash64("view")).join(hubs, ["view", "h"]).where("first <> hub").select("first", "hub")
        found = connected_components(ties, "first", "hub")
    rooted = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.select("fp", "root").distinct().join(smallest, "root").select("fp", "component_id")
    return rows.join(labelled, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingles: tuple[int, ...] = STAGE) -> DataFrame:
    """One row of each component stays: that of the smallest id, and of rows that share it the one of the smallest digest
    of the text.

    A row without an id stays in a component only where no row has one. Rows with the same id (or none) and the same text
    are one row, that of the smallest other columns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__none": F.col(id_col).isNull(), "__digest": F.unhex(F.md5(text.cast("binary")))})
    found = near_duplicates(keyed.select(F.struct("__none", F.col(id_col).alias("__id"), "__digest").alias("__key"), text.alias("__text")), "__key", "__text", shingles)
    found = shared.settled(found.select("__key", (F.col("__key") == F.col("component_id")).alias("stays")))
    gone = found.where("NOT stays").select("__key.*").withColumnRenamed("__digest", "__gone").distinct()
    left = keyed.join(gone.drop("__none"), (F.col("__digest") == F.col("__gone")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    repeated = found.where("stays").groupBy("__key").count().where("count > 1").limit(1).count() > 0
    if repeated:
        return left.groupBy(id_col, "__digest").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return left.select(*docs.columns)
