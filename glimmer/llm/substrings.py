"""Operator 5, substring dedup: fixed-block anchors.

Reference blocks are the non-overlapping blocks of ANCHOR words of every text; the probes are all rolling
windows of ANCHOR words. A repeat of WINDOW = 2 * ANCHOR - 1 words or more holds a whole block of the text
that has it, so it is enough to look where a probe of one text hits a block of another. Around each hit all
windows of WINDOW words are compared, and overlapping matches are merged: these are the maximal exact repeats.

How it scales. Texts are dealt into chunks of a fixed number of bytes by a hash of id and text, so that rows that
share an id, or have none, are spread. A chunk sends each hash once, however often it holds it, as packed
differences: a passage that a third of all texts share costs one entry per chunk, not one per text. A bucket of
hashes answers each chunk with the hashes that matter to it. So one task holds a chunk or a bucket, the driver
holds nothing, and what is shuffled is about three bytes a word once, and the texts once (Spark reuses that exchange
for the three passes). Chunks times buckets are cells; a bucket grows with the root of the input up to MOST_BUCKET
bytes of text, which keeps cells few.

Probes are compared by 43 bits, where a chance hit costs time only. Windows are compared by 96: a hash of 64 bits and
an independent one of 32 of the 13 words' own hashes, so that of 10^13 different windows no two are expected to be
taken for one another.

Defined results: a null or empty text has no words; rows with a null id keep all words and take none from
others, since no id is smaller or larger; rows that share an id don't take words from one another; an empty
table gives no rows; columns other than the id and those in keep are left out. Ids are integers. A text longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.llm import shared

WINDOW = 13
CHUNK_BYTES, MOST_BUCKET = 4 << 20, 16 << 20
_ID, _BITS = 20, 43


class _Chunk:
    """The words of a chunk's texts, as hashes, with the windows that stay within a text."""

    def __init__(self, table: pa.Table, window: int):
        self.data, self.offsets = shared.utf8(table.column("__text"))
        self.starts, self.ends, self.before = shared.words(self.data, self.offsets)
        self.hashes = shared.word_hashes(self.data, self.starts, self.ends)
        ids = table.column("__id")
        self.known = np.asarray(ids.is_valid().to_numpy(), bool) if len(ids) else np.zeros(0, bool)
        self.ids = np.asarray(ids.fill_null(0).to_numpy(), np.int64) if len(ids) else np.zeros(0, np.int64)
        self.window = window

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of that size in texts with an id, and the text of each."""
        at = shared.windows_within(self.before, size)
        text = np.searchsorted(self.before, at, "right") - 1
        keep = self.known[text]
        return (at, text) if keep.all() else (at[keep], text[keep])


def _sliced(values: np.ndarray, bits: int, n: int):
    """For ascending values of so many bits: (bucket, slice) of each bucket that has any."""
    cuts = np.array([-(-(b << bits) // n) for b in range(n + 1)], np.uint64) if bits < 64 else None
    at = np.searchsorted(values, cuts)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), slice(int(at[b]), int(at[b + 1]))


_CELL = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
CELL = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("extra", T.BinaryType())])


def _cells(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CELL)], schema=_CELL)


def _probes(anchor: int, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, anchor)
        at, text = chunk.places(anchor)
        if not len(at):
            return _cells([])
        rank = np.cumsum(np.bincount(text, minlength=len(chunk.ids)) > 0) - 1  # texts that have windows, numbered
        block = (at - chunk.before[text]) % anchor == 0
        hashes = shared.window_hashes(chunk.hashes, anchor, 1)[at] >> np.uint64(64 - _BITS)
        n_texts = int(rank[-1]) + 1
        if n_texts < 1 << _ID:
            whole = np.sort((hashes << np.uint64(_ID + 1)) | (rank[text].astype(np.uint64) << np.uint64(1)) | block.astype(np.uint64))
            hashes, text, block = whole >> np.uint64(_ID + 1), (whole >> np.uint64(1)) & np.uint64((1 << _ID) - 1), (whole & np.uint64(1)).astype(bool)
        else:
            order = np.lexsort((text, hashes))
            hashes, text, block = hashes[order], text[order], block[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        last = np.r_[first[1:], len(hashes)] - 1
        flags = np.maximum.reduceat(block.astype(np.uint8), first) | ((text[first] != text[last]).astype(np.uint8) << 1)
        hashes = hashes[first]
        number = key[0].as_py()
        return _cells([(b, number, shared.packed(hashes[s]), np.packbits(np.r_[flags[s] & 1, flags[s] >> 1]).tobytes()) for b, s in _sliced(hashes, _BITS, n_buckets)])

    return run


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list, list]:
    """All keys of a bucket's cells, the cell of each, and the cells' chunks and extras."""
    keys = [shared.unpacked(x) for x in table.column("keys").to_pylist()]
    return np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys]), table.column("chunk").to_pylist(), table.column("extra").to_pylist()


def _hits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Hashes that are a block of some text and a window of another, sent back to each chunk that has them."""
    keys, cell, chunks, extras = _gathered(table)
    sizes = np.bincount(cell, minlength=len(chunks))
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=2 * n).reshape(2, n) for x, n in zip(extras, sizes)]
    bits = np.concatenate(bits, axis=1)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[first, len(ordered)])
    good = (np.maximum.reduceat(bits[0][order], first) > 0) & ((count > 1) | (np.maximum.reduceat(bits[1][order], first) > 0))
    chosen = np.zeros(len(keys), bool)
    chosen[order] = np.repeat(good, count)
    ends = np.cumsum(sizes)
    return _cells([(key[0].as_py(), c, shared.packed(keys[e - n : e][chosen[e - n : e]]), b"") for c, e, n in zip(chunks, ends, sizes) if chosen[e - n : e].any()])


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys of all answers to a chunk, and the ids and checks with them (none with hits)."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), table.column("extra").to_pylist()))
    keys = [shared.unpacked(k) for _, k, _ in rows]
    extras = [(x[: 8 * len(k)], x[8 * len(k) :]) for k, (*_, x) in zip(keys, rows)]
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return joined(keys, np.uint64), joined([shared.from_planes(a) for a, _ in extras], np.int64), joined([np.frombuffer(b, "<u4") for _, b in extras], np.uint32)


def _checks(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A second hash, of 32 bits, of the windows that start at these places."""
    return np.concatenate([np.zeros(0, np.uint32), *[(shared.window_hashes_at(hashes, at[a : a + (1 << 16)], size, 3) >> np.uint64(32)).astype(np.uint32) for a in range(0, len(at), 1 << 16)]])


def _found(values: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the ascending within, and whether it does."""
    if not len(within):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(within, values), len(within) - 1)
    return at, within[at] == values


def _checked(within: np.ndarray, check: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values found at these places of within, where equal values stand in a row: the place whose check is the value's
    own, and whether there is one."""
    at, there = at.copy(), check[at] == own
    left = np.flatnonzero(~there)
    while len(left):
        onward = np.minimum(at[left] + 1, len(within) - 1)
        left, onward = (x[(onward > at[left]) & (within[onward] == within[at[left]])] for x in (left, onward))
        at[left] = onward
        there[left] = check[onward] == own[left]
        left = left[~there[left]]
    return at, there


def _candidates(window: int, anchor: int, n_buckets: int):
    """Windows around the hits of a chunk: each hash with its smallest id and whether other ids have it."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        wanted = _answers(hits)[0]
        if not len(wanted) or not docs.num_rows:
            return _cells([])
        chunk = _Chunk(docs, window)
        at, _ = chunk.places(anchor)
        hit = np.zeros(len(chunk.hashes) + 1, np.int64)
        hit[at] = _found(shared.window_hashes(chunk.hashes, anchor, 1)[at] >> np.uint64(64 - _BITS), wanted)[1]
        so_far = np.r_[0, np.cumsum(hit)]
        at, text = chunk.places(window)
        near = so_far[at + window - anchor + 1] > so_far[at]
        at, text = at[near], text[near]
        if not len(at):
            return _cells([])
        hashes, ids, check = shared.window_hashes(chunk.hashes, window, 2)[at], chunk.ids[text], _checks(chunk.hashes, at, window)
        order = np.lexsort((ids, check, hashes))
        hashes, ids, check = hashes[order], ids[order], check[order]
        first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])])
        last = np.r_[first[1:], len(hashes)] - 1
        more = ids[first] != ids[last]
        hashes, ids, check = hashes[first], ids[first], check[first]
        number = key[0].as_py()
        return _cells([(b, number, shared.packed(hashes[s]), shared.planes(ids[s]) + check[s].astype("<u4").tobytes() + np.packbits(more[s]).tobytes()) for b, s in _sliced_high(hashes, n_buckets)])

    return run


def _sliced_high(values: np.ndarray, n: int):
    """As _sliced, for all 64 bits."""
    top = (values >> np.uint64(64 - _BITS)).astype(np.uint64)
    yield from _sliced(top, _BITS, n)


def _smallest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The smallest id of each hash, sent back to the chunks in which a larger id has it."""
    keys, cell, chunks, extras = _gathered(table)
    sizes = np.bincount(cell, minlength=len(chunks))
    ids = np.concatenate([shared.from_planes(x[: 8 * n]) for x, n in zip(extras, sizes)])
    check = np.concatenate([np.frombuffer(x, "<u4", count=n, offset=8 * n) for x, n in zip(extras, sizes)])
    more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=12 * n), count=n) for x, n in zip(extras, sizes)]).astype(bool)
    order = np.lexsort((ids, check, keys))
    ordered, checked = keys[order], check[order]
    first = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]) | (checked[1:] != checked[:-1])])
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(ids[order][first], np.diff(np.r_[first, len(ordered)]))
    chosen = (least < ids) | more
    ends = np.cumsum(sizes)
    cells = [(key[0].as_py(), c, slice(e - n, e)) for c, e, n in zip(chunks, ends, sizes)]
    return _cells([(b, c, shared.packed(keys[s][chosen[s]]), shared.planes(least[s][chosen[s]]) + check[s][chosen[s]].tobytes()) for b, c, s in cells if chosen[s].any()])


def _cut(window: int, layout: str, keep: tuple[str, ...], schema: pa.Schema):
    """Takes the repeated words out of a chunk's texts."""

    def part(docs: pa.Table, wanted: np.ndarray, least: np.ndarray, check: np.ndarray) -> pa.Table:
        chunk = _Chunk(docs, window)
        n_words = np.diff(chunk.before)
        cover = np.zeros(len(chunk.starts) + 1, np.int64)
        if len(wanted):
            at, text = chunk.places(window)
            where, there = _found(shared.window_hashes(chunk.hashes, window, 2)[at] if len(at) else np.zeros(0, np.uint64), wanted)
            at, text, where = at[there], text[there], where[there]
            where, there = _checked(wanted, check, where, _checks(chunk.hashes, at, window))
            at = at[there & (least[where] < chunk.ids[text])]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        text = np.repeat(np.arange(len(n_words)), n_words)
        n_removed = np.bincount(text[gone], minlength=len(n_words))
        # Maximal repeats: runs of removed words within a text.
        edge = np.zeros(len(gone) + 1, bool)
        edge[chunk.before[:-1]] = True
        begins = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
        stops = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1
        runs = np.searchsorted(chunk.before, begins, "right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs, np.arange(len(n_words) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array((begins - chunk.before[runs]).astype(np.int32)), pa.array((stops - chunk.before[runs]).astype(np.int32))], ["start", "stop"]))
        kept = ~gone
        of = text[kept]
        if layout == "words":
            data, _, ends = shared.joined(chunk.data, chunk.starts[kept], chunk.ends[kept])
            last = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) if len(of) else np.zeros(0, np.int64)
            sizes = np.bincount(of, weights=(chunk.ends - chunk.starts + 1)[kept], minlength=len(n_words)).astype(np.int64)
            data, sizes = np.delete(data, ends[last]), sizes - (sizes > 0)
        else:  # a removed word goes with the white space after it
            stays = np.ones(len(chunk.data) + 1, np.int8)
            follow = np.r_[chunk.starts[1:], len(chunk.data)] if len(chunk.starts) else np.zeros(0, np.int64)
            follow = np.minimum(follow, chunk.offsets[1:][text]) if len(text) else follow
            change = np.zeros(len(chunk.data) + 1, np.int32)
            np.add.at(change, chunk.starts[gone], 1)
            np.add.at(change, follow[gone], -1)
            stays = np.cumsum(change)[:-1] == 0
            data, total = chunk.data[stays], np.r_[0, np.cumsum(stays)]
            sizes = np.diff(total[chunk.offsets])
        columns = [docs.column("__id"), *[docs.column(f"__keep_{i}") for i in range(len(keep))], pa.array(n_words), pa.array(n_removed), shared.texts(data, sizes), spans]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = _answers(answers)
        parts = [part(x, *found) for x in shared.portions(docs, "__text", 1 << 20)]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, layout: str = "words", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int | None = None) -> DataFrame:
    """Removes every word covered by a window that also starts in a text with a smaller id.

    Returns the id, the columns in keep, n_words, n_removed, kept_text and repeats, the removed maximal
    repeats as array<struct<start, stop>> in word numbers. layout "words" joins the kept words by a space;
    "text" keeps the white space between them. window must be odd; windows are judged on the input. bucket_bytes: text
    whose hashes make a bucket; if None 256 bytes for each byte of the input's root, a chunk to MOST_BUCKET.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    anchor = (window + 1) // 2
    n = shared.n_pieces(docs, text_col, chunk_bytes)
    size = bucket_bytes or min(max(MOST_BUCKET, chunk_bytes), max(chunk_bytes, int(256 * (n * chunk_bytes) ** 0.5)))
    buckets = max(1, -(-n * chunk_bytes // size))
    chunked = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("__chunk"),
        F.col(id_col).cast("long").alias("__id"),
        F.col(text_col).alias("__text"),
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
    )
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[fields[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))])
    from pyspark.sql.pandas.types import to_arrow_schema

    by_chunk = lambda: chunked.groupBy("__chunk")
    hits = by_chunk().applyInArrow(_probes(anchor, buckets), CELL).groupBy("bucket").applyInArrow(_hits, CELL)
    windows = by_chunk().cogroup(hits.groupBy("chunk")).applyInArrow(_candidates(window, anchor, buckets), CELL)
    least = windows.groupBy("bucket").applyInArrow(_smallest, CELL)
    return by_chunk().cogroup(least.groupBy("chunk")).applyInArrow(_cut(window, layout, keep, to_arrow_schema(schema)), schema)
