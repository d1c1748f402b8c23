"""Operator 2, LM scoring: masked pseudo-likelihood with a bidirectional window network in numpy.

Each word is predicted from the words to its left and to its right, itself masked out, in two softmaxes. A network
(random vectors made from each word's own hash, a trained projection, one hidden layer of tanh, a softmax over CLASSES)
gives log p(class | SIDE words on both sides), where classes are bands of about equal mass by real counts. Within a
class, a second softmax over all its words, with a weight of each word for each of the BITS that describe its left and
right neighbour, gives log p(word | class, both neighbours); its weights follow in closed form from how often each
bit was set beside the word, and its sums run over every word, so the probabilities of all words add up to 1.

The words, their counts and weights are a distributed table that grows with the corpus: a row for each bucket of word
hashes. Texts are cut into chunks; a chunk sends each of its distinct words once to the word's bucket, with its counts, and
gets back what the whole corpus says of it, so that one task holds a chunk or a bucket. Chunks times buckets are cells;
a bucket grows with the root of the corpus up to MOST_BUCKET bytes of text, which keeps cells few. A word is known by a
hash of 64 bits; two words of one hash are to be expected from some 10^9 words up. A word without a row (only in
texts that the model wasn't fitted on) has the last class, that of words out of the vocabulary, for itself.

Everything is learned from all texts: the table by one aggregation; the network by local training in every
partition, each taking all its words once a round, and averaging, weighted by words, over ROUNDS rounds. The driver holds
one set of weights, one row for each distinct count (not word), and the sums of the second softmax by class and bits.

Defined results: a null or empty text has no words, log-probability 0 and a null mean; a place beyond a text's
ends is the empty token 0; repeated rows are learned from and scored each; an empty table gives no rows; a null
id is kept; other columns are left out. Scores depend on how the input is split, through training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm import shared

CLASSES, SIDE, WIDTH, HIDDEN = 64, 2, 12, 32
ROUNDS, BATCH, RATE, SEED = 2, 512, 0.5, 5
#: Bits that describe both neighbours, half of them each; how many even observations each word's bits have beforehand.
BITS, PRIOR = 8, 4.0
#: Bytes of text of a chunk, and of the largest bucket of words.
CHUNK, MOST_BUCKET = 12 << 20, 128 << 20
_HALF = BITS // 2
_ONES = np.ones(CLASSES, np.float32)
_STEPS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


@dataclass(frozen=True)
class Weights:
    """The network's layers: inputs to hidden, hidden to classes, each with a bias as its last row."""

    inner: np.ndarray
    outer: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.ravel(), self.outer.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        n = (2 * SIDE * WIDTH + 1) * HIDDEN
        return Weights(flat[:n].reshape(-1, HIDDEN).astype(np.float32), flat[n:].reshape(HIDDEN + 1, CLASSES).astype(np.float32))

    @staticmethod
    def fresh() -> Weights:
        random = np.random.default_rng(SEED)
        return Weights(random.normal(0, (2 * SIDE * WIDTH) ** -0.5, (2 * SIDE * WIDTH + 1, HIDDEN)).astype(np.float32), np.zeros((HIDDEN + 1, CLASSES), np.float32))


class Vectors:
    """The fixed random vector of each token, made from the token itself; that of the empty token 0 is zero."""

    def __getitem__(self, tokens: np.ndarray) -> np.ndarray:
        tokens = np.asarray(tokens).astype(np.int64)
        salt = shared.mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) + np.uint64(SEED << 32))
        drawn = shared.mixed(tokens.view(np.uint64)[..., None] ^ salt) >> np.uint64(40)
        return ((drawn.astype(np.float32) / (1 << 23) - 1) * np.float32(3**0.5)) * (tokens != 0)[..., None].astype(np.float32)


def vectors() -> Vectors:
    return Vectors()


def text_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of each word (its hash, never 0), A-Z lower-cased, and the number of words before each text."""
    data = shared.lowered(data)
    starts, ends, before = shared.words(data, offsets)
    tokens = shared.word_hashes(data, starts, ends).view(np.int64)
    return np.where(tokens == 0, 1, tokens), before


def laid(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts with SIDE empty ones around each text, and where each token stands there."""
    n = np.diff(before)
    at = np.arange(len(tokens)) + np.repeat(SIDE * np.arange(1, len(n) + 1), n)
    out = np.zeros(len(tokens) + SIDE * (len(n) + 1), tokens.dtype)
    out[at] = tokens
    return out, at


def around(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 2 * SIDE tokens around each of these places of laid texts."""
    return line[at[:, None] + _STEPS]


def contexts(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The 2 * SIDE tokens around each word, 0 beyond its text."""
    return around(*laid(tokens, before))


def _hidden(inner: np.ndarray, table: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = table[context].reshape(len(context), -1)
    hidden = x @ inner[:-1]
    hidden += inner[-1]
    return x, np.tanh(hidden, out=hidden)


def _logits(outer: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    logits = hidden @ outer[:-1]
    logits += outer[-1]
    if np.abs(outer).sum(axis=0).max() > 80:  # hidden is within 1, so else exp can't overflow
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def class_log_probabilities(w: Weights, table: np.ndarray, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log p(class of the masked word | both sides)."""
    logits = _logits(w.outer, _hidden(w.inner, table, context)[1])
    own = logits[np.arange(len(context)), classes].astype(np.float64)
    return own - np.log(np.exp(logits, out=logits) @ _ONES)


def trained(w: Weights, table: np.ndarray, context: np.ndarray, classes: np.ndarray, rate: float = RATE) -> Weights:
    """The weights after one pass of gradient steps over the given words, BATCH of them a step."""
    inner, outer = w.inner.copy(), w.outer.copy()
    row = np.arange(BATCH)
    for a in range(0, len(context), BATCH):
        own = context[a : a + BATCH]
        x, hidden = _hidden(inner, table, own)
        slope = _logits(outer, hidden)
        np.exp(slope, out=slope)
        slope /= (slope @ _ONES)[:, None]
        slope[row[: len(own)], classes[a : a + BATCH]] -= 1
        slope *= np.float32(rate / max(len(own), BATCH // 4))
        back = slope @ outer[:-1].T
        back *= 1 - hidden * hidden
        outer[:-1] -= hidden.T @ slope
        outer[-1] -= slope.sum(axis=0)
        inner[:-1] -= x.T @ back
        inner[-1] -= back.sum(axis=0)
    return Weights(inner, outer)


def classes_of(counts: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, log p(token | class)): tokens by count, cut into classes of about equal mass.

    counts[0] is the empty token's; every other token counts once more than it was seen. words: how many tokens
    there are of each entry, one if None. The last class is left to words out of the vocabulary.
    """
    one = counts.astype(np.float64) + 1
    one[0] = 0
    mass = one if words is None else one * words
    order = np.lexsort((np.arange(len(mass)), -one))
    share = np.cumsum(mass[order]) / max(mass.sum(), 1)
    # Tokens heavier than a class have one each; the rest share what is left.
    number = np.zeros(len(mass), np.int64)
    number[order] = np.minimum((share - mass[order] / max(mass.sum(), 1) / 2) * (CLASSES - 1), CLASSES - 2).astype(np.int64)
    total = np.bincount(number, weights=mass, minlength=CLASSES)
    with np.errstate(divide="ignore"):
        return number, np.where(one > 0, np.log(np.maximum(one, 1e-300) / np.maximum(total[number], 1e-300)), 0.0)


@dataclass(frozen=True)
class Bands:
    """The class of each word: by its own hash where it stands alone in a class, else by its count."""

    least: np.ndarray  #: ascending least count of each band
    number: np.ndarray  #: and its class
    alone: np.ndarray  #: ascending words that stand alone
    alone_number: np.ndarray

    def of(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.number[np.maximum(np.searchsorted(self.least, n, "right") - 1, 0)]
        if len(self.alone):
            at = np.minimum(np.searchsorted(self.alone, words), len(self.alone) - 1)
            out = np.where(self.alone[at] == words, self.alone_number[at], out)
        return np.where(n > 0, out, CLASSES - 1)


def half_bits(tokens: np.ndarray) -> np.ndarray:
    """What is known of a neighbour: half of BITS bits of its hash."""
    return (shared.mixed(tokens.view(np.uint64)) >> np.uint64(64 - _HALF)).astype(np.uint8)


def neighbour_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number of BITS bits for each pair of neighbours (tokens)."""
    return half_bits(left).astype(np.int64) << _HALF | half_bits(right)


def shares(n: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The share of each bit beside a word, from its count and how often the bit was set: a byte each, in one long."""
    steps = np.minimum((often + PRIOR / 2) / (n + PRIOR)[:, None] * 256, 255).astype(np.uint8)
    return np.pad(steps, ((0, 0), (0, 8 - BITS))).view("<i8").ravel()


def _rates(packed: np.ndarray) -> np.ndarray:
    """The share of each bit, a byte each in packed, strictly between 0 and 1."""
    steps = np.ascontiguousarray(packed, "<i8").view(np.uint8).reshape(-1, 8)[:, :BITS]
    return (steps.astype(np.float32) + 0.5) / 256


_CODES = ((np.arange(1 << BITS)[:, None] >> np.arange(BITS)) & 1).astype(np.float32)
_HALF_CODES = _CODES[: 1 << _HALF, :_HALF]


class Within:
    """The second softmax for some words, given by count, class and packed shares."""

    def __init__(self, n: np.ndarray, c: np.ndarray, packed: np.ndarray, log_sums: np.ndarray):
        p = _rates(packed)
        off = np.log(1 - p)
        tilt = np.log(p) - off
        self.c, self.log_sums = c, log_sums
        # A word's weight for both neighbours' bits: the right one's are the low half.
        self.right = (tilt[:, :_HALF] @ _HALF_CODES.T) + (np.log(n + 1) + off.sum(axis=1))[:, None].astype(np.float32)
        self.left = tilt[:, _HALF:] @ _HALF_CODES.T

    def log_p(self, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """log p(word | its class, bits of both neighbours); words by their number among those given."""
        c = self.c[word]
        weight = self.right[word, bits & ((1 << _HALF) - 1)].astype(np.float64) + self.left[word, bits >> _HALF]
        return np.where(c == CLASSES - 1, 0.0, weight - self.log_sums[c, bits])


def within_class(facts: np.ndarray, bits: np.ndarray, log_sums: np.ndarray) -> np.ndarray:
    """log p(word | its class, bits of both neighbours), of words given by count, class and packed shares."""
    return Within(*facts.T, log_sums).log_p(np.arange(len(facts)), bits)


def _packed(x: np.ndarray) -> bytes:
    """An array in as few bytes as zstd makes of it, behind its size."""
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers, byte plane after byte plane."""
    return _packed(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _binary(*data: bytes) -> list[pa.Array]:
    return [pa.array([x], pa.binary()) for x in data]


CHUNKS = "chunk bigint, n_words bigint, words binary, local binary, sizes binary, ids binary"
_CHUNK = ["chunk", "n_words", "words", "local", "sizes", "ids"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts: distinct words, frequent ones first, each word's number among them (from 1), words of each
    text, ids."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in shared.portions(batch, "text", CHUNK):
            tokens, before = text_tokens(*shared.utf8(part.column("text")))
            words, local, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(1, len(words) + 1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.select(["id"]).schema) as out:
                out.write_batch(part.select(["id"]))
            blobs = _packed(words[order]), _planes(rank[local]), _packed(np.diff(before)), sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(tokens)]), *_binary(*blobs)], _CHUNK)
            chunk += 1


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words behind the empty token, each word's place there, words before each text)."""
    return np.r_[0, _unpacked(row["words"], np.int64)], _from_planes(row["local"]), np.r_[0, np.cumsum(_unpacked(row["sizes"], np.int64))]


def _beside(words: np.ndarray, local: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: its count, and how often each of BITS bits was set beside it."""
    line, at = laid(local, before)
    half, m = half_bits(words)[line], len(words)
    often = []
    for step in (1, -1):  # the right neighbour's bits are the low ones
        seen = np.bincount((local.astype(np.int64) << _HALF) | half[at + step], minlength=m << _HALF).reshape(m, -1)
        often.append(seen[1:] @ _HALF_CODES.astype(np.int64))
    return seen[1:].sum(axis=1), np.concatenate(often, axis=1)


def _edges(n_buckets: int) -> np.ndarray:
    """Where each bucket but the first begins among 64-bit hashes."""
    return np.arange(1, n_buckets, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // n_buckets)


def n_buckets(n_words: int, most: int = MOST_BUCKET) -> int:
    """How many buckets: of 256 bytes of text for each byte of the corpus' root, 1 MB to the most."""
    size = 6 * n_words
    return max(1, -(-size // int(min(most, max(1 << 20, 256 * size**0.5)))))


_CELL = "bucket int, chunk bigint, keys binary, n binary, often binary"
_FACT = "bucket int, chunk bigint, keys binary, n binary, shares binary"


def _cells(buckets: int, counted: bool):
    """A row for each bucket of a chunk's words: their hashes, ascending, and what the chunk counts of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, local, before = _opened(row)
                keys = words[1:].view(np.uint64)
                order = np.argsort(keys)
                keys = keys[order]
                n, often = (x[order].astype(np.int32) for x in _beside(words, local, before)) if counted else (None, None)
                at = np.r_[0, np.searchsorted(keys, _edges(buckets)), len(keys)]
                some = np.flatnonzero(np.diff(at))
                own = [slice(at[b], at[b + 1]) for b in some]
                blob = lambda x, put: pa.array([None if x is None else put(x[s]) for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), row["chunk"])), blob(keys, shared.packed), blob(n, _packed), blob(often, _packed)], ["bucket", "chunk", "keys", "n", "often"])

    return run


_FACT_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("shares", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FACT_SCHEMA)], schema=_FACT_SCHEMA)


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The words of a bucket (chunk null) with their counts and shares, and these facts for each chunk that has them."""
    cells = table.to_pylist()
    keys = [shared.unpacked(c["keys"]) for c in cells]
    ends = np.cumsum([len(k) for k in keys])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.add.reduceat(np.concatenate([_unpacked(c["n"], np.int32) for c in cells])[order], first, dtype=np.int64)
    often = np.add.reduceat(np.concatenate([_unpacked(c["often"], np.int32).reshape(-1, BITS) for c in cells])[order], first, axis=0, dtype=np.int64)
    share = shares(n, often)
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(every)]))
    bucket, own = key[0].as_py(), [number[e - len(k) : e] for k, e in zip(keys, ends)]
    return _rows([(bucket, None, shared.packed(ordered[first]), _packed(n), _packed(share)), *[(bucket, c["chunk"], None, _packed(n[at]), _packed(share[at])) for c, at in zip(cells, own)]])


def _asked(key: tuple[pa.Scalar, ...], cells: pa.Table, table: pa.Table) -> pa.Table:
    """What a bucket says of each chunk's words; of a word that it doesn't have, a count of 0."""
    out = []
    keys, n, share = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for row in table.to_pylist():
        keys, n, share = shared.unpacked(row["keys"]), _unpacked(row["n"], np.int64), _unpacked(row["shares"], np.int64)
    for c in cells.to_pylist():
        own = shared.unpacked(c["keys"])
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        there = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        found = [np.where(there, x[at], 0) if len(keys) else np.zeros(len(own), np.int64) for x in (n, share)]
        out.append((key[0].as_py(), c["chunk"], None, *map(_packed, found)))
    return _rows(out)


def _with_facts(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk with counts and shares of its distinct words, in its own order of them."""
    if not chunk.num_rows:
        return chunk.append_column("n", pa.array([], pa.binary())).append_column("shares", pa.array([], pa.binary()))
    order = np.argsort(_unpacked(chunk.column("words")[0].as_py(), np.int64).view(np.uint64))
    rows = sorted(answers.select(["bucket", "n", "shares"]).to_pylist(), key=lambda r: r["bucket"])
    for name in ("n", "shares"):
        facts = np.zeros(len(order), np.int64)
        facts[order] = np.concatenate([np.zeros(0, np.int64), *[_unpacked(r[name], np.int64) for r in rows]])
        chunk = chunk.append_column(name, pa.array([_packed(facts)], pa.binary()))
    return chunk


def _chunks(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    ids = F.lit(0) if id_col is None else F.col(id_col)
    return shared.settled(docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut, CHUNKS))


def _known(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks, each with what the corpus says about its distinct words."""
    return shared.settled(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_with_facts, f"{CHUNKS}, n binary, shares binary"))


def _facts(row: dict, words: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, class and packed shares of the empty token and of each distinct word."""
    n, share = (np.r_[0, _unpacked(row[k], np.int64)] for k in ("n", "shares"))
    return n, bands.of(words, n), share


def _learned(flat: np.ndarray, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = Weights.of(flat), 0
        for batch in batches:
            for row in batch.to_pylist():
                words, local, before = _opened(row)
                table, number = vectors()[words], _facts(row, words, bands)[1]
                line, at = laid(local, before)
                # Words in a seeded order, so that a step doesn't see one text only.
                at = np.random.default_rng(SEED + len(at)).permutation(at)
                for a in range(0, len(at), 32 * BATCH):
                    own = at[a : a + 32 * BATCH]
                    w = trained(w, table, around(line, own), number[line[own]])
                total += len(at)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w.flat))), pa.array(w.flat.astype(np.float64) * total), pa.array(np.full(len(w.flat), total))], ["k", "v", "n"])

    return run


def _scored(model: tuple):
    flat, log_sums, bands = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights.of(flat)
        for batch in batches:
            for row in batch.to_pylist():
                words, local, before = _opened(row)
                table, (n, c, share) = vectors()[words], _facts(row, words, bands)
                within, half = Within(n, c, share, log_sums), half_bits(words)
                line, at = laid(local, before)
                score = np.zeros(len(at))
                for a in range(0, len(at), 4 * BATCH):
                    own = at[a : a + 4 * BATCH]
                    context, word = around(line, own), line[own]
                    bits = half[context[:, SIDE - 1]].astype(np.int64) << _HALF | half[context[:, SIDE]]
                    score[a : a + len(own)] = class_log_probabilities(w, table, context, c[word]) + within.log_p(word, bits)
                total = np.r_[0, np.cumsum(score)]
                n = np.diff(before)
                (ids,) = pa.ipc.open_stream(row["ids"])
                yield pa.RecordBatch.from_arrays([ids.column("id"), pa.array(n), pa.array(np.where(n > 0, total[before[1:]] - total[before[:-1]], 0.0))], ["id", "n_words", "log_probability"])

    return run


def _opened_table(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and packed shares of a bucket."""
    return shared.unpacked(row["keys"]).view(np.int64), _unpacked(row["n"], np.int64), _unpacked(row["shares"], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a bucket have each count."""
    for batch in batches:
        for row in batch.to_pylist():
            n, many = np.unique(_unpacked(row["n"], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(many)], ["n", "many"])


def _listed(least: float, bands: Bands | None):
    """A row for each word that was seen so often at least: its count, class and packed shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n, share = _opened_table(row)
                for a in range(0, len(words), 1 << 16):
                    keep = a + np.flatnonzero(n[a : a + (1 << 16)] >= least)
                    c = bands.of(words[keep], n[keep]) if bands else np.zeros(len(keep), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words[keep], n[keep], c, share[keep])], ["w", "n", "c", "packed"])

    return run


def _sums(bands: Bands):
    """For each class and bits of both neighbours: the sum over the class's words of mass times exp(weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((CLASSES, 1 << BITS))
        for batch in batches:
            for row in batch.to_pylist():
                words, n, share = _opened_table(row)
                # Most words are rare, and rare ones of the same count and shares are many: they are summed at once.
                _, at, many = np.unique(shared.mixed(share.view(np.uint64) ^ shared.mixed(n.astype(np.uint64))), return_index=True, return_counts=True)
                c, n, share = bands.of(words[at], n[at]), n[at], share[at]
                for a in range(0, len(at), 4096):
                    own = slice(a, a + 4096)
                    p = _rates(share[own])
                    odds = np.exp(np.log(p / (1 - p)) @ _CODES.T + np.log(1 - p).sum(axis=1, keepdims=True)) * ((n[own] + 1) * many[own])[:, None]
                    order = np.argsort(c[own], kind="stable")
                    number, first = np.unique(c[own][order], return_index=True)
                    z[number] += np.add.reduceat(odds[order].astype(np.float64), first)
        seen = np.flatnonzero(z)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(z.ravel()[seen])], ["k", "v"])

    return run


@dataclass(frozen=True)
class Facts:
    """What the table of words says about the tokens asked for, and only these are fetched."""

    words: DataFrame
    of: Column
    other: float  #: of a token without a row

    def __getitem__(self, tokens: np.ndarray) -> np.ndarray:
        asked = [int(t) for t in np.unique(tokens)]
        found = dict(self.words.where(F.col("w").isin(asked)).select("w", self.of).collect()) if asked else {}
        return np.array([found.get(int(t), self.other) for t in tokens])


@dataclass(frozen=True)
class Model:
    weights: Weights
    table: DataFrame  #: a row for each bucket: words, counts and shares of the bits beside them
    buckets: int
    bands: Bands
    masses: np.ndarray  #: of each class, every word counting once more than it was seen
    log_sums: np.ndarray  #: of the second softmax, by class and bits

    @property
    def words(self) -> DataFrame:
        """w, n, c and packed of each word: count, class and shares of the bits beside it."""
        return self.table.mapInArrow(_listed(0, self.bands), "w bigint, n bigint, c bigint, packed bigint")

    @property
    def number(self) -> Facts:
        """Class of each token."""
        return Facts(self.words, F.col("c"), CLASSES - 1)

    @property
    def within(self) -> Facts:
        """log p(token | class) without its neighbours."""
        mass = F.element_at(F.array(*[F.lit(float(m)) for m in self.masses]), F.col("c").cast("int") + 1)
        return Facts(self.words, F.log((F.col("n") + 1) / mass), 0.0)


def _banded(table: DataFrame) -> tuple[Bands, np.ndarray]:
    """The classes of the table's words, and the mass of each."""
    rest = {r["n"]: r["many"] for r in table.mapInArrow(_counted, "n bigint, many bigint").groupBy("n").agg(F.sum("many").alias("many")).collect()}
    total = sum((n + 1) * many for n, many in rest.items())
    # Words as heavy as a class, fewer than CLASSES of them, stand alone; the rest go by count.
    heavy = table.mapInArrow(_listed(total / (CLASSES - 1) - 1, None), "w bigint, n bigint, c bigint, packed bigint").select("w", "n").collect()
    heavy.sort(key=lambda r: (-r["n"], r["w"]))
    for r in heavy:
        rest[r["n"]] -= 1
    rest = sorted(((n, many) for n, many in rest.items() if many), reverse=True)
    counts = np.array([0, *(r["n"] for r in heavy), *(n for n, _ in rest)])
    many = np.array([0, *(1 for _ in heavy), *(m for _, m in rest)])
    number, _ = classes_of(counts, many)
    masses = np.bincount(number[1:], weights=((counts + 1.0) * many)[1:], minlength=CLASSES)
    low = {int(c): int(n) for n, c in zip(counts[1 + len(heavy) :], number[1 + len(heavy) :])}  # the least count of each class
    least, band = np.array(sorted((n, c) for c, n in low.items()) or [(0, CLASSES - 2)]).T
    alone = np.array(sorted((r["w"], c) for r, c in zip(heavy, number[1:].tolist())) or np.zeros((0, 2)), np.int64).T
    return Bands(least, band, *alone), masses


def _fitted(chunks: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    buckets = n_buckets(chunks.agg(F.sum("n_words")).first()[0] or 0)
    merged = shared.settled(chunks.mapInArrow(_cells(buckets, True), _CELL).groupBy("bucket").applyInArrow(_merged, _FACT))
    table, answers = merged.where("chunk IS NULL"), merged.where("chunk IS NOT NULL")
    bands, masses = _banded(table)
    sums = np.zeros(CLASSES << BITS)
    for k, v in table.mapInArrow(_sums(bands), "k bigint, v double").groupBy("k").agg(F.sum("v")).collect():
        sums[k] = v
    with np.errstate(divide="ignore"):
        log_sums = np.log(sums).reshape(CLASSES, -1)
    known = _known(chunks, answers)
    flat = Weights.fresh().flat
    for _ in range(rounds):
        for k, v in known.mapInArrow(_learned(flat, bands), "k bigint, v double, n bigint").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).collect():
            flat[k] = v
    return Model(Weights.of(flat), table, buckets, bands, masses, log_sums), known


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """A model of all texts of docs."""
    return _fitted(_chunks(docs, None, text_col), rounds)[0]


def _scores(known: DataFrame, model: Model, docs: DataFrame, id_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    done = known.mapInArrow(_scored((model.weights.flat, model.log_sums, model.bands)), f"id {kind}, n_words bigint, log_probability double")
    return done.select(F.col("id").alias(id_col), "n_words", "log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")).alias("mean_log_probability"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_probability, mean_log_probability) per row."""
    chunks = _chunks(docs, id_col, text_col)
    cells = chunks.mapInArrow(_cells(model.buckets, False), _CELL)
    answers = cells.groupBy("bucket").cogroup(model.table.groupBy("bucket")).applyInArrow(_asked, _FACT)
    return _scores(_known(chunks, answers), model, docs, id_col)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What score gives for docs under a model of docs itself, with the texts read once."""
    model, known = _fitted(_chunks(docs, id_col, text_col))
    return _scores(known, model, docs, id_col)
