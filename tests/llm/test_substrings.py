import random
import re

import pytest

from glimmer.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passages = [" ".join(r.choices(vocab, k=r.randint(5, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choices(vocab, k=r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        out.append((r.randint(0, n) if r.random() < 0.1 else i, r.choice([" ", "\n", "  \t"]).join(parts)))
    return out


@pytest.mark.parametrize("seed, window, chunk", [(1, 13, 1 << 23), (2, 13, 900), (3, 5, 300)])
def test_equals_brute_force(spark, seed, window, chunk):
    docs = [*corpus(seed), (None, "w1 " * 40), (None, None), (7, ""), (9000, "w1 " * 40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.drop_repeats(rows, window=window, chunk_bytes=chunk, bucket_bytes=chunk * 2 // 3).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(brute(docs, window), key=key)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["repeats"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["repeats"], r["repeats"][1:]))


def test_windows_whose_first_hash_collides_are_told_apart(spark, monkeypatch):
    """With a first hash of a few bits everything collides there; the result stays that of the words themselves."""
    import numpy as np

    within, check = np.array([3, 3, 3, 9, 9], np.uint64), np.array([5, 7, 8, 1, 2], np.uint32)
    at, there = substrings._checked(within, check, np.array([0, 0, 0, 0, 3, 3]), np.array([5, 7, 8, 6, 2, 0], np.uint32))
    assert there.tolist() == [True, True, True, False, True, False] and at[there].tolist() == [0, 1, 2, 4]
    import pyarrow as pa

    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abab"]
    table = pa.table({"__id": [1, 2, 3, 4], "__text": texts})
    real = substrings.shared.window_hashes
    monkeypatch.setattr(substrings.shared, "window_hashes", lambda h, size, seed: real(h, size, seed) >> np.uint64(62) << np.uint64(62) if seed == 2 else real(h, size, seed))
    one = pa.scalar(0, pa.int32())
    hits = substrings._hits((one,), substrings._probes(7, 1)((one,), table))
    answers = substrings._smallest((one,), substrings._candidates(13, 7, 1)((one,), table, hits))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
    assert substrings._cut(13, "words", (), schema)((one,), table, answers).column("n_removed").to_pylist() == [0, 0, 30, 30]


def test_rows_without_an_id_or_with_one_id_are_spread(spark):
    rows = [(None, f"n{k} " * 50) for k in range(64)] + [(7, f"s{k} " * 50) for k in range(64)]
    got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=2000).collect()
    assert len(got) == 128 and all(r["n_removed"] == 0 for r in got)


def test_layout_keeps_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = spark.createDataFrame([(1, passage), (2, f"start\n\n{passage}\tend  here\n")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substrings.drop_repeats(rows, layout="text").collect()}
    assert got == {1: passage, 2: "start\n\nend  here\n"}


def test_awkward_rows(documents, awkward):
    got = {r["doc_id"]: r for r in substrings.drop_repeats(documents(awkward), keep=("lang", "source")).collect()}
    assert len(got) == len(awkward) and got[6]["n_removed"] == got[5]["n_words"] == 80 and got[6]["kept_text"] == ""
    assert substrings.drop_repeats(documents([])).count() == 0
