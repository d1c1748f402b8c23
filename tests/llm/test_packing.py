import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glimmer.llm import packing, tokens


def loads(plan, counts):
    lengths = np.repeat(np.arange(len(counts) - 1, 0, -1), counts[:0:-1])
    return np.bincount(plan.sequence(np.arange(len(lengths))), weights=lengths, minlength=plan.n_sequences) if len(lengths) else np.zeros(0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([2, 4, 8]), st.integers(1, 12))
def test_plan_places_every_piece_once(lengths, large, groups):
    counts = np.bincount(lengths, minlength=65)
    load = loads(packing.make_plan(counts, 64, large, groups), counts)
    assert load.sum() == sum(lengths) and load.max(initial=0) <= 64 and (load > 0).all()


@pytest.mark.parametrize("low, high, spare", [(1, 2048, 1.01), (1, 900, 1.001), (700, 2000, 1.15)])
def test_few_sequences(low, high, spare):
    lengths = np.random.default_rng(0).integers(low, high, 20_000)
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.best_plan(counts)
    load = loads(plan, counts)
    assert load.max() <= 2048 and plan.n_sequences <= spare * -(-lengths.sum() // 2048) + 1


def test_pieces_and_offsets(documents, awkward):
    texts = [*awkward, "a <|endoftext|> b", *[f"word{i} " * (i * 7 % 900) for i in range(60)]]
    rows = packing.pack(documents(texts), with_ids=True).collect()
    e = Tokenizer.from_file(tokens.tokenizer_path())
    by, where = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, text in enumerate(texts):
        own = sorted(by[i], key=lambda r: r["piece"])
        ids = [*e.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in own for x in r["ids"]] == ids and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 2048 for r in own[1:]) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    for parts in where.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert packing.pack(documents([])).count() == 0


def test_null_and_repeated_ids(documents):
    rows = packing.pack(documents(["a b c", "a b c", "d " * 3000, None], [None, None, 7, 7])).collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and {r["piece"] for r in rows if r["doc_id"] == 7} == {0, 1}
    where = {}
    for r in rows:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in where.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
