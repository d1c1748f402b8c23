import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glimmer.llm import tokens

HARD = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>é", "日 <|endoftext|>", "<|endoftext|", "", " ", "  a", "a  b ", "it's  you'll\n\n b \n c", "a\t b", "<|endoftext|> z", "é è́ 👍🏽 x", "a\x1c b", "\x85 a\x0b b", "ª²¼ x9 y", "日本語 テキスト ok", "a" * 5000, " " * 3000 + "b", "ab\n" * 50]


def fresh():
    """The file as anyone would open it, without a setting of ours."""
    return Tokenizer.from_file(tokens.tokenizer_path())


def test_ids_and_offsets_are_the_tokenizers_own():
    e, own = tokens.encoder_for(*tokens.files(None, None)), fresh()
    got = e.encode(HARD)
    for i, text in enumerate(HARD):
        want = own.encode(text, add_special_tokens=False)
        ids = got.ids[got.edges[i] : got.edges[i + 1]]
        assert ids.tolist() == want.ids
        first, past = e.spans(text, ids)
        assert list(zip(first.tolist(), past.tolist())) == want.offsets


LATIN = st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=80)
PIECES = st.lists(st.one_of(LATIN, st.sampled_from(["<|endoftext|>", "'ll", "'S", "  ", "\n \n", "\t", "\u00a0", "\u0085", "١2", "日本", "👍🏽", "ﬁ", "e\u0301", "0x1F", "é"])), max_size=12)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_ids_of_any_text_are_those_of_a_fresh_tokenizer(pieces):
    text = "".join(pieces)
    got = tokens.encoder_for(*tokens.files(None, None)).encode([text]).ids.tolist()
    assert got == fresh_one().encode(text, add_special_tokens=False).ids


def fresh_one(kept=[]):  # noqa: B006  opened once
    if not kept:
        kept.append(fresh())
    return kept[0]


def test_both_libraries_agree_on_the_corpus(spark):
    e = tokens.encoder_for(*tokens.files(None, None))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = e.encode(texts)
    assert np.array_equal(got.ids, np.concatenate([np.array(x.ids, np.uint32) for x in fresh().encode_batch(texts, add_special_tokens=False)]))


@pytest.mark.parametrize("rule, want", [("start", [0, 0, 1]), ("end", [0, 1, 1]), ("longest", [0, 1, 1])])
def test_rules_for_crossing_tokens(rule, want):
    assert tokens.attributed(np.array([0, 5]), np.array([0, 4, 7]), np.array([4, 7, 9]), rule).tolist() == want


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_add_up(documents, awkward, rule):
    texts = HARD + awkward
    rows = tokens.section_tokens(documents(texts), rule=rule).collect()
    e = fresh()
    for i, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == len(e.encode(text or "", add_special_tokens=False).ids)
        assert sum(r["n_chars"] for r in own) == len(text or "") and own[0]["start_char"] == 0
        if rule == "start" and text:
            spans = e.encode(text, add_special_tokens=False).offsets
            for r in own:
                assert r["n_tokens"] == sum(r["start_char"] <= a < r["start_char"] + r["n_chars"] for a, _ in spans)
    assert tokens.section_tokens(documents([])).count() == 0


def test_null_ids_are_kept(documents):
    rows = tokens.section_tokens(documents(["a b\nc", None, "a b\nc"], [None, None, 3])).collect()
    assert sorted((r["doc_id"] is None, r["section"], r["n_tokens"]) for r in rows) == [(False, 0, 3), (False, 1, 1), (True, 0, 0), (True, 0, 3), (True, 1, 1)]
