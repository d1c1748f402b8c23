import importlib.util
import re
from dataclasses import replace

import numpy as np

import corpus_pipeline
from glimmer.llm import mixing, packing, quality, tokens
from test_quality import brute as measures
from test_simhash import brute_groups
from test_substrings import WORD, brute as cut

COLUMNS = list(corpus_pipeline.COLUMNS)


def kept_by_rules(text):
    n, chars, symbols, dup, rep = measures(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    upper = len(re.findall("[A-Z]", text))
    return not (n == 0 or 100 * rep > 50 * n or 5 * symbols > n or chars < 3 * n or chars > 12 * n or 2 * dup > lines or 2 * upper > chars)


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain loops; mixing by its operator's own tested budgets."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in d.collect()}
    spark.createDataFrame(list(rows.values()), d.schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(len(out))))
        docs = spark.read.parquet(str(tmp_path / str(len(out))))
        out.append(docs)
    assert all(x.columns == COLUMNS for x in out[:4])
    good = {i for i, r in rows.items() if kept_by_rules(r["text"])}
    assert {r["doc_id"] for r in out[0].collect()} == good
    groups = brute_groups([(i, rows[i]["text"]) for i in sorted(good)])
    left = {i for i, g in groups.items() if i == g}
    assert {r["doc_id"] for r in out[1].collect()} == left
    want = {i: t for i, n, gone, t in cut([(i, rows[i]["text"]) for i in left], 13) if gone < n}
    got = {r["doc_id"]: r for r in out[2].collect()}
    assert {i: " ".join(WORD.findall(r["text"])) for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    taken = {r["doc_id"]: r["text"] for r in out[3].collect()}
    n = lambda ids: sum(len(WORD.findall(got[i]["text"])) for i in ids)
    assert set(taken) <= set(got) and all(taken[i] == got[i]["text"] for i in taken) and 0.75 * n(got) <= n(taken) <= 0.9 * n(got)
    e = tokens.encoder_for(*tokens.files(None, None))
    pieces = out[4].collect()
    for i in taken:
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == len(e.tokenizer.encode(taken[i], add_special_tokens=False).ids) + 1
    load = np.bincount([r["sequence_id"] for r in pieces], weights=[r["length"] for r in pieces])
    assert load.max() <= packing.CAPACITY
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_mix_of_the_pipeline_is_stated():
    assert corpus_pipeline.MIX == replace(mixing.PRODUCTION, budget_permille=900, epochs=1) and "too_few_words" not in quality.CORPUS.rules
    assert importlib.util.find_spec("corpus_pipeline")


def awkward_documents(spark):
    good = lambda seed: " ".join(f"word{(k * seed) % 997}" for k in range(80))
    rows = [(1, good(1)), (1, good(1)), (1, good(2)), (None, good(3)), (None, good(3)), (None, good(4)), (5, None), (6, ""), (7, "short"), (None, None), (8, good(1)), (9, good(5) + " " + good(6)), (10, good(7) + " " + good(6)), (11, " ".join(f"long{k}" for k in range(30_000)))]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "src1", k, 1, "x", 2, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp string, kept int, __row int")


def test_stages_on_awkward_rows(spark):
    docs = awkward_documents(spark)
    one = corpus_pipeline.quality_rules(spark, docs, "")
    assert one.columns == COLUMNS and one.where("text IS NULL OR text = ''").count() == 0 and one.count() == 11
    two = corpus_pipeline.near_copies(spark, one, "")
    got = sorted(((r["doc_id"], r["text"][:20]) for r in two.collect()), key=str)
    # One of the copies (1, 1, 8); the other text of id 1 stays; each text without an id stays once.
    assert two.columns == COLUMNS and [i for i, _ in got].count(1) == 2 and [i for i, _ in got].count(None) == 2 and 8 not in [i for i, _ in got] and {9, 10, 11} <= {i for i, _ in got}
    three = corpus_pipeline.repeated_passages(spark, two, "")
    lengths = {r["doc_id"]: r["n_chars"] for r in three.where("doc_id > 8").collect()}
    assert three.columns == COLUMNS and three.count() == two.count() and lengths[10] < lengths[9]
    four = corpus_pipeline.mixed_sources(spark, three, "")
    assert four.columns == COLUMNS and 0 < four.count() <= three.count()
    five = corpus_pipeline.packed_sequences(spark, docs, "")
    assert five.where("piece = 0").count() == docs.count() and five.where("length > 2048").count() == 0


def test_stages_on_empty_tables(spark):
    docs = awkward_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packed_sequences" or out.columns == COLUMNS)
