import re
from collections import Counter

from glimmer.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, t in enumerate(tri) if many[t] > 1 for k in range(3)})


def test_measures_equal_brute_force(documents, awkward):
    rows = quality.judge(quality.ledger(documents(awkward))).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality.MEASURES[:5]) for r in rows] == [brute(t) for t in awkward]
    for r, t in zip(rows, awkward):
        n, *_, rep = brute(t)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])


def test_clean_stays_and_junk_goes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.judge(quality.ledger(d, keep=("quality",))).where("n_words >= 50").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_ablations_by_bits(documents, awkward):
    rows = quality.ledger(documents(awkward))
    bits = [r["failed_bits"] for r in rows.collect()]
    by = {(r["policy"], r["version"], r["rule"]): r for r in quality.ablations(rows).collect()}
    p = quality.CURRENT
    for rule in (x for x in quality.RULES if x.name in p.rules):
        r, bit = by[p.name, p.version, rule.name], 1 << rule.bit
        assert r["n_kept"] == sum(not b & p.mask for b in bits)
        assert r["n_failed_alone"] == sum(b & p.mask == bit for b in bits)
        assert r["n_kept_without"] == sum(not b & p.mask & ~bit for b in bits)


def test_empty_table_and_filter(documents, awkward):
    assert quality.ledger(documents([])).count() == 0
    kept = quality.keep_good(policy=quality.CURRENT, docs=documents([*awkward, " ".join(f"word{i}" for i in range(80))]))
    assert [r["doc_id"] for r in kept.collect()] == [len(awkward)] and "n_words" in kept.columns
