from dataclasses import replace

from glimmer.llm import mixing


def water(budget, caps, weights):
    """Shares by weight, capped; what can't be used goes to the others."""
    budget, out, open_ = min(budget, sum(caps.values())), {}, set(caps)
    while True:
        used, w = sum(out.values()), sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] * w <= (budget - used) * weights[k]]
        if not full:
            return out | {k: (budget - used) * weights[k] // w for k in open_}
        # One at a time, smallest capacity for its weight first.
        k = min(full, key=lambda k: (caps[k] / weights[k], k))
        out[k] = caps[k]
        open_.discard(k)
        if not open_:
            return out


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10_000), ("web", "de", "c", 50), ("code", "en", "d", 500)]
    mix = mixing.Mix({"web": 3, "code": 1, "web/en": 1, "web/de": 1}, 500, 1)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()}
    total = sum(x[3] for x in leaves) * 500 // 1000
    top = water(total, {"web": 10_150, "code": 500}, {"web": 3, "code": 1})
    lang = water(top["web"], {"en": 10_100, "de": 50}, {"en": 1, "de": 1})
    want = {**water(lang["en"], {"a": 100, "b": 10_000}, {"a": 1, "b": 1}), "c": lang["de"], "d": top["code"]}
    assert got == want and got["a"] == 100 and got["c"] == 50


def test_prefix_epochs_and_awkward_rows(documents, awkward):
    texts = [*awkward, *[f"w{i} " * (i % 30 + 1) for i in range(400)]]
    for budget, epochs in ((600, 2), (1700, 2), (0, 1), (2000, 2)):
        mix = replace(mixing.PRODUCTION, budget_permille=budget, epochs=epochs)
        rows = mixing.mix_sources(documents(texts), mix, keep=("text",)).collect()
        n = sum(len((t or "").split()) for t in texts)
        taken = sum(r["n_tokens"] for r in rows)
        assert taken <= n * budget / 1000 and max([r["epoch"] for r in rows], default=0) < epochs
        assert all(r["text"] == texts[r["doc_id"]] for r in rows)
        if budget == 2000:
            assert taken == 2 * n
    a, b = ({(r["doc_id"], r["epoch"]) for r in mixing.mix_sources(documents(texts), replace(mixing.PRODUCTION, seed=s)).collect()} for s in (1, 2))
    assert a != b and a == {(r["doc_id"], r["epoch"]) for r in mixing.mix_sources(documents(texts), replace(mixing.PRODUCTION, seed=1)).collect()}


def test_shared_ids_go_together_and_empty(documents):
    rows = mixing.mix_sources(documents(["a b c"] * 60, [i // 2 for i in range(60)]), replace(mixing.PRODUCTION, budget_permille=500, epochs=1)).collect()
    ids = [r["doc_id"] for r in rows]
    assert 0 < len(ids) <= 60
    assert mixing.mix_sources(documents([])).count() == 0


def test_null_and_repeated_ids(documents):
    rows = mixing.mix_sources(documents(["a b c d"] * 6, [None, None, 3, 3, 4, 5]), mixing.Mix(budget_permille=1000, epochs=1)).collect()
    assert sum(r["doc_id"] is None for r in rows) == sum(r["doc_id"] == 3 for r in rows) == 2 and len(rows) == 6
