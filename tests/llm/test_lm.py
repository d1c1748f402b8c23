import math
import re
from collections import Counter, defaultdict

import numpy as np

from glimmer.llm import lm, shared

WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hash_of(word):
    data = word.encode()
    return int(lm.text_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0])


class Plain:
    """The registered configuration by plain loops over strings; only the network's weights are given."""

    def __init__(self, texts, weights):
        self.w, self.hashes, texts = weights, {}, [words_of(t) for t in texts]
        self.count = Counter(w for t in texts for w in t)
        self.hashes = {w: hash_of(w) for w in self.count}
        self.half = {w: int(lm.half_bits(np.array([h]))[0]) for w, h in self.hashes.items()} | {None: int(lm.half_bits(np.array([0]))[0])}
        beside = defaultdict(lambda: [0] * 8)
        for t in texts:
            for i, w in enumerate(t):
                code = self.code(t, i)
                for j in range(8):
                    beside[w][j] += code >> j & 1
        self.rate = {w: [(min(255, int((b + 2) / (n + 4) * 256)) + 0.5) / 256 for b in beside[w]] for w, n in self.count.items()}
        # Classes: words as heavy as one stand alone, the rest go by count, 63 of equal mass.
        total, so_far, self.number = sum(n + 1 for n in self.count.values()), 0, {}
        heavy = sorted((w for w, n in self.count.items() if (n + 1) * 63 >= total), key=lambda w: (-self.count[w], self.hashes[w]))
        groups = [[w] for w in heavy]
        for n in sorted({self.count[w] for w in self.count if w not in heavy}, reverse=True):
            groups.append([w for w in self.count if self.count[w] == n and w not in heavy])
        for g in groups:
            mass = sum(self.count[w] + 1 for w in g)
            for w in g:
                self.number[w] = min(62, int((so_far + mass / 2) / total * 63))
            so_far += mass
        self.members = defaultdict(list)
        for w, c in self.number.items():
            self.members[c].append(w)
        self.sums = {}

    def code(self, t, i):
        return self.half[t[i - 1] if i else None] << 4 | self.half[t[i + 1] if i + 1 < len(t) else None]

    def weight(self, w, code):
        return (self.count[w] + 1) * math.prod(p if code >> j & 1 else 1 - p for j, p in enumerate(self.rate[w]))

    def log_p(self, t, i):
        c, code = self.number[t[i]], self.code(t, i)
        if (c, code) not in self.sums:
            self.sums[c, code] = sum(self.weight(w, code) for w in self.members[c])
        x = [v for k in (-2, -1, 1, 2) for v in lm.vectors()[np.array([self.hashes[t[i + k]] if 0 <= i + k < len(t) else 0])][0].tolist()]
        hidden = [math.tanh(sum(a * b for a, b in zip([*x, 1], col))) for col in self.w.inner.T.tolist()]
        logits = [sum(a * b for a, b in zip([*hidden, 1], col)) for col in self.w.outer.T.tolist()]
        return logits[c] - math.log(sum(map(math.exp, logits))) + math.log(self.weight(t[i], code) / self.sums[c, code])


def test_registered_configuration_equals_plain_loops(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs)
    plain, got = Plain([r["text"] for r in rows], model.weights), {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    assert {r["w"]: (r["n"], r["c"]) for r in model.words.collect()} == {plain.hashes[w]: (n, plain.number[w]) for w, n in plain.count.items()}
    for r in rows[:25]:
        t = words_of(r["text"])
        assert got[r["doc_id"]]["n_words"] == len(t)
        assert abs(got[r["doc_id"]]["log_probability"] - sum(plain.log_p(t, i) for i in range(len(t)))) < 1e-3 * max(1, len(t))


def test_step_follows_the_gradient():
    r = np.random.default_rng(4)
    table, context, classes = lm.vectors(), r.integers(1, 30, (lm.BATCH, 2 * lm.SIDE)), r.integers(0, lm.CLASSES, lm.BATCH)
    w = lm.Weights.fresh()
    w = lm.Weights(w.inner, r.normal(0, 0.1, w.outer.shape).astype(np.float32))
    loss = lambda flat: -lm.class_log_probabilities(lm.Weights.of(flat), table[np.arange(31)], context, classes).mean()
    step = w.flat - lm.trained(w, table[np.arange(31)], context, classes, rate=1.0).flat
    for k in r.integers(0, len(step), 40):
        up, down = w.flat.astype(np.float64), w.flat.astype(np.float64)
        up[k], down[k] = up[k] + 1e-2, down[k] - 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - step[k]) < 1e-4


def test_held_out_text_beats_unigram_probabilities(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    learned, held = [r for r in rows if r["doc_id"] % 10], [r for r in rows if r["doc_id"] % 10 == 0]
    model = lm.fit(spark.createDataFrame(learned, "doc_id long, text string"))
    count = Counter(w for r in learned for w in words_of(r["text"]))
    total = sum(count.values()) + len(count)
    got = {r["doc_id"]: r["log_probability"] for r in lm.score(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    mine, unigram, n = 0.0, 0.0, 0
    for r in held:
        t = words_of(r["text"])
        if t and all(w in count for w in t):  # no word out of the vocabulary: both give proper probabilities
            mine, unigram, n = mine + got[r["doc_id"]], unigram + sum(math.log((count[w] + 1) / total) for w in t), n + len(t)
    assert n > 1000 and mine / n > unigram / n + 0.05


def test_many_buckets_and_chunks_give_the_same_table(documents, monkeypatch):
    texts = [f"all w{k % 7} of x{k} w{k % 3} all" for k in range(200)]
    one = {tuple(r) for r in lm.fit(documents(texts)).words.collect()}
    monkeypatch.setattr(lm, "n_buckets", lambda n: 7)
    many = lm.fit(documents(texts).repartition(9))
    assert {tuple(r) for r in many.words.collect()} == one and many.buckets == 7


def test_gradient_step_lowers_the_loss():
    r = np.random.default_rng(0)
    table, context = lm.vectors(), r.integers(1, 9, (4000, 2 * lm.SIDE))
    classes = context[:, 1] % 7  # what stands to the left decides
    w = lm.Weights.fresh()
    before = lm.class_log_probabilities(w, table, context, classes).mean()
    for _ in range(30):
        w = lm.trained(w, table, context, classes)
    after = lm.class_log_probabilities(w, table, context, classes).mean()
    unigram = np.log(np.bincount(classes) / len(classes))[classes].mean()
    assert after > unigram + 0.2 > before


def test_context_excludes_the_word_and_stays_in_its_text():
    tokens, before = np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4])
    assert lm.contexts(tokens, before).tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_scores_add_up_and_beat_shuffled_text(spark, documents, awkward):
    r = np.random.default_rng(1)
    chain = lambda: " ".join(f"w{(k * 3 + s) % 40}" for s in [r.integers(0, 40)] for k in range(60))
    texts = [chain() for _ in range(300)]
    mixed = [" ".join(r.permutation(t.split())) for t in texts[:60]]
    model = lm.fit(documents(texts), rounds=20)
    got = {x["doc_id"]: x for x in lm.score(documents([*texts[:60], *mixed, *awkward]), model).collect()}
    good, bad = (np.mean([got[i]["mean_log_probability"] for i in part]) for part in (range(60), range(60, 120)))
    assert good > bad + 0.3
    assert got[120]["log_probability"] == 0 and got[120]["mean_log_probability"] is None
    data, offsets = np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])])
    t, before = lm.text_tokens(data, offsets)
    by_hand = lm.class_log_probabilities(model.weights, lm.vectors(), lm.contexts(t, before), model.number[t]) + model.within[t]
    assert abs(by_hand.sum() - got[0]["log_probability"]) < 1e-3
    assert lm.score(documents([]), lm.fit(documents([]))).count() == 0 and shared.words(data, offsets)[2][-1] == len(t)


def test_token_probabilities_sum_to_one():
    counts = np.random.default_rng(2).zipf(1.3, 1 << 15) % 1000
    number, within = lm.classes_of(counts)
    for c in np.unique(number[1:]):
        assert abs(np.exp(within[1:][number[1:] == c]).sum() - 1) < 1e-9


def test_every_word_has_its_own_count_beyond_any_fixed_table(spark, documents):
    # 40,000 words, each once, beside one of 20,000: none may take over another's count.
    texts = [" ".join(f"junk{k}" for k in range(a, a + 400)) for a in range(0, 40_000, 400)] + ["often " * 20_000]
    model = lm.fit(documents(texts))
    assert model.words.count() == 40_001
    assert sorted(r["n"] for r in model.words.select("n").distinct().collect()) == [1, 20_000]


def test_probability_within_a_class_follows_the_neighbours_and_sums_to_one(documents):
    r = np.random.default_rng(3)
    # Thousands of words of one frequency, each beside its own neighbour: production rounds, far more words than classes.
    pairs = [f"a{k} b{k}" for k in range(3000)]
    texts = [" ".join(pairs[k] for k in r.permutation(3000)[:300]) for _ in range(150)]
    model = lm.fit(documents(texts))
    seen = [t.split() for t in texts[:60]]
    odd = [[w if i % 2 == 0 else f"b{r.integers(3000)}" for i, w in enumerate(t)] for t in seen]  # as frequent, but another's neighbour
    got = {x["doc_id"]: x["mean_log_probability"] for x in lm.score(documents([" ".join(t) for t in seen + odd]), model).collect()}
    assert np.mean([got[i] for i in range(60)]) > np.mean([got[i] for i in range(60, 120)]) + 0.3
    facts = np.array([tuple(x) for x in model.words.select("n", "c", "packed").collect()], np.int64)
    for bits in (0, 77, 255):
        p = np.exp(lm.within_class(facts, np.full(len(facts), bits), model.log_sums))
        assert all(abs(p[facts[:, 1] == c].sum() - 1) < 1e-4 for c in np.unique(facts[:, 1]))


def test_one_reading_scores_as_two(documents, awkward):
    texts = [f"all w{k % 7} of x{k} w{k % 3} all x{k} all" for k in range(300)] + awkward
    docs = documents(texts)
    one, two = ({r["doc_id"]: r["log_probability"] for r in d.collect()} for d in (lm.fit_and_score(docs), lm.score(docs, lm.fit(docs))))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) <= 0.02 * abs(two[k]) for k in one)


def test_null_and_repeated_ids(documents):
    rows = lm.fit_and_score(documents(["a b c", "a b c", None, "b"], [None, 3, 3, None])).collect()
    got = sorted((r["doc_id"] is None, r["n_words"], round(r["log_probability"], 6)) for r in rows)
    assert [x[:2] for x in got] == [(False, 0), (False, 3), (True, 1), (True, 3)] and got[1][2] == got[3][2]
