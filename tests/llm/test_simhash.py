import re

import numpy as np
import pytest
import xxhash

from glimmer.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return x ^ (x >> 31)


def brute_print(text, size=4, view=0):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    hashes = [mix(h ^ mix(view)) for h in hashes] if view else hashes
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {f: f for f in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    p = np.array(sorted(label), np.uint64)
    for i, f in enumerate(p):
        for g in p[i + 1 :][np.bitwise_count(p[i + 1 :] ^ f) <= 4]:
            a, b = sorted((root(int(f)), root(int(g))))
            label[b] = a
    return {f: root(f) for f in prints}


def brute_groups(rows, views=tuple((5, k) for k in range(9))):
    """The smallest id of each group linked by any view: rows are (id, text)."""
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for view in views:
        prints = {i: brute_print(t, *view) for i, t in rows}
        roots, first = brute_components(set(prints.values())), {}
        for i, f in prints.items():
            a, b = sorted((root(first.setdefault(roots[f], i)), root(i)))
            label[b] = a
    return {i: root(i) for i, _ in rows}


def check(rows, got):
    prints = {i: brute_print(t) for i, t in rows}
    roots = brute_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    for r in got:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == least.get(roots[prints[r["doc_id"]]])


def test_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = simhash.near_duplicates(d).collect()
    check(rows, got)
    assert len(got) == len(rows) and sum(r["component_id"] != r["doc_id"] for r in got) > 20


def test_awkward_rows(documents, awkward):
    texts = [*awkward, None, "Ünïcode WORDS"]
    got = simhash.near_duplicates(documents(texts)).collect()
    check(list(enumerate(texts)), got)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {0}
    assert simhash.near_duplicates(documents([])).count() == 0
    left = simhash.drop_near_copies(documents([*texts, texts[3]], [*range(len(texts)), 3]))
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and {3, 5} <= set(ids) and 6 not in ids and left.columns == documents([]).columns


@pytest.mark.parametrize("crowd", [2048, 4])
def test_links_have_all_components(crowd):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = lambda k: np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 30)).astype(np.uint64), axis=0)
    prints = np.unique(np.concatenate([base, *[base ^ flips(k) for k in (1, 2, 3, 4, 4, 5, 6, 3)]]))
    points, owner = simhash.grid_points(prints)
    order = np.argsort(points, kind="stable")
    node, root = simhash.forest(*simhash.links(points[order], prints[owner][order], 4, crowd))
    want = {f: c for f, c in brute_components([int(x) for x in prints]).items() if f != c}
    assert dict(zip(node.tolist(), root.tolist())) == want


def test_crowded_points_lose_no_link():
    """Thousands of fingerprints that share one half and differ anyhow in the other, among them near ones."""
    r = np.random.default_rng(7)
    other = r.integers(0, 1 << 32, 1500, dtype=np.uint64) << np.uint64(32)
    flip = lambda k: np.bitwise_or.reduce(np.uint64(1) << r.integers(32, 64, (k, 1500)).astype(np.uint64), axis=0)
    prints = np.unique(np.concatenate([other, other ^ flip(2), other ^ flip(3), other ^ flip(5)])) | np.uint64(0xFFFF)
    a, b = simhash._crowded(prints, 0, 4, 50)
    node, root = simhash.forest(np.concatenate(a), np.concatenate(b))
    want = {f: c for f, c in brute_components([int(x) for x in prints]).items() if f != c}
    assert dict(zip(node.tolist(), root.tolist())) == want and len(want) > 1500


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(2)
    a, b = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)]).astype(int)
    want = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (simhash._manhattan(simhash._embedded(a), simhash._embedded(b)) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


def test_rows_without_or_with_the_same_id_are_kept_apart(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, c), (None, c), (5, d), (5, a + " more"), (9, b), (7, d), (5, d)]
    for parts in (1, 5):
        left = simhash.drop_near_copies(spark.createDataFrame([(i, t, k % 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(parts))
        got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
        # a stays with its near text of id 5 if they are linked; c once; b under its id; d once.
        assert (None, c) in got and (9, b) in got and (None, b) not in got and got.count((None, c)) == got.count((5, d)) == 1 and (7, d) not in got
        assert ((None, a) in got) != (brute_groups([(0, a), (1, a + " more")])[1] == 0) and (5, a + " more") in got
        assert left.columns == ["doc_id", "text", "n"]
    assert simhash.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_over_many_partitions_makes_rows_in_proportion(spark):
    """Copies of one text with a word changed each, over many partitions: one group, and no table grows beyond views and nodes."""
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in r.integers(0, 5000, 400)]
    texts = []
    for k in range(300):
        t = list(words)
        t[int(r.integers(0, 400))] = f"x{k}"
        texts.append((k, " ".join(t)))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(40), shingles=simhash.STAGE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {x["doc_id"]: x["component_id"] for x in got} == brute_groups(texts)


def test_several_views_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    rows += [(10_000 + k, " ".join(w for i, w in enumerate(t.split()) if (i + k) % 37)) for k, (_, t) in enumerate(rows[:80])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingles=simhash.STAGE).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_groups(rows)
