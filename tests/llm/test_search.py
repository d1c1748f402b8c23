import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import search


def brute(rows, is_query, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    best = {}
    for q, a in ok:
        if is_query(q):
            for i, b in ok:
                if i != q and len(a) == len(b):
                    best.setdefault(q, []).append((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i))
    return sorted((q, n + 1, i, -s) for q, c in best.items() for n, (s, i) in enumerate(sorted(c)[:k]))


@pytest.mark.parametrize("shard, block, scale", [(7, 3, 1.0), (4096, 1024, 1.0), (16, 8, 1e6), (16, 8, 1e12)])
def test_equals_brute_force(spark, shard, block, scale):
    r = np.random.default_rng(4)
    rows = [(i, (np.round(r.normal(0, 1, 8), 1) * scale).tolist()) for i in range(160)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(900, None), (950, [float("nan")] * 8), (1000, [None] + [0.0] * 7), (1050, [float("inf")] * 8), (1100, [1.0, 2.0]), (1150, [0.5, 0.25]), (None, [0.0] * 8), (0, [0.0] * 8)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, search.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block).collect()))
    want = brute(rows, lambda q: q % 50 == 0)
    # Rows that share the id 0 are one query: one list, of the best over both.
    assert [g for g in got if g[0] != 0] == [w for w in want if w[0] != 0]
    assert len([g for g in got if g[0] == 0]) == 5


def test_empty(spark):
    assert search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
