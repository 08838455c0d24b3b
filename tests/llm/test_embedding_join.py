import math

import numpy as np
from llm.conftest import Links

from tramline.llm import embedding_join

SCHEMA = "vec_id long, embedding array<double>, id string, home int"


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    links, count = Links(i for i, _ in rows), {i: 0 for i, _ in rows}
    for i, x in good:
        for j, y in good:
            if i < j and len(x) == len(y) and x @ y >= threshold:
                links.join(i, j)
                count[i] += 1
                count[j] += 1
    return {i: (count[i], links.root(i)) for i, _ in rows}


def found(df, **options):
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(df, **options).collect()}


def test_links_are_those_of_brute_force(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert found(vectors) == want
    assert found(vectors, block=7, per_pivot=11) == want


def test_dense_groups_over_small_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(3, 8))
    rows = [(i, (centres[i % 3] + rng.normal(scale=0.13, size=8)).tolist(), None, 0) for i in range(150)]
    assert found(spark.createDataFrame(rows, SCHEMA), block=9, per_pivot=10) == brute([r[:2] for r in rows])


def test_many_equal_vectors_count_without_being_compared(spark):
    rng = np.random.default_rng(3)
    same, other = rng.normal(size=6), rng.normal(size=6)
    near = [same + rng.normal(scale=0.05, size=6) for _ in range(20)]
    rows = [(i, same.tolist(), None, 0) for i in range(10_000)] + [(20_000 + i, v.tolist(), None, 0) for i, v in enumerate(near)] + [(30_000, other.tolist(), None, 0), (30_001, [1.0, 2.0], None, 0), (30_002, [2.0, 4.1], None, 0)]
    few = brute([r[:2] for r in rows if r[0] >= 20_000 or r[0] == 0])
    got = found(spark.createDataFrame(rows, SCHEMA), block=8, per_pivot=6)
    assert got[0] == (few[0][0] + 9_999, 0) and all(got[i] == got[0] for i in range(10_000))
    close = {i: bool(same @ v / np.linalg.norm(same) / np.linalg.norm(v) >= 0.95) for i, v in enumerate(near)}
    assert any(close.values()) and all(got[20_000 + i] == (few[20_000 + i][0] + 9_999 * c, few[20_000 + i][1]) for i, c in close.items())
    assert got[30_000] == few[30_000] and got[30_001] == got[30_002] == (1, 30_001)


def test_edge_cases(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, math.nan], [math.inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1e300, 1e200], [1e-320, 0.0], [-1.0, 0.0], [1.0, 2.0, 3.0]]
    got = found(spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA))
    assert {i: got[i] for i in range(6)} == {i: (0, i) for i in range(6)}
    assert got[6] == got[7] == got[8] == got[9] == (3, 6) and got[10] == (0, 10) and got[11] == (0, 11)
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(1, None, "x", 1), (2, None, "x", 1)], SCHEMA)) == {1: (0, 1), 2: (0, 2)}


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(11)
    rows = []
    for base, dim, n in ((0, 6, 400), (1000, 3, 120), (2000, 1, 7)):
        points = rng.normal(size=(n, dim))
        points[1::2] = points[::2][: n // 2] + rng.normal(scale=0.05, size=(n // 2, dim))
        rows += [(base + i, v.tolist()) for i, v in enumerate(points)]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links, counts = Links(units), dict.fromkeys(units, 0)
    for i, u in units.items():
        for j, v in units.items():
            if i != j and len(u) == len(v) and u @ v >= 0.95:
                counts[i] += 1
                links.join(i, j)
    rows += [(10_000 + i, [0.0] * 8) for i in range(6000)] + [(20_000, [float("nan"), 1.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64, per_pivot=50).collect()}
    assert got == {**{i: (counts[i], links.root(i)) for i in units}, **{i: (0, i) for i, _ in rows if i >= 10_000}}
    assert all(any(counts[i] for i in counts if a <= i < a + 1000) for a in (0, 1000, 2000))
