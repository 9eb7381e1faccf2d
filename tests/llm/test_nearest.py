import numpy as np

from behavior_spark.llm import nearest as N

QUERY = "id % 50 = 0"


def rows_of(frame):
    return [tuple(r) for r in frame.orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = N.search(table, QUERY).toPandas(), N.brute_force(table, QUERY)
    pairs = set(zip(want.query_id, want.vec_id))
    assert len(pairs & set(zip(got.query_id, got.vec_id))) >= 0.9 * len(pairs)
    held = {r.vec_id: np.array(r.embedding, np.float32) for r in table.collect()}
    for q, v, s in zip(got.query_id, got.vec_id, got.score):
        a, b = held[q].astype(np.float64), held[v].astype(np.float64)
        assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert (got.groupby("query_id")["vec_id"].count() == 5).all()
    assert all(list(g["rank"]) == [1, 2, 3, 4, 5] and g["score"].is_monotonic_decreasing for _, g in got.sort_values(["query_id", "rank"]).groupby("query_id"))


def test_blocks_do_not_change_the_result(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    small = N.CrossPolytope(block=7, query_block=2, bucket_rows=50)
    assert rows_of(N.search(table, QUERY, conf=small)) == rows_of(N.search(table, QUERY, conf=N.CrossPolytope(bucket_rows=50)))


def test_equal_vectors_bad_vectors_and_repeats(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400, 10)] + [(1, [1.0, 2.0, 2.9]), (2, [3.0, -1.0, 0.5])]
    rows += [(3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    table = vectors(spark, [(*r, "x", 1) for r in rows], ", id string, score int")
    got = rows_of(N.search(table, QUERY))
    for q in range(0, 400, 50):
        mine = [v for query, _, v, _ in got if query == q]
        assert mine == [i for i in range(0, 70, 10) if i != q][:5]
    assert {q for q, *_ in got} == set(range(0, 400, 50))


def test_few_and_no_rows(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [(q, v) for q, _, v, _ in rows_of(N.search(few, QUERY))] in ([(0, 2), (0, 1)], [(0, 2)])
    assert rows_of(N.search(vectors(spark, []), QUERY)) == []
    assert rows_of(N.search(vectors(spark, [(50, [1.0])]), QUERY)) == []


def test_rotations_keep_lengths_and_probes_start_at_the_own_bucket():
    hashes = N.Hash(10, 2, N.CrossPolytope(tables=2))
    x = N._unit(np.random.default_rng(0).normal(size=(50, 10)).astype(np.float32))
    assert np.allclose(np.linalg.norm(hashes.turned(x, 0, 0), axis=1), 1, atol=1e-4)
    probes = hashes.probes(x, 1, 20)
    assert (probes[:, 0] == hashes.buckets(x, 1)).all()
    assert all(len(set(p)) == 20 for p in probes.tolist())


def test_too_few_probes_make_the_search_exact(spark):
    """Directions without any structure: one probe in each of two tables finds next to nothing."""
    rng = np.random.default_rng(6)
    table = vectors(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))])
    conf = N.CrossPolytope(tables=2, bucket_rows=2, most_probes=1, recall=1.0)
    got, want = N.search(table, QUERY, conf=conf).toPandas(), N.brute_force(table, QUERY)
    assert set(zip(got.query_id, got.vec_id)) == set(zip(want.query_id, want.vec_id))
