import random

import numpy as np
import xxhash

from behavior_spark.llm import simhash_dedup as S
from behavior_spark.llm.common import written
from behavior_spark.llm.components import components
from tests.llm.helpers import awkward, frame


def slow_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows: list[tuple], limit: int = 4) -> dict:
    """(id, text) to the smallest id reachable, by comparing all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, fps[i], least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def test_classes_equal_all_pairs(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.classes(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(slow_classes(rows), key=str)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for conf in (S.SimHash(), S.SimHash(shard_rows=60)):
        got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.classes(docs, conf).collect()]
        assert sorted(got) == sorted(slow_classes(rows))


def test_same_hash_as_the_jvm(spark):
    assert spark.sql("select xxhash64('ab cd')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab cd", 42)


def test_tree_search_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    near = []
    for x in base:
        for _ in range(40):
            y = int(x)
            for b in random.Random(int(rng.integers(1 << 30))).sample(range(64), int(rng.integers(0, 7))):
                y ^= 1 << b
            near.append(y)
    values = np.unique(np.array(near, np.uint64))
    conf = S.SimHash()
    want = {(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 4}
    at = {int(v): i for i, v in enumerate(values)}
    found = set()
    for mask in conf.masks():
        top = S.Top(values[::7], mask, 3)
        rows, shard, home = top.route(values, conf.radius)
        assert np.bincount(rows[home], minlength=len(values)).tolist() == [1] * len(values)
        for s in np.unique(shard):
            own = shard == s
            forest = S.Forest(values)
            S.search(forest, rows[own & home], rows[own], mask, conf.radius, conf.limit)
            found |= {(max(at[int(a)], at[int(b)]), min(at[int(a)], at[int(b)])) for a, b in zip(*forest.edges())}
            assert len(forest.a) == 0 or len(np.concatenate(forest.a)) < len(values)
    assert found <= want

    def parts(pairs):
        root = list(range(len(values)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert parts(found) == parts(want)


def test_a_large_family_gives_few_edges(spark):
    """Fingerprints that are all within a few bits of each other fall into the same shards."""
    rng = np.random.default_rng(2)
    bits = np.array([3, 5, 8, 13, 21, 22, 30, 34, 41, 47, 50, 55, 58, 60, 62], np.uint64)
    values = np.unique((rng.integers(0, 2, (40_000, len(bits)), dtype=np.uint64) << bits).sum(axis=1, dtype=np.uint64) ^ np.uint64(0x0123456789ABCDEF))
    assert len(values) > 20_000
    fps = spark.createDataFrame(S.pd.DataFrame({"fp": values.view(np.int64)}), "fp long")
    for conf, most in ((S.SimHash(), 6), (S.SimHash(shard_rows=4000, block_rows=3000), 30)):  # trees x blocks x shards that a query reaches
        edges = written(S.links(fps, conf), "edges")
        assert edges.count() < most * len(values)
        assert components(edges).select("root").distinct().count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)] + [(600, i) for i in range(601, 640)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = frame(spark)
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert {r.doc_id for r in rows} >= {1, 4, 7, 8, None} and 2 not in {r.doc_id for r in rows}
    assert S.deduplicated(frame(spark, [])).count() == 0
