"""Near-duplicate documents by SimHash, with fingerprints searched in vantage-point trees.

Two fingerprints that differ in at most ``limit`` bits differ in at most ``limit // segments`` bits of one of the
``segments`` bit ranges. Each range has a tree: a node splits by Hamming distance (in that range) to a vantage point, at
the median. By the triangle inequality a search with radius r enters a side only if the distance reaches it within r, and
the narrow radius of a range is what makes this bound prune. The top of each tree, grown from a
small sample of fingerprints, names shards. A fingerprint lives in its home shard and is sent as a query to those shards that its
radius overlaps; the rest of the tree is grown inside the shard. Pairs at the leaves are compared on all 64 bits.

Equal fingerprints are one before any search, so a group of copies costs no more than its number. A shard returns a spanning forest of its
links, fewer edges than it has fingerprints, however many pairs there are. A shard with many home points (a large family of
like fingerprints, which no tree can part) is cut into blocks of them, each of which gets all queries: work that grows with the square of such a family is
spread over tasks, and none holds it. Components are linked over distinct fingerprints.

Defined results: null texts and texts without words have fingerprint 0, linked like any other. Rows that repeat id
and text share the result. Null ids come after all others (a component of only null ids has a null id). An empty table gives an
empty one. Other columns are not looked at; ``deduplicated`` returns them unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import free_name, map_rows, texts_of, written
from behavior_spark.llm.components import components

BITS = 64


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4  # words
    limit: int = 4  # differing bits
    segments: int = 3
    shard_rows: int = 50_000  # fingerprints that live in a shard, on average
    sample_per_shard: int = 16  # fingerprints sampled for each shard when the top of the trees is grown
    most_depth: int = 16  # of the tops: 2^16 shards and a million sampled fingerprints at most
    block_rows: int = 200_000  # home points of a shard that one task compares, at most about; ordinary shards are not cut
    seed: int = 42

    @property
    def radius(self) -> int:
        return self.limit // self.segments

    def masks(self) -> list[int]:
        edges = [BITS * i // self.segments for i in range(self.segments + 1)]
        return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, as rows of 8 bytes; a shorter text is one run, a text without words has none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(n, 8)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle, seed)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, conf: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """doc_id, digest (of the text) and fp (the 64 bits as a signed long) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, conf.shingle, conf.seed) for t in texts_of(batch)]
        fp = pa.array(np.array(fps, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), fp], ["doc_id", "digest", "fp"])

    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return map_rows(own, work, "doc_id long, digest long, fp long")


def distances(values: np.ndarray, point: int | np.ndarray, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(point) if np.isscalar(point) else values ^ point) & np.uint64(mask)).astype(np.int16)


class Top:
    """The top of a vantage-point tree as arrays: node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.depth = mask, depth
        self.point = np.zeros((1 << depth) - 1, np.uint64)
        self.median = np.zeros((1 << depth) - 1, np.int16)
        sets = {0: sample}
        for node in range((1 << depth) - 1):
            own = sets.pop(node)
            if len(own):
                self.point[node] = own[0]
                d = distances(own, int(own[0]), mask)
                self.median[node] = int(np.median(d))
            else:
                d = np.zeros(0, np.int16)
            sets[2 * node + 1], sets[2 * node + 2] = own[d <= self.median[node]], own[d > self.median[node]]

    def route(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) for each shard that a value's ball overlaps."""
        rows, nodes, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            d = distances(values[rows], self.point[nodes], self.mask)
            m = self.median[nodes]
            inside, outside = d - radius <= m, d + radius > m
            rows = np.concatenate([rows[inside], rows[outside]])
            home = np.concatenate([(home & (d <= m))[inside], (home & (d > m))[outside]])
            nodes = np.concatenate([2 * nodes[inside] + 1, 2 * nodes[outside] + 2])
        return rows, nodes - ((1 << self.depth) - 1), home


LEAF = 256
BLOCK = 4096


class Forest:
    """Links among distinct values (sorted), of which only those are kept that connect what was apart."""

    def __init__(self, values: np.ndarray):
        self.values, self.root = values, np.arange(len(values))
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def link(self, near: np.ndarray, home: np.ndarray, query: np.ndarray) -> None:
        """Take the links of a matrix (home, query) of places in ``values``: a star per row, less what is one tree already."""
        for row in np.flatnonzero(near.any(axis=1)):
            mine = self.root[home[row]]
            others = query[near[row]]
            others = others[self.root[others] != mine]
            if len(others):
                roots, first = np.unique(self.root[others], return_index=True)
                self.a.append(np.full(len(roots), home[row]))
                self.b.append(others[first])
                self._join(mine, roots)

    def _join(self, mine: int, roots: np.ndarray) -> None:
        # Every value knows its root: few joins, many look-ups.
        if len(roots) == 1:
            self.root[self.root == roots[0]] = mine
        else:
            self.root[np.isin(self.root, roots)] = mine

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return self.values[np.concatenate(self.a)], self.values[np.concatenate(self.b)]


def _stars(forest: Forest, home: np.ndarray, query: np.ndarray, limit: int) -> None:
    """Compare all home values with all queries (places in the forest's values)."""
    for i in range(0, len(home), LEAF):
        h = home[i : i + LEAF]
        for j in range(0, len(query), BLOCK):
            q = query[j : j + BLOCK]
            near = np.bitwise_count(forest.values[h][:, None] ^ forest.values[q][None, :]) <= limit
            near &= h[:, None] != q[None, :]
            forest.link(near, h, q)


def search(forest: Forest, home: np.ndarray, query: np.ndarray, mask: int, radius: int, limit: int) -> None:
    """The rest of a tree: split home points and queries (places) at the median distance to a vantage point, compare at the leaves."""
    whole, values = (1 << BITS) - 1, forest.values
    stack = [(home, query, mask, radius)]
    while stack:
        home, query, mask, radius = stack.pop()
        if not len(home) or not len(query):
            continue
        if len(home) <= LEAF:
            _stars(forest, home, query, limit)
            continue
        point = int(values[home[len(home) // 2]])
        d, e = distances(values[home], point, mask), distances(values[query], point, mask)
        m = int(np.median(d))
        if (d <= m).all():
            m -= 1
        if not (d <= m).any():
            if mask == whole:
                _stars(forest, home, query, limit)
            else:  # all alike in this range: go on with all bits
                stack.append((home, query, whole, limit))
            continue
        stack.append((home[d <= m], query[e - radius <= m], mask, radius))
        stack.append((home[d > m], query[e + radius > m], mask, radius))


def links(fps: DataFrame, conf: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """Edges (a, b) among distinct fingerprints (column fp) that connect exactly what the limit connects."""
    spark = fps.sparkSession
    rows = fps.count()
    depth = min(conf.most_depth, max(0, (max(1, rows // conf.shard_rows) - 1).bit_length()))
    wanted = conf.sample_per_shard << depth
    share = min(1.0, wanted / max(rows, 1))
    sample = fps.where(F.xxhash64("fp", F.lit(conf.seed)) < F.lit(int(-(2**63) + share * (2**64 - 2**12)))).select("fp")
    points = np.sort(np.array([r.fp for r in sample.collect()], np.int64)).view(np.uint64)
    order = np.argsort((points * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 64) - 1))  # vantage points are taken in a mixed order
    tops = [Top(points[order], mask, depth) for mask in conf.masks()]
    shared = spark.sparkContext.broadcast(tops)  # 20 bytes a shard and range
    masks, radius, limit = conf.masks(), conf.radius, conf.limit

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, top in enumerate(shared.value):
                rows, shard, home = top.route(values, radius)
                columns = [pa.array(x) for x in (np.full(len(rows), k, np.int32), shard, values[rows].view(np.int64), home)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "shard", "fp", "home"])

    def within(group: pd.DataFrame) -> pd.DataFrame:
        values, place = np.unique(group["fp"].to_numpy().view(np.uint64), return_inverse=True)
        forest, home = Forest(values), np.unique(place[group["home"].to_numpy()])
        search(forest, home, np.arange(len(values)), masks[int(group["tree"].iloc[0])], radius, limit)
        a, b = forest.edges()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = written(fps.select("fp").mapInArrow(deal, "tree int, shard long, fp long, home boolean"), "shards")
    # A shard that many like fingerprints share is cut into blocks of home points; its queries go to every block.
    homes = dealt.where("home").groupBy("tree", "shard").agg(F.count("*").alias("homes"))
    blocks = homes.select("tree", "shard", F.ceil(F.col("homes") / conf.block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(conf.seed + 1)), F.col("blocks")).cast("int")
    cut = dealt.join(blocks, ["tree", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("tree", "shard", "block", "fp", (F.col("home") & (F.col("block") == own)).alias("home"))
    return cut.groupBy("tree", "shard", "block").applyInPandas(within, "a long, b long")


def classes(docs: DataFrame, conf: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """doc_id, digest, fp, root and component_id (the smallest id of all documents reachable over links) for every row.

    ``root`` is the smallest fingerprint of the component and names it even where no document has an id.
    """
    own = written(fingerprints(docs, conf), "fingerprints")
    least = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least, conf))
    linked = least.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return own.join(named, F.col("fp") == F.col("f")).select("doc_id", "digest", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, conf: SimHash = SimHash()) -> DataFrame:  # noqa: B008
    """One document of each component, with all its columns: the one with the smallest id (null last, then by digest).

    Of rows that repeat id and text the first by their columns stays.
    """
    return first_of_each(docs, classes(docs, conf))


def first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; ``named`` has doc_id, digest and root of each."""
    this = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    kept = named.groupBy("root").agg(F.min(this).alias("k"))
    digest, rank, first = (free_name(docs.columns, x) for x in ("text_digest", "repeat", "first"))
    kept = kept.select(F.col("k").alias(first))
    rows = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))
    stay = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{first}.doc_id")) & (F.col(digest) == F.col(f"{first}.digest")), "left_semi")
    order = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant", "void")]
    repeats = Window.partitionBy("doc_id", digest).orderBy(*order)
    return stay.withColumn(rank, F.row_number().over(repeats)).where(F.col(rank) == 1).select(*docs.columns)
