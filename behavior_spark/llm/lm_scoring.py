"""Documents scored by masked pseudo-likelihood.

A small network predicts each token from the tokens on both sides of it, the token itself being hidden: embeddings of the
window, weighted by position, summed and squashed, then a softmax over classes and one over the tokens of the class. The score
of a document is the sum of the log-probabilities of its tokens.

The vocabulary is the most frequent words of the corpus; the rest shares ``buckets`` hash buckets, in which every different word is
equally likely. Words are counted, and the network is trained, over all documents: the corpus is dealt into ``rounds``; in each round
every partition trains its own copy by numpy on its documents of the round, and the copies are averaged (weighted by tokens) in a tree of
groups of ``fan`` each. Only one averaged copy of fixed size (under a megabyte) reaches the driver and goes out again.

Defined results: words are lower-cased (A-Z) runs between ASCII white space. Null and empty texts have 0 words, score 0
and no mean. Rows are scored one by one, so repeated rows have repeated scores; ids may be null. An empty table gives an empty one. Other
columns are not looked at. Partitioning decides which documents a copy sees, so scores depend on it slightly; with the same files and settings they
are the same again.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import map_rows, texts_of, written


@dataclass(frozen=True)
class Window:
    classes: int = 32
    per_class: int = 32
    buckets: int = 128  # of the classes * per_class tokens, the last so many stand for rare words
    radius: int = 2
    width: int = 16  # of embeddings
    rounds: int = 3
    batch: int = 16384  # tokens in a training step
    rate: float = 0.08
    fan: int = 32
    seed: int = 11

    @property
    def tokens(self) -> int:
        return self.classes * self.per_class


class Net:
    """The parameters as views of one flat vector."""

    def __init__(self, conf: Window, flat: np.ndarray | None = None):
        self.conf = conf
        c, k, d, v, r = conf.classes, conf.per_class, conf.width, conf.tokens, conf.radius
        shapes = {"embed": (v + 1, d), "place": (2 * r, d), "bias": (d,), "cls": (c, d), "cls_bias": (c,), "out": (c, k, d), "out_bias": (c, k)}
        size = sum(math.prod(s) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(conf.seed)
            flat = rng.normal(0, 0.1, size).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in shapes.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def start(self, counts: np.ndarray) -> None:
        """Begin with the frequencies of the tokens."""
        p = (counts + 0.5).reshape(self.conf.classes, self.conf.per_class)
        self.place[:] = 1
        self.bias[:] = 0
        self.cls_bias[:] = np.log(p.sum(1) / p.sum())
        self.out_bias[:] = np.log(p / p.sum(1, keepdims=True))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.bias, (len(around), self.conf.width)).copy()
        for j in range(around.shape[1]):
            total += self.embed[around[:, j]] * self.place[j]
        return np.tanh(total)

    def groups(self, token: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, rows of it)."""
        kind = token // self.conf.per_class
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.conf.classes + 1))
        for c in range(self.conf.classes):
            if edges[c + 1] > edges[c]:
                yield c, order[edges[c] : edges[c + 1]]

    def log_probs(self, token: np.ndarray, around: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        logits = h @ self.cls.T + self.cls_bias
        out = logits[np.arange(len(token)), token // self.conf.per_class] - _logsum(logits)
        for c, rows in self.groups(token):
            inner = h[rows] @ self.out[c].T + self.out_bias[c]
            out[rows] += inner[np.arange(len(rows)), token[rows] % self.conf.per_class] - _logsum(inner)
        return out

    def step(self, token: np.ndarray, around: np.ndarray, seen: Net) -> None:
        """One step down the gradient, each parameter at its own pace (``seen``: sums of squared gradients)."""
        grad = Net(self.conf, np.zeros_like(self.flat))
        n, h = len(token), self.hidden(around)
        logits = h @ self.cls.T + self.cls_bias
        p = np.exp(logits - _logsum(logits)[:, None])
        p[np.arange(n), token // self.conf.per_class] -= 1
        grad.cls[:], grad.cls_bias[:] = p.T @ h, p.sum(0)
        back = p @ self.cls
        for c, rows in self.groups(token):
            x = h[rows]
            inner = x @ self.out[c].T + self.out_bias[c]
            q = np.exp(inner - _logsum(inner)[:, None])
            q[np.arange(len(rows)), token[rows] % self.conf.per_class] -= 1
            grad.out[c], grad.out_bias[c] = q.T @ x, q.sum(0)
            back[rows] += q @ self.out[c]
        back *= 1 - h * h
        grad.bias[:] = back.sum(0)
        for j in range(around.shape[1]):
            used = self.embed[around[:, j]]
            grad.place[j] = (back * used).sum(0)
            given = back * self.place[j]
            order = np.argsort(around[:, j], kind="stable")
            ids = around[order, j]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            grad.embed[ids[first]] += np.add.reduceat(given[order], first, axis=0)
        grad.flat /= n
        seen.flat += grad.flat * grad.flat
        self.flat -= self.conf.rate * grad.flat / (np.sqrt(seen.flat) + 1e-4)


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def windows(rows: list[np.ndarray], conf: Window) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some documents and what is around each; outside a document is padding."""
    pad, r = conf.tokens, conf.radius
    gap = np.full(r, pad, np.int64)
    flat = np.concatenate([gap, *[y for x in rows for y in (x.astype(np.int64), gap)]])
    at = np.flatnonzero(flat != pad)
    near = [i for i in range(-r, r + 1) if i]
    return flat[at], np.stack([flat[at + i] for i in near], axis=1)


def vocabulary(docs: DataFrame, conf: Window) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Ids of the frequent words, the counts of all tokens, and for each bucket the number of its different words."""
    import xxhash

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            bucket = [xxhash.xxh64_intdigest(w) % conf.buckets for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(held.values()), pa.int64()), pa.array(bucket, pa.int32())], ["word", "n", "bucket"])

        for batch in batches:
            for text in texts_of(batch):
                held.update(text.lower().split())
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long, bucket int")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n"), F.first("bucket").alias("bucket")), "words")
    frequent = conf.tokens - conf.buckets
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    ids = {bytes(r.word): i for i, r in enumerate(top)}
    totals, different = np.zeros(conf.tokens), np.ones(conf.buckets)
    totals[: len(top)] = [r.n for r in top]
    edge = (top[-1].n, bytes(top[-1].word)) if top else (0, b"")
    rare = counts.where((F.col("n") < edge[0]) | ((F.col("n") == edge[0]) & (F.col("word") > F.lit(edge[1]))))
    for r in rare.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect():
        totals[frequent + r.bucket], different[r.bucket] = r.n, r.different
    return ids, totals, different


def numbered(docs: DataFrame, ids: dict[bytes, int], conf: Window) -> DataFrame:
    """(doc_id, round, tokens as packed 16-bit numbers), written."""
    import xxhash

    shared, frequent = docs.sparkSession.sparkContext.broadcast(ids), conf.tokens - conf.buckets

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, hashed = shared.value.get, xxhash.xxh64_intdigest
        out = []
        for text in texts_of(batch):
            words = text.lower().split()
            tokens = [known(w, -1) for w in words]
            out.append(np.array([t if t >= 0 else frequent + hashed(w) % conf.buckets for t, w in zip(tokens, words, strict=True)], "<u2").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("round"), pa.array(out, pa.binary())], ["doc_id", "round", "tokens"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = own.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(conf.rounds)).cast("int"))
    return written(map_rows(own, work, "doc_id long, round int, tokens binary"), "tokens")


def _batches(batches: Iterator[pa.RecordBatch], conf: Window) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for x in batch.column("tokens").to_pylist():
            tokens = np.frombuffer(x, "<u2")
            held.append(tokens)
            size += len(tokens)
            if size >= 4 * conf.batch:
                yield windows(held, conf)
                held, size = [], 0
    if size:
        yield windows(held, conf)


def train(tokens: DataFrame, totals: np.ndarray, conf: Window) -> np.ndarray:
    """The flat parameters after all rounds."""
    net = Net(conf)
    net.start(totals)
    flat, sc = net.flat, tokens.sparkSession.sparkContext
    pieces = 8
    edges = [len(flat) * i // pieces for i in range(pieces + 1)]
    for turn in range(conf.rounds):
        start = sc.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen, n = Net(conf, start.value.copy()), Net(conf, np.zeros_like(start.value)), 0
            for token, around in _batches(batches, conf):
                order = np.random.default_rng(conf.seed).permutation(len(token))
                for i in range(0, len(token), conf.batch):
                    some = order[i : i + conf.batch]
                    own.step(token[some], around[some], seen)
                n += len(token)
            if n:
                part = TaskContext.get().partitionId()
                values = [(own.flat[a:b].astype(np.float64) * n).tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                arrays = [pa.array(range(pieces), pa.int32()), pa.array([part] * pieces, pa.int64()), pa.array([float(n)] * pieces), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["piece", "node", "n", "total"])

        def together(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("child")  # always the same sum
            total = np.zeros(len(group["total"].iloc[0]) // 8)
            for x in group["total"]:
                total += np.frombuffer(x)
            return pd.DataFrame({"piece": group["piece"].iloc[:1], "node": group["node"].iloc[:1], "n": [group["n"].sum()], "total": [total.tobytes()]})

        own = tokens.where(F.col("round") == turn)
        parts = own.rdd.getNumPartitions()
        copies, ddl = own.mapInArrow(learn, "piece int, node long, n double, total binary"), "piece int, node long, n double, total binary"
        while parts > 1:
            copies = copies.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / conf.fan))
            copies = copies.groupBy("piece", "node").applyInPandas(together, ddl)
            parts = math.ceil(parts / conf.fan)
        for r in copies.collect():  # one row per piece
            flat = flat.copy()
            flat[edges[r.piece] : edges[r.piece + 1]] = (np.frombuffer(bytes(r.total)) / r.n).astype(np.float32)
    return flat


def score(docs: DataFrame, conf: Window = Window()) -> DataFrame:  # noqa: B008
    """doc_id, n_words, log_likelihood (sum of the conditional log-probabilities) and mean_log_prob for every row."""
    ids, totals, different = vocabulary(docs, conf)
    tokens = numbered(docs, ids, conf)
    flat = tokens.sparkSession.sparkContext.broadcast(train(tokens, totals, conf))
    inside = np.zeros(conf.tokens)
    inside[conf.tokens - conf.buckets :] = -np.log(different)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(conf, flat.value)
        for batch in batches:
            ids_, rows, at = batch.column("doc_id"), [np.frombuffer(x, "<u2") for x in batch.column("tokens").to_pylist()], 0
            sums = np.zeros(len(rows))
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end]) <= 4 * conf.batch):
                    size += len(rows[end])
                    end += 1
                if size:
                    token, around = windows(rows[at:end], conf)
                    logs = np.concatenate([net.log_probs(token[i : i + conf.batch], around[i : i + conf.batch]) for i in range(0, size, conf.batch)])
                    owner = np.repeat(np.arange(at, end), [len(x) for x in rows[at:end]])
                    sums[at:end] = np.bincount(owner - at, logs + inside[token], end - at)
                at = end
            lengths = np.array([len(x) for x in rows])
            means = [s / n if n else None for s, n in zip(sums.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids_, pa.array(lengths, pa.int64()), pa.array(sums), pa.array(means, pa.float64())],
                                             ["doc_id", "n_words", "log_likelihood", "mean_log_prob"])

    return tokens.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_prob double")
