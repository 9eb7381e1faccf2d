"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is measured by a few numbers about its words, lines and characters. The log-odds of good quality are a sum of lookup tables,
one per measure and one for some pairs of measures. They are learnt by cyclic boosting: round after round each measure in turn gets a shallow
tree of the present residuals, whose leaves are added to its table at a small rate; then the pairs whose trees explain most of what is left
get the same in turn. A score is a sum of table entries, found by binning whole columns at once.

On Spark: bin borders are quantiles over all labelled rows, labelled rows are binned and equal ones are counted, and the distinct rows are
dealt by hash into bags of about ``bag`` rows. Each bag is boosted in a task of its own and the tables are averaged: averages of additive models
are additive models. So every labelled row takes part, the number of bags grows with them, and only the tables reach the driver.

Defined results: a null text is empty; empty texts have measures of zero and a score like any other. Labels other than 0 and 1 are ignored; a
document with both labels counts as both. Without any usable label every score is 0.5. Rows are scored one by one, so repeated rows get equal
scores; a null id is not held out and has no label. Other columns are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import map_rows, schema_of, texts_of, written

MEASURES = (
    "words", "word_bytes", "longest_word", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "marked_words", "lines",
    "line_words", "distinct_lines", "ended_lines", "letters", "capitals", "digits", "symbols", "stops", "shouts", "blanks", "foreign", "entropy",
)
KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@{}[]\\/_=+~^", b".,;:", b"!?", b" \t\n\x0b\x0c\r", bytes(range(128, 256))),
    start=1,
):
    KINDS[list(_bytes)] = _kind


@dataclass(frozen=True)
class Boosting:
    """Settings of the fit; ``bag`` is the expected number of distinct labelled rows that one task boosts on."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 80
    rate: float = 0.15
    ridge: float = 1.0
    pairs: int = 6
    bag: int = 20_000


@dataclass
class Model:
    """Bin borders, the constant, and tables by measure or pair of measures."""

    borders: list[np.ndarray]
    start: float = 0.0
    single: dict[int, np.ndarray] = field(default_factory=dict)
    double: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    settings: Boosting = Boosting()

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(b, x, side="right") for b, x in zip(self.borders, columns, strict=True)]).astype(np.uint8)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        """``bins``: one row per measure."""
        total = np.full(bins.shape[1], self.start)
        for i, cells in self.single.items():
            total += cells[bins[i]]
        width = self.settings.bins // self.settings.coarse
        for (i, j), cells in self.double.items():
            total += cells[bins[i] // width, bins[j] // width]
        return total


def measured(raw: bytes) -> list[float]:
    """The measures of one text."""
    words = raw.split()
    if not words:
        return [0.0] * len(MEASURES)
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=9)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = seen[seen > 0] / size
    ended = sum(1 for x in lines if x.rstrip().endswith((b".", b"!", b"?", b":", b'"')))
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    letters = int(kinds[1] + kinds[2])
    return [
        math.log1p(n), float(lengths.mean()), math.log1p(int(lengths.max())), float((lengths <= 3).mean()), float((lengths >= 14).mean()),
        len(counts) / n, max(counts.values()) / n, len(set(zip(words, words[1:], strict=False))) / n, marked / n, math.log1p(len(lines)),
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), ended / len(lines), letters / size, int(kinds[2]) / max(letters, 1),
        int(kinds[3]) / size, int(kinds[4]) / size, int(kinds[5]) / size, int(kinds[6]) / size, int(kinds[7]) / size, int(kinds[8]) / size,
        float(-(share * np.log2(share)).sum()),
    ]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and one double per measure."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.array([measured(raw) for raw in texts_of(batch)], np.float64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, table.T)], ["doc_id", *MEASURES])

    ddl = "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES)
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, ddl)


def held_out(doc_id: Column | str) -> Column:
    """One row of three, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def gains(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Along the last axis: what a cut behind each cell gains over no cut, and the gain of no cut."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    whole = all_g**2 / (all_h + ridge)
    return left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - whole, whole[..., 0]


def tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered cells: cut where it gains most, twice."""
    if depth and len(g) > 1:
        gain, _ = gains(g, h, ridge)
        at = int(gain.argmax())
        if gain[at] > 1e-9:
            return np.concatenate([tree(x[0], x[1], ridge, depth - 1) for x in ((g[: at + 1], h[: at + 1]), (g[at + 1 :], h[at + 1 :]))])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one axis and then, on either side, the other."""
    best, values = -np.inf, np.zeros_like(g)
    for swapped in (False, True):
        a, b = (g.T, h.T) if swapped else (g, h)
        low_g, low_h = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        sides = [(low_g, low_h), (a.sum(0) - low_g, b.sum(0) - low_h)]
        found = [gains(x, y, ridge) for x, y in sides]
        total = sum(gain.max(1) + whole for gain, whole in found)
        at = int(total.argmax())
        if total[at] > best:
            best, cells = float(total[at]), np.zeros_like(a)
            for rows, (x, y), (gain, _) in zip((slice(0, at + 1), slice(at + 1, None)), sides, found, strict=True):
                cut = int(gain[at].argmax()) + 1
                for columns in (slice(0, cut), slice(cut, None)):
                    cells[rows, columns] = x[at, columns].sum() / (y[at, columns].sum() + ridge)
            values = cells.T if swapped else cells
    return best - float(g.sum() ** 2 / (h.sum() + ridge)), values


def boosted(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, settings: Boosting) -> Model:
    """Fit the tables to binned rows (``bins``: one row per measure)."""
    n, ridge = len(bins), settings.ridge
    good = float((weights * labels).sum())
    model = Model([], math.log((good + 1) / (float(weights.sum()) - good + 1)), {i: np.zeros(settings.bins) for i in range(n)}, {}, settings)
    odds = np.full(bins.shape[1], model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return weights * (labels - p), weights * p * (1 - p)

    for _ in range(settings.rounds):
        for i in range(n):
            g, h = slopes()
            step = settings.rate * tree(np.bincount(bins[i], g, settings.bins), np.bincount(bins[i], h, settings.bins), ridge)
            model.single[i] += step
            odds += step[bins[i]]
    size = settings.coarse
    coarse = bins.astype(np.int64) // (settings.bins // size)
    g, h = slopes()

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * size + coarse[j], values, size * size).reshape(size, size)

    ranked = sorted(((pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0], -i, -j) for i in range(n) for j in range(i)), reverse=True)
    chosen = [(-i, -j) for _, i, j in ranked[: settings.pairs]]
    model.double = {pair: np.zeros((size, size)) for pair in chosen}
    for _ in range(settings.rounds):
        for i, j in chosen:
            g, h = slopes()
            step = settings.rate * pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1]
            model.double[i, j] += step
            odds += step[coarse[i], coarse[j]]
    return model


def train(rows: DataFrame, label: str, settings: Boosting = Boosting()) -> Model:
    """Fit to rows with all measures and a label of 0 or 1 (others are left out)."""
    rows = rows.where(F.col(label).isin(0, 1)).select(*MEASURES, F.col(label).cast("int").alias(label))
    shares = [i / settings.bins for i in range(1, settings.bins)]
    borders = rows.agg(*[F.percentile_approx(m, shares, 10_000).alias(m) for m in MEASURES]).first()
    if borders[0] is None:
        return Model([np.empty(0)] * len(MEASURES), settings=settings)
    model = Model([np.unique(np.array(b)) for b in borders], settings=settings)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned([batch.column(m).to_numpy() for m in MEASURES])
            packed = [row.tobytes() for row in np.ascontiguousarray(bins.T)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(label)], ["bins", "good"])

    distinct = written(rows.mapInArrow(to_bins, schema_of("bins binary, good int")).groupBy("bins", "good").agg(F.count("*").alias("weight")), "bags")
    bags = -(-distinct.count() // settings.bag)

    def boost(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values(["bins", "good"])  # sums come out the same on a rerun
        bins = np.frombuffer(b"".join(bag["bins"]), np.uint8).reshape(len(bag), -1).T
        fit = boosted(np.ascontiguousarray(bins), bag["good"].to_numpy(float), bag["weight"].to_numpy(float), settings)
        tables = [(-1, -1, [fit.start])] + [(i, -1, x.tolist()) for i, x in fit.single.items()]
        tables += [(i, j, x.ravel().tolist()) for (i, j), x in fit.double.items()]
        return pd.DataFrame(tables, columns=["i", "j", "cells"])

    dealt = distinct.withColumn("bag", F.pmod(F.xxhash64("bins", "good"), F.lit(bags)))
    tables = dealt.groupBy("bag").applyInPandas(boost, "i int, j int, cells array<double>")
    # A pair that a bag did not choose is a table of zeros there, so sums are divided by the number of all bags.
    sums = tables.select("i", "j", F.posexplode("cells").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum(F.col("value").cast("decimal(30,12)")).alias("s"))
    cells: dict[tuple[int, int], dict[int, float]] = {}
    real = tables.agg(F.count(F.when(F.col("i") < 0, 1))).first()[0] if bags > 1 else 1
    for r in sums.collect():
        cells.setdefault((r.i, r.j), {})[r.at] = float(r.s) / real
    for (i, j), values in cells.items():
        flat = np.array([values[k] for k in range(len(values))])
        if i < 0:
            model.start = float(flat[0])
        elif j < 0:
            model.single[i] = flat
        else:
            model.double[i, j] = flat.reshape(settings.coarse, settings.coarse)
    return model


def scored(measured_rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-model.log_odds(model.binned([batch.column(m).to_numpy() for m in MEASURES]))))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return measured_rows.withColumn("held_out", held_out("doc_id")).mapInArrow(run, schema_of("doc_id long, held_out boolean, score double, predicted int"))


def labelled(measured_rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Measures of the rows to learn from: those not held out, once for each different label of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("label in (0, 1)").distinct()
    return measured_rows.where(~held_out("doc_id")).join(known, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, settings: Boosting = Boosting()) -> DataFrame:
    """Learn from the labelled documents that are not held out and score all documents. Texts are read once."""
    rows = written(measures(docs), "measures")
    return scored(rows, train(labelled(rows, labels), "label", settings))
