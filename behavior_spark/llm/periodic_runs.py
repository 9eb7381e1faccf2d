"""Periodic runs of words, found online by catching squares in dyadic blocks.

A text is appended word by word to a detector. Whenever a block of ``L = 2^k`` words is completed it becomes a *catcher*: a square of
period p with ``2 L <= p < 4 L`` has a whole aligned block of L words in its first half, so the block must come back p words later. A
catcher lives while the two octaves behind it are appended: it compares its block with every window that ends at a new word, two
catchers of each size being alive at a time. Words one to three apart are compared by the catchers of single words.

Catchers that follow each other and come back at the same distance form a chain. A chain that stops growing holds squares if it
spans long enough; suffix comparison of the words before it and after it gives the whole stretch, and squares of one period that touch are
one run. Chains inside a run that is known already, at a multiple of its period, are not primitive and are left out.

Windows are compared by 64-bit names, made by doubling: two names of L words give the name of 2 L words. Every chain is then
compared word by word, so a clash of names cannot give a wrong run; equal windows always have equal names, so none is lost.

The detector takes words in pieces of any size, with the same result; Spark's tasks append whole slices of documents, with a
word of its own behind each document, which no square can contain. Memory is a few numbers per word of a slice; only a single longer
text makes a slice larger than 8 MB.

Defined results: a run has at least ``exponent`` (four or more) periods and ``shortest`` words; its period is its smallest one. Null, empty
and blank texts have no words and no runs. Each row is handled on its own: repeated rows get repeated results, ids may be null, other
columns are passed on unless a new column takes their name. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import WORD, free_name, schema_of, sliced, texts_of

PIECE = 1 << 18  # words appended at once: arrays of a level stay in the processor's cache
ODD = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Repetition:
    """``exponent``: periods that a run has at least; ``shortest``: words that it has at least."""

    exponent: int = 4
    shortest: int = 6

    def __post_init__(self) -> None:
        if self.exponent < 4:
            raise ValueError("runs of fewer than four periods may overlap too far to be told apart by the middle word")


def named(x: np.ndarray) -> np.ndarray:
    """64-bit names, all below ``NONE``."""
    x = x * ODD
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(1)


class Level:
    """The catchers of blocks of ``length`` words."""

    def __init__(self, length: int, exponent: int):
        self.length, self.exponent = length, exponent
        self.lags = (1, 2, 3) if length == 1 else (2, 3)  # in blocks
        self.half = np.empty(0, np.uint64)  # names that wait for their second half
        self.rest = np.empty(0, np.uint64)  # names that do not fill a row yet
        self.alive = np.full(3, NONE)  # the last three completed blocks
        self.rows = 0
        self.since = np.full((len(self.lags), length), -1, np.int64)  # row in which an open chain began, by lag and column

    def append(self, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Take the names of new windows; return the names of doubled windows and the chains that ended, as rows (start, period, words)."""
        size = self.length
        joined = np.concatenate([self.half, names])
        doubled = named(joined[:-size] + (joined[size:] ^ ODD) * np.uint64(3)) if len(joined) > size else joined[:0]
        self.half = joined[len(doubled) :]
        waiting = np.concatenate([self.rest, names])
        n = len(waiting) // size
        grid = waiting[: n * size].reshape(n, size)
        self.rest = waiting[n * size :]
        if not n:
            return doubled, []
        blocks = np.concatenate([self.alive, grid[:, 0]])
        ended = [self._advance(i, lag, grid == blocks[3 - lag : 3 - lag + n, None]) for i, lag in enumerate(self.lags)]
        self.alive, self.rows = blocks[-3:], self.rows + n
        return doubled, [x for x in ended if x is not None]

    def _advance(self, i: int, lag: int, caught: np.ndarray) -> np.ndarray | None:
        """Follow the chains of one lag over new rows; column c of row r is the window at r * length + c."""
        since, size = self.since[i], self.length
        if not caught.any() and since.max() < 0:
            return None
        grown = np.concatenate([(since >= 0)[None], caught])
        column, row = np.nonzero((grown[1:] != grown[:-1]).T)
        if not len(column):
            return None
        row += self.rows
        first = np.concatenate([[True], column[1:] != column[:-1]])
        # Changes of a column alternate between beginning and end; which comes first depends on the open chain.
        order = np.arange(len(column)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        ends = (order % 2 == 0) == (since[column] >= 0)
        before = np.where(first, since[column], np.concatenate([[0], row[:-1]]))
        column_end, row_end, begun = column[ends], row[ends], before[ends]
        last = np.concatenate([first[1:], [True]])
        since[column[last]] = np.where(ends[last], -1, row[last])
        period = lag * size + column_end
        words = (row_end - begun) * size
        keep = words + 2 * (size - 1) >= (self.exponent - 1) * period
        return np.stack([(begun - lag) * size, period, words], axis=1)[keep] if keep.any() else None


class Detector:
    """Runs of a growing sequence of word numbers. ``longest``: words of the longest text in it (periods beyond a share of it are not looked for)."""

    def __init__(self, longest: int, settings: Repetition = Repetition()):
        self.settings = settings
        self.levels = [Level(1, settings.exponent)]
        while 4 * self.levels[-1].length * settings.exponent <= longest:
            self.levels.append(Level(2 * self.levels[-1].length, settings.exponent))
        self.pieces: list[np.ndarray] = []
        self.chains: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> int:
        """Take the next words; the number of chains of squares that came to their end."""
        found = 0
        for at in range(0, len(words), PIECE):
            self.pieces.append(words[at : at + PIECE])
            names = named(self.pieces[-1].astype(np.uint64) + np.uint64(1))
            for level in self.levels:
                names, ended = level.append(names)
                self.chains += ended
                found += sum(map(len, ended))
        return found

    def finish(self) -> np.ndarray:
        """End the sequence: all runs as rows (start, length, period), by start and period."""
        n = sum(map(len, self.pieces))
        top = 1 + max((int(p.max()) for p in self.pieces if len(p)), default=0)
        self.append(np.arange(top, top + 6 * self.levels[-1].length + 6))  # words that equal nothing end every chain
        text = np.concatenate(self.pieces)
        runs = merged(text, np.concatenate(self.chains), self.settings.exponent) if self.chains else np.empty((0, 3), np.int64)
        assert not len(runs) or (runs[:, 0] + runs[:, 1]).max() <= n
        runs = runs[runs[:, 1] >= self.settings.shortest]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements agree, looking at more and more of them."""
    done, step, n = 0, 32, min(len(x), len(y))
    while done < n:
        differs = np.flatnonzero(x[done : min(n, done + step)] != y[done : min(n, done + step)])
        if len(differs):
            return done + int(differs[0])
        done, step = min(n, done + step), 4 * step
    return n


def merged(text: np.ndarray, chains: np.ndarray, exponent: int) -> np.ndarray:
    """Chains of squares, merged into runs by rising period.

    Each run marks its words. Two runs share fewer words than their periods together, so a chain of ``exponent`` periods
    lies in a known run of a divisor of its period if and only if the run that marks its middle word holds all of it.
    """
    runs: list[tuple[int, int, int]] = []
    mark = np.full(len(text), -1, np.int32)
    chains = chains[np.argsort(chains[:, 1], kind="stable")]
    # Periods of one octave are no multiples of each other; one to three go one by one.
    octave = np.where(chains[:, 1] < 4, chains[:, 1], 3 + np.floor(np.log2(chains[:, 1])).astype(np.int64))
    for part in np.split(chains, np.flatnonzero(np.diff(octave)) + 1):
        at, period, words = part.T
        known = mark[at + (words + period) // 2]
        if runs:
            a, length, q = np.array(runs)[known].T
            inside = (known >= 0) & (period % q == 0) & (a <= at) & (at + words + period <= a + length)
            part = part[~inside]
        new = set()
        for s, p, size in part.tolist():
            equal = text[s : s + size] == text[s + p : s + p + size]
            if equal.all():
                stretches = [(s, s + size)]
            else:  # a clash of names
                edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
                stretches = [(s + int(x), s + int(y)) for x, y in edge.reshape(-1, 2)]
            for x, y in stretches:
                start = x - agreeing(text[:x][::-1], text[: x + p][::-1][: x])
                stop = y + p + agreeing(text[y:], text[y + p :])
                holder = runs[mark[(start + stop) // 2]] if mark[(start + stop) // 2] >= 0 else (0, 0, 1)
                primitive = p % holder[2] or not (holder[0] <= start and stop <= holder[0] + holder[1])
                if stop - start >= exponent * p and primitive:
                    new.add((start, stop - start, p))
        for start, length, p in sorted(new, key=lambda r: r[2]):
            mark[start : start + length] = len(runs)
            runs.append((start, length, p))
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def runs_of(texts: list[list], settings: Repetition = Repetition()) -> list[np.ndarray]:
    """The runs of each text (a list of words), found by one detector to which all texts are appended."""
    number: dict = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    detector = Detector(int(sizes.max(initial=0)), settings)
    ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    free = len(number)
    buffer = [x for i, t in enumerate(ids) for x in (t, np.array([free + i]))]
    detector.append(np.concatenate(buffer) if buffer else np.empty(0, np.int64))
    runs = detector.finish()
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    cut = np.searchsorted(runs[:, 0], starts)
    return [runs[cut[i] : cut[i + 1]] - [starts[i], 0, 0] for i in range(len(texts))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def found(docs: DataFrame, settings: Repetition = Repetition()) -> DataFrame:
    """The documents with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repeated periods."""
    docs = docs.drop("runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    schema = schema_of("runs array<struct<start long, length long, period long>> not null, collapsed string not null")
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                words = [t.split() for t in texts_of(part)]
                runs = runs_of(words, settings)
                short = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.concatenate(runs)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, "runs", "collapsed"])

    schema.fields[:0] = docs.schema.fields
    schema.names[:0] = docs.schema.names
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the smallest start, then period, settles ties. Null without runs."""
    return F.reduce(
        runs, F.get(runs, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    )


def planted(docs: DataFrame) -> DataFrame:
    """Make one document of ten periodic from some word on, as the query's contract says; the id decides which and how.

    With h the CRC-32 of the decimal id and g = floor(h / 10), documents with h % 10 = 0 and n > 0 words keep their first a + p words, and word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    names = {x: free_name(docs.columns, x) for x in ("h", "words")}
    h, words = F.col(names["h"]), F.col(names["words"])
    g = F.floor(h / 10)
    cut = docs.withColumn(names["h"], F.crc32(F.col("doc_id").cast("string").cast("binary")))
    cut = cut.withColumn(names["words"], F.when(h % 10 == 0, F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD})"), F.lit(1))))
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    at = F.sequence(F.lit(0).cast("long"), n - 1)
    again = F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    text = F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text"))
    return cut.withColumn("text", F.coalesce(text, F.col("text"))).drop(*names.values())
