"""Repeated word sequences, found by recompression.

A text is rewritten in rounds. The first round names runs of one word; every round names pairs: a hash bit puts each symbol
on the left or on the right side, and a left symbol followed by a right one becomes one symbol. Names are hashes of what they name, so equal
sequences get equal symbols in every task without an exchange of dictionaries. Each symbol also knows its *reach*, the words that
decided about it (its own and those of the neighbours that were looked at). If the reach lies inside a window of words, every equal window holds the
same symbol at the same place.

So each window of ``width`` words is represented by the largest symbol whose reach it contains (the smallest span of text decides
ties). Equal windows have equal representatives: a window whose representative is found nowhere else is unique, and most of the corpus is
settled by this first shuffle of short names. The windows under shared symbols are verified by a 128-bit
hash of their words: every window but the first of its hash repeats an earlier one. The whole text is the topmost symbol: of documents with equal words only the first goes through the rounds.

The texts are read once: words, digests and the runs of names of each document's windows are written to the shared folder with the text, in blocks of
bounded size, and no names are made again. Later passes read the runs, and only of documents under shared names the text. A block sends each name and
each window once, however often it occurs in the block, so no group has more rows than there are blocks; what a task holds
is bounded by a block, whatever the size of the scan partitions.

Defined results: null and empty texts have no words and lose none. Documents are ordered by id (null first), then by text digest; rows that
repeat id and text count as one after the other, so the later ones lose what the first one keeps. An empty table gives an empty one. Other columns
are not looked at. Whole texts are processed, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import running, sliced, texts_of, written
from behavior_spark.llm.token_files import _filesystem
from behavior_spark.session import new_folder

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two word hashes
PIECE = 1 << 20  # bytes of text hashed at once


@dataclass(frozen=True)
class Recompression:
    width: int = 20  # words in a window
    rounds: int = 3
    block_bytes: int = 24 << 20  # text of a block, about: what a task holds at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multipliers and of their inverses, as far as needed."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.size:
            self.size = n
            self.pairs = []
            for m in LANES:
                both = [np.full(n, x, np.uint64) for x in (m, pow(m, -1, 1 << 64))]
                for x in both:
                    x[0] = 1
                self.pairs.append(tuple(np.cumprod(x, dtype=np.uint64) for x in both))
        return self.pairs


_POWERS = _Powers()


def _hash_piece(raw: bytes) -> list[np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    inside = ~SPACES[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for power, inverse in _POWERS.upto(max(PIECE, len(data) + 1)):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * inverse[starts]
        out.append(mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
    return out


def word_hashes(raw: bytes) -> list[np.ndarray]:
    """Two 64-bit hashes of every word; long texts are cut at white space."""
    if len(raw) <= PIECE:
        return _hash_piece(raw)
    parts, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and not SPACES[raw[end]]:
            end += 1
        parts.append(_hash_piece(raw[start:end]))
        start = end
    return [np.concatenate([p[i] for p in parts]) for i in range(len(LANES))]


def representatives(names: np.ndarray, apart: np.ndarray, conf: Recompression) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the representative's name and place. ``apart`` marks the separators between documents."""
    width, n = conf.width, len(names)
    place = np.arange(n, dtype=np.int64)
    lo, hi, span = place, place + 1, np.ones(n, np.int64)
    top = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def offer(name, lo, hi, span, apart):
        fits = ~apart & (hi - lo <= width)
        top[0].append(lo[fits])
        top[1].append(span[fits].astype(np.uint64) << np.uint64(58) | name[fits] >> np.uint64(6))
        top[2].append((hi - lo)[fits])

    def before(x):
        return np.concatenate([[-1], x[:-1]])

    def after(x):
        return np.concatenate([x[1:], [n + 1]])

    offer(names, lo, hi, span, apart)
    for step in range(conf.rounds):
        if step == 0 and n:  # runs of one word
            first = np.concatenate([[True], (names[1:] != names[:-1]) | apart[1:] | apart[:-1]])
            at = np.flatnonzero(first)
            count = np.diff(np.concatenate([at, [n]]))
            last = at + count - 1
            names = np.where(count > 1, mixed(names[at] + count.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), names[at])
            apart, span, lo, hi = apart[at], count, before(lo)[at], after(hi)[last]
            offer(names, lo, hi, span, apart)
        side = (mixed(names + np.uint64(0xA0761D6478BD642F * (step + 1) % 2**64)) & np.uint64(1)).astype(bool)
        left, right = ~side & ~apart, side & ~apart
        pair = np.zeros(len(names), bool)
        pair[:-1] = left[:-1] & right[1:]
        second = np.concatenate([[False], pair[:-1]])
        nxt = np.concatenate([names[1:], names[:1]])
        joined = mixed(names * np.uint64(0xE7037ED1A0B428DB) + mixed(nxt + np.uint64(step + 1)))
        # A left symbol looked at the next one, a right symbol that is no second part at the one before it.
        new_lo = np.minimum(lo, np.where(left, after(lo), np.where(right, before(lo), lo)))
        new_hi = np.maximum(hi, np.where(left, after(hi), np.where(right, before(hi), hi)))
        new_span = span + np.where(pair, np.concatenate([span[1:], [0]]), 0)
        names, keep = np.where(pair, joined, names), ~second
        names, lo, hi, span, apart = names[keep], new_lo[keep], new_hi[keep], new_span[keep], apart[keep]
        offer(names, lo, hi, span, apart)
    at, key, reach = (np.concatenate(x) for x in top)
    best, where = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    for w in range(1, width + 1):
        # Windows of w words hold what windows of w - 1 words hold, and the symbols that reach exactly w words.
        later, later_where = best[1:], where[1:]
        take = (later > best[:-1]) | ((later == best[:-1]) & (later_where < where[:-1]))
        best[:-1], where[:-1] = np.where(take, later, best[:-1]), np.where(take, later_where, where[:-1])
        own = reach == w
        if own.any():
            exact = np.zeros(n + 1, np.uint64)
            np.maximum.at(exact, at[own], key[own])
            take = (exact >= best) & (exact > 0)
            best, where = np.where(take, exact, best), np.where(take, np.arange(n + 1), where)
    return best[:n], where[:n]


def runs_of(texts: list[bytes], conf: Recompression) -> list[tuple[np.ndarray, np.ndarray]]:
    """The representatives of each text's windows as runs (names, number of windows); a new place begins a new run."""
    hashes = [word_hashes(raw)[0] for raw in texts]
    lengths = np.array([len(h) for h in hashes], np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    apart = np.zeros(int((lengths + 1).sum()), bool)
    apart[begins + lengths] = True
    gap = np.zeros(1, np.uint64)
    names = np.concatenate([y for h in hashes for y in (h, gap)]) if hashes else gap[:0]
    best, where = representatives(names, apart, conf) if (lengths >= conf.width).any() else (names, names)
    out = []
    for begin, n in zip(begins.tolist(), (lengths - conf.width + 1).tolist(), strict=True):
        if n <= 0:
            out.append((best[:0], np.zeros(0, np.int32)))
            continue
        key, place = best[begin : begin + n], where[begin : begin + n]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
        out.append((key[first], np.diff(np.append(first, n)).astype(np.int32)))
    return out


def window_hashes(raw: bytes, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start at some words."""
    out = []
    for lane, m in zip(word_hashes(raw), LANES, strict=True):
        h = np.zeros(len(at), np.uint64)
        for i in range(width):
            h = h * np.uint64(m) + lane[at + i]
        out.append(mixed(h))
    return out[0], out[1]


def _stored(folder: str, block: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The documents of a block, a few at a time, in the order in which they were written."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = _filesystem(f"{folder}/block={block}")
    for path in sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")):
        with files.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(256, columns=columns)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _first_of_each(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, rank and position, and in it where a new hash begins."""
    order = np.lexsort((pos, rank, h2, h1))
    a, b = h1[order], h2[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)


def stretches(rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of rows, as (row, first position, number) of those that follow each other."""
    order = np.lexsort((pos, rows))
    rows, pos = rows[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1] + 1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[first], pos[first], np.diff(np.append(first, len(rows)))


def described(docs: DataFrame, conf: Recompression) -> str:
    """Write what one reading of the texts gives: a folder of blocks of documents with their text, digests and runs of names.

    A block is a part of a scan partition with about ``block_bytes`` of text (one document at least).
    """
    folder = new_folder(docs.sparkSession, "llm-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part = TaskContext.get().partitionId()
        row, block, held = part << 33, part << 24, 0
        for batch in batches:
            for piece in sliced(batch, "text", PIECE):
                texts = texts_of(piece)
                runs = runs_of(texts, conf)
                words = [raw.split() for raw in texts]
                joined = [b" ".join(w) for w in words]
                blocks = []
                for raw in texts:
                    if held >= conf.block_bytes:
                        block, held = block + 1, 0
                    blocks.append(block)
                    held += len(raw)
                columns = {
                    "row": pa.array(range(row, row + len(texts)), pa.int64()),
                    "doc_id": piece.column("doc_id"),
                    "text": piece.column("text"),
                    "digest": piece.column("digest"),
                    "n_words": pa.array(map(len, words), pa.int64()),
                    "whole": pa.array([xxhash.xxh3_128_digest(x) for x in joined], pa.binary()),
                    "sha": pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
                    "names": pa.array([k.tobytes() for k, _ in runs], pa.binary()),
                    "windows": pa.array([c.tobytes() for _, c in runs], pa.binary()),
                    "block": pa.array(blocks, pa.int64()),
                }
                row += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.withColumn("digest", F.xxhash64("text")).mapInArrow(run, DESCRIBED).write.partitionBy("block").parquet(folder)
    return folder


DESCRIBED = "row long, doc_id long, text string, digest long, n_words long, whole binary, sha string, names binary, windows binary, block long"


def removed(docs: DataFrame, conf: Recompression = Recompression()) -> DataFrame:  # noqa: B008
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by spaces) for every row."""
    spark, width = docs.sparkSession, conf.width
    folder = described(docs, conf)
    info = spark.read.schema(DESCRIBED).parquet(folder).select("row", "block", "doc_id", "digest", "n_words", "whole", "sha")
    info = running(info.withColumn("one", F.lit(1)), [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")], ["one"])
    info = info.withColumnRenamed("before_one", "rank")
    firsts = info.groupBy(F.col("whole").alias("w")).agg(F.min("rank").alias("first"))
    info = written(info.join(firsts, F.col("whole") == F.col("w")).withColumn("copy", F.col("rank") != F.col("first")).drop("w", "whole", "first", "one", "digest"), "documents")

    # Copies are settled: all their words are covered, if they fill a window. So are texts shorter than a window.
    settled = info.where(F.col("copy") | (F.col("n_words") < width))
    gone = F.when(F.col("copy") & (F.col("n_words") >= width), F.col("n_words")).otherwise(F.lit(0))
    empty = hashlib.sha256(b"").hexdigest()
    settled = settled.select("doc_id", "n_words", gone.alias("n_removed"), F.when(gone > 0, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"))
    left = info.where(~F.col("copy") & (F.col("n_words") >= width))
    ranks = written(left.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "rank", "sha"))).alias("docs")), "blocks")
    count = max(1, ranks.count())

    def of_block(block: int, rows: np.ndarray, columns: list[str]) -> Iterator[tuple[int, list]]:
        """(place in ``rows``, values) of the documents of a block that are in ``rows`` (sorted)."""
        for batch in _stored(folder, block, ["row", *columns]):
            own = batch.column("row").to_numpy()
            place = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
            wanted = rows[place] == own
            some = batch.filter(pa.array(wanted))
            for i, *values in zip(place[wanted].tolist(), *[some.column(c).to_pylist() for c in columns], strict=True):
                yield i, values

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                block = batch.column("block")[j].as_py()
                rows = batch.column("docs").slice(j, 1).flatten().field("row").to_numpy()
                found = [np.frombuffer(x, np.uint64) for _, (x,) in of_block(block, rows, ["names"])]
                keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                for i in range(0, len(keys), 1 << 16):
                    some = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([_long(some), pa.array(np.full(len(some), block)), pa.array(counts[i : i + (1 << 16)] > 1)], ["key", "block", "twice"])

    keys = ranks.repartition(count, "block").mapInArrow(name, "key long, block long, twice boolean")
    same = Window.partitionBy("key")
    shared = keys.withColumn("n", F.count("*").over(same)).where((F.col("n") > 1) | F.col("twice"))
    shared = shared.groupBy(F.col("block").alias("b")).agg(F.collect_list("key").alias("shared"))
    known = written(ranks.join(shared, F.col("block") == F.col("b"), "left").drop("b"), "shared")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each window under a shared name the first one in its block; stretches of others (``size`` windows) that repeat one in it."""
        columns = ["h1", "h2", "rank", "pos", "row", "block", "size"]
        for batch in batches:
            for j in range(batch.num_rows):
                block = batch.column("block")[j].as_py()
                docs_ = batch.column("docs").slice(j, 1).flatten()
                rows, ranked = docs_.field("row").to_numpy(), docs_.field("rank").to_numpy()
                shared_ = np.sort(batch.column("shared").slice(j, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                found: list[list[np.ndarray]] = [[], [], [], []]
                for i, (raw, names, windows) in of_block(block, rows, ["text", "names", "windows"]) if len(shared_) else ():
                    runs, times = np.frombuffer(names, np.uint64), np.frombuffer(windows, np.int32)
                    under = shared_[np.minimum(np.searchsorted(shared_, runs), len(shared_) - 1)] == runs
                    if under.any():
                        at = np.flatnonzero(np.repeat(under, times))
                        h1, h2 = window_hashes(raw.encode(), at, width)
                        for part, x in zip(found, (h1, h2, np.full(len(at), i, np.int32), at.astype(np.int32)), strict=True):
                            part.append(x)
                if not found[0]:
                    continue
                h1, h2, which, pos = map(np.concatenate, found)
                order, new = _first_of_each(h1, h2, ranked[which], pos)
                at = order[new]
                for i in range(0, len(at), 1 << 16):
                    k = at[i : i + (1 << 16)]
                    parts = (h1[k], h2[k], ranked[which[k]], pos[k], rows[which[k]], np.full(len(k), block), np.zeros(len(k), np.int64))
                    yield pa.RecordBatch.from_arrays(list(map(_long, parts)), columns)
                at = order[~new]
                row, first, size = stretches(rows[which[at]], pos[at])
                # Known to repeat: hashes of their own, so that nothing is compared with them.
                parts = (row, first, np.zeros(len(row), np.int64), first, row, np.full(len(row), block), size)
                yield pa.RecordBatch.from_arrays(list(map(_long, parts)), columns)

    windows = known.repartition(count, "block").mapInArrow(verify, "h1 long, h2 long, rank long, pos long, row long, block long, size long")
    earlier = Window.partitionBy("h1", "h2", F.col("size") > 0).orderBy("rank", "pos")
    again = windows.withColumn("n", F.row_number().over(earlier)).where((F.col("n") > 1) | (F.col("size") > 0))
    again = again.groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("row", "pos", "size")).alias("again"))
    known = ranks.join(again, F.col("block") == F.col("b"), "left").drop("b")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                block = batch.column("block")[j].as_py()
                docs_ = batch.column("docs").slice(j, 1).flatten()
                rows, shas = docs_.field("row").to_numpy(), docs_.field("sha")
                told = batch.column("again").slice(j, 1).flatten()
                marks = [told.field(x).to_numpy(zero_copy_only=False).astype(np.int64) if len(told) else np.zeros(0, np.int64) for x in ("row", "pos", "size")]
                order = np.argsort(marks[0], kind="stable")
                row, pos, size = (x[order] for x in marks)
                begin, end = np.searchsorted(row, rows, side="left"), np.searchsorted(row, rows, side="right")
                out = []
                touched = begin < end
                wanted = ["doc_id", "n_words", "text"] if touched.any() else ["doc_id", "n_words"]
                for i, (doc_id, n_words, *raw) in of_block(block, rows, wanted):
                    if not touched[i]:
                        out.append((doc_id, n_words, 0, shas[i].as_py()))
                        continue
                    words = raw[0].encode().split()
                    covered, mine = np.zeros(n_words + 1, np.int64), slice(begin[i], end[i])
                    np.add.at(covered, pos[mine], 1)
                    np.add.at(covered, pos[mine] + np.maximum(size[mine], 1) - 1 + width, -1)
                    keep = np.cumsum(covered[:-1]) == 0
                    kept = b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])
                    out.append((doc_id, n_words, n_words - int(keep.sum()), hashlib.sha256(kept).hexdigest()))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    done = known.repartition(count, "block").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return settled.union(done)
