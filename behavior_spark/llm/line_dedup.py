"""Line deduplication by pairwise alignment.

Documents with the same sequence of lines are one at first: the earliest stands for all, and its copies lose every line. The others are linked
by rare lines. The key of a line is a hash of the shortest run of lines, from it on, that has at least ``long`` bytes (a long line is a run of
its own, short lines stand for themselves only together with those after them), and of the number of times the run came before in the
document. Each key links a document at first with the nearest earlier document that holds it: n holders give n - 1 links, not all pairs. Lines
that this alignment leaves (they cross others there) are linked with the holders before that one, twice as many in each round, until they are
deleted or every earlier holder was looked at (``Alignment.farther``, as the queries ask). So a line with a key stays only if no earlier document that
holds the key aligns it.

Each pair is aligned by patience over all keys that both documents hold, not only those that linked them: dealt in the order of the later document, the
longest rising sequence of their places in the earlier one is the alignment. Around each aligned line the equal lines on both sides belong to
the block. The blocks are deleted from the later document. Of the earlier document that part is looked at which a block
can reach: its linking lines and as many lines before and after them as the later document has.

Holders are put in order by range partitions of key and document, so a line that a third of all documents hold is spread over tasks.

Defined results: lines are cut at newlines and compared without the white space at their ends; blank lines have no key and are
deleted only beside or inside a block. Documents without any other line have no copies. Documents are ordered by id (null first), then by text digest; rows that repeat id
and text are one document and get the same result. A null text stays null. An empty table gives an empty one. Texts of any length are
processed whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import free_name, map_rows, running, texts_of, written


@dataclass(frozen=True)
class Alignment:
    """``long``: bytes that the lines of a key have together, at least. ``farther``: lines that the alignment with the nearest holder of their
    key leaves are aligned with the holders before it, too."""

    long: int = 24
    farther: bool = False


def lines_of(raw: bytes) -> list[bytes]:
    return [x.strip() for x in raw.split(b"\n")]


def keys_of(lines: list[bytes], long: int) -> list[int | None]:
    """The key of each line; None for blank lines and where the document ends before there are enough bytes."""
    import xxhash

    out: list[int | None] = []
    seen: Counter[bytes] = Counter()
    for i, line in enumerate(lines):
        run, size, end = line, len(line), i + 1
        while line and size < long and end < len(lines):
            run, size, end = run + b"\n" + lines[end], size + len(lines[end]), end + 1
        if not line or size < long:
            out.append(None)
            continue
        out.append(xxhash.xxh64_intdigest(run, seen[run] & 0xFFFFFFFF) - (1 << 63))
        seen[run] += 1
    return out


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, x in enumerate(places):
        pile = bisect_left(tops, x)
        if pile == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[pile], at[pile] = x, i
        back.append(at[pile - 1] if pile else -1)
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def blocks(own: list[bytes], own_keys: dict[int, int], other: list[bytes], other_keys: list[int | None]) -> set[int]:
    """Lines of a document in blocks that it shares with (a part of) another one; ``own_keys`` gives the line of each key."""
    cards = sorted((own_keys[k], j) for j, k in enumerate(other_keys) if k is not None and k in own_keys)
    out: set[int] = set()
    shift, end = None, -1  # of the last block
    for i in rising([j for _, j in cards]):
        line, its = cards[i]
        if (its - line == shift and line < end) or own[line] != other[its]:
            continue  # in the last block, or two keys of one hash
        shift, end = its - line, line
        while end < len(own) and end + shift < len(other) and own[end] == other[end + shift]:
            end += 1
        begin = line
        while begin > 0 and begin + shift > 0 and own[begin - 1] == other[begin + shift - 1]:
            begin -= 1
        out.update(range(begin, end))
    return out


def _listed(docs: DataFrame, conf: Alignment) -> DataFrame:
    """(id, digest, seq, size, filled, hs, keys): hashes of the sequence of lines and of each line, and the keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seqs, sizes, filled, hashes, keys = [], [], [], [], []
        for raw in texts_of(batch):
            lines = lines_of(raw)
            seqs.append(hashlib.blake2b(b"\n".join(lines), digest_size=16).digest())
            sizes.append(len(lines))
            filled.append(any(lines))
            hashes.append([hashlib.blake2b(x, digest_size=12).digest() for x in lines])
            keys.append(keys_of(lines, conf.long))
        arrays = [
            pa.array(seqs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(filled), pa.array(hashes, pa.list_(pa.binary())), pa.array(keys, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *arrays], ["id", "digest", "seq", "size", "filled", "hs", "keys"])

    return map_rows(docs, work, "id long, digest long, seq binary, size int, filled boolean, hs array<binary>, keys array<long>")


def nearest_holders(keys: DataFrame) -> DataFrame:
    """(doc, line, size, odoc, oline) of each line whose key (key, doc, line, size) an earlier document holds: the last one before."""
    ranged = written(keys.repartitionByRange("key", "doc").withColumn("part", F.spark_partition_id()), "holders")
    place = F.struct("doc", "line")
    inside = Window.partitionBy("part", "key").orderBy("doc")
    found = ranged.withColumn("o", F.lag(place).over(inside))
    # The first row of a partition may go on with the last key of the one before: one row per partition.
    last = ranged.groupBy("part").agg(F.max(F.struct("key", "doc", "line")).alias("z"))
    before = last.select(F.lag("z").over(Window.orderBy("part")).alias("z"), F.col("part").alias("p"))
    found = found.join(before, (F.col("part") == F.col("p")) & F.col("o").isNull() & (F.col("key") == F.col("z.key")), "left")
    other = F.coalesce("o", F.struct(F.col("z.doc").alias("doc"), F.col("z.line").alias("line")))
    found = found.withColumn("o", F.when(F.col("o").isNotNull() | F.col("z").isNotNull(), other)).where(F.col("o").isNotNull())
    return found.select("doc", "line", "size", F.col("o.doc").alias("odoc"), F.col("o.line").alias("oline"))


def deletions(docs: DataFrame, conf: Alignment = Alignment()) -> DataFrame:  # noqa: B008
    """(id, digest, lines): the line numbers to delete from each document that loses any."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    listed = written(_listed(own, conf), "lines")
    heads = listed.select("id", "digest", "seq", "size", "filled").distinct().withColumn("one", F.lit(1).cast("long"))
    heads = running(heads, [F.col("id").asc_nulls_first(), F.col("digest")], ["one"]).withColumnRenamed("before_one", "doc")
    firsts = heads.where("filled").groupBy(F.col("seq").alias("s")).agg(F.min("doc").alias("first"))
    heads = heads.join(firsts, F.col("seq") == F.col("s"), "left").withColumn("copy", F.col("filled") & (F.col("doc") > F.col("first")))
    heads = written(heads.select("id", "digest", "size", "doc", "copy"), "documents")
    copies = heads.where("copy").select("id", "digest", F.sequence(F.lit(0), F.col("size") - 1).alias("lines"))

    single = heads.where("not coalesce(copy, false)").select(F.col("id").alias("i"), F.col("digest").alias("d"), "doc")
    kept = listed.dropDuplicates(["id", "digest"]).join(single, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
    kept = written(kept.select("doc", "size", "hs", "keys"), "single")
    held = kept.select("doc", "size", F.posexplode("keys").alias("line", "key")).where("key IS NOT NULL").select("key", "doc", "line", "size")
    rounds = [written(_aligned(kept, nearest_holders(held)), "aligned")]
    left = rounds[0].select("doc", F.explode("left").alias("line"))
    if conf.farther and not left.isEmpty():
        rounds += _with_farther_holders(kept, held, left)
    gone = rounds[0].select("doc", "lines")
    for more in rounds[1:]:
        gone = gone.unionByName(more.select("doc", "lines"))
    if len(rounds) > 1:
        gone = gone.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    gone = gone.where(F.size("lines") > 0)
    return heads.select("id", "digest", "doc").join(gone, "doc").select("id", "digest", "lines").unionByName(copies)


def _with_farther_holders(kept: DataFrame, held: DataFrame, left: DataFrame) -> list[DataFrame]:
    """Alignments of the lines that are still left with the holders of their keys before the nearest, until there are none.

    The holders of these keys are numbered. A round looks at as many holders as all rounds before it, farther back each time, and only for lines
    that none of those rounds deleted.
    """
    wanted = written(held.join(left, ["doc", "line"], "left_semi"), "left")
    holders = held.join(wanted.select("key").distinct(), "key", "left_semi").withColumn("one", F.lit(1).cast("long"))
    holders = running(holders, [F.col("doc"), F.col("line")], ["one"], ["key"]).withColumnRenamed("before_one", "place").drop("one")
    holders = written(holders, "numbered")
    rest = holders.join(wanted.select("doc", "line"), ["doc", "line"], "left_semi").where("place > 1")
    earlier = holders.select("key", F.col("place").alias("at"), F.col("doc").alias("odoc"), F.col("line").alias("oline"))
    rounds, reach = [], 1
    while not rest.isEmpty():
        span = F.sequence(F.greatest(F.col("place") - 2 * reach, F.lit(0)), F.col("place") - reach - 1)
        links = rest.withColumn("at", F.explode(span)).join(earlier, ["key", "at"]).select("doc", "line", "size", "odoc", "oline")
        rounds.append(written(_aligned(kept, links, whole=True), "aligned"))
        reach *= 2
        left = rounds[-1].select("doc", F.explode("left").alias("line"))
        rest = written(rest.join(left, ["doc", "line"], "left_semi").where(F.col("place") > reach), "left")
    return rounds


def _aligned(kept: DataFrame, links: DataFrame, whole: bool = False) -> DataFrame:
    """(doc, lines, left): the lines that the alignment with the linked documents deletes, and the linked lines that it does not.

    ``whole`` takes every key of the linked documents; otherwise the part of them that a block at the linking lines can reach.
    """
    # What a block can reach of the earlier document, by pair.
    pairs = links.groupBy("doc", "odoc").agg(
        F.min("oline").alias("lo"), F.max("oline").alias("hi"), F.first("size").alias("size"), F.collect_list("line").alias("linked")
    )
    low, high = F.greatest(F.col("lo") - F.col("size"), F.lit(0)).alias("lo"), (F.col("hi") + F.col("size")).alias("hi")
    pairs = written(pairs.select("doc", "odoc", low, high, "linked"), "pairs")
    others = kept.select(F.col("doc").alias("odoc"), "hs", "keys").join(pairs, "odoc")

    def part(column: str):
        return F.slice(column, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias(column)

    others = others.select("doc", "odoc", *(("hs", "keys") if whole else (part("hs"), part("keys"))), "linked")
    owns = kept.select("doc", F.lit(-1).cast("long").alias("odoc"), "hs", "keys", F.array().cast("array<int>").alias("linked"))
    owns = owns.join(pairs.select("doc").distinct(), "doc", "left_semi")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document comes first, then the parts of others that it is compared with."""
        doc, own, keys, gone, linked = None, [], {}, set(), set()

        def done() -> pa.RecordBatch:
            lists = [pa.array([sorted(x)], pa.list_(pa.int32())) for x in (gone, linked - gone)]
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *lists], ["doc", "lines", "left"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["odoc"] < 0:
                    if linked:
                        yield done()
                    doc, own, gone, linked = row["doc"], row["hs"], set(), set()
                    keys = {k: i for i, k in enumerate(row["keys"]) if k is not None}
                else:
                    gone |= blocks(own, keys, row["hs"], row["keys"])
                    linked.update(row["linked"])
        if linked:
            yield done()

    cards = owns.unionByName(others).repartition("doc").sortWithinPartitions("doc", "odoc")
    return cards.mapInArrow(align, "doc long, lines array<int>, left array<int>")


def _cut(raw: bytes, lines: list[int]) -> bytes:
    gone = set(lines)
    return b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in gone)


def _with_lines(docs: DataFrame, conf: Alignment) -> tuple[DataFrame, str]:
    gone = deletions(docs, conf)
    name = free_name(docs.columns, "deleted_lines")
    gone = gone.select(F.struct("id", "digest", "lines").alias(name))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}.id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{name}.digest"))
    return docs.join(gone, same, "left").select(*docs.columns, F.col(f"{name}.lines").alias(name)), name


def report(docs: DataFrame, conf: Alignment = Alignment()) -> DataFrame:  # noqa: B008
    """doc_id, n_lines, n_removed, text (what is left) and kept_sha256 of it, for every row."""
    marked, name = _with_lines(docs.select("doc_id", "text"), conf)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = texts_of(batch), [x or [] for x in batch.column(name).to_pylist()]
        left = [_cut(t, g) for t, g in zip(texts, gone, strict=True)]
        nulls = batch.column("text").is_null().to_pylist()
        arrays = [
            batch.column("doc_id"), pa.array([t.count(b"\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(g) for g in gone], pa.int64()),
            pa.array([None if n else x.decode() for n, x in zip(nulls, left, strict=True)], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in left]),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_removed", "text", "kept_sha256"])

    return map_rows(marked, work, "doc_id long, n_lines long, n_removed long, text string, kept_sha256 string")


def deduplicated(docs: DataFrame, conf: Alignment = Alignment()) -> DataFrame:  # noqa: B008
    """The documents without their deleted lines, all columns; ``n_chars`` is counted again where there is one."""
    marked, name = _with_lines(docs, conf)

    def run(batches):
        for batch in batches:
            gone = batch.column(name).to_pylist()
            if any(gone):
                texts = batch.column("text").to_pylist()
                texts = [_cut(t.encode(), g).decode() if g else t for t, g in zip(texts, gone, strict=True)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))
            yield batch.drop_columns([name])

    out = marked.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
