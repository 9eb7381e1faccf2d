"""Mixing sources to target weights along a curriculum.

A source's weight is a schedule over training time 0..1, given by points and linear between them. Its integral is the
source's weight in the whole mix, which fixes how many words the mix takes from it (``targets``). Integrated up to
a time it is the source's cumulative demand; inverting it gives the time at which the source's n-th word is due. Documents of a
source are taken in a seeded hash order, again from the start when the source is used up; range-sorting all
pieces by time gives the training order.

No window runs over a whole source: offsets in a source come from the sums of hash buckets (about
``BUCKET_ROWS`` rows each) and the rows ahead in the own bucket.

Defined results: null texts and texts without words have size 0; nothing is taken of them. A null source is a source of its own,
the last one. Rows that repeat id and text get one place each in the order. An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import WORD, free_name, running, written

BUCKET_ROWS = 2_000
Schedule = tuple[tuple[float, float], ...]  # (time, weight), times rising from 0 to 1


@dataclass(frozen=True)
class Mix:
    """``schedules`` go to the sources by rank (code point order, null last), repeating."""

    schedules: tuple[Schedule, ...] = (
        ((0.0, 7.5), (1.0, 2.5)),  # integral 5: strong at first
        ((0.0, 2.0), (1.0, 2.0)),  # integral 2: even
        ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),  # integral 1: late
    )
    total_share: float = 1.5  # of all words
    most_repeats: float = 2.0
    seed: int = 17


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def due(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` (0..1) of the schedule's integral has passed: its inverse, piece by piece."""
    whole, done, out = integral(schedule), 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = F.greatest(share * F.lit(whole) - F.lit(done), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
        passed = F.when(rest > 0, rest * F.lit(2.0) / (F.lit(w0) + root)).otherwise(0.0)
        pieces.append((done + area, F.lit(t0) + F.least(passed, F.lit(t1 - t0))))
        done += area
    for end, time in reversed(pieces):
        out = F.when(share * F.lit(whole) <= F.lit(end), time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, rank, target from one row per source (source, source_size).

    A target is the smaller of weight times a common level and the most a source may give. The sources reach their
    most in the order of most / weight, so the level follows from running sums in that order.
    """
    n = len(mix.schedules)
    ranked = running(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], ["one"])
    kind = F.pmod(F.col("before_one"), F.lit(n)).cast("int")
    weights = F.array(*[F.lit(float(integral(s))) for s in mix.schedules])
    named = ranked.select(
        "source", "source_size", F.col("before_one").alias("rank"), kind.alias("schedule"), F.element_at(weights, kind + 1).alias("weight"),
        (F.col("source_size") * F.lit(mix.most_repeats)).alias("most"),
    )
    named = named.withColumn("ratio", F.col("most") / F.col("weight"))
    levelled = running(named, [F.col("ratio"), F.col("rank")], ["most", "weight"])
    totals = named.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"),
    ).first()
    goal = totals["size"] * mix.total_share
    # While the sources before this one give their most, the rest is shared by the weights from here on.
    level = (F.lit(float(goal)) - F.col("before_most")) / (F.lit(float(totals["weight"])) - F.col("before_weight"))
    found = levelled.withColumn("level", level).where(F.col("level") <= F.col("ratio") * F.lit(1 + 1e-12)).agg(F.min_by("level", F.struct("ratio", "rank")))
    level = found.first()[0]
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(float(level)))
    return levelled.select("source", "source_size", "rank", "schedule", target.alias("target"))


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, digest (of its text), source, size, source_size, target, offset, taken, schedule.

    ``offset`` is the number of words ahead of it in one pass over its source. ``taken`` counts repeats: the words in
    [0, target) of the endless repetition of the source that are the document's, so that each source gives its target,
    rounded down. Only the last document of the last pass can be cut.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.xxhash64(F.col("text").cast("string"))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("source").cast("string").alias("source"), size.alias("size")
    )
    own = written(own.withColumn("h", F.xxhash64("doc_id", "digest", F.lit(mix.seed))), "sizes")
    per_source = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(per_source, mix), "targets")
    buckets = max(1, own.count() // BUCKET_ROWS)
    own = own.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)))
    sums = own.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("at"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, (F.col("source").eqNullSafe(F.col("s"))) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("offset", F.col("at") + F.col("in")).drop("s", "b", "at", "in", "bucket", "h")
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "schedule")
    out = placed.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    last = F.floor("target") - whole * F.col("source_size") - F.col("offset")
    out = out.withColumn("taken", (whole * F.col("size") + F.least(F.greatest(last, F.lit(0)), F.col("size"))).cast("long"))
    return out


def pieces(placed: DataFrame, mix: Mix = Mix(), sort: bool = True) -> DataFrame:  # noqa: B008
    """The takes in training order: one row per document and pass, with ``position`` (0..1) and ``words`` (of the document).

    Range-sorted by position; ties go by id.
    """
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = placed.where(F.col("taken") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    start = F.col("pass") * F.col("source_size") + F.col("offset")
    share = start.cast("double") / F.col("target")
    position = F.lit(None).cast("double")
    for i, schedule in enumerate(mix.schedules):
        position = F.when(F.col("schedule") == i, due(schedule, share)).otherwise(position)
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    out = rows.select("doc_id", "digest", "source", "offset", "pass", words.alias("words"), "size", position.alias("position"))
    if not sort:
        return out
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "digest", "pass")


def scheduled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The rows of ``taken`` as the training order has them: ``taken`` is the sum of the row's pieces.

    ``first_position`` and ``last_position`` are the times of its first and last pass, ``first_rank`` is the number of pieces
    ahead of the first one; null where nothing is taken. Ties go by id, digest, source, offset and pass.
    """
    placed = written(taken(docs, mix), "placed")
    order = [F.col(c) for c in ("position", "doc_id", "digest", "source", "offset", "pass")]
    ranked = running(pieces(placed, mix, sort=False).withColumn("one", F.lit(1).cast("long")), order, ["one"])
    # Rows with words have an offset of their own in their source.
    keys = ("doc_id", "digest", "source", "offset")
    sums = ranked.groupBy(*keys).agg(
        F.sum("words").alias("words"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.min("before_one").alias("first_rank"),
    )
    same = None
    for key in keys:
        sums = sums.withColumnRenamed(key, f"__{key}")
        equal = placed[key].eqNullSafe(F.col(f"__{key}"))
        same = equal if same is None else same & equal
    out = placed.drop("taken").join(sums, (placed["size"] > 0) & same, "left").drop(*[f"__{key}" for key in keys])
    return out.withColumn("taken", F.coalesce("words", F.lit(0))).drop("words")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mix as documents: all columns, one row per pass, range-sorted by training time.

    Documents stay whole: the one document of a source that the end of its last pass cuts is taken if at least half of its words
    are due. Documents without words are in no mix.
    """
    at, copy, digest, due_at = (free_name(docs.columns, x) for x in ("position", "copy", "text_digest", "due"))
    keys = ("doc_id", "digest", "source")
    takes = pieces(taken(docs, mix), mix, sort=False).where(F.col("words") * 2 >= F.col("size"))
    # Rows that repeat id, text and source have places of their own in the source; the nth copy takes the nth place.
    takes = takes.withColumn("copy", F.dense_rank().over(Window.partitionBy(*keys).orderBy("offset")))
    takes = takes.select(F.struct(*keys, "copy", "pass", "position").alias(due_at))
    source = F.col("source").cast("string")
    order = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant", "void")]
    rows = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))
    rows = rows.withColumn(copy, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), digest, source).orderBy(*order)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{due_at}.doc_id")) & (F.col(digest) == F.col(f"{due_at}.digest"))
    same = same & source.eqNullSafe(F.col(f"{due_at}.source")) & (F.col(copy) == F.col(f"{due_at}.copy"))
    joined = rows.join(takes, same).withColumn(at, F.col(f"{due_at}.position"))
    return joined.repartitionByRange(F.col(at), F.col("doc_id")).sortWithinPartitions(at, "doc_id", digest, copy).select(*docs.columns)
