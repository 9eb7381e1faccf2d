"""Micro-batch folders merged into the month layout.

A stream leaves a folder per micro-batch and month: 17,280 a day at one every five seconds. Compaction rewrites the closed ones into few
sorted files per month and commits the result in the table's manifest together with the number of the last batch that went in.
Readers then take the merged folders and only the younger batches. A batch that is replayed after it was merged is not
read again: replays have the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from behavior_spark.sources import manifest as M
from behavior_spark.sources import tables
from behavior_spark.sources.manifest import WHOLE, Manifest
from behavior_spark.sources.tables import MONTH


def closed_batches(spark: SparkSession, path: str, known: Manifest | None) -> dict[str, list[int]]:
    """Micro-batches by run that are written to their end and not merged yet. They stop at the first unfinished one."""
    merged, out = (known.merged if known else {}), {}
    for name in M.listed(spark, path):
        if not name.startswith("run="):
            continue
        run = name.removeprefix("run=")
        numbers = sorted(int(n.removeprefix("ingest_batch=")) for n in M.listed(spark, f"{path}/{name}") if n.startswith("ingest_batch="))
        for number in numbers:
            if number <= merged.get(run, -1):
                continue
            if "_SUCCESS" not in M.listed(spark, f"{path}/{name}/ingest_batch={number}"):
                break
            out.setdefault(run, []).append(number)
    return out


def compact(
    spark: SparkSession, path: str, schema: T.StructType, order: Sequence[str] = (), folders_per_month: int = 1,
    combine: Callable[[DataFrame], DataFrame] | None = None, by_month: bool = True,
) -> Manifest | None:
    """Merge all closed micro-batches of a table; None if there is nothing to do.

    A month whose number of folders would exceed ``folders_per_month`` is rewritten as a whole; others get one folder more, so a larger number
    rewrites old rows less often. Rows are sorted by ``order`` inside files. ``combine`` may shrink the rows of a month before they are written (tables of
    partial sums). One compaction at a time: a second one that started from the same version fails at its commit and changes nothing.
    """
    known = M.load(spark, path)
    fresh = closed_batches(spark, path, known)
    if not fresh:
        return None
    folders = [f"run={run}/ingest_batch={n}" for run, numbers in fresh.items() for n in numbers]
    months = {m.split("=")[1] for f in folders for m in M.listed(spark, f"{path}/{f}") if m.startswith(f"{MONTH}=")} if by_month else {WHOLE}
    now = known or Manifest()
    rewritten = {m for m in months if len(now.folders.get(m, [])) + 1 > folders_per_month}
    part = M.new_part()
    if months:
        stored = schema if not by_month else T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())])
        rows = tables.batches(spark, path, stored, folders)
        if any(now.folders.get(m) for m in rewritten):
            rows = rows.unionByName(tables.merged_rows(spark, path, stored, now, rewritten))
        if combine is not None:
            rows = combine(rows)
        target = f"{path}/{M.PARTS}/{part}"
        if by_month:
            rows.hint("rebalance", MONTH).sortWithinPartitions(MONTH, *order).write.partitionBy(MONTH).parquet(target)
        else:
            rows.hint("rebalance").write.parquet(target)
    merged = {**now.merged, **{run: numbers[-1] for run, numbers in fresh.items()}}
    return M.commit(spark, path, known, replace(now.with_folder(part, sorted(months), rewritten), merged=merged))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove merged micro-batch folders and parts that the last ``keep`` manifests do not need."""
    known = M.versions(spark, path)
    if not known:
        return []
    oldest = M.load(spark, path, known[-keep:][0])
    gone = []
    for run, last in oldest.merged.items():
        for name in M.listed(spark, f"{path}/run={run}"):
            if name.startswith("ingest_batch=") and int(name.removeprefix("ingest_batch=")) <= last:
                M.remove(spark, f"{path}/run={run}/{name}")
                gone.append(f"run={run}/{name}")
    return gone + M.vacuum(spark, path, keep)
