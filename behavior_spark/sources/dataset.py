"""The offline dataset: four CSV files, numbered rows, a batch id from file names and sizes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from behavior_spark.schemas import CSV_SCHEMAS, DATASET_FILES

FIRST_ROW = 2  # the header is line 1


def source_files(spark: SparkSession, folder: str, names: tuple[str, ...] = DATASET_FILES) -> DataFrame:
    """Name and size of the required files, without reading their content.

    Raises FileNotFoundError when one is missing.
    """
    frames = []
    for position, name in enumerate(names):
        try:
            found = spark.read.format("binaryFile").load(f"{folder}/{name}")
        except AnalysisException as error:
            raise FileNotFoundError(f"missing dataset file: {folder}/{name}") from error
        frames.append(
            found.select(F.lit(position).alias("position"), F.lit(name).alias("name"), F.col("length").alias("size"))
        )
    listing = frames[0]
    for frame in frames[1:]:
        listing = listing.unionByName(frame)
    return listing


def load_batch_id(files: DataFrame) -> str:
    """First 16 hex digits of the SHA-256 over ``name:size`` of every file, joined by bars.

    ``files`` is the short listing of ``source_files`` (one row per file).
    """
    entry = F.struct("position", F.concat_ws(":", "name", F.col("size").cast("string")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    return files.agg(F.substring(F.sha2(F.concat_ws("|", ordered), 256), 1, 16).alias("id")).first()["id"]


def already_loaded(table: DataFrame, batch_id: str) -> bool:
    """Whether a table holds rows of this batch; reads at most one row."""
    return not table.where(F.col("load_batch_id") == batch_id).limit(1).isEmpty()


def with_source_row_num(rows: DataFrame) -> DataFrame:
    """Add ``source_file`` and ``source_row_num`` to rows freshly read from split text files.

    Rows are counted where they are read: a task's running id less the split's first id is the place in the split, and a
    short table (one row per split) says how many rows of the file come before it. No row is shuffled. Not for
    ``multiLine`` files. If the two passes cut a file differently the job fails instead of giving wrong numbers.
    """
    located = rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    split = ["_path", "_block", "_length"]
    sizes = located.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"), F.min("_seen").alias("_first"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, "_rows", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_seen") - F.col("_first")
    checked = F.when(place.between(0, F.col("_rows") - 1), F.col("_offset") + place + F.lit(FIRST_ROW))
    changed = F.raise_error(F.lit("file splits changed between two passes")).cast("bigint")
    number = F.coalesce(checked, changed).alias("source_row_num")
    return located.join(offsets, split, "left").select(*rows.columns, "source_file", number)


def read_dataset_csv(spark: SparkSession, folder: str, number_rows: bool = True) -> dict[str, DataFrame]:
    """The four files as frames of strings, with file name and row number."""
    source_files(spark, folder)
    frames = {}
    for name in DATASET_FILES:
        # The header is checked against the schema; the escape is the doubled quote.
        rows = (
            spark.read.schema(CSV_SCHEMAS[name])
            .option("header", True)
            .option("enforceSchema", False)
            .option("escape", '"')
            .csv(f"{folder}/{name}")
        )
        frames[name] = with_source_row_num(rows) if number_rows else rows
    return frames
