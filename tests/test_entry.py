"""Entry points, and some of the named queries against their SQL (``check.py`` runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import check
from behavior_spark import session
from behavior_spark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "normalize_events", "purchase_items", "orders_latest", "live_session_features", "rule_contributions", "top_leads",
    "heatmap_filtered", "session_stats", "page_filter_underscore", "category_coverage", "consent_gate", "mousemove_throttle",
    "rule_average_precision", "stratified_split",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_entry_gives_tiers(spark):
    assert {r.score_tier for r in entry_points.entry(spark).collect()} == {"hot", "warm", "cold"}


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    without = set(entry_points.queries()) - set(entry_points.oracle_sql())
    assert not any(name in catalog.QUERIES for name in without)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    cursor = db.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


class _Settings:
    """Stands in for a session: core settings cannot be changed at run time."""

    def __init__(self, master, **values):
        self.conf, self.sparkContext, self.master, self.values = self, self, master, values

    def get(self, key, default):
        return self.values.get("folder", default) if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_work_folder_comes_from_the_session(spark):
    assert session.work_dir(_Settings("yarn", folder="/shared/checkpoints/")) == "/shared/checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(_Settings("yarn"))
    assert session.work_dir(spark)
    assert session.new_folder(spark, "x").startswith("file:/")
