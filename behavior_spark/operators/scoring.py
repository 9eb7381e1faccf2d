"""Rule-based lead scores. Rules are data: a name, a delta and a Spark predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark.functions import round_half_even

# Tier limits and score range.
HOT_FROM = 60
WARM_FROM = 30
LOWEST, HIGHEST = 0, 100


@dataclass(frozen=True)
class Rule:
    """One scoring rule; ``predicate`` is a Spark SQL condition over the feature columns."""

    name: str
    delta: int
    predicate: str

    @property
    def column(self) -> str:
        return f"rule_{self.name}"

    def flag(self) -> Column:
        """1 if the rule fires, else 0; a predicate over NULL does not fire."""
        return F.when(F.expr(self.predicate), 1).otherwise(0)


# The rule table.
RULES: tuple[Rule, ...] = (
    Rule("add_to_cart", 30, "add_to_cart_count > 0"),
    Rule("purchase", 20, "purchase_count > 0"),
    Rule("browsing_depth", 15, "distinct_products_viewed >= 3"),
    Rule("search_intent", 10, "search_count > 0"),
    Rule("scroll_engagement", 10, "max_scroll_pct > 70.0"),
    Rule(
        "bouncer",
        -10,
        "page_views = 1 AND product_views + add_to_cart_count + purchase_count + search_count = 0",
    ),
)

SCORE_KEYS = ("session_id", "anonymous_user_id", "source", "first_event_at", "last_event_at")


def tier(score: Column) -> Column:
    """Label of a score on the 0..100 scale."""
    return F.when(score >= HOT_FROM, "hot").when(score >= WARM_FROM, "warm").otherwise("cold")


def as_percent(probability: Column, digits: int) -> Column:
    """A probability as a percentage."""
    return round_half_even(probability.cast("double") * 100, digits)


def contributions(rules: Sequence[Rule] = RULES) -> Column:
    """Map from the name of every fired rule to its delta; needs the flag columns."""
    fired = F.filter(
        F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.delta).alias("delta"), F.col(r.column).alias("on")) for r in rules]),
        lambda entry: entry["on"] == 1,
    )
    return F.map_from_entries(F.transform(fired, lambda entry: F.struct(entry["name"], entry["delta"])))


def lead_score(rules: Sequence[Rule] = RULES) -> Column:
    """Sum of the deltas of the rules that fire, within 0..100."""
    total = reduce(add, [r.flag() * r.delta for r in rules], F.lit(0))
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), total)).cast("int")


def score(features: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Score, tier and one 0/1 flag per rule for every session; no shuffle, no UDF."""
    keys = [c for c in SCORE_KEYS if c in features.columns]
    flags = [r.flag().alias(r.column) for r in rules]
    scored = features.select(*keys, lead_score(rules).alias("lead_score"), *flags)
    return scored.select(
        *keys, "lead_score", tier(F.col("lead_score")).alias("score_tier"), *[r.column for r in rules]
    )


def score_with_contributions(features: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """As ``score``, with the map of fired rules instead of the flags."""
    scored = score(features, rules).withColumn("rule_contributions", contributions(rules))
    return scored.drop(*[r.column for r in rules])
