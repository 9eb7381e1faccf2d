"""Language of web pages and documents by Bayesian evidence fusion.

Four kinds of evidence are added up as log-probabilities for each language:

- the text: a naive Bayes model over hashed byte n-grams, tempered by the text's length, trained on a bounded sample of labelled documents;
- the language declared in the markup (``<html lang=...>``): how often pages of a language declare it;
- the address suffix (the last label of the host): how often pages of a language are found under it;
- the host: how often it holds the language, smoothed towards its parent domain, and that towards the whole corpus.

The last three are tables counted by grouped aggregation over all rows, weighted with what the text alone says; a row's own
share is taken out of the counts that judge it. Hot hosts are combined before the shuffle like any other aggregate, and
the tables are joined back on short keys (AQE splits a hot one).

Defined results: null and empty texts leave the text's evidence even, so the other kinds decide; with none of them the prior does. Null or
unreadable addresses have no host and share the null group. Rows that repeat are judged alike. Without any labelled row every language list is
empty and the result has null languages. An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import map_rows, texts_of, written


@dataclass(frozen=True)
class Fusion:
    per_language: int = 1500  # labelled documents of each language in the training sample (expected number)
    features: int = 1 << 14
    temper: float = 0.02  # weight of an n-gram: they are far from independent
    most_text: float = 12.0  # the text's evidence is at most so many nats apart
    kappa: float = 8.0  # pseudo-counts of a smoothed prior
    seed: int = 3


TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")


def visible(page: bytes) -> bytes:
    """The text of a page without markup."""
    return html.unescape(TAGS.sub(b" ", page).decode("utf-8", "replace")).encode()


def grams(raw: bytes, size: int) -> np.ndarray:
    """Counts of hashed byte n-grams of one to four bytes, letters in lower case; long texts go in pieces."""
    return sum((_grams(raw[at : at + (1 << 18)], size) for at in range(0, len(raw), 1 << 18)), np.zeros(size))


def _grams(raw: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(size)
    key = np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        key = key[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] if len(data) >= n else key[:0]
        hashed = (key * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(8)
        total += np.bincount(hashed % np.uint32(size), minlength=size)
    return total


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # (languages, features): log-probabilities, centred over the languages
    conf: Fusion

    def evidence(self, raw: bytes) -> np.ndarray:
        """Log-likelihood of the text for each language, the best being 0."""
        if not raw.strip() or not self.languages:
            return np.zeros(len(self.languages))
        total = self.weights @ grams(raw, self.conf.features) * self.conf.temper
        return np.maximum(total - total.max(), -self.conf.most_text)


def train(labelled: DataFrame, conf: Fusion = Fusion()) -> TextModel:  # noqa: B008
    """From (text, lang): n-gram counts of a hash sample of each language, summed by Spark; one short vector per language reaches the driver.

    Rows are drawn by text and ``doc_id``, where there is one, so copies of a text are drawn one by one. Every label that occurs is learnt, from whole texts.
    """
    own = [F.col("doc_id")] if "doc_id" in labelled.columns else []
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text", *own, F.lit(conf.seed)).alias("draw"))
    rows = rows.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return TextModel([], np.zeros((0, conf.features)), conf)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, conf.per_language / r["count"]))])
    drawn = F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * F.lit(float(1 << 30))
    rows = rows.where(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                held[lang] = held.get(lang, 0) + grams(raw, conf.features)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["lang", "f", "n"])

    total = rows.mapInArrow(count, "lang string, f int, n double").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in counts)
    table = np.full((len(languages), conf.features), 0.5)
    for r in total.collect():  # at most features rows per language
        table[languages.index(r.lang), r.f] += r.n
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    return TextModel(languages, logs - logs.mean(axis=0), conf)


def described(rows: DataFrame, model: TextModel) -> DataFrame:
    """(kind, id, declared, host, domain, suffix, text_evidence) from (kind, id, text, markup, address)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages x features, bounded by the settings

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        markup = batch.column("markup").to_pylist()
        scores = [m.evidence(visible(t) if is_page else t).tolist() for t, is_page in zip(texts_of(batch), markup, strict=True)]
        names = ["kind", "id", "declared", "host"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.list_(pa.float64()))], [*names, "text_evidence"])

    declared = F.when(F.col("markup"), F.lower(F.nullif(F.regexp_extract("text", DECLARED.pattern, 1), F.lit(""))))
    host = F.lower(F.nullif(F.regexp_extract("address", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    given = rows.select("kind", "id", "text", "markup", declared.alias("declared"), host.alias("host"))
    out = map_rows(given, work, "kind string, id long, declared string, host string, text_evidence array<double>")
    labels = F.split("host", r"\.")
    parts = F.size(labels)
    out = out.withColumn("suffix", F.when(parts > 1, F.element_at(labels, -1)))
    return out.withColumn("domain", F.when(parts > 1, F.concat_ws(".", F.slice(labels, F.greatest(parts - 1, F.lit(1)), 2))).otherwise(F.col("host")))


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """For each key the summed text posteriors, as an array."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])
    return sums.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.array(*[f"s{i}" for i in range(n)]).alias(name))


def _joined(df: DataFrame, sums: DataFrame, keys: list[str], name: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys])
    return df.join(sums, same, "left").drop(*[f"{name}_{k}" for k in keys])


def fused(rows: DataFrame, model: TextModel) -> DataFrame:
    """(kind, id, language, confidence, text_language, declared, host): the language of every row of ``described`` rows.

    ``confidence`` is the posterior of ``language``; ``text_language`` is what the text alone says.
    """
    n, conf = len(model.languages), model.conf
    if not n:
        unknown = F.lit(None).cast("string")
        return described(rows, model).select(
            "kind", "id", unknown.alias("language"), F.lit(None).cast("double").alias("confidence"), unknown.alias("text_language"), "declared", "host"
        )
    names = F.array(*[F.lit(x) for x in model.languages])
    base = written(described(rows, model).withColumn("p", _softmax(F.col("text_evidence"))), "evidence")
    total = base.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    whole = [float(x) for x in total]
    every = F.array(*[F.lit(x) for x in whole])
    out = base
    for name, keys in (("by_declared", ["declared"]), ("by_suffix", ["suffix"]), ("by_domain", ["suffix", "domain"]), ("by_host", ["domain", "host"])):
        out = _joined(out, _sums(base, keys, n, name), keys, name)
    size = max(sum(whole), 1.0)
    prior = F.transform(every, lambda s: (s + F.lit(1.0)) / F.lit(size + n))

    def others(name: str) -> Column:
        """Counts without the row's own share."""
        return F.zip_with(F.col(name), F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def add(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)

    def smoothed(name: str, towards: Column) -> Column:
        """Share of each language, drawn towards a wider group's."""
        return F.zip_with(others(name), towards, lambda s, q: (s + F.lit(conf.kappa) * q) / (add(others(name)) + F.lit(conf.kappa)))

    out = out.withColumn("domain_prior", smoothed("by_domain", prior))
    out = out.withColumn("host_prior", smoothed("by_host", F.col("domain_prior")))

    def likelihood(name: str) -> Column:
        """P(value | language): what the rest of the corpus says, with the value's own share of it as pseudo-counts."""
        value_share = (add(others(name)) + 1) / F.lit(size + 1)
        return F.zip_with(others(name), every, lambda s, w: (s + F.lit(conf.kappa) * value_share) / (w + F.lit(conf.kappa)))

    out = out.withColumn("declared_likelihood", likelihood("by_declared")).withColumn("suffix_likelihood", likelihood("by_suffix"))
    log = lambda c: F.transform(c, lambda v: F.log(F.greatest(v, F.lit(1e-12))))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    even = F.array(*[F.lit(0.0)] * n)
    evidence = plus(F.col("text_evidence"), log(F.col("host_prior")))
    evidence = plus(evidence, F.when(F.col("declared").isNotNull(), log(F.col("declared_likelihood"))).otherwise(even))
    evidence = plus(evidence, F.when(F.col("suffix").isNotNull(), log(F.col("suffix_likelihood"))).otherwise(even))
    out = out.withColumn("posterior", _softmax(evidence))
    best = F.array_max("posterior")
    return out.select(
        "kind", "id", F.element_at(names, F.array_position("posterior", best).cast("int")).alias("language"), best.alias("confidence"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_language"), "declared", "host",
    )


def rows_of(pages: DataFrame | None, docs: DataFrame | None) -> DataFrame:
    """Pages (page_id, url, html) and documents (doc_id, text, source as their host) in one shape."""
    parts = []
    if pages is not None:
        parts.append(pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("text"),
                                  F.lit(True).alias("markup"), F.col("url").cast("string").alias("address")))
    if docs is not None:
        parts.append(docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                                 F.lit(False).alias("markup"), F.col("source").cast("string").alias("address")))
    return reduce(DataFrame.unionByName, parts)
