"""Quality rules as a short-circuit cascade.

Every rule rejects or passes one text. On a sample the cost of each rule (time per text) and its selectivity (share
rejected of what the rules before it pass) are estimated; the rule with the most rejections per cost runs first. A text is
dropped by the first rule that rejects it, later rules do not look at it. The order changes the cost, never the verdict.

Defined results: a null text has no words; texts without words fail ``few_words``. Rows are judged one by one,
so repeated rows get repeated results and ids may be null. Other columns are not looked at.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import map_rows, texts_of

SYMBOLS = b"#*$%&|<>"
WORDY = re.compile(r"[^\W\d_]")


class Text:
    """A text with its measures, each worked out when it is first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        first: dict[tuple, int] = {}
        hit = bytearray(len(words))
        for i, window in enumerate(windows):
            j = first.setdefault(window, i)
            if j != i:
                hit[i : i + 3] = b"\1\1\1"
                hit[j : j + 3] = b"\1\1\1"
        return sum(hit)

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if w.isalpha() or WORDY.search(w.decode()))

    @cached_property
    def n_ellipsis_lines(self) -> int:
        return sum(1 for x in self.lines if x.rstrip().endswith((b"...", "…".encode())))

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(1 for x in self.lines if x.lstrip().startswith((b"- ", b"* ", "•".encode())))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# The two base rules of the query's contract, then thresholds in use for web text, wide enough for ordinary prose.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
RULES = BASE + (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("letters", lambda t: 10 * t.n_letter_words < 6 * t.n_words),
    Rule("ellipsis_lines", lambda t: len(t.lines) > 3 and 10 * t.n_ellipsis_lines > 5 * len(t.lines)),
    Rule("bullet_lines", lambda t: len(t.lines) > 3 and 10 * t.n_bullet_lines > 9 * len(t.lines)),
)
SAMPLE = 2000  # texts on which cost and selectivity are estimated (expected number)


@dataclass(frozen=True)
class Cascade:
    """The rules in the order in which they run, by position in ``rules``."""

    rules: tuple[Rule, ...]
    order: tuple[int, ...]

    def failed(self, text: Text) -> str | None:
        """The first rule that rejects the text."""
        for i in self.order:
            if self.rules[i].rejects(text):
                return self.rules[i].name
        return None


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> list[tuple[list[bool], list[float]]]:
    """Verdict and seconds of every rule on a hash sample of about ``sample`` texts (every text of a smaller table)."""
    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("h"))
    rows = texts.count()
    if rows > sample:
        texts = texts.where(F.pmod("h", F.lit(rows)) < sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        verdicts, seconds = [], []
        for raw in texts_of(batch):
            some, took = [], []
            for rule in rules:
                text = Text(raw)  # nothing shared: the rule's whole cost
                began = time.perf_counter()
                some.append(rule.rejects(text))
                took.append(time.perf_counter() - began)
            verdicts.append(some)
            seconds.append(took)
        return pa.RecordBatch.from_arrays([pa.array(verdicts, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], ["v", "s"])

    return [(r.v, r.s) for r in map_rows(texts, work, "v array<boolean>, s array<double>").collect()]


def ordered(rules: tuple[Rule, ...], measured: list[tuple[list[bool], list[float]]]) -> Cascade:
    """Greedy: again and again the rule with the most rejections, among texts still passing, per second spent on them."""
    left, passing, order = list(range(len(rules))), list(measured), []
    while left:

        def gain(i: int, passing=passing) -> tuple[float, float]:
            cost = sum(s[i] for _, s in passing) + 1e-12
            return sum(v[i] for v, _ in passing) / cost, -cost

        best = max(left, key=gain)
        order.append(best)
        left.remove(best)
        passing = [x for x in passing if not x[0][best]]
    return Cascade(rules, tuple(order))


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> Cascade:
    return ordered(rules, measure(docs, rules, sample))


def judge(docs: DataFrame, cascade: Cascade, base: tuple[str, ...] = tuple(r.name for r in BASE)) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``kept`` and ``rejected_by`` (first rule in the cascade's order)."""
    fixed = [r for r in cascade.rules if r.name in base]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in texts_of(batch):
            t = Text(raw)
            by = cascade.failed(t)
            base_failed = by in base or (by is not None and any(r.rejects(t) for r in fixed))
            rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base_failed, by is None, by))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    ddl += ", base_failed boolean, kept boolean, rejected_by string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, ddl)


def passing(docs: DataFrame, cascade: Cascade) -> DataFrame:
    """The documents that no rule rejects, with all their columns; rules after the first rejection do not run."""

    def run(batches):
        for batch in batches:
            keep = [cascade.failed(Text(raw)) is None for raw in texts_of(batch)]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
