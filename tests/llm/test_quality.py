from collections import Counter

import pytest

from behavior_spark.llm import quality_rules as Q
from tests.llm.helpers import PROSE, awkward, frame


def slow(text: str | None) -> tuple:
    """The measures by plain loops."""
    space = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in space:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(space):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_measures_and_base_rules(spark):
    extra = [(20, (PROSE + "\n") * 4), (21, "# $ <b> | " + PROSE), (22, PROSE + " " + PROSE[::-1] + " " + PROSE)]
    rows = awkward() + [(i, t, None, None, 0, "", 0, "", 0, "") for i, t in extra]
    docs = frame(spark, rows)
    got = Counter(tuple(r)[:7] + (r.kept,) for r in Q.judge(docs, Q.plan(docs)).collect())
    assert sum(got.values()) == len(rows)
    measured = Counter(k[:6] for k in got.elements())
    assert measured == Counter((i, *slow(t)) for i, t, *_ in rows)
    for _, n, *_, repeats, failed, kept in got:
        assert failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (failed and kept)


def test_order_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = len(Q.RULES)
    verdicts = [{r.doc_id: (r.kept, r.base_failed) for r in Q.judge(docs, Q.Cascade(Q.RULES, order)).collect()} for order in (tuple(range(n)), tuple(range(n))[::-1])]
    assert verdicts[0] == verdicts[1]
    kept = {r.doc_id for r in Q.passing(docs, Q.plan(docs)).collect()}
    assert kept == {i for i, (k, _) in verdicts[0].items() if k}


def test_rules_with_more_rejections_per_cost_come_first():
    rules = tuple(Q.Rule(x, lambda t: False) for x in "abc")
    measured = [([True, False, True], [1.0, 1.0, 0.1])] * 3 + [([False, True, False], [1.0, 1.0, 0.1])] * 2
    assert [rules[i].name for i in Q.ordered(rules, measured).order] == ["c", "b", "a"]


def test_a_rule_after_the_first_rejection_does_not_run():
    def never(_):
        raise AssertionError("ran")

    cascade = Q.Cascade((Q.Rule("late", never), Q.Rule("first", lambda t: True)), (1, 0))
    assert cascade.failed(Q.Text(b"x")) == "first"


def test_clean_documents_pass_and_junk_fails(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.judge(docs, Q.plan(docs)).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_empty_table_and_columns(spark):
    docs = frame(spark, [])
    cascade = Q.plan(docs)
    assert Q.judge(docs, cascade).count() == 0
    assert Q.passing(docs, cascade).columns == docs.columns


@pytest.mark.parametrize("rows", [1999, 2001, 3000, 4000, 4001])
def test_sample_of_tables_around_the_sample_size(spark, rows):
    docs = spark.range(rows).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text")
    got = len(Q.measure(docs, Q.RULES[:1]))
    assert got == rows if rows <= 2000 else abs(got - 2000) < 200
