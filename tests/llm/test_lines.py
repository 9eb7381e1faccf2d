import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from behavior_spark.llm import line_dedup as L
from tests.llm.helpers import PROSE, SECOND, awkward, frame


def key_of(lines, i, long):
    """The shortest run from line i on with enough bytes."""
    if not lines[i]:
        return None
    for end in range(i + 1, len(lines) + 1):
        if sum(map(len, lines[i:end])) >= long:
            return tuple(lines[i:end])
    return None


def longest_rising(cards):
    """A longest sequence of cards (i, j) that rises in both; the one that patience sorting gives."""
    cards = sorted(cards)
    return [cards[k] for k in L.rising([j for _, j in cards])]


def slow(rows, long=24):
    """The definition by plain loops over documents in order; (id, text) must be unique."""
    docs = [[x.strip() for x in (t or "").encode().split(b"\n")] for _, t in rows]
    out, first = [set() for _ in rows], {}
    keys = []
    for d, lines in enumerate(docs):
        own = [key_of(lines, i, long) for i in range(len(lines))]
        keys.append([None if k is None else (k, own[:i].count(k)) for i, k in enumerate(own)])
        if any(lines) and first.setdefault(tuple(lines), d) != d:
            out[d] = set(range(len(lines)))
            keys[d] = []
    for d, lines in enumerate(docs):
        links = defaultdict(list)
        for k in keys[d]:
            holders = [e for e in range(d) if k is not None and k in keys[e]]
            if holders:
                links[holders[-1]].append(keys[holders[-1]].index(k))
        for e, at in links.items():
            low, high = max(0, min(at) - len(lines)), max(at) + len(lines)
            cards = [(keys[d].index(k), j) for j, k in enumerate(keys[e]) if low <= j <= high and k is not None and k in keys[d]]
            for i, j in longest_rising(cards):
                for step in (1, -1):
                    x, y = i, j
                    while 0 <= x < len(lines) and low <= y <= min(high, len(docs[e]) - 1) and lines[x] == docs[e][y]:
                        out[d].add(x)
                        x, y = x + step, y + step
    return out


def left(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_longest_rising_sequence():
    for places in ([], [3], [1, 2, 3], [3, 2, 1], [2, 9, 4, 7, 1, 8], [5, 1, 6, 2, 7, 3]):
        got = [places[i] for i in L.rising(places)]
        best = max(len(c) for n in range(len(places) + 1) for c in combinations(places, n) if list(c) == sorted(set(c)))
        assert got == sorted(set(got)) and len(got) == best


def test_whole_table_equals_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i: left(t, g) for (i, t), g in zip(rows, slow(rows))}
    got = {r.doc_id: (r.text, r.n_removed) for r in L.report(docs).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n for _, n in got.values()) > 0
    edited = L.deduplicated(docs)
    assert edited.columns == docs.columns
    assert {r.doc_id: r.text for r in edited.collect()} == want
    assert edited.where("n_chars != char_length(text)").count() == 0


def test_blocks_grow_and_crossed_lines_stay(spark):
    a, b = PROSE, SECOND
    rows = [(1, f"{a}\nshort\n\n{b}\nend"), (2, f"other start of this text here\n{a}\nshort\n\n{b}\nnot the end"), (3, f"{b}\n{a}"), (4, "short\nend")]
    docs = frame(spark, [(i, t, None, None, 0, "", 0, "", 0, "") for i, t in rows])
    got = {r.doc_id: r.text for r in L.report(docs).collect()}
    assert got[1] == rows[0][1] and got[4] == rows[3][1]
    assert got[2] == "other start of this text here\nnot the end"
    assert got[3] in (a, b)  # one line is aligned, the crossed one stays


def test_awkward_rows(spark):
    docs = frame(spark)
    kept = L.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(awkward())
    by_id = defaultdict(list)
    for r in kept.collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[None] and PROSE in by_id[None]  # null ids come first
    assert by_id[1] == [""] and by_id[2] == [""] and by_id[4] == [None] and by_id[5] == [""]
    assert by_id[9] == ["" if by_id[8] != [""] else by_id[9][0]]
    assert L.report(frame(spark, [])).count() == 0 and L.deduplicated(frame(spark, [])).count() == 0


def edited(spark, rows, conf=L.Alignment()):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in L.report(docs, conf).collect()}


def test_random_lines_equal_loops(spark):
    """Few different lines, so that most of them repeat inside and across documents."""
    rnd = random.Random(4)
    some = [PROSE, SECOND, "short", "tiny", "", "a line of middle length", "another one like it here", "x"]
    rows = [(i, "\n".join(rnd.choice(some) for _ in range(rnd.randint(1, 9)))) for i in range(150)]
    assert edited(spark, rows) == {i: left(t, g) for (i, t), g in zip(rows, slow(rows), strict=True)}
    assert edited(spark, rows, L.Alignment(long=1)) == {i: left(t, g) for (i, t), g in zip(rows, slow(rows, 1), strict=True)}


def test_copies_lose_every_line(spark):
    a, b = PROSE, SECOND
    both = f"{a}\nshort\n{b}"
    rows = [(1, a), (2, b), (3, both), (4, both), (5, "two words\nand three words"), (6, "two words\nand three words"), (7, "x"), (8, "x "), (9, "短い"), (10, "短い")]
    got = edited(spark, rows)
    assert got[4] == got[6] == got[8] == got[10] == "" and got[3] == "short" and got[5] and got[7] and got[9]


def test_a_document_is_aligned_with_the_copy_it_comes_from(spark):
    """Its lines were in other documents before; all of them are in the third one, in another order than in the first two."""
    one, two, three = PROSE, SECOND, "a third line that is long enough to link documents"
    rows = [(1, f"{one}\n{two}"), (2, f"{three}\n{one}"), (3, f"{two}\n{one}\ntiny\n{three}"), (4, f"{two}\n{one}\ntiny\n{three}\nthe end of the fourth document")]
    got = edited(spark, rows)
    assert got[4] == "the end of the fourth document"


def test_exact_copies_of_a_large_table_keep_no_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    copies = docs.join(first, "text").where("doc_id > first and length(trim(text)) > 0").select("doc_id")
    left_over = L.report(docs).join(copies, "doc_id").where("text <> ''")
    assert copies.count() > 100 and left_over.count() == 0


def test_a_line_that_every_document_holds(spark):
    rows = [(i, f"the license line that every document holds, word for word\nown line number {i} of this table of documents") for i in range(3000)]
    got = edited(spark, rows)
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].split("\n")[1] for i in range(1, 3000))


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i} of a text of many megabytes, with enough words to be told apart" for i in range(300_000))
    got = edited(spark, [(1, text), (2, text + "\nend"), (3, "start\n" + text[: len(text) // 2])])
    assert got[1] == text and got[2] == "end" and got[3].startswith("start")


def test_a_line_that_crosses_in_the_nearest_holder_is_aligned_with_one_before(spark):
    a, b, c = PROSE, SECOND, "a third line that is long enough to be a key of its own"
    rows = [(1, f"{a}\n{b}"), *[(n, f"{b}\n{a}\nends of number {n} that nobody else has at all") for n in range(2, 9)], (9, f"{a}\n{b}\n{c}")]
    # 9 finds both lines in order in 1 only, seven holders back.
    assert edited(spark, rows, L.Alignment(farther=True))[9] == c
    assert edited(spark, rows)[9] != c
    # No holder has both in order: one of them stays.
    assert edited(spark, [(1, f"{b}\n{a}"), (2, f"{a}\n{b}\n{c}")], L.Alignment(farther=True))[2] in (f"{a}\n{c}", f"{b}\n{c}")


def test_farther_holders_on_random_lines_equal_loops_over_all_of_them(spark):
    rnd = random.Random(8)
    some = [PROSE, SECOND, "a line of middle length, no more", "another one like it, right here", "the fifth of the lines that come often"]
    rows = [(i, "\n".join([*rnd.sample(some, rnd.randint(1, 5)), f"line of document {i} and nobody else"])) for i in range(60)]
    keys = [t.encode().split(b"\n") for _, t in rows]
    want = {}
    for d, (_, text) in enumerate(rows):
        gone = slow(rows[: d + 1])[d]
        for e in range(d):
            if any(k in keys[e] for i, k in enumerate(keys[d]) if i not in gone):
                cards = [(i, keys[e].index(k)) for i, k in enumerate(keys[d]) if k in keys[e]]
                gone = gone | {i for i, _ in longest_rising(cards)}
        want[d] = left(text, gone)
    got = edited(spark, rows, L.Alignment(farther=True))
    assert {i for i in got if got[i].count("\n") > want[i].count("\n")} == set()
    assert got != edited(spark, rows)
