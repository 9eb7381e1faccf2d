import hashlib
import random
import re
from zlib import crc32

import pytest

from behavior_spark.llm import periodic_runs as P
from behavior_spark.llm.queries import QUERIES
from tests.llm.helpers import awkward, frame

FOLDER = "/root/testdata/sf0.001"


def slow(words: list, exponent: int = 4, shortest: int = 6) -> list[tuple]:
    """All runs from the definition: every period, every stretch that it explains, smallest periods only."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            smaller = (q for q in range(1, p) if p % q == 0 and all(words[t] == words[t + q] for t in range(i, i + length - q)))
            if j > i and length >= max(exponent * p, shortest) and next(smaller, None) is None:
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_text(rnd: random.Random, most: int) -> list[int]:
    words = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, most))]
    if words and rnd.random() < 0.7:
        a = rnd.randrange(len(words))
        p = 1 + (len(words) - a) // rnd.randint(3, 10)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rnd.random() < 0.4:
            words = words + [rnd.randrange(3)] + words
    return words


def listed(runs) -> list[tuple]:
    return [tuple(r) for r in runs.tolist()]


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        texts = [some_text(rnd, 90) for _ in range(rnd.randint(1, 4))]
        assert [listed(r) for r in P.runs_of(texts)] == [slow(t) for t in texts]


def test_other_settings():
    rnd = random.Random(6)
    for _ in range(100):
        text = some_text(rnd, 90)
        assert listed(P.runs_of([text], P.Repetition(5, 8))[0]) == slow(text, 5, 8)
    with pytest.raises(ValueError):
        P.Repetition(3)


def test_pieces_of_any_size_give_the_same_runs():
    rnd = random.Random(7)
    for _ in range(60):
        text = P.np.array(some_text(rnd, 150), P.np.int64)
        results = []
        for most in (1, 2, 13, 1000):
            detector, at = P.Detector(len(text)), 0
            while at < len(text):
                step = rnd.randint(1, most)
                detector.append(text[at : at + step])
                at += step
            results.append(listed(detector.finish()))
        assert all(r == results[0] == slow(text.tolist()) for r in results)


def test_squares_are_reported_when_they_end():
    detector = P.Detector(100)
    assert detector.append(P.np.array([1, 2] * 10)) == 0
    assert detector.append(P.np.array([7, 8, 9, 10, 11, 12, 13, 14])) > 0


def test_names_that_clash_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "named", lambda x: x % P.np.uint64(3))
    rnd = random.Random(8)
    for _ in range(100):
        text = some_text(rnd, 60)
        assert listed(P.runs_of([text])[0]) == slow(text)


def test_one_word_many_times_and_long_periods():
    assert listed(P.runs_of([["x"] * 200_000])[0]) == [(0, 200_000, 1)]
    block = [f"w{i}" for i in range(5_003)]
    assert listed(P.runs_of([["a", *block * 5, "b"]])[0]) == [(1, 25_015, 5_003)]
    nested = (["a"] * 7 + ["b"]) * 9
    assert listed(P.runs_of([nested])[0]) == slow(nested)


def test_collapsed():
    words = "a b a b a b a b c".split()
    assert P.collapsed(words, P.runs_of([words])[0]) == ["a", "b", "c"]


def contract(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow(words)
    best = min(runs, key=lambda r: (-P.np.float64(r[1]) / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    text = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    milli = None if not runs else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 1500}
    got = {r[0]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i in short) > 5
    for doc_id, text in short.items():
        assert got[doc_id] == contract(doc_id, text)


def test_awkward_rows_and_clashing_columns(spark, folder):
    docs = frame(spark, awkward() + [(77, "a b " * 50, "en", "s", 0, "", 0, "h", 0, "")]).withColumnRenamed("kept", "runs")
    out = P.found(P.planted(docs))
    assert [c for c in out.columns if c not in ("runs", "collapsed")] == [c for c in docs.columns if c != "runs"]
    assert out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[4].collapsed == by_id[5].collapsed == by_id[6].collapsed == "" and by_id[4].runs == []
    assert [tuple(r) for r in by_id[12].runs] == [(0, 400, 1)] and by_id[12].collapsed == "x"
    assert P.found(frame(spark, [])).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect())))
    short = [tuple(r)[:2] for r in docs.collect() if len((r.text or "").split()) < 1500]
    assert len(got) == docs.count() and {str(contract(*r)) for r in short} <= set(got)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 100_003}" for i in range(1_200_000)) + " " + "la " * 300_000
    (row,) = P.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("runs").collect()
    assert [tuple(r) for r in row.runs] == [(0, 1_200_000, 100_003), (1_200_000, 300_000, 1)]
