import hashlib
import random


from behavior_spark.llm import substring_dedup as R
from tests.llm.helpers import awkward, frame, texts


def slow(rows, width=20):
    """Sorted (id, words, removed, digest) by a set of all windows seen so far."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for p in range(len(words) - width + 1):
            window = tuple(words[p : p + width])
            if window in seen:
                covered[p : p + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out.append((doc_id, len(words), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, conf=R.Recompression()):
    return sorted((tuple(r) for r in R.removed(docs, conf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_names_depend_on_the_window_alone():
    rng = random.Random(3)
    for _ in range(150):
        letters, width = rng.choice(["ab", "abc", "abcdefghijklmnopqrstuvwxyz"]), rng.choice([4, 7, 20])
        docs = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).encode() for i in range(5)]
        docs += [docs[0] + b" x " + docs[1], b"q " + docs[2][4:]]
        names, count = {}, {}
        for raw, (runs, windows) in zip(docs, R.runs_of(docs, R.Recompression(width=width)), strict=True):
            words, keys = raw.split(), R.np.repeat(runs, windows).tolist()
            assert len(keys) == max(0, len(words) - width + 1)
            for p, key in enumerate(keys):
                window = tuple(words[p : p + width])
                assert names.setdefault(window, key) == key
                count[window] = count.get(window, 0) + 1


def test_stretches():
    row, pos, size = R.stretches(R.np.array([2, 1, 1, 1, 2]), R.np.array([0, 5, 3, 4, 2]))
    assert list(zip(row.tolist(), pos.tolist(), size.tolist(), strict=True)) == [(1, 3, 3), (2, 0, 1), (2, 2, 1)]


def test_words_are_told_apart():
    lanes = R.word_hashes("a b\tab ba \n a é é ".encode() + b"z" * 50)
    assert len(lanes[0]) == 8 and len(set(lanes[0].tolist())) == 7 and lanes[0][0] == lanes[0][4]
    long = b" ".join(b"w%d" % i for i in range(400_000))
    assert (R.word_hashes(long)[0] == R._hash_piece(long)[0]).all()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(docs.repartition(7)) == slow(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_repetitive_texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(100, "a " * 300), (101, "a b " * 200), (102, "a b c " * 100), (103, "a " * 25)]
    for width in (5, 20):
        assert run(texts(spark, rows).repartition(5), R.Recompression(width=width)) == slow(rows, width)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    docs = frame(spark)
    digests = {t: docs.sparkSession.sql("select xxhash64(cast(:t as string))", args={"t": t}).first()[0] if t is not None else 42 for _, t in rows}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digests[r[1]]))
    assert run(docs) == slow(ordered)
    assert run(frame(spark, [])) == []


def test_small_blocks_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = slow(sorted((r.doc_id, r.text) for r in docs.collect()))
    for size in (1, 20_000, 1 << 30):
        assert run(docs, R.Recompression(block_bytes=size)) == expected


def test_a_very_long_text(spark):
    words = [f"w{i % 70_001}" for i in range(900_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:60_000]))]
    got = run(texts(spark, rows))
    assert [r[:3] for r in got] == [(1, 900_000, 900_000 - 70_001 ), (2, 59_900, 59_900)]
