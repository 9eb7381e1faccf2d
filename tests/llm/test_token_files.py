import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from behavior_spark.llm import token_files as T
from tests.llm.helpers import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 500, T.BLOCK])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    wide = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    for ids in (np.zeros(n), rng.integers(0, 2, n), rng.integers(0, 50257, n), wide, wide >> rng.integers(0, 64, n).astype(np.uint64)):
        ids = ids.astype(np.uint64)
        back = T.unpack(T.pack(ids), n)
        assert len(back) == n and (back == ids).all()


def test_small_ids_share_words():
    assert len(T.pack(np.ones(600, np.uint64))) == 10
    assert len(T.pack(np.array([2**64 - 1], np.uint64))) == 2  # the escape and the id


def test_stretches_equal_the_library():
    rng, encoder = np.random.default_rng(3), T.Encoder(PATH)
    parts = ["a", "the", "Ing", " ", " ", "  ", "\n", "é", "日", "\t", "'s", "'", "12", "?!", "\x1c", "<|endoftext|>", "\x85", "　", ",", "."]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 15)))
        assert encoder.encode(text) == encoder.library.encode(text, add_special_tokens=False).ids, text


def expected(rows):
    library = Tokenizer.from_file(PATH)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_what_was_written(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files = T.write(docs, PATH, parts=5)
    assert files.count() == 5
    got = sorted(tuple(r) for r in T.read(files).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    library = Tokenizer.from_file(PATH)
    first = {r.doc_id: r.text for r in docs.where("doc_id < 20").collect()}
    for r in T.read_ids(files).where("doc_id < 20").collect():
        assert r.ids == [*library.encode(first[r.doc_id], add_special_tokens=False).ids, 0]


def test_awkward_rows(spark):
    files = T.write(frame(spark), PATH)
    got = [tuple(r) for r in T.read(files).collect()]
    want = expected([(r[0], r[1]) for r in awkward()])
    # Rows under one id come in the order of their digests: compare them as a set, and the starts as a sequence.
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), n, c) for i, _, n, c in want)
    starts = sorted((s, n) for _, s, n, _ in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert [i for i, *_ in sorted(got, key=lambda r: r[1])] == [i for i, *_ in want]


def test_empty_table_and_broken_file(spark, tmp_path):
    assert T.read(T.write(frame(spark, []), PATH)).count() == 0
    import pyarrow as pa

    (tmp_path / "x.s8b").write_bytes(b"0" * 100)
    with pytest.raises((ValueError, OSError, MemoryError)):
        T.Reader(pa.OSFile(str(tmp_path / "x.s8b")))


def test_signs_behind_words():
    import random

    import public_tokenizers

    e = T.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    words = ["word", "Ünter", "naïve", "日本", "x", "don't", "it's", "a1", "12", "<|endoftext|>", "end<|endoftext|>", "́", "é"]
    tails = ["", ".", ",", "...", "!!", "###", "$$$", ",***", "'s", ".'", "-", "--x", ")", '".', "…", "%%%", "<|", "|>", "'", "!?!?!?!?!?"]
    for _ in range(400):
        text = "".join(rnd.choice(words) + rnd.choice(tails) + rnd.choice([" ", " ", "\n", "  ", "\n\n"]) for _ in range(rnd.randint(1, 12)))
        assert e.encode(text) == e._ask(text), text


def counted(encoder):
    """The encoder with a library that notes how many characters it is asked for."""

    class Library:
        asked = 0

        def __init__(self, library):
            self.library = library

        def encode(self, text, **options):
            self.asked += len(text)
            return self.library.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            self.asked += sum(map(len, texts))
            return self.library.encode_batch_fast(texts, **options)

    encoder.library = Library(encoder.library)
    return encoder


def test_library_sees_new_stretches_once_and_nothing_else():
    e = counted(T.Encoder(PATH))
    words = [f"{a}{b}{c}" for a in ("ba", "ne", "Ko") for b in ("lu", "ti", "ra") for c in "bcdfghklmn"]
    text = " ".join(words) + "\n" + " ".join(w + x for w in words for x in (".", ",", "!?"))
    want = e.library.library.encode(text, add_special_tokens=False).ids
    assert e.encode(text) == want
    # Each word with a space; the first of each line with a newline too, and once more where it stands behind a space; signs behind a letter.
    assert e.library.asked <= sum(len(w) + 1 for w in words) + 2 * (len(words[0]) + 1) + len("a.a" + "a,a" + "a!?a")
    asked = e.library.asked
    assert e.encode(text) == want and e.library.asked == asked


def test_repeated_stretches_are_not_python_objects():
    import tracemalloc

    e = T.Encoder(PATH)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = " ".join(words * 1000)
    once = e.encode(" ".join(words))
    tracemalloc.start()
    (ids,) = e.encode_many([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 400_000
    assert ids[: len(once)].tolist() == once and len(ids) > 400_000


def test_many_texts_keep_their_places_and_forgotten_stretches_are_asked_again():
    import random

    import pyarrow as pa

    e, rnd = T.Encoder(PATH), random.Random(4)
    e.REMEMBERED, e.LONGEST = 50, 6
    parts = ["a", "the", "word", "longer", " ", " ", "\n", "\n\n", "  ", "é", "日本", "\t", "'s", "12", "?!", "<|endoftext|>", "\x00", "​", "Ġ", "Ċ", "]", "\\", "-", "^"]
    for _ in range(300):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 20))]
        got = [ids.tolist() for ids in e.encode_many(pa.array(texts, pa.string()))]
        assert got == [e.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert e.older and len(e.known) < 500


def test_words_hold_as_many_ids_as_they_can():
    rng = np.random.default_rng(6)
    for n in (1, 7, 61, 1000):
        ids = (rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)) >> rng.choice([0, 1, 4, 40, 50, 58, 63], n).astype(np.uint64)
        want, at = [], 0
        while at < n:
            for s, (count, bits) in enumerate(T.SELECTORS):
                held = ids[at : at + count].tolist()
                if all(x < 1 << bits for x in held):
                    want.append(s << 60 | sum(x << i * bits for i, x in enumerate(held)))
                    break
            else:
                held = ids[at : at + 1].tolist()
                want += [T.ESCAPE << 60, *held]
            at += len(held)
        assert T.pack(ids).tolist() == want


def test_blank_lines_and_a_last_newline_are_cut_too():
    e = counted(T.Encoder(PATH))
    for text in ("one two.\n\nthree\nfour\n", "x\n\ny z\n", "a\n\n\nb", "a\n\n", "a\n\n b", "a \n\nb", "\n\na"):
        assert e.encode(text) == e.library.encode(text, add_special_tokens=False).ids, text
    e.encode("one two.\n\nthree\nfour\n")
    asked = e.library.asked
    e.encode("one\ntwo.\n\nfour three\n\n" + "two three.\n\n" * 50 + "two\n")
    assert e.library.asked - asked <= len("\ntwo\n four two")
