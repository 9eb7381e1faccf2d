import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from behavior_spark.llm import sentencepiece_codec as S
from tests.llm.helpers import awkward, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_random_texts(library):
    rng, codec = random.Random(4), S.codec(MODEL)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "日", "𓀀", "\t", "▁", "<s>", "1", "...", "\r", " " * 17, "\x00", "Ab", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids)


def test_backtracking_gives_what_merging_gives(library):
    rng, codec = random.Random(5), S.codec(MODEL)
    for _ in range(500):
        chunk = "".join(rng.choice("abcdeinorst▁") for _ in range(rng.randint(1, 14)))
        assert codec.pieces(chunk) == codec.merged(chunk)


def test_long_word_without_spaces(library):
    text = "abcdefghij" * 3000
    assert S.codec(MODEL).encode(text) == library.encode(text)


def test_every_row_has_its_digests(spark, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.encode(frame(spark), MODEL).collect())
    want = []
    for doc_id, text, *_ in awkward():
        ids = library.encode(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((doc_id or -1, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert S.encode(frame(spark, []), MODEL).count() == 0


def test_round_trip(spark):
    encoded = S.encode(frame(spark), MODEL, keep_ids=True)
    back = {(r.doc_id, r.text) for r in S.decode(encoded, MODEL).collect()}
    assert back == {(r.doc_id, r.decoded) for r in encoded.collect()}


def test_other_models_are_refused(tmp_path):
    with pytest.raises((ValueError, OSError, RuntimeError)):
        S.MergeCodec(str(tmp_path / "missing.model"))
