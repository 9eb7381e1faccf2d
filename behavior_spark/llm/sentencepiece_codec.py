"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The encoding of a text by merges is the only sequence of pieces in which each piece, and each adjacent pair, merges
back to itself. So no merge queue is needed. An Aho-Corasick automaton gives the pieces that start at each
position; the longest one is tried first; it may follow the last piece if re-merging the two gives just these two
pieces; a position from which no piece leads on is marked in a bitfield and never tried again.

No piece has a space after another character or a newline, so texts are cut before each run of spaces, around newlines, and
between any two characters that are neighbours in no piece. The results of short chunks are remembered in each worker.

Defined results: null and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows get repeated
results, other columns are not looked at. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from behavior_spark.llm.common import map_rows, texts_of

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
MARK = re.compile(r"\W")
REMEMBERED, SHORT = 400_000, 48  # results that a worker remembers (about 100 MB), and their longest text


class MergeCodec:
    """Encoder for a SentencePiece BPE model with byte fallback and without text normalization."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.byte_ids = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self._refuse_others(path)
        # Pieces that their own text does not merge into never occur.
        self.reachable = {p for p in self.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.reachable:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.decimals = [str(i) for i in range(n)]
        self.parts: dict[str, tuple[int, ...]] = {}
        # Two characters that are neighbours in no piece stay apart: the text can be cut between them.
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    def _refuse_others(self, path: str) -> None:
        """This method is exact for merge models that leave the text as it is; anything else is an error."""
        texts = ["a  b ", "ﬁ① é", "\t\n x"]
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if len(self.byte_ids) != 256 or inner or any(self.library.decode(self.library.encode(t)) != t for t in texts):
            raise ValueError(f"{path}: not a merge model with byte fallback and unchanged text")

    def merged(self, text: str) -> list[str]:
        """Plain merging: the adjacent pair whose joined text scores best, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk, by backtracking."""
        size = len(chunk)
        if chunk in self.reachable:
            return [chunk]
        # Matches come in order of their ends, so the list of a start is in order of length.
        lengths: list[list[int]] = [[] for _ in range(size)]
        for end, length in self.automaton.iter(chunk):
            lengths[end - length + 1].append(length)
        for at, options in enumerate(lengths):
            if not options or options[0] != 1:
                options.insert(0, 1)  # a character without a piece of its own is spelled as bytes
        failed = bytearray((size >> 3) + 1)
        at, found, choice = 0, [], []
        option = len(lengths[0]) - 1 if size else 0
        while at < size:
            while option >= 0:
                end = at + lengths[at][option]
                if not failed[end >> 3] >> (end & 7) & 1 and (not found or self.follows(found[-1], chunk[at:end])):
                    break
                option -= 1
            if option >= 0:
                found.append(chunk[at:end])
                choice.append(option)
                at = end
                option = len(lengths[at]) - 1 if at < size else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(found.pop())
                option = choice.pop() - 1
        return found

    def part(self, chunk: str) -> tuple[int, ...]:
        known = self.parts.get(chunk)
        if known is None:
            ids: list[int] = []
            for piece in self.pieces(chunk):
                if piece in self.ids:
                    ids.append(self.ids[piece])
                else:
                    ids.extend(self.byte_ids[b] for b in piece.encode())
            known = tuple(ids)
            if len(chunk) <= SHORT:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[chunk] = known
        return known

    def word(self, key: str) -> tuple[int, ...]:
        """The ids of a newline and the text after it, or of a (left out) space and the text after it."""
        chunk, start = key if key[:1] == "\n" else SPACE + key, 0
        ids: tuple[int, ...] = ()
        for mark in MARK.finditer(chunk, 1):
            for i in mark.span():
                if start < i < len(chunk) and chunk[i - 1 : i + 1] not in self.neighbours:
                    ids += self.part(chunk[start:i])
                    start = i
        ids += self.part(chunk[start:])
        if len(key) <= SHORT:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[key] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " ":
            keys = [x[1:] if x[0] == SPACE else x for x in CHUNK.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.replace("\n", " \n").split(" ")
        ids: list[int] = []
        known, word = self.words.get, self.word
        for key in keys:
            ids += known(key) or word(key)
        return ids

    def spelled(self, ids: list[int]) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(path: str) -> MergeCodec:
    """One codec per worker process and model."""
    return MergeCodec(path)


def encode(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ``keep_ids`` also the ids and the decoded text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        rows: list[tuple] = []
        for text in texts_of(batch):
            ids = c.encode(text.decode())
            back = c.decode(ids)
            row = (len(ids), hashlib.sha256(c.spelled(ids).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
            rows.append(row + (ids, back) if keep_ids else row)
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        arrays = [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), work, ddl)


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids (null ids: null)."""

    def run(batches):
        for batch in batches:
            c = codec(model)
            texts = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), encoded[ids].cast("array<int>")).mapInArrow(run, "doc_id long, text string")
