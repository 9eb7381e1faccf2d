"""Token ids in files of Simple-8b words, written and read in parallel.

Format of a file (little-endian throughout):

- 8 bytes magic ``S8BTOK01``.
- Blocks of ``BLOCK`` ids each (the last one shorter), as 64-bit words. The top 4 bits of a word are its selector: how many
  ids of how many bits it holds, the first id in the lowest bits. Selector 13 holds one id of up to 60 bits; selector 15 is the
  escape: the next word is the id itself, all 64 bits.
- Index: ``n_blocks + 1`` unsigned 64-bit word offsets of the blocks, then for each document its id (signed 64 bits,
  the smallest value for null) and its number of ids (unsigned 64 bits).
- Footer of 32 bytes: number of words, blocks, documents and ids (unsigned 64 bits).

A reader finds any block by its offset and decodes it selector by selector, all words of a selector at once.

Documents are range-partitioned and sorted by id; each partition writes one file, block by block, under a temporary name and
renames it, so a lost or repeated task leaves a whole file or none. The table of files (one row each) gives the position of every document in the
whole sequence.

Defined results: a null or empty text has only the end id. Rows that repeat an id are kept, in the order of their texts' digests;
null ids come first. An empty table gives no file. Texts of any length are encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from behavior_spark.llm.common import sliced, written
from behavior_spark.session import new_folder

MAGIC, BLOCK, NULL_ID = b"S8BTOK01", 1 << 16, -(2**63)
# Fixed values of the format: (ids in a word, bits of an id) by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
SLICE = 32 << 20  # bytes of text whose stretches are numbered together
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe, which begins an ending
_LIMITS = np.array([1 << bits for _, bits in SELECTORS], np.uint64)
_KINDS = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)
_STEPS = np.array([count for count, _ in SELECTORS] + [1] * (ESCAPE + 1 - len(SELECTORS)), np.int64)


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of one block: from each place on, the selector that holds the most ids."""
    m = len(ids)
    if not m:
        return np.zeros(0, np.uint64)
    # The narrowest selector that holds one id; a selector holds several if it holds the widest of them.
    kind = np.zeros(m + SELECTORS[0][0], np.uint8)
    kind[:m] = _KINDS[ids] if int(ids.max()) < len(_KINDS) else np.searchsorted(_LIMITS, ids.astype(np.uint64), side="right")
    choice, widest, seen = np.full(m, ESCAPE, np.uint8), kind[:m].copy(), 1
    for s in reversed(range(len(SELECTORS))):  # selectors with more ids overrule
        while seen < SELECTORS[s][0]:
            np.maximum(widest, kind[seen : seen + m], out=widest)
            seen += 1
        fits = widest <= s
        if not fits.any():
            break  # those with more ids have fewer bits
        np.copyto(choice, s, where=fits)
    starts, i, steps = [], 0, _STEPS[choice].tolist()
    while i < m:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = choice[starts]
    escapes = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escapes) - escapes  # an escape takes two words
    words = np.zeros(len(starts) + int(escapes.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(SELECTORS[0][0], ids.dtype)]).astype(np.uint64)  # a word cut short by the end holds zeros
    for s in np.unique(chosen[~escapes]).tolist():
        count, bits = SELECTORS[s]
        own = np.flatnonzero(chosen == s)
        at, word = starts[own], np.full(len(own), s << 60, np.uint64)
        for j in range(count):
            word |= padded[at + j] << np.uint64(j * bits)
        words[place[own]] = word
    words[place[escapes]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[escapes] + 1] = padded[starts[escapes]]
    return words


def unpack(words: np.ndarray, m: int) -> np.ndarray:
    """The m ids of one block."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kinds == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0] * (16 - len(SELECTORS)))[kinds]
    counts[raw] = 1
    at = np.cumsum(counts) - counts
    out = np.zeros(int(at[-1] + counts[-1]) if len(words) else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero((kinds == s) & ~raw)
        if len(own):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            out[at[own][:, None] + np.arange(count)] = words[own][:, None] >> shifts & np.uint64((1 << bits) - 1)
    out[at[raw]] = words[raw]
    return out[:m]


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder:
        folder = re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Writer:
    """One file: takes the ids of one document after the other."""

    def __init__(self, out):
        self.out, self.waiting, self.held = out, [], 0
        self.offsets, self.docs, self.n_ids = [0], [], 0
        out.write(MAGIC)

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= BLOCK or (last and at < len(ids)):
            words = pack(ids[at : at + BLOCK])
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(self.offsets[-1] + len(words))
            at += BLOCK
        self.waiting = [ids[at:]] if at < len(ids) else []
        self.held = max(0, len(ids) - at)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= 4 * BLOCK:
            self._flush()

    def close(self) -> None:
        self._flush(last=True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(np.array([self.offsets[-1], len(self.offsets) - 1, len(self.docs), self.n_ids], "<u8").tobytes())
        self.out.close()


class Reader:
    """A file's index, and its ids block by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_words, blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(source.read_at(32, size - 32), "<u8"))
        if source.read_at(8, 0) != MAGIC or size != 8 + 8 * n_words + 8 * (blocks + 1) + 16 * docs + 32:
            raise ValueError("not a whole file of token ids")
        index = source.read_at(8 * (blocks + 1) + 16 * docs, 8 + 8 * n_words)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        self.lengths = np.frombuffer(index, "<u8", docs, 8 * (blocks + 1) + 8 * docs).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        words = np.frombuffer(self.source.read_at(int(8 * (self.offsets[i + 1] - self.offsets[i])), int(8 + 8 * self.offsets[i])), "<u8")
        return unpack(words, min(BLOCK, self.n_ids - i * BLOCK))

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """(doc_id, its ids in pieces) in order; the pieces are to be used up before the next document."""
        state = {"block": -1, "ids": np.zeros(0, np.uint64), "at": 0}

        def pieces(left: int) -> Iterator[np.ndarray]:
            while left:
                if state["at"] == len(state["ids"]):
                    state["block"] += 1
                    state["ids"], state["at"] = self.block(state["block"]), 0
                piece = state["ids"][state["at"] : state["at"] + left]
                state["at"] += len(piece)
                left -= len(piece)
                yield piece

        for doc_id, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            yield (None if doc_id == NULL_ID else doc_id), pieces(n)


class Encoder:
    """The tokenizers library, asked once for each short stretch of text.

    Byte-level BPE cuts a text before a single space between two other characters, and around each of one or two newlines between two.
    Arrow cuts the texts there and numbers the different stretches; Python sees each of these once. Those that a worker does not
    remember go to the library joined as they would stand in a text: the ids that begin with a space or newline part the answers.
    What a worker remembers is bounded in bytes. A text with any other white space, or with a special token, goes to the library whole.
    """

    REMEMBERED, BYTES, LONGEST = 400_000, 24 << 20, 64  # stretches and their bytes in each of two generations; longer ones are not remembered
    JOINED, ASKED = 100, 64  # stretches in a text for the library, texts in one question

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # by stretch, with the newline or (left out) space before it
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        newline, space = self._ask("\n"), self._ask(" b")
        # Ids that begin a stretch: their tokens begin as those of the newline and the space.
        vocab, first = self.library.get_vocab(), {self.library.id_to_token(i)[0] for i in (*newline, *space[:1])}
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[:1] in first]] = True
        pieces = [newline, self._ask("a"), space, newline, self._ask("c"), self._ask(" d")]
        ids, marks = [*chain(*pieces)], [i == 0 and piece not in (1, 4) for piece, x in enumerate(pieces) for i in range(len(x))]
        # False: this tokenizer does not cut there, so every text goes to the library.
        self.parts = len(newline) == 1 and self._ask("\na b\nc d") == ids and self._ask("a b") == [*pieces[1], *space] and self.begins[ids].tolist() == marks
        self.parts = self.parts and self._ask("a\n\nc\n b\n") == [*pieces[1], *newline, *newline, *pieces[4], *newline, *space, *newline]
        # None: this tokenizer does not cut between letters and signs.
        signs = [x for x in (".", ",", "...", "!?", ",###", "$$$", "-", ")") if not any(y in x for y in self.special)]
        cuts = all(self._ask(f" word{x}") == self._ask(" word") + self._ask(f"a{x}")[len(self._ask("a")) :] for x in signs)
        self.tails: dict[str, bytes] | None = {} if cuts and not any(x.strip(SIGNS) == "" for x in self.special) else None
        # Texts that go to the library whole: other white space, more of ours in a row or at an end, a special token, nothing at all.
        spaces = "".join(f"\\x{{{i:x}}}" for i in range(1 << 16) if chr(i).isspace() and chr(i) not in " \n")  # none lies higher
        self.whole = "|".join([r"\A(?:[ \n]|\z)", r" (?:[ \n]|\z)", r"\n(?: |\n\n|\n\z)", f"[{spaces}]", *map(re.escape, self.special)])

    def _ask(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ask for stretches."""
        out, step = [], self.JOINED * self.ASKED
        for at in range(0, len(keys), step):
            some = keys[at : at + step]
            asked = [(" " + " ".join(some[i : i + self.JOINED])).replace(" \n", "\n") for i in range(0, len(some), self.JOINED)]
            answers = self.library.encode_batch_fast(asked, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([x.ids for x in answers]), "<u4")
            edges, raw = (np.flatnonzero(self.begins[ids]) * 4).tolist(), ids.tobytes()
            if len(edges) != len(some):
                raise ValueError("the tokenizer does not part stretches at spaces and newlines")
            out += [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)], strict=True)]
        return out

    def _answers(self, keys: list[str]) -> list[bytes]:
        """The ids of different stretches."""
        if len(self.known) >= self.REMEMBERED or self.held >= self.BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        found: list[bytes | None] = list(map(self.known.get, keys))
        lost = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i, ids in zip(lost, map(self.older.get, [keys[i] for i in lost]), strict=True):
                found[i] = ids
        new = [i for i in lost if found[i] is None]
        for i, ids in zip(new, self._learn([keys[i] for i in new]), strict=True):
            found[i] = ids
        remember = {keys[i]: found[i] for i in lost if len(keys[i]) <= self.LONGEST}
        self.known.update(remember)
        self.held += sum(map(len, remember)) + sum(map(len, remember.values()))
        return found

    def _parted(self, keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Letters and the signs after them, so that a word is asked for once whatever follows it; other stretches stay whole."""
        if self.tails is None:
            return keys, pa.array([""]).take(pa.array(np.zeros(len(keys), np.int64)))
        both = pc.extract_regex(keys, rf"\A(?P<stem>\n?\p{{L}}+)(?P<tail>[{re.escape(SIGNS)}]{{1,8}})\z")
        return pc.coalesce(pc.struct_field(both, 0), keys), pc.fill_null(pc.struct_field(both, 1), "")

    def _tail(self, signs: str) -> bytes:
        """The ids of signs behind a letter."""
        ids = self.tails.get(signs) if signs else b""
        if ids is None:
            if len(self.tails) >= 10_000:
                self.tails.clear()
            ids = self.tails[signs] = np.array(self._ask("a" + signs)[len(self._ask("a")) :], "<u4").tobytes()
        return ids

    def encode_many(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, one after the other; null is empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.whole) if self.parts else pa.array([True] * len(texts), pa.bool_())
        # The first stretch is looked up as if a newline were before it.
        lines = pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n")
        nothing, newline = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        split = pc.split_pattern(pc.binary_join_element_wise(nothing, lines, newline), " ")
        del lines
        cuts, which = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del split
        stems, tails = self._parted(which.dictionary)
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        heads = pa.array(self._answers(stems.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(stems.indices)
        ends = pa.array([self._tail(x) for x in tails.dictionary.to_pylist()], pa.large_binary()).take(tails.indices)
        answers = pc.binary_join_element_wise(heads, ends, pa.scalar(b"", pa.large_binary())).take(which.indices)
        del which, stems, tails, heads, ends
        _, offsets, raw = answers.buffers()
        edges = (np.frombuffer(offsets, np.int64)[cuts] >> 2).tolist() if len(cuts) > 1 else []
        ids, i = np.frombuffer(raw or b"", "<u4"), 0
        for at, alone in enumerate(whole.to_pylist()):
            if alone:
                (answer,) = self.library.encode_batch_fast([texts[at].as_py()], add_special_tokens=False)
                yield np.array(answer.ids, "<u4")
            else:
                yield ids[edges[i] + 1 : edges[i + 1]]  # the newline before the first stretch goes
                i += 1

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Write the ids of all texts below ``folder`` (a new one in the shared folder by default); one row per file.

    Columns: part, path, n_docs, n_ids, n_bytes. The rows are written first, so the files exist when this returns.
    """
    folder = folder or new_folder(docs.sparkSession, "token-files")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = own.repartitionByRange(parts, *order[:1]) if parts else own.repartitionByRange(*order[:1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                files, root = _filesystem(folder)
                files.create_dir(root, recursive=True)
                part = TaskContext.get().partitionId()
                path, hidden = f"{root}/part-{part:07d}.s8b", f"{root}/.{part:07d}-{uuid.uuid4().hex}"
                writer = Writer(files.open_output_stream(hidden))
                e = encoder(tokenizer)
            for piece in sliced(batch, "text", SLICE):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), e.encode_many(piece.column("text")), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            files.move(hidden, path)
            row = {"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [files.get_file_info(path).size]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    files = ranged.sortWithinPartitions(*order).mapInArrow(run, "part long, path string, n_docs long, n_ids long, n_bytes long")
    return written(files.withColumn("folder", F.lit(folder)), "token-index")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; one task reads a few files, block by block.

    ``start`` counts the ids of all documents before it. The offsets window runs over one row per file.
    """
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
    count = max(1, files.count())
    placed = placed.repartition(count, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder, start in zip(*[batch.column(c).to_pylist() for c in ("path", "folder", "first")], strict=True):
                with _filesystem(folder)[0].open_input_file(path) as source:
                    rows = []
                    for doc_id, pieces in Reader(source).documents():
                        crc, n = 0, 0
                        for piece in pieces:
                            crc, n = zlib.crc32(piece.astype("<u4").tobytes(), crc), n + len(piece)
                        rows.append((doc_id, start, n, crc))
                        start += n
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id and ids (as an array) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                with _filesystem(folder)[0].open_input_file(path) as source:
                    for doc_id, pieces in Reader(source).documents():
                        ids = np.concatenate([*pieces, np.zeros(0, np.uint64)]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.repartition(max(1, files.count()), "part").mapInArrow(run, "doc_id long, ids array<long>")
