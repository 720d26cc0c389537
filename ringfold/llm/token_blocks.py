"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK_IDS``. A
block stores its minimum, and per id the difference to it in as many bits as the given
percentile of differences needs; the differences that need more keep their low bits in
place and their high bits in a list of exceptions. The footer has the offset of every
block and the first id of every document, so that any range of ids is read by itself.

Layout, little-endian::

    block*      count u32, minimum u32, width u8, exceptions u32,
                packed bits, exception positions u32[], exception high bits u32[]
    footer      block offsets u64[], document ids i64[], document starts u64[]
    trailer     ids per block u64, blocks u64, documents u64, ids u64, footer offset u64, magic 8 bytes
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringfold.workdir import stored, work_dir

BLOCK_IDS = 4096
WIDTH_PERCENTILE = 90
MAGIC = b"PFORIDS2"
_HEAD = struct.Struct("<IIBI")
_TRAILER = struct.Struct("<QQQQQ8s")
#: Distinct words that a tokenizing worker remembers, in each of two generations, some 240 bytes
#: each; and how many times fewer ends of words.
REMEMBERED_WORDS = 400_000
WORDS_PER_TAIL = 8
#: Characters of the longest word that is remembered.
LONGEST_REMEMBERED = 64
#: Letters, then punctuation or a line end: a byte-level BPE tokenizer cuts between the two.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LETTERS = re.compile(f"[{_LETTER}]+")
_WORD_AND_TAIL = re.compile(f"([{_LETTER}]+)([!-/:-@\\[-`{{-~\n](?:.*[!-~{_LETTER}])?)", re.DOTALL)


def pack_block(ids: np.ndarray, percentile: float = WIDTH_PERCENTILE) -> bytes:
    """One block; at most 2^32 - 1 is stored per id."""
    ids = ids.astype(np.uint32)
    low = int(ids.min()) if len(ids) else 0
    rest = ids - np.uint32(low)
    typical = int(np.partition(rest, k := int((len(rest) - 1) * percentile / 100))[k]) if len(rest) else 0
    width = typical.bit_length()
    over = np.flatnonzero(rest >> np.uint64(width)) if width < 32 else np.zeros(0, np.int64)
    # eight ids of w bits fill w bytes: bit planes, packed per eight
    groups = np.zeros((-(-len(rest) // 8) * 8,), np.uint32)
    groups[: len(rest)] = rest
    planes = np.empty((width, len(groups)), np.uint8)
    for bit in range(width):
        planes[bit] = (groups >> np.uint32(bit)) & np.uint32(1)
    return b"".join(
        (
            _HEAD.pack(len(ids), low, width, len(over)),
            np.packbits(planes, axis=1, bitorder="little").tobytes(),
            over.astype("<u4").tobytes(),
            (rest[over].astype(np.uint64) >> np.uint64(width)).astype("<u4").tobytes(),
        )
    )


def unpack_block(data: bytes | memoryview) -> np.ndarray:
    count, low, width, n_over = _HEAD.unpack_from(data)
    row = -(-count // 8)
    at = _HEAD.size
    packed = np.frombuffer(data, np.uint8, width * row, at).reshape(width, row)
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :count]
    out = np.zeros(count, np.uint32)
    for bit in range(width):
        out |= bits[bit].astype(np.uint32) << np.uint32(bit)
    at += width * row
    where = np.frombuffer(data, "<u4", n_over, at)
    high = np.frombuffer(data, "<u4", n_over, at + 4 * n_over)
    if n_over:
        out[where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return out + np.uint32(low)


class IdFileWriter:
    """Appends documents to an open file; at most a block and the footer are held."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, percentile: float = WIDTH_PERCENTILE):
        self._out, self._block_ids, self._percentile = out, block_ids, percentile
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0
        self._at = 0
        self._blocks: list[int] = []
        self._docs: list[int] = []
        self._starts: list[int] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(np.iinfo(np.int64).min if doc_id is None else doc_id)
        self._starts.append(self.n_ids)
        self.n_ids += len(ids)
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= 64 * self._block_ids:
            self._flush()

    def _flush(self, rest: bool = False) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.zeros(0, np.uint32)
        whole = len(ids) if rest else len(ids) // self._block_ids * self._block_ids
        for a in range(0, whole, self._block_ids):
            block = pack_block(ids[a : min(a + self._block_ids, whole)], self._percentile)
            self._blocks.append(self._at)
            self._out.write(block)
            self._at += len(block)
        self._waiting, self._n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(rest=True)
        for values, kind in ((self._blocks, "<u8"), (self._docs, "<i8"), (self._starts, "<u8")):
            self._out.write(np.array(values, kind).tobytes())
        self._out.write(_TRAILER.pack(self._block_ids, len(self._blocks), len(self._docs), self.n_ids, self._at, MAGIC))


class IdFileReader:
    """Reads documents of a file by ranges of blocks."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        trailer = _TRAILER.unpack(self._range(size - _TRAILER.size, size))
        self._block_ids, n_blocks, n_docs, self.n_ids, self._end, magic = trailer
        if magic != MAGIC:
            raise ValueError("not a file of token-id blocks")
        footer = self._range(self._end, self._end + 8 * (n_blocks + 2 * n_docs))
        self._blocks = np.append(np.frombuffer(footer, "<u8", n_blocks), self._end).astype(np.int64)
        self.docs = np.frombuffer(footer, "<i8", n_docs, 8 * n_blocks)
        self.starts = np.append(np.frombuffer(footer, "<u8", n_docs, 8 * (n_blocks + n_docs)), self.n_ids).astype(np.int64)

    def _range(self, start: int, end: int) -> bytes:
        self._source.seek(start)
        return self._source.read(end - start)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at positions ``start`` to ``end`` of the file."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self._block_ids, (end - 1) // self._block_ids
        data = memoryview(self._range(self._blocks[first], self._blocks[last + 1]))
        parts = [
            unpack_block(data[self._blocks[b] - self._blocks[first] : self._blocks[b + 1] - self._blocks[first]])
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self._block_ids : end - first * self._block_ids]

    def documents(self, most_ids: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document's id, start and ids; about ``most_ids`` ids are decoded at a time."""
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + most_ids, "right")) - 1)
            ids = self.ids(int(self.starts[a]), int(self.starts[b]))
            for d in range(a, b):
                own = ids[self.starts[d] - self.starts[a] : self.starts[d + 1] - self.starts[a]]
                doc = int(self.docs[d])
                yield None if doc == np.iinfo(np.int64).min else doc, int(self.starts[d]), own
            a = b


def _ends_word(part: str) -> bool:
    """Whether no reading of the last character is white space."""
    return bool(part) and not part[-1].isspace() and part[-1] not in "\u180e\u200b\ufeff"


def _byte_characters() -> dict[int, str]:
    """The character of a byte-level vocabulary for each byte: itself if it is printable, else one after 255."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()


def _as_bytes(part: str) -> str:
    """A word after a space as a byte-level vocabulary spells it."""
    return (b" " + part.encode()).decode("latin-1").translate(_BYTE_CHARACTERS)


class _NotAlone(Exception):
    """A piece of text that cannot be cut off where it is cut."""


def _splits_by_letters(tokenizer) -> bool:
    """Whether a space and the letters after it are one piece, spelled in bytes, and nothing else is done to them."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    words = ("of", "Straße", "éàÿ")
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str("".join(" " + w for w in words))
    return [p for p, _ in pieces] == [_as_bytes(w) for w in words]


class _Pieces(dict):
    """Ids, as bytes, of a word after a space. Words not met for long are forgotten."""

    def __init__(self, tokenizer, remembered: int):
        super().__init__()
        self._most_words, self._most_tails = remembered, remembered // WORDS_PER_TAIL
        self._tokenizer = tokenizer
        self._model = tokenizer.model if _splits_by_letters(tokenizer) else None
        self._older: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self._stored(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, letters: str) -> bytes:
        """A space and letters, which the tokenizer takes as one piece, so its model is asked alone."""
        if self._model is None:
            return self.encode(" " + letters)
        return self._stored([t.id for t in self._model.tokenize(_as_bytes(letters))])

    @staticmethod
    def _stored(found: list[int]) -> bytes:
        ids = array("I", found)
        return ids.tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        got = self._older.get(part)
        if got is None:
            cut = _WORD_AND_TAIL.fullmatch(part)
            if cut and part[-1] != "\n":
                got = self[cut[1]] + self._tail(cut[2])
            elif _LETTERS.fullmatch(part):
                got = self._word(part)
            elif _ends_word(part) and _ends_word(part[0]):
                got = self.encode(" " + part)
            else:
                raise _NotAlone
        self._remember(part, got)
        return got

    def _remember(self, part: str, ids: bytes) -> None:
        if len(part) > LONGEST_REMEMBERED:
            return
        if len(self) >= self._most_words:
            self._older = dict(self)
            self.clear()
        self[part] = ids

    def _tail(self, tail: str) -> bytes:
        got = self._tails.get(tail)
        if got is None:
            got = self.encode(tail)
            if len(self._tails) < self._most_tails:
                self._tails[tail] = got
        return got


class TextEncoder:
    """A byte-level BPE tokenizer that remembers words.

    Such a tokenizer takes a single space as the start of the word after it and joins neither
    to what stands before, so a text may be cut before each space between two characters
    that are no white space, and each word be encoded once per task. Where spaces meet other
    white space, the words around stay together. A text that holds an added token, such as
    an end of text, is encoded as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._words = _Pieces(tokenizer, remembered)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self._added):
            return self._words.encode(text)
        first, *rest = text.split(" ")
        if _ends_word(first):
            try:
                return self._words.encode(first) + b"".join(map(self._words.__getitem__, rest))
            except _NotAlone:
                pass
        return self._cut(text)

    def _cut(self, text: str) -> bytes:
        """As above for a text that only in places can be cut."""
        out: list[bytes] = []
        parts = text.split(" ")
        a = 0
        while a < len(parts):
            b = a + 1
            while b < len(parts) and not (_ends_word(parts[b - 1]) and _ends_word(parts[b][:1])):
                b += 1
            if a and b == a + 1 and _ends_word(parts[a]) and _ends_word(parts[a][0]):
                out.append(self._words[parts[a]])
            else:
                out.append(self._words.encode(" " * bool(a) + " ".join(parts[a:b])))
            a = b
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(path: str, remembered: int) -> TextEncoder:
    """One per Python worker, so that a task starts with the words of earlier ones."""
    return TextEncoder(path, remembered)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
    percentile: float = WIDTH_PERCENTILE,
    remembered: int = REMEMBERED_WORDS,
) -> DataFrame:
    """Tokenize all texts and write their ids, in ascending order of the document id.

    Returns the stored list of files: ``file_no`` (ascending with the document ids),
    ``path``, ``n_docs``, ``n_ids``. A document is its ids followed by ``end_id``; a null
    or empty text is ``end_id`` alone. A null document id comes first. Rows with one
    document id stay apart, in the order of their texts. Other columns are not read. An
    empty table gives an empty list.

    A Python worker keeps up to twice ``remembered`` words and their ids, also after its
    tasks. Fewer take less of the memory that other steps need, and more CPU time.

    Each task writes a file under a name of its own and lists it; files of attempts that
    failed are in no list. Files are written and read by pyarrow's file systems, below the
    session's shared folder.
    """
    base = work_dir(docs.sparkSession, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = None
        n_docs = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = _encoder(tokenizer_path, remembered)
                end = np.array([end_id], "<u4").tobytes()
                system, folder = fs.FileSystem.from_uri(base)
                system.create_dir(folder, recursive=True)
                number = TaskContext.get().partitionId()
                name = f"{number:07d}-{uuid.uuid4().hex}.ids"
                out = system.open_output_stream(f"{folder}/{name}")
                writer = IdFileWriter(out, block_ids, percentile)
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                writer.add(doc.as_py(), np.frombuffer(encode(text.as_py() or "") + end, "<u4"))
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file_no": [number], "path": [f"{base}/{name}"], "n_docs": [n_docs], "n_ids": [writer.n_ids]}
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, "file_no bigint, path string, n_docs bigint, n_ids bigint"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the listed files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it. A task reads one file at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    rows: list[tuple] = []
                    for doc, start, ids in IdFileReader(source).documents():
                        rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))

    # one row per file, so the window without a key stays small
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", "file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, files.count())
    return placed.repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
