"""Operator 1: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary file (ranks or tokenizer JSON) is read on the driver and sent to the executors as its
bytes, so the file need not exist there. A worker process builds the tokenizer once and keeps the
codes of recent chunks. Texts are cut, on the Arrow buffer, at spaces that begin a match of the pattern;
Arrow's dictionary encoding finds the distinct chunks of a part, only those not seen lately go through the
library, and the ids of all chunks are then laid end to end.

Defined results: a null text counts as empty (no ids, empty bytes); texts of any length are encoded
whole; repeated rows and ties give equal rows; an empty table gives an empty result; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker remembers before it starts afresh; about 200 bytes each.
REMEMBERED = 300_000
#: Text encoded together; bounds a worker's memory whatever the size of an Arrow batch. A longer text is a part by itself.
PART_BYTES = 4 << 20
#: First bytes of one-byte white space, and the longer white-space characters in UTF-8.
SPACE_BYTES = np.array([b < 128 and chr(b).isspace() for b in range(256)])
WORD, STOP, FEED = 1, 2, 3
KINDS = np.array([WORD if b < 128 and chr(b).isalnum() else STOP if chr(b) in ",.;:!?" else FEED if b == 10 else 0 for b in range(256)], np.uint8)
WIDE_SPACES = {c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()}


def byte_to_char() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, others follow from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in sorted(visible)} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def build_tokenizer(vocabulary: bytes, pattern: str | None):
    """A tokenizers.Tokenizer from tokenizer JSON (pattern None) or from tiktoken ranks.

    Ranks name no merges; every split of a token into two tokens is a merge of that token's rank,
    and a piece that is itself a token is taken at once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if pattern is None:
        return Tokenizer.from_str(vocabulary.decode())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    table = byte_to_char()
    spelled = {token: "".join(map(table.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
        found = [(ranks[a], ranks[b], spelled[a], spelled[b]) for a, b in cuts if a in ranks and b in ranks]
        merges += [(a, b) for *_, a, b in sorted(found)]
    tokenizer = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class Ragged:
    """Growing rows of numbers of different lengths; ``take`` lays chosen rows end to end."""

    def __init__(self, kind: type):
        self.flat, self.start, self.length = np.empty(1024, kind), np.empty(256, np.int64), np.empty(256, np.int64)
        self.rows = self.used = 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        rows, used = self.rows + len(lengths), self.used + len(values)
        if rows > len(self.start):
            self.start, self.length = (np.concatenate((x, np.empty(rows, np.int64))) for x in (self.start, self.length))
        if used > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(used, self.flat.dtype)))
        self.flat[self.used : used] = values
        self.length[self.rows : rows] = lengths
        self.start[self.rows : rows] = self.used + np.cumsum(lengths) - lengths
        self.rows, self.used = rows, used

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' numbers, and where each row begins among them, with the end."""
        lengths = self.length[rows]
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        at = np.repeat(self.start[rows] - bounds[:-1], lengths)
        at += np.arange(bounds[-1])
        return self.flat[at], bounds


def _is_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character begins at each place of UTF-8 bytes."""
    padded = np.concatenate((raw, np.zeros(3, np.uint8)))
    first = padded[at]
    out = SPACE_BYTES[first]
    for k in np.flatnonzero((first == 0xC2) | ((first >= 0xE1) & (first <= 0xE3))):
        out[k] = bytes(padded[at[k] : at[k] + (2 if first[k] == 0xC2 else 3)]) in WIDE_SPACES
    return out


class Codec:
    """Encodes a column of texts to ids and decodes ids to bytes, a few MB at a time."""

    def __init__(self, vocabulary: bytes, pattern: str | None):
        self.tokenizer = build_tokenizer(vocabulary, pattern)
        table = {c: b for b, c in byte_to_char().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        pieces = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            pieces[i] = token.encode() if token in special else bytes(map(table.__getitem__, token))
        self.pieces = Ragged(np.uint8)
        self.pieces.add(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.spaced = np.fromiter((p[:1] == b" " for p in pieces), bool, len(pieces))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.codes = Ragged(np.uint32)

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of new chunks. Many that begin with their only space are one text for the library: an id whose piece
        begins with a space begins the next chunk."""
        plain = [c for c in chunks if c[:1] == b" " and c.count(b" ") == 1]
        left = [c for c in chunks if c[:1] != b" " or c.count(b" ") != 1]
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            (coded,) = self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32)
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(some):
                self.codes.add(ids, np.diff(np.append(at, len(ids))))
                self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            else:
                left += some
        for i in range(0, len(left), 4096):
            some = left[i : i + 4096]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)]
            self.codes.add(np.array([x for e in coded for x in e], np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)))
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, chunks))
        if None in found:
            new = [c for c, f in zip(chunks, found, strict=True) if f is None]
            if len(self.known) + len(new) > REMEMBERED or self.codes.used > 8 * REMEMBERED:
                self._forget()
                new = chunks
            self._learn(new)
            found = list(map(self.known.__getitem__, chunks))
        return np.array(found, np.int64)

    def _part(self, raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(docs), np.int64)
        # Chunks begin where a match of the pattern begins whatever stands around it: at a space before a character that
        # is not white space, at a line feed after one, at a stop after a letter or digit, and at a text's first byte.
        begins = np.zeros(len(raw) + 1, bool)
        begins[docs] = True
        space = np.flatnonzero(raw == 0x20)
        space = space[~begins[space + 1]]
        begins[space[~_is_space(raw, space + 1)]] = True
        kind = KINDS[raw]
        begins[1:-1] |= ((kind[1:] == STOP) & (kind[:-1] == WORD)) | ((kind[1:] == FEED) & ((kind[:-1] == WORD) | (kind[:-1] == STOP)))
        cuts = np.flatnonzero(begins)
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
        coded = chunks.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, bounds = self.codes.take(rows)
        return ids, bounds[np.searchsorted(cuts, docs)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, ids, bounds) for parts of a string column: ids[bounds[i]:bounds[i + 1]] are those of row + i. Null counts as empty."""
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PART_BYTES, "right")) - 1)
            yield a, *self._part(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            a = b

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for _, ids, bounds in self.encode_column(pa.array(texts, pa.string())):
            raw = ids.astype("<u4").tobytes()
            yield from (raw[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False))

    def decode(self, ids: bytes) -> bytes:
        return self.pieces.take(np.frombuffer(ids, "<u4").astype(np.int64))[0].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last character of each id. An id that holds a part of a character covers it whole."""
        bounds = self.pieces.take(ids.astype(np.int64))[1]
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        return char[bounds[:-1]], char[bounds[1:] - 1] + 1


@functools.lru_cache(maxsize=4)
def codec(vocabulary: bytes, pattern: str | None) -> Codec:
    """The worker's codec: kept between the tasks of a reused worker."""
    return Codec(vocabulary, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends): token ids with the characters that each covers."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for batch in batches:
            for row, ids, bounds in c.encode_column(batch.column(1)):
                n = len(bounds) - 1
                texts = batch.column(1).slice(row, n).to_pylist()
                spans = [c.offsets(t or "", ids[x:y]) for t, x, y in zip(texts, bounds.tolist(), bounds[1:].tolist(), strict=False)]
                ends = pa.array(bounds, pa.int32())
                lists = [ids.astype(np.int32), *(np.concatenate([s[k] for s in spans]).astype(np.int32) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists)], names=["id", "ids", "starts", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes, text): the decoded bytes, and their text with U+FFFD for bytes that form no character.

    All ids are joined before the text is read, so a character split over several ids is whole again.
    """
    sent = coded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for batch in batches:
            raw = [c.decode(np.asarray(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()]
            text = pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), text], names=["id", "bytes", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"id {kind}, bytes binary, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded, then its ids decoded.

    One map over the rows, without a shuffle; ids and bytes stay in the worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        sha = lambda raw, bounds: pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.string())
        for batch in batches:
            for row, ids, bounds in c.encode_column(batch.column(1)):
                text, begins = c.pieces.take(ids.astype(np.int64))
                columns = [pa.array(np.diff(bounds)), sha(memoryview(ids.astype("<u4").tobytes()), 4 * bounds), sha(memoryview(text.tobytes()), begins[bounds])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(bounds) - 1), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
