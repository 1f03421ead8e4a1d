import base64
import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from evokit.llm import byte_bpe, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "plain words, here.", "a  b   c \n d\n\n e ", " lead", "naïve 🙂 東京 été", "x" * 5000, "tab\tand\u00a0nbsp \u2003wide", "it's they'll 123 4567!!", "plain words, here."]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_reference(reference):
    r = random.Random(5)
    letters = "aabbc  \n\t'sté東京🙂  ​0123.,!-_"
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    codec = byte_bpe.codec(byte_bpe.read_vocabulary(RANKS), P.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == array("I", reference.encode_ordinary(text)).tobytes(), repr(text)
        assert codec.decode(ids) == text.encode()


def test_json_vocabulary_as_library():
    texts = [t or "" for t in TEXTS] + ["a<|endoftext|> b"]
    tokenizer = Tokenizer.from_file(JSON)
    codec = byte_bpe.codec(byte_bpe.read_vocabulary(JSON), None)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_offsets_and_decode(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    coded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    rows = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(TEXTS):
        r, covered = rows[i], set()
        for a, b in zip(r.starts, r.ends, strict=True):
            assert 0 <= a < b <= len(t or "")
            covered |= set(range(a, b))
        assert covered == set(range(len(t or "")))
    back = {r.doc_id: (bytes(r.bytes), r.text) for r in byte_bpe.decode(coded, RANKS, P.PATTERN).collect()}
    assert back == {i: ((t or "").encode(), t or "") for i, t in enumerate(TEXTS)}


def test_split_character_is_replaced():
    codec = byte_bpe.codec(byte_bpe.read_vocabulary(RANKS), P.PATTERN)
    (ids,) = codec.encode(["東"])
    assert codec.decode(ids).decode() == "東"
    if len(ids) > 4:
        assert codec.decode(ids[:4]).decode("utf-8", "replace") == "\ufffd"


def test_digests_of_edge_rows(spark, reference):
    import hashlib

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x")], "doc_id long, text string")
    rows = byte_bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.round_trip_digests(docs.where("false"), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65536, 7], list(range(0, 200_000, 7))])
def test_codes(ids):
    codes = token_files.Codes(token_files.pack(np.array(ids, np.uint32)))
    assert len(codes) == len(ids) and codes.between(0, len(ids)).tolist() == ids
    r = random.Random(len(ids))
    for _ in range(200):
        a, b = sorted((r.randrange(len(ids) + 1), r.randrange(len(ids) + 1)))
        b = min(b, a + r.choice([0, 1, 600, 10**6]))
        assert codes.between(a, b).tolist() == ids[a:b]
    for i in {0, 1, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert codes[i] == ids[i]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_equal_ids_and_repeated_rows(spark, tmp_path):
    rows = [(1, "b c d"), (1, "a"), (1, "b c d"), (0, None), (2, "x y" * 400)]
    path = str(tmp_path / "f")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, JSON, partitions=2, segment_tokens=3)
    tokenizer = Tokenizer.from_file(JSON)
    ids = sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    found = token_files.read_documents(spark, path).orderBy("start").collect()
    assert sorted((x.doc_id, x.ids) for x in found) == ids and [x.doc_id for x in found] == [0, 1, 1, 1, 2]
    assert [x.start for x in found] == [sum(x.n_tokens for x in found[:k]) for k in range(5)]
    assert [x.ids for x in found[1:4]] in ([found[1].ids] * 2 + [found[3].ids], [found[1].ids] + [found[3].ids] * 2)


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "POSITIONS", 7)
    rows = [(i * 3 % 17, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    path = str(tmp_path / "f")
    token_files.write_tokens(docs, path, JSON, partitions=3, segment_tokens=40)
    tokenizer = Tokenizer.from_file(JSON)
    at, every = 0, []
    found = {r.doc_id: r for r in token_files.document_checksums(spark, path).collect()}
    whole = {r.doc_id: r.ids for r in token_files.read_documents(spark, path).collect()}
    for i, t, _ in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[i] == ids
        at, every = at + len(ids), every + ids
    asked = spark.createDataFrame([(p,) for p in [*range(0, at, 5), 0, 5, None, -1, at, at + 10**7]], "position long")
    assert {r.position: r.id for r in token_files.token_at(spark, path, asked).collect()} == {p: every[p] for p in range(0, at, 5)}


def test_token_files_of_nothing_and_null_id(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(empty, str(tmp_path / "e"), JSON)
    assert token_files.document_checksums(spark, str(tmp_path / "e")).count() == 0
    token_files.write_tokens(spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string"), str(tmp_path / "n"), JSON)
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.document_checksums(spark, str(tmp_path / "n")).orderBy("start").collect()] == [(None, 0, 2), (1, 2, 1)]
