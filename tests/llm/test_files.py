"""WARC archives, hard negatives and fill-in-middle against brute force."""

import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evokit.llm import fill_middle, hard_negatives, warc


def pages_of():
    r = random.Random(2)
    big = ["<p>" + " ".join(r.choice("alpha beta gamma délta 東京 🙂".split()) for _ in range(60)) + f" {k}</p>" for k in range(30)]
    rows = [(k, f"http://h{k % 5}.net/p?q={k}", big[k % 25], "c") for k in range(100)]
    rows += [(200, None, None, "c"), (201, "http://a/\r\nInjected: x y", "short", "c"), (202, "u", "short", "c"), (203, "", "", "c"), (None, "n", big[0], "c"), (None, "m", big[29], "c"), (None, "o", big[29], "c"), (0, "http://h0.net/p?q=0", big[0], "c"), (300, "u" * 5000, "<b>" * 200_000, "c"), (301, "é", "x" * 99, "c"), (302, "é", "x" * 99, "c"), (303, "é", "x" * 100, "c"), (304, "é", "x" * 100, "c")]
    return rows


def expected_records(rows):
    first = {}
    for page_id, _, html, _ in rows:
        if page_id is not None and len((html or "").encode()) >= warc.LEAST:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        to = first.get(html) if len(raw) >= warc.LEAST else None
        to = None if to == page_id else to
        out.append((page_id, "response" if to is None else "revisit", to, len(raw), hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_archives(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = pages_of()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, copies string").repartition(3)
    path = str(tmp_path / "a")
    warc.write(pages, path)
    got = [(x.page_id, x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for x in warc.describe(spark, path).collect()]
    assert sorted(got, key=str) == expected_records(rows)
    index = warc.index(spark, path).collect()
    assert sorted(((x.page_id, x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for x in index), key=str) == sorted(got, key=str)
    # Payloads come back whole, those of revisits from their responses; urls are as they were.
    assert sorted(((x.page_id, x.url, bytes(x.html).decode()) for x in warc.read(spark, path).collect()), key=str) == sorted(((p, u, h or "") for p, u, h, _ in rows), key=str)
    chosen = warc.index(spark, path).where("page_id % 10 = 3")
    assert sorted(x.page_id for x in warc.read(spark, path, chosen).collect()) == [*range(3, 100, 10), 203, 303]
    # The files are gzip members one after another, each where the index has it, and records of the standard's form.
    for name in {x.file for x in index}:
        raw = (tmp_path / "a" / "archives" / name).read_bytes()
        whole = gzip.decompress(raw)
        parts = [gzip.decompress(raw[x.offset : x.offset + x.length]) for x in sorted((x for x in index if x.file == name), key=lambda x: x.offset)]
        head = whole[: len(whole) - sum(map(len, parts))]
        assert b"".join([head, *parts]) == whole and head.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for p in parts:
            fields, http, payload = warc.parse(p)
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys() and "Injected" not in fields
            assert p.count(b"WARC/1.1\r\nWARC-Type") == 1 and (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)
            assert fields["WARC-Type"] == "revisit" or int(http["Content-Length"]) == len(payload)
    ids = {}
    for x in index:
        if x.record_type == "response" and x.page_id is not None:
            ids.setdefault(warc._record_id(x.page_id, x.payload_digest), set()).add(x.page_id)
    assert all(len(v) == 1 for v in ids.values())


def test_archives_of_nothing_and_damage(spark, tmp_path):
    rows = spark.createDataFrame(pages_of(), "page_id long, url string, html string, file string")
    warc.write(rows.where("false"), str(tmp_path / "none"))
    assert warc.describe(spark, str(tmp_path / "none")).count() == 0 == warc.read(spark, str(tmp_path / "none")).count()
    raw = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"y").hexdigest(), None, None)
    with pytest.raises(ValueError, match="digest"):
        warc._described({}, warc.parse(raw))
    for bad in (raw[:-3], raw[4:], raw + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_spans_are_coalesced():
    gap, read = warc.GAP, warc.READ
    places = [("a", 0, 10), ("a", 10, 10), ("a", 10, 10), ("a", 20 + gap, 5), ("a", 26 + 2 * gap, 5), ("b", 0, 5), ("b", 5, read), ("b", 5 + read, 1)]
    assert list(warc.spans(places)) == [("a", 0, 25 + gap, [0, 1, 2, 3]), ("a", 26 + 2 * gap, 31 + 2 * gap, [4]), ("b", 0, 5, [5]), ("b", 5, 5 + read, [6]), ("b", 5 + read, 6 + read, [7])]
    assert list(warc.spans([])) == []


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(256 * x)) for x in v]
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    width = max((len(v) for _, v in best.values()), default=0)
    ids = sorted(best)
    x = np.array([best[i][1] + [0] * (width - len(best[i][1])) for i in ids], dtype=np.int64).reshape(len(ids), width)
    labels = [best[i][0] for i in ids]
    out = set()
    for k, a in enumerate(ids):
        if a % 50:
            continue
        score = (x @ x[k]).tolist()
        order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[k] and j != k][:positives]:
            fits = [j for j in order if labels[j] != labels[k] and low * score[p] <= 100 * score[j] <= high * score[p]]
            out |= {(a, ids[p], r + 1, ids[j], score[p], score[j]) for r, j in enumerate(fits[:negatives])}
    return out


def vectors_of(kind):
    r = np.random.default_rng(4)
    n = 700
    if kind == "clustered":
        x = r.normal(size=(12, 6))[r.integers(0, 12, n)] + 0.05 * r.normal(size=(n, 6))
    elif kind == "spread":
        x = r.normal(size=(n, 16))
    else:  # few different vectors, so ties and groups of equal rows
        x = r.integers(-1, 2, size=(n, 3)) / 2
    rows = [(int(i), [float(v) for v in row], int(label)) for i, row, label in zip(r.permutation(n * 2)[:n], x, r.integers(0, 4, n), strict=True)]
    return rows


@pytest.mark.parametrize("kind", ["clustered", "spread", "tied"])
def test_hard_negatives(spark, monkeypatch, kind):
    for name, v in (("BLOCK", 64), ("BUCKET", 8), ("SAMPLE", 200), ("CHUNK", 5)):
        monkeypatch.setattr(hard_negatives, name, v)
    rows = vectors_of(kind)
    odd = [(None, rows[0][1], 1), (2050, None, 1), (2100, [None] * 6, 1), (2150, [float("nan")] * 6, 1), (2200, [float("inf")] + [0.0] * 5, 2), (2250, rows[3][1], None), (2300, [], 1), (2350, [1.0], 2), rows[0], (rows[1][0], rows[2][1], 3), (rows[1][0], rows[2][1], 0)]
    d = spark.createDataFrame([(*x, "c") for x in rows + odd], "vec_id long, embedding array<float>, label int, leaf string")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows + odd]
    got = {(x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in hard_negatives.hard_negatives(d, F.col("id") % 50 == 0).collect()}
    assert got == brute_negatives(f32) and len(got) > 50


def test_hard_negatives_places_left_empty(spark):
    """A bucket with fewer rows than places does not close the search of the others: all places are filled."""
    r = np.random.default_rng(2)
    labels = r.integers(0, 10, 700)
    x = np.float32(r.normal(0, 0.15, (700, 64))[labels] + r.normal(0, 0.03, (700, 64)))
    rows = [(i, [float(c) for c in v], int((k + 1) % 10 if i % 7 == 0 else k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {tuple(y[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for y in hard_negatives.hard_negatives(d, F.col("id") % 50 == 0).collect()}
    assert got == brute_negatives(rows)


def test_hard_negatives_defined(spark):
    d = spark.createDataFrame([(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    none = F.col("id") % 50 == 0
    assert hard_negatives.hard_negatives(d.where("false"), none).count() == 0 == hard_negatives.hard_negatives(d, none).count()
    with pytest.raises(ValueError, match="2\\^24"):
        hard_negatives.hard_negatives(d, none, scale=1 << 26)
    with pytest.raises(ValueError, match="low"):
        hard_negatives.hard_negatives(d, none, window=(60, 50))


def test_tree_leaves_regions_out():
    """On clustered vectors most buckets are never looked at, and the nearest are found all the same."""
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + 0.01 * r.normal(size=(4000, 8))
    x = np.rint(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    top = float((x * x).sum(1).max())
    tree = hard_negatives.Tree(x, top, 6)
    order, labels, ids = tree.order, np.zeros(4000, np.int32), np.arange(4000)
    a = hard_negatives.Anchors(ids[:50], labels[:50], x[:50], np.full((50, 1), 2**48), np.full((50, 1), -(2**48)), True, 5, top)
    seen = []
    wanted = a.wanted
    a.wanted = lambda least, most, rows=slice(None): seen.append(wanted(least, most, rows)) or seen[-1]
    place = hard_negatives.search(x[order], ids[order], labels[order], tree, a)
    assert np.sum(seen) < 0.35 * 50 * 64
    for k in range(50):
        score = x @ x[k]
        best = sorted((j for j in range(4000) if j != k), key=lambda j: (-score[j], j))[:5]
        assert ids[order][place[k, 0]].tolist() == best


TEXTS = [None, "", "a", "word  two\nthree\n\n four", "has <P> mark", "has <S>", "<M>", "<", "<P", ">S<M", "é東京🙂​ x", "<<S>>", "<S<P<M" * 5, "long " * 40_000, "\x00\x01", " lead", "word  two\nthree\n\n four"]


def test_fill_middle(spark):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS * 12)] + [(None, "no id at all", "c"), (7, "again", "c"), (7, "again", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in fill_middle.transform(d).collect()), key=str)
    expected = []
    for doc_id, text, _ in rows:
        t = text or ""
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        n = len(t)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
            expected.append((doc_id, n, "plain", None, None, t))
        elif h4 % 100 < 20:
            expected.append((doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"))
        else:
            expected.append((doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))
    assert got == sorted(expected, key=str) and {x[2] for x in got} == {"plain", "psm", "spm"}
    digests = sorted(((x.doc_id, x.output_sha256, x.restored_sha256) for x in fill_middle.digests(d).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    output = {(x[0], x[5]) for x in expected}
    assert digests == sorted(((i, sha(o[5]), sha(t or "")) for (i, t, _), o in zip(rows, expected, strict=True)), key=str) and output
    assert fill_middle.digests(d.where("false")).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_middle.transform(d, "page")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units(spark, unit):
    """Texts are cut at ends of units only, and put together again."""
    split = {"char": lambda t: list(t), "word": lambda t: re.findall(r"\s+|\S+", t), "line": lambda t: t.splitlines(keepends=True) if "\r" not in t else re.findall(r"[^\n]*\n|[^\n]+", t)}[unit]
    texts = ["one two  three\nfour\n", "a", "  x ", "l1\nl2\n\nl4", "é 東京\n🙂"]
    for t in texts:
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        ends = fill_middle.unit_ends(points, unit).tolist()
        assert [t[a:b] for a, b in zip(ends, ends[1:], strict=False)] == split(t)
    d = spark.createDataFrame([(k, texts[k % 5]) for k in range(60)], "doc_id long, text string")
    out = fill_middle.transform(d, unit).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    for x in out.collect():
        assert x.back == texts[x.doc_id % 5] and x.n == len(split(x.back))
        if x.form != "plain":
            ends = fill_middle.unit_ends(np.frombuffer(x.back.encode("utf-32-le"), "<u4"), unit).tolist()
            assert x.prefix_chars in ends and x.prefix_chars + x.middle_chars in ends


def test_batch_of_nulls():
    assert warc._index_batch([("f", 0, 1, None, None, 0, "d", "response", None, 1)]).num_rows == 1 and isinstance(fill_middle._batch([None], [(0, "plain", None, None, "")]), pa.RecordBatch)
