"""Operator 10: secret scans with a battery of randomness tests and false-discovery control.

Base kinds are three fixed patterns. The method adds the kind ``random``: runs of ``LEAST`` code characters or more, outside
base spans, whose encoding is inferred (hexadecimal, base-32, base-36, base-62 or base-64 alphabet). A battery of
three tests for uniform noise over that alphabet is made of each: chi-squared uniformity, the runs test about the
alphabet's middle, and the serial correlation of neighbours. A run is

* no noise if Fisher's combination of the three rejects it (``BATTERY_ALPHA``), and
* else as likely a written name as names of its length and encoding come so near to noise in the three tests. How names fare is found
  from a fixed model of names (words, cases, digits, signs) for each length, so a short run needs far better evidence.

These p-values, of all runs tested in the corpus, are controlled by the Benjamini-Hochberg procedure. Their
distribution is counted in fixed bins of log10 p, so what reaches the driver is one count a bin (at most ``BINS``), however
large the corpus. The values of base spans are tested with the others and counted as ``n_noise`` if they are discoveries; they stay spans in any case.

Defined results: a null text counts as empty and has no spans; texts of any length are read whole; runs of over ``LONGEST`` characters are
tested whole and held against names of that length, which are less unlike noise than names of their own; runs under ``LEAST`` are not
tested, as they hardly differ from names; of runs with equal evidence all or none are discoveries;
repeated rows give equal rows; an empty table gives an empty result; columns other than the id and
the text are ignored, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.session import scratch_path

#: The base patterns; letters of the first in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Matches of [0-9a-f]+ are whole runs, so those of 16 and more are the matches of this.
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: The shortest run that is tested, and the length from which on all are held against names of that length.
LEAST, LONGEST = 20, 256
CODE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Alphabets in the order in which they are tried.
ALPHABETS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
ORDERS = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS}
SETS = {name: frozenset(a) for name, a in ALPHABETS}
#: How often letters come in written words, in thousandths, and what a name is made of.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
DIGITS = dict(zip("0123456789", (20, 18, 13, 9, 8, 8, 7, 6, 6, 5), strict=True))
NAMES = 1500
#: The battery rejects noise below this combined p-value.
BATTERY_ALPHA = 0.001
FALSE_DISCOVERIES = 0.01
BINS, BIN_WIDTH = 2001, 0.02


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi2(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    return _upper_normal(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def infer_encoding(code: str) -> str | None:
    """The first alphabet that holds all characters and that they make use of, else None.

    Words and identifiers are no codes: letters and digits must both occur, or both cases with a sign.
    """
    used = set(code.rstrip("="))
    digits, upper, lower = any(c.isdigit() for c in used), any(c.isupper() for c in used), any(c.islower() for c in used)
    if digits + upper + lower < 2 or not (digits or used & set("+/")):
        return None
    return next((name for name, _ in ALPHABETS if used <= SETS[name]), None)


def battery(codes: list[str], encoding: str) -> np.ndarray:
    """Deviations from uniform noise over the encoding's alphabet, a row a code; the codes are of one length and without padding.

    Columns: of chi-squared (its cube root, which is nearly normal), of the number of runs, and of the serial correlation, each in units of its own standard deviation.
    """
    order = ORDERS[encoding]
    x = np.array([[order[c] for c in code] for code in codes])
    (k, n), a = x.shape, len(order)
    count = np.bincount((x + np.arange(k)[:, None] * a).ravel(), minlength=k * a).reshape(k, a)
    chi = (count * count).sum(1) * a / n - n
    high = x >= a / 2
    n1 = high.sum(1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 2 * (n - n1) * n1 / n + 1
    var = np.maximum((mean - 1) * (mean - 2), 0) / (n - 1)
    y = x - x.mean(1, keepdims=True)
    total = (y * y).sum(1)
    serial = np.where(total > 0, (y[:, 1:] * y[:, :-1]).sum(1) / np.maximum(total, 1e-9), 1.0)
    z_runs = np.where(var > 0, (runs - mean) / np.sqrt(np.maximum(var, 1e-9)), -math.sqrt(n))
    step = 2 / (9 * (a - 1))
    return np.stack([(np.cbrt(chi / (a - 1)) - (1 - step)) / math.sqrt(step), z_runs, (serial + 1 / n) * math.sqrt(n)], axis=1)


def noise_p(z: np.ndarray) -> float:
    """Fisher's combination of the three tests' p-values for uniform noise."""
    each = (_upper_normal(z[0]), 2 * _upper_normal(abs(z[1])), 2 * _upper_normal(abs(z[2])))
    return _upper_chi2(-2 * sum(math.log(max(min(p, 1.0), 1e-300)) for p in each), 6)


def _name(r: random.Random, encoding: str, n: int) -> str:
    """A written name of ``n`` characters of the alphabet: words in one style, numbers between some, a number in each."""
    alphabet = SETS[encoding]
    letters = {c: w for c, w in LETTERS.items() if c in alphabet or c.upper() in alphabet}
    signs = [c for c in "-_/+" if c in alphabet]
    style = r.choice(["lower", "upper", "camel"] if "a" in alphabet and "A" in alphabet else ["lower" if "a" in alphabet else "upper"])
    sign = r.choice([*signs[:2], ""]) if signs else ""
    digits = {c: w for c, w in DIGITS.items() if c in alphabet}
    parts, size, words = [], 0, 0
    at = r.randrange(0, max(1, n // 8))
    while size < n:
        if words == at or r.random() < 0.25:
            part = "".join(r.choices(list(digits), list(digits.values()), k=r.choice([1, 2, 2, 3, 4, 4, 8])))
        else:
            part = "".join(r.choices(list(letters), list(letters.values()), k=r.randrange(2, 10)))
            part = part.upper() if style == "upper" else part.capitalize() if style == "camel" else part
        words += 1
        parts += [part, sign]
        size += len(part) + len(sign)
    return "".join(parts)[:n]


@functools.lru_cache(maxsize=None)
def name_scale(encoding: str, n: int) -> tuple[np.ndarray, float, float]:
    """How the battery tells names of length ``n`` from noise: the weights of its three tests, and where names' sums lie (their middle and their spread above it).

    The weights are those of Fisher's linear discriminant between names of the model and noise, drawn with a fixed seed: the same everywhere.
    """
    r = random.Random(f"{encoding}:{n}")
    alphabet = sorted(SETS[encoding])
    names = battery([_name(r, encoding, n) for _ in range(NAMES)], encoding)
    noise = battery(["".join(r.choices(alphabet, k=n)) for _ in range(NAMES)], encoding)
    spread = np.cov(names.T) + np.cov(noise.T) + 1e-6 * np.eye(3)
    weights = np.linalg.solve(spread, noise.mean(0) - names.mean(0))
    sums = np.sort(names @ weights)
    middle = float(sums[NAMES // 2])
    return weights, middle, max((float(sums[-NAMES // 100]) - middle) / 2.326, 1e-6)


def _evidence(code: str, encoding: str) -> float:
    """-log10 of the p-value of a name's being so like noise; 0 if the battery rejects noise."""
    z = battery([code], encoding)[0]
    if noise_p(z) < BATTERY_ALPHA:
        return 0.0
    # Lengths on a grid, rounded down: fewer to model, and never more evidence than there is.
    n = len(code)
    n = n if n < 32 else n // 4 * 4 if n < 64 else n // 16 * 16 if n < 128 else min(LONGEST, n // 64 * 64)
    weights, middle, spread = name_scale(encoding, n)
    return -math.log10(max(_upper_normal((float(z @ weights) - middle) / spread), 1e-40))


def evidence(code: str) -> float | None:
    """The evidence of a run, or of its longest part between signs if that is greater, for two trials; None if neither is long enough or of a known encoding."""
    whole = code.rstrip("=")
    tried = {whole, max(re.split(r"[-_=]+", whole), key=len)}
    found = [_evidence(c, name) for c in tried if len(c) >= LEAST and (name := infer_encoding(c))]
    return max(max(found) - math.log10(len(tried)), 0.0) if found else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted."""
    return sorted(x[:3] for x in _base_values(text))


def _base_values(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), which ends where the span does."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _bin(code: str) -> int | None:
    """The bin of a run's evidence; None if it is not tested."""
    own = evidence(code)
    return None if own is None else min(BINS - 1, int(own / BIN_WIDTH))


def tested_spans(text: str) -> list[tuple[int, int, int, int | None]]:
    """(start, kind, end, bin), sorted: base spans, then of the other code runs those that were tested."""
    base = _base_values(text)
    out = [(s, k, e, _bin(text[v:e])) for s, k, e, v in base]
    starts = [s for s, *_ in base]
    furthest, reach = 0, []
    for _, _, e, _ in base:
        furthest = max(furthest, e)
        reach.append(furthest)
    for m in CODE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # base spans that begin before the run's end
        if not (before and reach[before - 1] > a) and (own := _bin(m[0])) is not None:
            out.append((a, 3, b, own))
    return sorted(out, key=lambda x: x[:3])


def least_bin(counts: dict[int, int], rate: float = FALSE_DISCOVERIES) -> int:
    """Benjamini-Hochberg over binned evidence: the least bin whose runs are discoveries; BINS if there is none."""
    total, above, least = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if b and 10 ** (-b * BIN_WIDTH) <= rate * above / total:
            least = b
    return least


def discovery_threshold(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> int:
    """The least bin whose runs count as discoveries over the whole table; BINS if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for t in batch.column(0):
                if text := t.as_py():
                    counts.update(b for *_, b in tested_spans(text) if b is not None)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bin", "n"])

    rows = docs.select(text_col).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    return least_bin({r.bin: r.n for r in rows}, rate)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(id, spans): every span as struct(start, kind, end, noise), in order, of every document; noise tells whether a value was discovered.

    The texts are scanned once: the tested spans are written, and what is discovered follows from the bins in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            spans = [[{"start": s, "kind": KINDS[k], "end": e, "bin": b} for s, k, e, b in tested_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    path = scratch_path(docs.sparkSession, "tested-spans")
    docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, spans array<struct<start: int, kind: string, end: int, bin: int>>").write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    bins = found.select(F.explode("spans.bin").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    least = least_bin({r.bin: r.n for r in bins.collect()}, rate)
    noise = lambda x: F.coalesce(x["bin"] >= least, F.lit(False))
    kept = F.transform(F.filter("spans", lambda x: (x["kind"] != "random") | noise(x)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), noise(x).alias("noise")))
    return found.select(F.col("id").alias(id_col), kept.alias("spans"))


def _spans(text: str, least: int) -> list[tuple[int, int, int]]:
    return [(s, k, e) for s, k, e, b in tested_spans(text) if k < 3 or b >= least]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_noise): the spans as kind:start:end, comma-joined; base spans whose value is noise are counted last."""
    spans = scan(docs, id_col, text_col, rate)
    spelled = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda s: F.array_join(F.transform(s, spelled), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return spans.select(id_col, *map(number, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number("random"), F.size(F.filter("spans", lambda x: x["noise"] & (x["kind"] != "random"))).cast("long").alias("n_noise"))


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; of spans that overlap, one mark stands for all."""
    least = discovery_threshold(docs, text_col, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else _masked(t, least) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    rows = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)


def _masked(text: str, least: int) -> str:
    out, done = [], 0
    for s, k, e in _spans(text, least):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join(out) + text[done:] if out else text
