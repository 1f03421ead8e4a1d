"""Operator 13: fill-in-middle transformation over code point arrays.

A text is decoded to an array of code points. Each point has a class (its own place for the unit ``char``, white space or not for ``word``,
the number of line ends before it for ``line``); units end where neighbouring classes differ. Two ranks among the units' ends, drawn from
a hash of the document's id, cut the text into prefix, middle and suffix, which are put together again by form: plain (the text as it
is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each piece after its mark.

The draw depends on the id alone, so a task that is run again, or another partitioning, gives the same rows.

Defined results: a null text counts as empty; an empty text, and one that holds a mark, is plain, so that ``restore`` is always exact; a null id
is drawn as an empty one; equal ids are cut at ranks drawn alike; repeated rows are kept; texts of any length are cut whole, in a task's
memory one Arrow batch at a time; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are cut, and of these in the order suffix, prefix, middle.
CUT, SPM = 90, 20
SEED = 1
UNITS = ("char", "word", "line")
#: Code points that str.isspace() takes for white space.
_SPACE = np.array([c for c in range(0x3001) if chr(c).isspace()], "<u4")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin and end: 0, each place whose class is not that of the place before it, and the length."""
    if unit == "char":
        classes = np.arange(len(points))
    elif unit == "word":
        classes = np.isin(points, _SPACE)
    elif unit == "line":
        classes = np.cumsum(points == 0x0A) - (points == 0x0A)
    else:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut_text(text: str, doc_id: int | None, unit: str = "char", cut: int = CUT, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's and middle's code points, output)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = unit_ends(points, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= cut or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = (int(ends[r]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le", "surrogatepass") for x in (points[:a], points[a:b], points[b:]))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, unit: str = "char", cut: int = CUT, spm: int = SPM, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: its units, its form, the code points before and in the middle (null if plain)."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, size = batch.column(0).to_pylist(), [], 0
            kept: list[int | None] = []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                parts.append(cut_text(text.as_py() or "", doc_id, unit, cut, spm, seed))
                kept.append(doc_id)
                size += len(parts[-1][-1])
                if size >= 1 << 22:
                    yield _batch(kept, parts)
                    kept, parts, size = [], [], 0
            if kept:
                yield _batch(kept, parts)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA).withColumnsRenamed({"doc_id": id_col})


def _batch(ids: list[int | None], parts: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*parts, strict=True)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, n, form, prefix, middle, output), kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form. No piece holds a mark and a mark can't overlap another, so the first mark found is the one that was put there."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        x = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(x) + len(second) + 1)
        y = F.substring_index(rest, MIDDLE, 1)
        return x, y, F.substr(rest, F.length(y) + len(MIDDLE) + 1)

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): ``transform``'s rows with the SHA-256 of the output, and of the text that ``restore`` makes of it."""
    done = transform(docs, id_col=id_col, text_col=text_col)
    return done.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
