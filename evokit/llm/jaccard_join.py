"""Operator 8: n-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; texts with equal sets are one class from the start. In each
run a set follows every token that a hash shared by all sets samples with probability 1 / (threshold * size),
so a similar pair keeps about one common token a level, and other sets part. A bucket that is small is
compared by brute force; a larger one is split on by tokens sampled anew for its path, to ``DEPTH`` levels.
Runs are repeated until a pair at the threshold meets with ``TARGET_RECALL``, as the survival of the
sampled paths gives it. In a bucket, sizes and 64-byte sketches (minima of 64 parts of the hash range)
sort out pairs far below the threshold with five standard deviations to spare.

Buckets give only the links that join what is not yet joined, at most one a member. Their connected components
then get the full sets, each set once, and all pairs within a component are verified exactly as matrix
products; so number of links and classes are exact within components, whichever bucket found them, and no list of
pairs is made. Buckets and components beyond a block's size are dealt out as pairs of blocks.

Words are runs without ASCII white space, as they are written; a text of one to four words has one shingle,
all its words. Defined results: a null or empty text has no shingles, is its own class and has no links; a
null id gives a null class and no links; rows that repeat an id are one document; equal texts link to each other;
long texts count whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.llm.runs import key_runs
from evokit.operators.components import connected_components
from evokit.session import cut, scratch_path

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99
DEPTH = 3
#: A bucket of at most this many sets is compared at once instead of being split on.
SMALL = 256
#: Sets in a block of a large bucket or component, and shingles in a block of a component.
BLOCK = 1024
BLOCK_SHINGLES = 4_000_000
#: Rows of a broadcast list of large buckets: a path each.
BROADCAST_ROWS = 500_000
BINS = 64

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h))


def runs_for(recall: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold shares a path of full depth in one of them."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)  # the pair's common tokens that are sampled are Poisson with mean 1 at least
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def sketch(s: np.ndarray) -> bytes:
    """A byte of the least hash in each of 64 parts of the range; 0 where there is none."""
    at = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    full = at < np.append(at[1:], len(s))
    out = np.zeros(BINS, np.uint8)
    out[full] = 1 + ((s[at[full]] >> np.uint64(20)) % np.uint64(255))
    return out.tobytes()


def chosen_paths(s: np.ndarray, runs: int, threshold: float = THRESHOLD, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, (path above, path) of every sampled token; level one has the run in place of a path."""
    least = 1 / (threshold * len(s))
    bound = np.uint64(0xFFFFFFFFFFFFFFFF) if least >= 1 else np.uint64(int(least * 2.0**64))
    above = _mixed(np.arange(1, runs + 1, dtype=np.uint64))
    out = []
    for _ in range(depth):
        value = (s[None, :] ^ above[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        value *= _MIX[0]
        row, col = np.nonzero(value <= bound)
        path = _mixed(value[row, col] + above[row])
        out.append((above[row], path))
        above = path
        if not len(path):
            above = np.empty(0, np.uint64)
    return out


def _prepare(docs: DataFrame, runs: int, threshold: float, k: int) -> DataFrame:
    """(doc, key, n, sketch, p1, p2, p3...): what the search needs to know of each document."""
    names = ["doc", "key", "n", "sketch", *(f"p{d}" for d in range(1, DEPTH + 1))]
    pairs = pa.list_(pa.struct([("up", pa.int64()), ("p", pa.int64())]))
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), *[pairs] * DEPTH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, keys, sizes, sketches = batch.column(0).to_pylist(), [], [], []
                ups: list[list] = [[] for _ in range(DEPTH)]
                paths: list[list] = [[] for _ in range(DEPTH)]
                ends = [[0] for _ in range(DEPTH)]
                for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                    s = shingle_set(text, k)
                    known = len(s) > 0 and doc is not None
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if known else None)
                    sizes.append(len(s))
                    sketches.append(sketch(s) if known else None)
                    for d, (up, p) in enumerate(chosen_paths(s, runs, threshold) if known else ()):
                        ups[d].append(up)
                        paths[d].append(p)
                        ends[d][-1] += len(p)
                    for e in ends:
                        e.append(e[-1])
                columns = []
                for d in range(DEPTH):
                    flat = [pa.array((np.concatenate(x) if x else np.empty(0, np.uint64)).view(np.int64)) for x in (ups[d], paths[d])]
                    bounds = pa.array([0, *ends[d][:-1]], pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(flat, ["up", "p"])))
                values = [pa.array(v, t) for v, t in zip((ids, keys, sizes, sketches), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*values, *columns], names=names)

    kind = "array<struct<up: long, p: long>>"
    schema = "doc long, key binary, n int, sketch binary, " + ", ".join(f"p{d} {kind}" for d in range(1, DEPTH + 1))
    return docs.mapInArrow(run, schema)


def _blocks(rows: DataFrame, blocks: str, tie: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: columns b (its own), bi <= bj."""
    own = rows.withColumn("b", F.pmod(F.xxhash64(tie), F.col(blocks)).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return other.withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o")


def _by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _large(rows: DataFrame) -> DataFrame:
    """(path, blocks) of the buckets with more than SMALL sets; counts are combined before the shuffle."""
    found = cut(rows.groupBy("p").agg(F.count("*").alias("m")).where(F.col("m") > SMALL).select("p", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    return F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found


def _bucket_rows(sets: DataFrame) -> DataFrame:
    """(p, bi, bj, rep, n, sketch): the sets of every bucket to compare."""
    level = lambda d: sets.select("rep", "n", "sketch", F.explode(f"p{d}").alias("x")).select("rep", "n", "sketch", "x.up", "x.p")
    rows, out = level(1).drop("up"), None
    for d in range(1, DEPTH + 1):
        large = _large(rows)
        small = rows.join(large, "p", "left_anti").withColumn("blocks", F.lit(1))
        if d == DEPTH:  # what a bucket of the last level still holds is compared block by block
            small = small.unionByName(rows.join(large, "p"))
        out = small if out is None else out.unionByName(small)
        if d < DEPTH:
            # Counted and then compared or split again: made once, for the large buckets' sets only.
            rows = cut(level(d + 1).join(large.select(F.col("p").alias("up")), "up", "left_semi").drop("up"))
    return _blocks(out, "blocks", "rep").select("p", "bi", "bj", "rep", "n", "sketch")


def _joined(lab: np.ndarray, pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Joins labels in place; gives the pairs that joined two."""

    def find(x: int) -> int:
        while lab[x] != x:
            lab[x] = lab[lab[x]]
            x = lab[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            lab[max(a, b)] = min(a, b)
            yield i, j


def compare_buckets(threshold: float):
    """For mapInArrow over sorted buckets: links (a, b) that join similar sets, not all similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in key_runs(batches, ["p", "bi", "bj"]):
            sizes = np.diff(bounds)
            if sizes.max() < 2:
                continue
            keep = np.repeat(sizes > 1, sizes)
            end = np.repeat(np.cumsum(np.where(sizes > 1, sizes, 0)), sizes)[keep]
            t = t.filter(pa.array(keep))
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            lab = np.arange(len(rep))
            out: list[tuple[int, int]] = []
            idx = np.arange(len(rep))
            for step in range(1, int(sizes.max())):
                idx = idx[idx + step < end[idx]]
                i = idx[lab[idx] != lab[idx + step]]
                j = i + step
                near = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[near], j[near]
                if not len(i):
                    continue
                x, y = sk[i], sk[j]
                some = ((x | y) > 0).sum(1)
                same = ((x == y) & (x > 0)).sum(1)
                hit = same >= threshold * some - 5 * np.sqrt(threshold * (1 - threshold) * some)
                new = list(_joined(lab, zip(i[hit].tolist(), j[hit].tolist(), strict=True)))
                if new:
                    out += new
                    while True:
                        up = lab[lab]
                        if np.array_equal(up, lab):
                            break
                        lab = up
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, from the tokens that two sets or more have."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1] if shared.any() else token[shared]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = 4096
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (first, first + width))
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], token[a:b] - first] = 1
        out += part @ part.T
    return out


def verify_components(threshold: float, k: int):
    """For mapInArrow over sorted components: (rep, component, blocks, links, root) by exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for t, bounds in key_runs(batches, ["component", "bi", "bj"]):
            rows: list[list] = [[] for _ in kinds]
            for a, b in zip(bounds, bounds[1:], strict=False):
                g = t.slice(a, b - a)
                sets = [shingle_set(x, k) for x in g.column("text").to_pylist()]
                fits = [xxhash.xxh3_128_digest(s.tobytes()) == key for s, key in zip(sets, g.column("key").to_pylist(), strict=True)]
                first: dict = {}
                for i, pair in enumerate(zip(g.column("rep").to_pylist(), g.column("key").to_pylist(), strict=True)):
                    fits[i] = fits[i] and first.setdefault(pair, i) == i  # rows that repeat a document count once
                g, sets = g.filter(pa.array(fits)), [s for s, f in zip(sets, fits, strict=True) if f]
                if not sets:
                    continue
                rep, copies, own = (g.column(c).to_numpy() for c in ("rep", "copies", "b"))
                size = np.array([len(s) for s in sets], np.float64)
                inter = _common(sets).astype(np.float64)
                ok = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
                ok &= rep[:, None] != rep[None, :]
                if g.column("bi")[0] != g.column("bj")[0]:
                    ok &= own[:, None] != own[None, :]
                root = rep.copy()
                while True:
                    low = np.minimum(root, np.where(ok, root[None, :], np.iinfo(np.int64).max).min(1))
                    if np.array_equal(low, root):
                        break
                    root = low
                for column, values in zip(rows, (rep, g.column("component").to_numpy(), g.column("blocks").to_numpy(), ok @ copies, root), strict=True):
                    column += values.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds, strict=True)], names=["rep", "component", "blocks", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) of every row: the least id joined to it by links, and its number of links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "chosen-paths")
    _prepare(rows, runs_for(recall), threshold, k).write.parquet(path)
    known = spark.read.parquet(path)
    payload = ["n", "sketch", *(f"p{d}" for d in range(1, DEPTH + 1))]
    sets = known.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.count_distinct("doc").alias("copies"), F.first(F.struct(*payload)).alias("x"))
    sets = cut(sets.select("key", "rep", "copies", "x.*"))
    links = _by_key(_bucket_rows(sets), ["p", "bi", "bj"]).mapInArrow(compare_buckets(threshold), "a long, b long")
    components = connected_components(links)
    members = sets.select("rep", "key", "copies", "n").join(components.withColumnRenamed("node", "rep"), "rep")
    # The most blocks that a component needs, for its sets or for their shingles.
    blocks = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = _blocks(members.join(blocks, "component"), "blocks", "rep")
    texts = rows.where("doc is not null")
    dealt = texts.join(members, texts.doc == members.rep).select("component", "bi", "bj", "b", "blocks", "rep", "key", "copies", "text")
    verified = cut(_by_key(dealt, ["component", "bi", "bj"]).mapInArrow(verify_components(threshold, k), "rep long, component long, blocks int, links long, root long"))
    whole = verified.where("blocks = 1").select("rep", "links", "root")
    split = verified.where("blocks > 1")
    if split.limit(1).count():
        roots = connected_components(split.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        sums = split.groupBy("rep").agg(F.sum("links").alias("links"))
        roots = roots.withColumnRenamed("node", "rep").withColumnRenamed("component", "root")
        whole = whole.unionByName(sums.join(roots, "rep", "left").select("rep", "links", F.coalesce("root", "rep").alias("root")))
    classes = sets.select("key", "rep", "copies").join(whole, "rep", "left")
    classes = classes.select("key", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.select("doc", "key").join(classes, "key", "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one of the least id.

    Each row is judged by its own text: rows without an id, and those whose id another text has too, are told apart by a hash
    of id and text that is greater than any id below 2^62. Rows that repeat an id and its text are one document, of which one row stays.
    """
    own = "row_key"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    stand_in = F.lit(1 << 62) + F.xxhash64(id_col, text_col).bitwiseAND(F.lit((1 << 62) - 1))
    # Ids that rows share, and whether their texts differ: found from a hash a row, without the texts.
    tie, differ, again = F.xxhash64(F.lit(31), text_col), f"{own}2", f"{own}3"
    counts = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(own)).agg(F.count("*").alias("n"), F.min(tie).alias("a"), F.max(tie).alias("b"))
    shared = cut(counts.where("n > 1").select(own, (F.col("a") != F.col("b")).alias(differ)))
    few = shared.limit(BROADCAST_ROWS + 1).count()
    keyed = docs.withColumn(own, F.col(id_col).cast("long"))
    keyed = keyed.join(F.broadcast(shared) if few <= BROADCAST_ROWS else shared, own, "left") if few else keyed.withColumn(differ, F.lit(None).cast("boolean"))
    apart = F.col(own).isNull() | F.coalesce(differ, F.lit(False))
    keyed = keyed.select(*docs.columns, F.when(apart, stand_in).otherwise(F.col(own)).alias(own), (F.col(own).isNull() | F.col(differ).isNotNull()).alias(again))
    found = near_duplicates(keyed, threshold, recall, k, own, text_col)
    others = found.where(F.col(own) != F.col("class_id")).select(own).distinct()
    kept = keyed.join(others, own, "left_anti")
    # Only rows that may be repeated are shuffled to drop repeats.
    return kept.where(~F.col(again)).unionByName(kept.where(again).dropDuplicates([own])).select(*docs.columns)
