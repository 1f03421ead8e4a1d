"""Operator 12: hard negatives by vantage-point trees over norm-augmented vectors.

Every vector gets one more component, the square root of M^2 - |x|^2 with M the largest norm, and an anchor gets 0 there. The distance of an
anchor q to a row x is then the root of |q|^2 + M^2 - 2 <q, x>: nearer is the same as of higher score, and a window of scores is an annulus of
distances. An anchor's positives are its nearest rows of its label; the negatives of a positive are the first rows of other labels that a
nearest-first traversal meets inside the annulus of its window.

Index: a tree of vantage points over a sample of at most ``SAMPLE`` rows, those least by a hash of their id, deals *every* row to one of at most
``LEAVES`` regions; a region is dealt by hash into blocks of about ``BLOCK`` rows, and a block, one row of a Parquet table, holds a tree of its
own down to buckets of ``BUCKET`` rows. However many equal vectors there are, a block is bounded.
Search: anchors first visit the region that they lie in, or where their annulus begins. What they find bounds how far the others have to be looked
at; regions, and in them buckets, beyond that distance or outside the annulus are left out. In a block, an anchor goes
through buckets by their least distance and stops when no bucket left can hold anything nearer. Bounds have a slack for rounding, scores are
whole numbers and exact, so the result is that of brute force (tested), not an approximation.

How much is left out depends on the vectors: clustered ones prune well; for those spread evenly over a sphere of many
dimensions no tree of distances prunes (all are about equally far), and every bucket is visited, in blocks, by matrix products.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; of rows that share an id the
least by label, then vector, does; shorter vectors count as if filled up with zeros; components are floored after ``scale`` and must
stay under 2^24 with squared norms under 2^46, else an error is raised; ties go to the smaller id; an anchor without other rows of its label, or a positive with a
score under 0 (whose window is empty), gives no row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evokit.session import cut, scratch_path

SAMPLE = 4096
LEAVES = 64
BLOCK = 4096
BUCKET = 256
#: Anchors that go through a block together.
CHUNK = 512
#: The per cent of a positive's score that bound its window.
WINDOW = (50, 95)
_NONE = np.iinfo(np.int64).min
FOUND = "anchor long, anchor_label int, place int, positive_id long, positive_score long, id long, score long"


class Tree:
    """A complete binary tree of vantage points: rows nearer to the point than the median go left, the others right; each child keeps the least and greatest distance of its rows.

    ``order`` lists the rows leaf by leaf, ``ends`` where each leaf begins and ends.
    """

    def __init__(self, x: np.ndarray, top: float, depth: int):
        """``top`` is M^2."""
        self.depth, self.top = depth, top
        n, norms = len(x), (x * x).sum(1)
        tail = np.sqrt(np.maximum(top - norms, 0))
        self.points, self.lo, self.hi, self.median = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2 ** (depth + 1) - 1), np.full(2 ** (depth + 1) - 1, np.inf), np.zeros(2**depth - 1)
        self.tails = np.zeros(2**depth - 1)
        parts = [np.arange(n)]
        for level in range(depth):
            halves = []
            for k, rows in enumerate(parts):
                at = 2**level - 1 + k
                if not len(rows):
                    self.median[at] = 0
                    halves += [rows, rows]
                    self.lo[2 * at + 1] = self.lo[2 * at + 2] = np.inf
                    self.hi[2 * at + 1] = self.hi[2 * at + 2] = -np.inf
                    continue
                far = rows[np.argmax(self._between(x[rows], tail[rows], x[rows[0]], tail[rows[0]]))]
                self.points[at], self.tails[at] = x[far], tail[far]
                d = self._between(x[rows], tail[rows], x[far], tail[far])
                place = np.argsort(d, kind="stable")
                half = (len(rows) + 1) // 2
                self.median[at] = d[place[half - 1]]
                for child, own in ((2 * at + 1, place[:half]), (2 * at + 2, place[half:])):
                    halves.append(rows[own])
                    self.lo[child], self.hi[child] = (d[own].min(), d[own].max()) if len(own) else (np.inf, -np.inf)
            parts = halves
        self.order = np.concatenate(parts)
        self.ends = np.cumsum([0, *(len(p) for p in parts)])

    def _between(self, x: np.ndarray, tail: np.ndarray, p: np.ndarray, p_tail: float) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * (x @ p + tail * p_tail), 0))

    def open_ended(self) -> Tree:
        """For rows that were not there when the tree was made: left is up to the median, right from there on."""
        self.lo[1::2], self.hi[1::2] = 0, self.median
        self.lo[2::2], self.hi[2::2] = self.median, np.inf
        return self

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        tail = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(2 * self.top - 2 * ((x * self.points[at]).sum(1) + tail * self.tails[at]), 0))
            at = 2 * at + 1 + (d > self.median[at])
        return at - (2**self.depth - 1)

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance of each anchor to the rows of each leaf, by the triangle inequality at every vantage point on the way."""
        norms = (q * q).sum(1)[:, None]
        least, most = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            d = np.repeat(np.sqrt(np.maximum(norms + self.top - 2 * (q @ self.points[nodes].T), 0)), 2, 1)
            lo, hi = self.lo[2 ** (level + 1) - 1 : 2 ** (level + 2) - 1], self.hi[2 ** (level + 1) - 1 : 2 ** (level + 2) - 1]
            least = np.maximum(np.repeat(least, 2, 1), np.maximum(d - hi, lo - d))
            most = np.minimum(np.repeat(most, 2, 1), d + hi)
        return least, most


class Anchors:
    """Anchors with the windows of scores in which they look for the ``k`` best rows; ``floor`` is the least score that still matters, of the window or of what was found elsewhere."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, high: np.ndarray, floor: np.ndarray, same: bool, k: int, top: float):
        self.ids, self.labels, self.q, self.high, self.floor, self.same, self.k, self.top = ids, labels, q, high, floor.copy(), same, k, top
        self.norms = (q * q).sum(1)
        self.slack = 1e-6 * (1 + np.sqrt(self.norms.max(initial=0)) + np.sqrt(top))

    def distance(self, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norms[:, None] + self.top - 2.0 * score, 0))

    def wanted(self, least: np.ndarray, most: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which anchors can find something between the distances ``least`` and ``most`` of a region, in any of their windows."""
        outer, inner = self.distance(self.floor)[rows], self.distance(self.high)[rows]
        open_ = (self.high >= self.floor)[rows]
        return (open_ & (least[:, None] <= outer + self.slack) & (most[:, None] >= inner - self.slack)).any(1)


def search(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, tree: Tree, a: Anchors) -> np.ndarray:
    """(anchors, windows, k) places in ``ids`` of the best rows, -1 where there are fewer; ``x``, ``ids`` and ``labels`` are in the tree's order."""
    n = len(x)
    best = np.full((*a.high.shape, a.k), _NONE)
    if not n or not len(a.ids):
        return np.full(best.shape, -1)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    least, most = tree.reach(a.q)
    turn = np.argsort(np.maximum(least, a.distance(a.high).min(1)[:, None]), 1, kind="stable")
    every = np.arange(len(a.ids))
    for t in range(turn.shape[1]):
        leaf = turn[:, t]
        active = np.flatnonzero(a.wanted(least[every, leaf], most[every, leaf]))
        for b in np.unique(leaf[active]):
            rows = active[leaf[active] == b]
            own = slice(tree.ends[b], tree.ends[b + 1])
            if own.start == own.stop:
                continue
            score = np.rint(a.q[rows] @ x[own].T).astype(np.int64)
            fits = (labels[own] == a.labels[rows][:, None]) == a.same
            if a.same:
                fits &= ids[own] != a.ids[rows][:, None]
            # One number orders rows by score, then by the smaller id.
            key = score * n - rank[own]
            for w in range(best.shape[1]):
                seen = fits & (score <= a.high[rows, w][:, None]) & (score >= a.floor[rows, w][:, None])
                some = np.flatnonzero(seen.any(1))
                if not len(some):
                    continue
                kept = np.concatenate([best[rows[some], w], np.where(seen[some], key[some], _NONE)], 1)
                kept = np.sort(np.partition(kept, kept.shape[1] - a.k, 1)[:, -a.k :], 1)[:, ::-1]  # _NONE last; it has no negative
                best[rows[some], w] = kept
                full = kept[:, -1] != _NONE
                a.floor[rows[some][full], w] = np.maximum(a.floor[rows[some][full], w], -(-kept[full, -1] // n))
    place = np.full(best.shape, -1)
    there = best != _NONE
    score = -(-best[there] // n)
    place[there] = by_id[score * n - best[there]]
    return place


def prepared(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): the rows that take part, their components as whole numbers, one row an id."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("raw"), v.alias("v"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()).where(finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Index:
    """The blocks of all rows in a Parquet table, and the tree over their regions."""

    def __init__(self, rows: DataFrame):
        """``rows`` as ``prepared`` gives them; they are written to the shared folder."""
        spark = rows.sparkSession
        path = scratch_path(spark, "vectors")
        rows.write.parquet(path)
        self.spark, self.rows = spark, spark.read.parquet(path)
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        of = self.rows.select(F.count("*"), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
        self.count, self.width, top, largest = of[0], max(of[1] or 0, 1), float(of[2] or 0), of[3] or 0
        if top >= 2.0**46 or largest >= 2**24:
            raise ValueError("components must stay under 2^24 and squared norms under 2^46")
        self.top = max(top, 1.0)
        sample = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        depth = max(min(LEAVES, self.count // BLOCK, sample.num_rows // 8).bit_length() - 1, 0)
        self.tree = Tree(_matrix(sample.column(0), self.width), self.top, depth).open_ended()
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = self._blocks()
        #: At most LEAVES rows: how many blocks each region has.
        self.regions = {r.leaf: r.n for r in self.blocks.groupBy("leaf").agg(F.max("block").alias("n")).collect()}

    def _blocks(self) -> DataFrame:
        width, tree = self.width, self.spark.sparkContext.broadcast(self.tree)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.value.leaf_of(_matrix(b.column("v"), width))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.columns], names=["leaf", *b.schema.names])

        dealt = self.rows.mapInArrow(deal, "leaf int, id long, label int, v array<long>")
        sizes = F.broadcast(dealt.groupBy("leaf").agg((F.ceil(F.count("*") / BLOCK)).alias("of")))  # at most LEAVES rows
        keyed = dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")).drop("of")

        def pack(group: pa.Table) -> pa.Table:
            x, ids, labels = _matrix(group.column("v"), width), group.column("id").to_numpy(), group.column("label").to_numpy()
            own = Tree(x, tree.value.top, _depth(len(x)))
            order, own.order = own.order, None
            return pa.table({"leaf": group.column("leaf")[:1], "block": group.column("block")[:1], "tree": pa.array([pickle.dumps(own)], pa.binary()), "x": pa.array([x[order].astype("<i4").tobytes()], pa.binary()), "ids": pa.array([ids[order]], pa.list_(pa.int64())), "labels": pa.array([labels[order]], pa.list_(pa.int32()))})

        path = scratch_path(self.spark, "blocks")
        keyed.repartition(self.parts, "leaf", "block").groupBy("leaf", "block").applyInArrow(pack, "leaf int, block int, tree binary, x binary, ids array<long>, labels array<int>").write.parquet(path)
        return self.spark.read.parquet(path)

    def visit(self, anchors: DataFrame, chunks: int, same: bool, k: int, first: bool) -> DataFrame:
        """What anchors find: FOUND rows. ``anchors`` has (id, label, v, windows), a window being (place, positive_id, positive_score, high, floor).

        With ``first`` they visit the region nearest to where their windows begin, else all others that they want.
        """
        if not self.count:
            return self.spark.createDataFrame([], FOUND)
        width, tree, top, regions = self.width, self.spark.sparkContext.broadcast(self.tree), self.top, self.regions
        window = "array<struct<place:int,positive_id:long,positive_score:long,high:long,floor:long>>"

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("v"), width)
                a = _anchors(b.to_pylist(), q, same, k, top)
                least, most = tree.value.reach(q)
                there = np.isin(np.arange(least.shape[1]), list(regions))
                start = np.where(there, np.maximum(least, a.distance(a.high).min(1)[:, None]), np.inf).argmin(1)
                go = np.zeros(least.shape, bool)
                if first:
                    go[np.arange(len(q)), start] = True
                else:
                    for leaf in np.flatnonzero(there):
                        go[:, leaf] = a.wanted(least[:, leaf], most[:, leaf]) & (start != leaf)
                leaves = pa.array([np.flatnonzero(g).astype(np.int32) for g in go], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([leaves, *b.columns], names=["leaves", *b.schema.names])

        routed = anchors.select("id", "label", "v", "windows").mapInArrow(route, f"leaves array<int>, id long, label int, v array<long>, windows {window}")
        spread = routed.select(F.explode("leaves").alias("leaf"), F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.struct("id", "label", "v", "windows").alias("a"))
        packed = spread.groupBy("leaf", "chunk").agg(F.collect_list("a").alias("anchors"))
        last = F.element_at(F.create_map(*(F.lit(x) for kv in regions.items() for x in kv)), F.col("leaf"))
        packed = packed.select("leaf", F.explode(F.sequence(F.lit(0), last)).alias("block"), "anchors")
        units = self.blocks.repartition(self.parts, "leaf", "block").join(packed.repartition(self.parts, "leaf", "block"), ["leaf", "block"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, labels = (b.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
                    x = np.frombuffer(b.column("x")[i].as_py(), "<i4").reshape(len(ids), width).astype(float)
                    own = b.column("anchors")[i].values
                    rows, q = own.to_pylist(), _matrix(own.field("v"), width)
                    a = _anchors(rows, q, same, k, top)
                    place = search(x, ids, labels, pickle.loads(b.column("tree")[i].as_py()), a)
                    at = np.argwhere(place >= 0)
                    if not len(at):
                        continue
                    where = place[tuple(at.T)]
                    score = np.rint((q[at[:, 0]] * x[where]).sum(1)).astype(np.int64)
                    seen = [(rows[r]["id"], rows[r]["label"], rows[r]["windows"][w]) for r, w in at[:, :2].tolist()]
                    cols = ([s[0] for s in seen], [s[1] for s in seen], *([s[2][c] for s in seen] for c in ("place", "positive_id", "positive_score")), ids[where], score)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in (1, 2) else pa.int64()) for n, c in enumerate(cols)], names=[f.split()[0] for f in FOUND.split(", ")])

        return units.select("tree", "x", "ids", "labels", "anchors").mapInArrow(run, FOUND)

    def nearest(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND rows with ``rank``, the first ``k`` of each anchor and window: a first visit, then one to every region that may still hold nearer rows."""
        order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        chunks = max(1, -(-anchors.count() // CHUNK))
        near = cut(best(self.visit(anchors, chunks, same, k, True)))
        # The k-th score found so far is the least that matters from now on.
        worst = near.where(F.col("rank") == k).groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("worst"))
        raised = F.transform("windows", lambda w: w.withField("floor", F.greatest(w["floor"], F.coalesce(F.try_element_at("worst", w["place"]), w["floor"]))))
        rest = anchors.join(worst, "id", "left").withColumn("windows", raised).drop("worst")
        return best(near.drop("rank").unionByName(self.visit(rest, chunks, same, k, False)))


def _depth(n: int) -> int:
    return max(-(-n // BUCKET) - 1, 0).bit_length()


def _anchors(rows: list[dict], q: np.ndarray, same: bool, k: int, top: float) -> Anchors:
    """Anchors of rows with windows, as many windows as the largest number; those that are not there are empty."""
    most = max((len(r["windows"]) for r in rows), default=0)
    high, floor = np.full((len(rows), max(most, 1)), -(2**50)), np.full((len(rows), max(most, 1)), 2**50)
    for i, r in enumerate(rows):
        for j, w in enumerate(r["windows"]):
            high[i, j], floor[i, j] = w["high"], w["floor"]
    return Anchors(np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), q, high, floor, same, k, top)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = WINDOW, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on the column ``id``."""
    low, high = window
    if not 0 <= low <= high:
        raise ValueError("a window needs 0 <= low <= high")
    found = Index(prepared(vectors, scale, id_col, vector_col, label_col))
    anchors = found.rows.where(is_anchor)
    wide = F.lit(2**48)
    whole = F.struct(F.lit(0).alias("place"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"), wide.alias("high"), (-wide).alias("floor"))
    near = found.nearest(anchors.withColumn("windows", F.array(whole)), True, positives)
    near = near.where("score >= 0").select(F.col("anchor").alias("id"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ends = near.select("id", "place", "positive_id", "positive_score", F.expr(f"{high} * positive_score div 100").alias("high"), F.expr(f"({low} * positive_score + 99) div 100").alias("floor"))
    windows = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score", "high", "floor"))).alias("windows"))
    mined = found.nearest(cut(anchors.join(windows, "id")), False, negatives)
    return mined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
