"""Features of windows at events, slices of block-stored samples, and windowed transforms of movies.

Windows are equi-joins on (key, frame); components follow from sums of products of flattened windows, so the driver gets the
square of a window's size. Samples are stored as blocks, a row a block, and an interval is joined to the blocks that it touches. A movie's frames are dealt
into blocks with the frames on either side that a window reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evokit.operators import regression as rg

#: Frames of a movie in one task's group.
FRAMES = 256


def event_windows(events: DataFrame, frames: DataFrame, key: str, index: str, vector: str, length: int, width: int) -> DataFrame:
    """(event columns, window): the ``length`` frames of ``width`` values from each event on, one after another; frames past an end, null or of another width are zeros."""
    spread = events.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("frame", F.col(index) + F.col("lag"))
    right = frames.select(F.col(key), F.col(index).alias("frame"), F.col(vector).cast("array<double>").alias("x"))
    whole = F.when((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)), F.col("x")).otherwise(F.array_repeat(F.lit(0.0), width))
    joined = spread.join(right, [key, "frame"], "left").select(*events.columns, F.struct("lag", whole.alias("x")).alias("v"))
    return joined.groupBy(*events.columns).agg(F.flatten(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["x"])).alias("window"))


def event_components(windows: DataFrame, kind: str, kinds: list, components: int) -> tuple[DataFrame, np.ndarray]:
    """(``windows`` with ``features`` in place of ``window``, directions): each window on the largest principal components of all windows, in the block of its kind.

    Features have a block of ``components`` for each of ``kinds``, zeros but for the event's own; a kind without events is zeros, an event of another kind too. Where a
    window is shorter than ``components`` there are as many as it has values.
    """
    m = rg.total(rg.array_moments(windows.withColumn("zero", F.lit(0.0)).withColumn("all", F.lit(0)), "window", "zero", "all"))
    _, directions = rg.principal_components(m, components)
    centre = m.centred()[2]
    size = directions.shape[1]
    out = windows.withColumn("place", F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col(kind)).cast("int") - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name != "window") + ", features array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if not len(g):
                continue
            scores = (np.stack(g["window"].to_numpy()).astype(float) - centre) @ directions
            features = np.zeros((len(g), len(kinds) * size))
            for i, place in enumerate(g["place"].fillna(-1).astype(int)):
                if place >= 0:
                    features[i, place * size : (place + 1) * size] = scores[i]
            yield g.drop(columns=["window", "place"]).assign(features=list(features))

    return out.mapInPandas(run, schema), directions


def event_modulation(windows: DataFrame, keys: list[str], length: int, width: int, times: int, bands: int) -> DataFrame:
    """(keys..., k, l, power): two-dimensional power of each window about its own mean, at temporal frequencies -times..times and spectral ones 0..bands, less the mean over all windows."""
    schema = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys) + ", p array<double>"
    at = np.arange(-times, times + 1) % length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                w = np.stack(g["window"].to_numpy()).astype(float).reshape(-1, length, width)
                p = abs(np.fft.fft2(w - w.mean((1, 2), keepdims=True))) ** 2
                yield g[keys].assign(p=list(p[:, at, : bands + 1].reshape(len(g), -1)))

    rows = windows.select(*keys, "window").mapInPandas(run, schema).select(*keys, F.posexplode("p").alias("i", "p"))
    mean = rows.groupBy("i").agg(F.avg("p").alias("mean"))  # a row a frequency
    place = F.floor(F.col("i") / (bands + 1)) - times
    return rows.join(F.broadcast(mean), "i").select(*keys, place.cast("int").alias("k"), (F.col("i") % (bands + 1)).cast("int").alias("l"), (F.col("p") - F.col("mean")).alias("power"))


def sample_blocks(samples: DataFrame, key: str, index: str, value: str, size: int) -> DataFrame:
    """(key, block, data): samples 0, 1, 2... of each channel stored ``size`` to a row; ones that are not there are null."""
    rows = samples.where(F.col(index) >= 0).groupBy(key, F.floor(F.col(index) / size).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col(index) % size).cast("int").alias("u"), F.col(value).alias("v")))).alias("m"))
    return rows.select(key, "block", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda u: F.try_element_at("m", u)).alias("data"))


def slices(intervals: DataFrame, blocks: DataFrame, key: str, start: str, stop: str, rate: float, size: int) -> DataFrame:
    """(interval columns, data): the samples from floor(start * rate) to before floor(stop * rate) of the interval's channel, cut from its blocks and put together in order.

    What lies before 0 or past the last sample is left out; an interval that holds nothing, ends before it starts or has a null bound, or whose channel isn't there, has an empty array. An interval's size is
    that of its data, so its parts meet in one row.
    """
    a, z = F.when(F.col(start).isNotNull(), F.greatest(F.floor(F.col(start) * rate), F.lit(0))), F.floor(F.col(stop) * rate)
    names = intervals.columns
    numbered = intervals.withColumn("row_", F.monotonically_increasing_id()).withColumns({"a_": a, "z_": z})
    touched = numbered.where("z_ > a_").select("row_", key, "a_", "z_", F.explode(F.sequence(F.floor(F.col("a_") / size), F.floor((F.col("z_") - 1) / size))).alias("block"))
    first = F.greatest(F.col("a_") - F.col("block") * size, F.lit(0))
    last = F.least(F.col("z_") - F.col("block") * size, F.size("data"))
    cut_ = touched.join(blocks, [key, "block"]).select("row_", F.struct("block", F.slice("data", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).alias("data")).alias("x"))
    joined = cut_.groupBy("row_").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["data"])).alias("data"))
    kind = blocks.schema["data"].dataType.simpleString()
    return numbered.join(joined, "row_", "left").select(*names, F.coalesce("data", F.array().cast(kind)).alias("data"))


def fade(n: int, limit: float) -> np.ndarray:
    """A Gaussian over n places that falls to ``limit`` at the first and last."""
    x = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    return np.exp(np.log(limit) * x**2)


def movie_fourier(movie: DataFrame, index: str, pixels: str, shape: tuple[int, int], length: int, limit: float = 0.05) -> DataFrame:
    """(index, k, v): sizes of the three-dimensional spectrum of ``length`` frames about each frame, faded to the edges, at the temporal frequencies from 0 up.

    The movie is a circle: frames 0..n - 1, the first after the last. k runs over rows, columns and temporal frequencies of the
    shifted spectrum. Frames that aren't there, null pixels and frames of another size are zeros; a movie of fewer frames than a window goes round it more than once.
    """
    (h, w), n = shape, (movie.agg(F.max(index)).first()[0] or 0) + 1
    before = -(-length // 2) - 1
    mask = fade(h, limit)[:, None, None] * fade(w, limit)[None, :, None] * fade(length, limit)[None, None, :]
    kept = length // 2 + 1
    rows = movie.where(F.col(index) >= 0).select(F.col(index).cast("long").alias("t"), F.transform(F.col(pixels).cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))).alias("x")).where(F.size("x") == h * w)
    # The places on the circle's line, a turn before and after, from which a block's windows reach a frame.
    turns = range(-(-length // n) * -1, -(-length // n) + 1)
    at = F.explode(F.array(*(F.lit(k * n) for k in turns)))
    near = F.sequence(F.floor((F.col("at") - (length - 1 - before)) / FRAMES), F.floor((F.col("at") + before) / FRAMES))
    spread = rows.select("t", "x", at.alias("turn")).withColumn("at", F.col("t") + F.col("turn")).where(F.col("at").between(-before, n - 1 + length)).withColumn("block", F.explode(near)).where((F.col("block") >= 0) & (F.col("block") * FRAMES < n))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["block"].iloc[0]) * FRAMES
        last = min(first + FRAMES, n)
        line = np.zeros((last - first + length - 1, h, w))
        own = g[(g["at"] >= first - before) & (g["at"] < last + length - 1 - before)]
        line[own["at"].to_numpy() - first + before] = np.stack(own["x"].to_numpy()).reshape(-1, h, w) if len(own) else 0
        out = []
        for k in range(last - first):
            cube = line[k : k + length].transpose(1, 2, 0) * mask
            out.append(abs(np.fft.fftshift(np.fft.fftn(cube)))[:, :, -kept:].ravel())
        there = np.isin(np.arange(first, last), g["t"][g["t"] == g["at"]])
        return pd.DataFrame({"t": np.arange(first, last)[there], "v": [v for v, keep in zip(out, there, strict=True) if keep]})

    done = spread.groupBy("block").applyInPandas(run, "t long, v array<double>")
    return done.select(F.col("t").alias(index), F.posexplode("v").alias("k", "v"))
