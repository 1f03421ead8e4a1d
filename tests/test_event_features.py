"""Event windows, slices, movies and stateful products against numpy."""

import numpy as np
from pyspark.sql import functions as F

from evokit.operators import event_features as ef
from evokit.session import scratch_path
from evokit.streaming import products


def windows_of(r, n, width, length):
    frames = r.normal(size=(n, width))
    events = [(int(t), k) for t, k in zip(r.integers(0, n, 60), r.choice(["on", "off", "odd"], 60), strict=True)]
    events = sorted(set(events))
    padded = np.vstack((frames, np.zeros((length, width))))
    return frames, events, {e: padded[e[0] : e[0] + length].ravel() for e in events}


def test_event_components(spark):
    r = np.random.default_rng(1)
    frames, events, expected = windows_of(r, 80, 3, 4)
    f = spark.createDataFrame([(0, t, [float(v) for v in x]) for t, x in enumerate(frames)] + [(0, 90, None)], "s int, t long, x array<double>")
    e = spark.createDataFrame([(0, t, k) for t, k in events], "s int, t long, kind string")
    w = ef.event_windows(e, f, "s", "t", "x", 4, 3)
    got = {(x.t, x.kind): np.array(x.window) for x in w.collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    out, directions = ef.event_components(w, "kind", ["on", "off", "never"], 5)
    x = np.array(list(expected.values()))
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(abs(v[:5] @ directions), np.eye(5), atol=1e-6) and s[0] > 0
    for row in out.collect():
        own = (expected[row.t, row.kind] - x.mean(0)) @ directions
        features = np.array(row.features).reshape(3, 5)
        for k, name in enumerate(["on", "off", "never"]):
            assert np.allclose(features[k], own if name == row.kind else 0)
    assert ef.event_components(w, "kind", ["on"], 99)[1].shape == (12, 12)
    power = {(x.t, x.kind, x.k, x.l): x.power for x in ef.event_modulation(w, ["t", "kind"], 4, 3, 1, 1).collect()}
    dense = {k: abs(np.fft.fft2(v.reshape(4, 3) - v.mean())) ** 2 for k, v in expected.items()}
    mean = np.mean(list(dense.values()), axis=0)
    assert len(power) == len(expected) * 6
    for (t, kind, k, l), v in power.items():
        assert np.isclose(v, (dense[t, kind] - mean)[k % 4, l])


def test_slices(spark):
    r = np.random.default_rng(2)
    wave = {c: r.integers(0, 99, n).tolist() for c, n in (("a", 103), ("b", 16))}
    samples = spark.createDataFrame([(c, i, v) for c, w in wave.items() for i, v in enumerate(w)] + [("a", -1, 5)], "c string, i long, v long")
    blocks = ef.sample_blocks(samples, "c", "i", "v", 16)
    assert sorted((x.c, x.block, len(x.data)) for x in blocks.collect())[-2:] == [("a", 6, 7), ("b", 0, 16)]
    bounds = [(0.0, 0.3), (1.55, 1.65), (1.6, 3.2), (3.2, 3.2), (5.0, 4.0), (-1.0, 0.4), (9.9, 50.0), (50.0, 60.0), (0.0, 10.3), (None, 1.0), (0.25, 0.26)]
    rows = [(k, c, a, z) for k, (a, z) in enumerate(bounds) for c in ("a", "b", "gone")] + [(1, "a", 1.55, 1.65)]
    got = ef.slices(spark.createDataFrame(rows, "id int, c string, start double, stop double"), blocks, "c", "start", "stop", 10.0, 16).collect()
    assert len(got) == len(rows)
    for x in got:
        none = x.start is None or x.c == "gone"
        assert x.data == ([] if none else wave[x.c][max(int(np.floor(x.start * 10)), 0) : max(int(np.floor(x.stop * 10)), 0)]), x


def test_movie(spark, monkeypatch):
    monkeypatch.setattr(ef, "FRAMES", 4)
    r = np.random.default_rng(3)
    for n, length in ((13, 5), (9, 4), (3, 6)):
        movie = r.normal(size=(n, 2, 3))
        d = spark.createDataFrame([(t, [float(v) for v in movie[t].ravel()]) for t in range(n)], "t long, x array<double>")
        got = {}
        for x in ef.movie_fourier(d, "t", "x", (2, 3), length).collect():
            got.setdefault(x.t, {})[x.k] = x.v
        mask = ef.fade(2, 0.05)[:, None, None] * ef.fade(3, 0.05)[None, :, None] * ef.fade(length, 0.05)
        for t in range(n):
            at = (np.arange(1, length + 1) + t + 1 - -(-length // 2) - 1) % n
            cube = movie[at].transpose(1, 2, 0) * mask
            dense = abs(np.fft.fftshift(np.fft.fftn(cube)))[:, :, -(length // 2 + 1) :].ravel()
            assert np.allclose([got[t][k] for k in range(len(dense))], dense), (n, length, t)
    assert np.isclose(ef.fade(5, 0.05)[0], 0.05) and ef.fade(5, 0.05)[2] == 1
    # A frame that isn't there is zeros and gives no row.
    assert ef.movie_fourier(d.where("t <> 1"), "t", "x", (2, 3), 6).select("t").distinct().count() == 2


def test_stateful_products(spark, tmp_path):
    """Any split into batches gives the batch query's sums, across a restart; a quiet key ends and comes again anew; late rows are dropped and counted."""
    r = np.random.default_rng(5)
    rows = [(k, int(s), float(a), float(b)) for k, s, a, b in zip(r.choice(["a", "b", "c"], 40), np.sort(r.integers(1, 3000, 40)), r.integers(0, 9, 40), r.integers(0, 9, 40), strict=True)]
    schema = "k string, s long, x double, y double"
    whole = {x.k: tuple(x)[1:] for x in spark.createDataFrame(rows, schema).groupBy("k").agg(F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))).collect()}

    def put(path, part):
        spark.createDataFrame(part, schema).coalesce(1).withColumn("ts", F.timestamp_seconds("s")).write.mode("append").parquet(path)

    def run(path, check, out, alive):
        source = spark.readStream.schema("k string, s long, x double, y double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        q = products.running_products(source, "ts", "k", "x", "y", "1 hour", alive).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        return products.late_rows(q.recentProgress)

    for split in ([40], [7, 33], [10, 10, 10, 10]):
        path, check, out = (scratch_path(spark, x) for x in ("in", "check", "out"))
        at = 0
        for n in split:  # a start from the checkpoint for each part
            put(path, rows[at : at + n])
            at += n
            run(path, check, out, 10**9)
        last = {x.k: x.v for x in spark.read.parquet(out).groupBy("k").agg(F.max_by(F.struct(*products.SUMS), "batch").alias("v")).collect()}
        assert {k: tuple(v) for k, v in last.items()} == whole
    path, check, out = (scratch_path(spark, x) for x in ("in", "check", "out"))
    parts = [[("a", 100, 1.0, 2.0)], [("b", 90_000, 1.0, 1.0)], [("b", 90_001, 1.0, 1.0), ("a", 5, 9.0, 9.0)], [("a", 90_010, 3.0, 1.0), (None, 90_010, 1.0, 1.0)]]
    late = 0
    for part in parts:
        put(path, part)
        late += run(path, check, out, 3_600_000)
    got = sorted((x.batch, x.k, x.n, x.sxy, x.final) for x in spark.read.parquet(out).collect())
    seen = [g[1:] for g in got]
    assert ("a", 1.0, 2.0, True) in seen and ("a", 1.0, 3.0, False) in seen and ("b", 2.0, 2.0, False) in seen and late == 1
    assert not any(g[2] > 1.5 and g[1] == "a" for g in got)
