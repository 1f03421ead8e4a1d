"""Readers of trials, spikes, sound clips and word tables. All go through Spark's sources, so any store works."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spike_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, repetition, spike_times): one row a line of ``spike<N>`` files; a blank line is a trial without spikes.

    A file is one record, as line numbers count within it; it holds the trials of one stimulus.
    """
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("repetition", "line"))
    times = F.transform(F.array_remove(F.split(F.trim("line"), r"\s+"), ""), lambda x: x.cast("double"))
    number = F.regexp_extract("path", r"spike(\d+)[^/]*$", 1).cast("int")
    return lines.select("path", number.alias("number"), "repetition", times.alias("spike_times"))


def spike_raster(spikes: DataFrame, duration: int) -> DataFrame:
    """(number, repetition, bin): distinct bins of valid times, the rounded time plus one, below ``duration``."""
    t = spikes.select("number", "repetition", F.explode("spike_times").alias("t")).where("t >= 0 and not isnan(t)")
    return t.select("number", "repetition", (F.round("t") + 1).cast("int").alias("bin")).where(F.col("bin") < duration).distinct()


def stimulus_links(spark: SparkSession, path: str) -> DataFrame:
    """(number, sound): the first line of each ``stim<N>`` file."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.regexp_extract("path", r"stim(\d+)[^/]*$", 1).cast("int").alias("number"), F.trim(F.split("value", "\n")[0]).alias("sound"))


def stimulus_pairs(spark: SparkSession, stimuli: str, spikes: str) -> tuple[DataFrame, DataFrame]:
    """Stimulus links with their spike files by number, and the spike files that have none."""
    links, trains = stimulus_links(spark, stimuli), spike_text(spark, spikes)
    return links.join(trains, "number"), trains.select("number", "path").distinct().join(links, "number", "left_anti")


def wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channel, samples) of 8-, 16- or 32-bit sound files, scaled to -1..1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
                    data = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
                data = (data - 128) / 128 if width == 1 else data / float(1 << (8 * width - 1))
                data = data.reshape(-1, channels)
                columns = [[name] * channels, [rate] * channels, list(range(channels)), [data[:, k] for k in range(channels)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["path", "rate", "channel", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, rate int, channel int, samples array<double>")


WORDS = "word_idx long, start double, end double, est_idx long, est_end_idx long, sentence_idx long, idx_in_sentence long, speaker string, rms double, pitch double, magnitude double, surprisal double, mel string"


def words(spark: SparkSession, path: str) -> DataFrame:
    """The word table, with its list of mel values read from text."""
    rows = spark.read.csv(path, header=True, schema=WORDS)
    return rows.withColumn("mel", F.from_json("mel", "array<double>"))


READERS = {"parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p), "csv": lambda s, p: s.read.csv(p, header=True), "json": lambda s, p: s.read.json(p), "txt": lambda s, p: s.read.text(p), "wav": wav}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path; an unknown ending is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise TypeError(f"no reader for .{kind}")
    return READERS[kind](spark, path)
