"""Label masks and heatmaps as tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_SCHEMA = "sample_id long, channel int, cls int, y int, x0 int, x1 int"
#: Runs that a task hands on at a time, or the one array that has more.
RUNS = 1 << 16
#: Array files that are made at a time.
ENCODED = 64


def _decode(batches):
    for batch in batches:
        frames, n = [], 0
        for sample_id, content in zip(batch["sample_id"], batch["content"]):
            label = np.load(io.BytesIO(content))
            if label.ndim != 3 or label.shape[0] < 2:
                raise ValueError(f"label of sample {sample_id} has shape {label.shape}, expected (2, H, W)")
            for channel in (0, 1):
                plane = label[channel]
                edge = np.ones(plane.shape, dtype=bool)
                edge[:, 1:] = plane[:, 1:] != plane[:, :-1]
                y, x0 = np.nonzero(edge)
                last = np.append(y[1:] != y[:-1], True)
                x1 = np.where(last, plane.shape[1] - 1, np.append(x0[1:], 0) - 1)
                frames.append(pd.DataFrame({"sample_id": sample_id, "channel": channel, "cls": plane[y, x0], "y": y, "x0": x0, "x1": x1}))
                n += len(y)
            if n >= RUNS:
                yield pd.concat(frames, ignore_index=True)
                frames, n = [], 0
        if frames:
            yield pd.concat(frames, ignore_index=True)


def read_label_runs(contents: DataFrame) -> DataFrame:
    """(sample_id, content of a (2,H,W) array file) -> class runs of both channels."""
    return contents.select("sample_id", "content").mapInPandas(_decode, RUN_SCHEMA)


def encode_test_labels(batches):
    """Label files for the registered query: class (id + row + block + channel) mod 6, blocks of four columns."""
    for batch in batches:
        for start in range(0, len(batch), ENCODED):
            part = batch.iloc[start : start + ENCODED]
            blobs = []
            for sample_id, h, w in zip(part["sample_id"], part["h"], part["w"]):
                y, x = np.mgrid[0:h, 0:w]
                label = np.stack([(sample_id + y + x // 4 + c) % 6 for c in (0, 1)]).astype(np.uint8)
                buffer = io.BytesIO()
                np.save(buffer, label)
                blobs.append(buffer.getvalue())
            yield pd.DataFrame({"sample_id": part["sample_id"], "content": blobs})


def explode_heatmaps(docs: DataFrame) -> DataFrame:
    """``{channel: [[x, y], ..]}`` -> one row per point."""
    parsed = docs.select("sample_id", F.from_json("heatmaps", "map<string, array<array<bigint>>>").alias("m"))
    points = parsed.select("sample_id", F.explode("m").alias("channel", "pts")).select("sample_id", "channel", F.explode("pts").alias("p"))
    return points.filter(F.size("p") >= 2).select("sample_id", "channel", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def array_summary(runs: DataFrame) -> DataFrame:
    """What a JSON report keeps of an array: shape, dtype, nonzero count, min, max."""
    return runs.groupBy("sample_id", "channel").agg(
        F.format_string("[%d,%d]", F.max("y") + 1, F.max("x1") + 1).alias("shape"),
        F.lit("uint8").alias("dtype"),
        F.coalesce(F.sum(F.when(F.col("cls") != 0, F.col("x1") - F.col("x0") + 1)), F.lit(0)).alias("nonzero_count"),
        F.min("cls").alias("min"), F.max("cls").alias("max"),
    )
