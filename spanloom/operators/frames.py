"""Aggregates over measured frames and sound: luma, faces, loudness; and geometry of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luma_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, avg, min, max, u_avg, v_avg, samples: means over a clip's frames (of the frames' minima and maxima too)."""
    names = {"yavg": "avg", "ymin": "min", "ymax": "max", "uavg": "u_avg", "vavg": "v_avg"}
    return frames.groupBy(*keys).agg(*[F.avg(c).alias(n) for c, n in names.items()], F.count("yavg").alias("samples"))


def median_faces(faces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, center: the exact median of face centres of a scene."""
    return faces.groupBy(*keys).agg(F.percentile("center", F.lit(0.5)).alias("center"))


def loudness(samples: DataFrame, keys: list[str], window_s: float) -> DataFrame:
    """keys, window_no, rms of sound samples (keys, time, value)."""
    rows = samples.withColumn("window_no", F.floor(F.col("time") / window_s).cast("int"))
    return rows.groupBy(*keys, "window_no").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def two_largest(faces: Column) -> Column:
    """The two widest boxes of an array<struct<x, y, w, h>>, from left to right."""
    wide = F.array_sort(faces, lambda a, b: F.when(a["w"] * a["h"] > b["w"] * b["h"], -1).when(a["w"] * a["h"] < b["w"] * b["h"], 1).otherwise(0))
    return F.array_sort(F.slice(wide, 1, 2), lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))


def holds_box(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x"] + outer["w"] >= inner["x"] + inner["w"]) & (outer["y"] + outer["h"] >= inner["y"] + inner["h"])


def face_in_person(face: Column, people: Column, margin: float = 0.05) -> Column:
    """Whether a face's centre lies in one of the persons' boxes, widened by a share of their size."""
    cx, cy = face["x"] + face["w"] / 2, face["y"] + face["h"] / 2
    within = lambda p: (cx >= p["x"] - p["w"] * margin) & (cx <= p["x"] + p["w"] * (1 + margin)) & (cy >= p["y"] - p["h"] * margin) & (cy <= p["y"] + p["h"] * (1 + margin))
    return F.exists(people, within)
