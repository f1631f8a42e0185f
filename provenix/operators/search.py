"""Search over index records: composable filters, their validation, and location clusters."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.functions.geo import cell, haversine, near
from provenix.functions.text import contains_literal
from provenix.sources.shared import written

MAX_RADIUS_KM, LEAST_HASH = 1000.0, 8
TEXT_FIELDS = ("device_make", "device_model", "device_display", "software", "caption", "title")


@dataclass(frozen=True)
class Filters:
    """All that are set must hold; unset ones are None (or empty)."""

    device: str | None = None
    date: str | None = None
    date_range: tuple[str, str] | None = None
    gps_only: bool = False
    near: tuple[float, float, float] | None = None
    anomaly: str | None = None
    text: str | None = None
    hash: str | None = None

    def is_empty(self) -> bool:
        return not self.describe()

    def describe(self) -> dict:
        """The filters that are set, as they are shown."""
        given = {"device": self.device, "date": self.date, "date_range": list(self.date_range or ()), "gps": self.gps_only, "near": dict(zip(("lat", "lon", "radius_km"), self.near or (), strict=False)), "anomaly": self.anomaly, "text": self.text, "hash": self.hash}
        return {k: v for k, v in given.items() if v}

    @classmethod
    def parsed(cls, device: str | None = None, date: str | None = None, date_range: str | None = None, gps: bool = False, near: str | None = None, anomaly: str | None = None, text: str | None = None, hash: str | None = None) -> Filters:  # noqa: A002
        """Filters from texts; what can't be one is a ValueError."""
        return cls(device, parse_date(date) if date else None, parse_date_range(date_range) if date_range else None, bool(gps), parse_near(near) if near else None, anomaly, text, parse_hash(hash) if hash else None)

    def predicate(self) -> Column:
        """One column; cheap tests come first."""
        out = F.lit(True)
        if self.device:
            out &= contains_literal(F.col("device_display"), self.device)
        if self.date:
            out &= F.col("capture_day") == self.date
        if self.date_range:
            out &= F.col("capture_day").between(*self.date_range) & (F.col("capture_day") != "unknown")
        if self.gps_only:
            out &= F.col("has_gps")
        if self.hash:
            out &= F.startswith(F.lower("sha256"), F.lit(self.hash.lower()))
        if self.anomaly:
            out &= F.array_contains("anomaly_rule_ids", self.anomaly)
        if self.text:
            needle = self.text
            out &= F.exists(F.concat(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in TEXT_FIELDS)), F.col("keywords")), lambda x: contains_literal(x, needle))
        if self.near:
            out &= F.coalesce(near(F.col("gps_lat"), F.col("gps_lon"), *self.near), F.lit(False))
        return out


def parse_date(text: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a date: {text}")
    date.fromisoformat(text)
    return text


def parse_date_range(text: str) -> tuple[str, str]:
    first, dots, last = text.partition("..")
    if not dots or parse_date(first) > parse_date(last):
        raise ValueError(f"not a date range: {text}")
    return first, last


def parse_near(text: str) -> tuple[float, float, float]:
    try:
        lat, lon, radius = (float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"not lat,lon,radius: {text}") from None
    if not (all(map(math.isfinite, (lat, lon, radius))) and abs(lat) <= 90 and abs(lon) <= 180 and 0 < radius <= MAX_RADIUS_KM):
        raise ValueError(f"out of range: {text}")
    return lat, lon, radius


def parse_hash(text: str) -> str:
    if not re.fullmatch(rf"[0-9a-fA-F]{{{LEAST_HASH},}}", text):
        raise ValueError(f"not a hash prefix: {text}")
    return text.lower()


def cell_components(located: DataFrame) -> DataFrame:
    """(y, x, label) of distinct grid cells, neighbours (8) in one component, by least labels until none changes.

    Each round is a table in the session's shared folder, so lineage stays short and survives lost executors.
    """
    cells = located.select(cell(F.col("lat")).alias("y"), cell(F.col("lon")).alias("x")).distinct()
    cells = written(cells.withColumn("label", F.struct("y", "x")), "cells")
    steps = F.array(*(F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    while True:
        reach = cells.select("label", F.explode(steps).alias("s"), "y", "x").select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label")
        near_labels = reach.groupBy("y", "x").agg(F.min("label").alias("near"))
        root = cells.select(F.col("y").alias("ry"), F.col("x").alias("rx"), F.col("label").alias("root"))
        moved = cells.join(near_labels, ["y", "x"]).join(root, (F.col("label.y") == F.col("ry")) & (F.col("label.x") == F.col("rx")))
        moved = written(moved.select("y", "x", F.col("label").alias("old"), F.least("label", "near", "root").alias("label")), "cells")
        cells = moved.select("y", "x", "label")
        if not moved.where("old <> label").limit(1).count():
            return cells


def clusters(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, centre, radius in km, count, span of days) of each component of cells, and its members (label, path).

    Sums of cells give the centres, so only the distances to them need the rows again.
    """
    rows = written(located.select("path", "lat", "lon", F.when(F.col("capture_day") != "unknown", F.col("capture_day")).alias("day"), cell(F.col("lat")).alias("y"), cell(F.col("lon")).alias("x")), "located")
    sums = rows.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    cells = cell_components(rows)
    total = sums.join(cells, ["y", "x"]).groupBy("label").agg(F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    total = written(total.select("label", (F.col("lat") / F.col("n")).alias("center_lat"), (F.col("lon") / F.col("n")).alias("center_lon"), "n", "first_day", "last_day"), "clusters")
    placed = rows.join(cells.join(total, "label"), ["y", "x"])
    radius = placed.groupBy("label").agg(F.max(haversine(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon"))).alias("radius_km"))
    return total.join(radius, "label").select("label", "center_lat", "center_lon", "radius_km", "n", "first_day", "last_day"), rows.join(cells, ["y", "x"]).select("label", "path")
