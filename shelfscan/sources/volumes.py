"""The volumes that are mounted here."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

MOUNTS = "volume_id string, mount string, label string"


def _names(folder: str) -> dict[str, str]:
    """device -> name, of a folder of links to devices."""
    try:
        return {os.path.realpath(e.path): e.name for e in os.scandir(folder)}
    except OSError:
        return {}


def mounted(table: str = "/proc/self/mounts", by_id: str = "/dev/disk/by-uuid", by_label: str = "/dev/disk/by-label") -> list[tuple[str, str, str]]:
    """(volume id, mount, label) of the mounted devices that have an id; none where the system does not tell. The driver's own view, as walks are started from it."""
    ids, labels = _names(by_id), _names(by_label)
    try:
        with open(table, encoding="utf-8", errors="surrogateescape") as f:
            lines = [line.split() for line in f]
    except OSError:
        return []
    blank = lambda s: s.replace("\\040", " ").replace("\\134", "\\")
    return [(ids[d], blank(m), labels.get(d, "")) for d, m in ((os.path.realpath(x[0]), x[1]) for x in lines if len(x) > 1) if d in ids]


def mounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mounted(), MOUNTS)
