"""Decisions as a stream. (An addition: the job itself is a batch.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Results by window of event time; a file that comes again within the lateness counts once. stream: ts, file_id, resultado."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_id"])
    return once.groupBy(F.window("ts", every), "resultado").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "resultado", "n")
