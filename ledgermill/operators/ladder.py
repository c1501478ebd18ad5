"""Which reading of a document counts: the cheapest one that is good enough, and a paid one only within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.tables import ranked


def ladder(readings: DataFrame, budget: int, order: tuple[str, ...] = ("seq", "file_id"), good: float = 0.6, paid: bool = True) -> DataFrame:
    """file_id, escalon, texto, calidad and error: the rung that each document's reading comes from.

    readings: file_id, what orders documents, capa and q_capa (text layer and its quality), cache, local and q_local (own reader), ilegible (its text is corrupt), nube and q_nube (paid reader). Null texts: that reader gave nothing.
    The text layer counts if it is good, else what is cached, else the own reader. Where that is weak (or gave nothing), the paid reader is asked while the budget lasts, in the documents' order, and taken if it is better. What was asked is paid for, whether it helped or not.

    Who is asked follows from the place among all weak documents, which comes from ranges and their sums (tables.ranked): the same at any partitioning, and without all of them in one task.
    """
    c = F.col
    q = F.coalesce(F.when(c("local").isNotNull(), c("q_local")), F.lit(0.0))
    rows = readings.withColumn("_q", q)
    rows = rows.withColumn("_rung", F.when(F.coalesce("q_capa", F.lit(0.0)) >= good, "capa_texto").when(c("cache").isNotNull(), "cache_ocr").otherwise("vision_ocr"))
    weak = (c("_rung") == "vision_ocr") & (c("local").isNull() | (c("_q") < good) | F.coalesce("ilegible", F.lit(False)))
    asks = rows.where(weak)
    asks = ranked(asks, *order, name="_place") if paid else asks.withColumn("_place", F.lit(None).cast("long"))
    rows = asks.unionByName(rows.where(~weak).withColumn("_place", F.lit(None).cast("long")))
    asked = F.coalesce(c("_place") <= budget, F.lit(False))
    better = asked & c("nube").isNotNull() & (F.coalesce("q_nube", F.lit(0.0)) > c("_q"))
    error = F.when(better | c("_place").isNull(), "").when(~asked, "presupuesto agotado").when(c("nube").isNull(), "sin respuesta").otherwise("sin mejora")
    rung = F.when(better, "vision_nube").when((c("_rung") == "vision_ocr") & c("local").isNull(), "degradado").otherwise(c("_rung"))
    rows = rows.select("file_id", "capa", "cache", "local", "nube", "q_capa", "_q", "q_nube", rung.alias("escalon"), error.alias("error"))
    pick = lambda **of: F.coalesce(*[F.when(c("escalon") == k, v) for k, v in of.items()])
    text = pick(capa_texto=c("capa"), cache_ocr=c("cache"), vision_ocr=c("local"), vision_nube=c("nube"))
    quality = pick(capa_texto=c("q_capa"), vision_ocr=F.greatest("q_capa", "_q"), vision_nube=F.greatest("q_capa", "q_nube"))
    return rows.select("file_id", "escalon", F.coalesce(text, F.lit("")).alias("texto"), F.coalesce(quality, "q_capa", F.lit(0.0)).alias("calidad"), "error")
