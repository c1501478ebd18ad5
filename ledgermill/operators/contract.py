"""Whether a delivery keeps its contract, line by line: the strict check before it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.traces import RESULTS
from ledgermill.sources.logs import is_json, is_object

ERROR, NOTE = "error", "aviso"
# Fixed value: the key that people write in place of `result`.
WRONG_KEY = "resultado"


def line_problems(lines: DataFrame, names: DataFrame) -> DataFrame:
    """severity, message and num (null: of no line) of a delivery's lines (num, value, from sources.logs.numbered_lines for one file) and the names of the documents that must be in it (name).

    A line that can't be used isn't counted as its document's; a repeated id is told with its first line. Messages carry what they are about, so equal ones can be counted together (grouped).
    """
    c, lit = F.col, F.lit
    bom = F.startswith("value", lit("\ufeff")) & (c("num") == 1)
    rows = lines.select("num", bom.alias("bom"), F.endswith("value", lit("\r")).alias("crlf"), F.when(bom, F.substr("value", lit(2))).otherwise(c("value")).alias("value"))
    rows = rows.withColumn("line", F.when(c("crlf"), F.substr("value", lit(1), F.length("value") - 1)).otherwise(c("value"))).drop("value")
    blank = ~c("line").rlike(r"(?U)\S")
    keys = F.coalesce(F.when(is_object(c("line")), F.json_object_keys("line")), F.array().cast("array<string>"))
    rows = rows.withColumns({"blank": blank, "json": is_json(c("line")), "object": is_object(c("line")), "keys": keys})
    # As a variant, so that a number isn't taken for a text.
    read = F.try_parse_json(F.when(c("object"), c("line")))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get(read, f"$.{key}", "variant")) == "STRING", F.try_variant_get(read, f"$.{key}", "string"))
    rows = rows.withColumns({"id": text("file_id"), "result": text("result"), "raw": F.get_json_object("line", "$.result")})
    has = lambda key: F.array_contains("keys", key)
    named = F.coalesce(c("id") != "", lit(False))
    path = named & c("id").rlike(r"[/\\]")
    extra = F.array_sort(F.array_except("keys", F.array(lit("file_id"), lit("result"))))
    one = lambda when, severity, message: F.when(when, F.struct(lit(severity).alias("severity"), message.alias("message")))
    told = lambda *parts: F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])
    obj = c("object")
    found = F.array_compact(
        F.array(
            one(c("crlf"), NOTE, lit("termina en CRLF")),
            one(c("blank"), ERROR, lit("línea vacía")),
            one(~c("blank") & ~c("json"), ERROR, lit("no es JSON")),
            one(~c("blank") & c("json") & ~obj, ERROR, lit("no es un objeto JSON")),
            one(obj & ~has("file_id"), ERROR, lit("falta file_id")),
            one(obj & has("file_id") & ~named, ERROR, lit("file_id no es un texto o está vacío")),
            one(obj & path, ERROR, told("file_id con ruta: ", c("id"))),
            one(obj & ~has("result") & has(WRONG_KEY), ERROR, told("falta result y aparece ", WRONG_KEY)),
            one(obj & ~has("result") & ~has(WRONG_KEY), ERROR, lit("falta result")),
            one(obj & has("result") & ~F.coalesce(c("result").isin(RESULTS), lit(False)), ERROR, told("result fuera del contrato: ", F.coalesce("raw", lit("null")))),
            one(obj & (F.size(extra) > 0), NOTE, told("campos de más: ", F.array_join(extra, ", "))),
        )
    )
    whole = rows.where("bom").select(lit(ERROR).alias("severity"), lit("empieza con BOM").alias("message"), lit(None).cast("long").alias("num"))
    each = rows.select(F.explode(found).alias("p"), "num").select("p.severity", "p.message", c("num").cast("long").alias("num"))
    good = rows.where(obj & named & ~path).select("id", c("num").cast("long").alias("num"))
    firsts = good.groupBy("id").agg(F.min("num").alias("first"), F.count("*").alias("n"))
    again = good.join(firsts.where("n > 1"), "id").where("num > first").select(lit(ERROR).alias("severity"), told(c("id"), " repetido (ya en la línea ", c("first").cast("string"), ")").alias("message"), "num")
    real = names.select("name").distinct()
    # Names that only differ in capitals: the first one in order is told.
    near = real.groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("near"))
    unknown = firsts.select("id").join(real, F.col("id") == F.col("name"), "left_anti").withColumn("_low", F.lower("id")).join(near, "_low", "left").select("id", "near")
    message = F.when(c("near").isNull(), told(c("id"), " no es un documento")).otherwise(told(c("id"), " no existe, el documento es ", c("near")))
    strange = good.join(unknown, "id").select(lit(ERROR).alias("severity"), message.alias("message"), "num")
    missing = real.join(firsts, c("name") == c("id"), "left_anti").select(lit(ERROR).alias("severity"), told(c("name"), " sin línea").alias("message"), lit(None).cast("long").alias("num"))
    return whole.unionByName(each).unionByName(again).unionByName(strange).unionByName(missing)


def grouped(problems: DataFrame) -> DataFrame:
    """Equal messages as one: severity, message, n, and first, the least line (null: of no line)."""
    return problems.groupBy("severity", "message").agg(F.count("*").alias("n"), F.min("num").alias("first"))


def outcome(problems: DataFrame) -> DataFrame:
    """One row: n_errors, n_notes, and the exit code (1 if there is an error)."""
    out = problems.agg(F.count_if(F.col("severity") == ERROR).alias("n_errors"), F.count_if(F.col("severity") == NOTE).alias("n_notes"))
    return out.withColumn("exit_code", F.when(F.col("n_errors") > 0, 1).otherwise(0))
