"""A trace's records as the rows of a list and as the detail of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.traces import main_reason, principal_currency, said


def number(text: Column) -> Column:
    """The number that text stands for, with a dot or a comma and any spaces; null for anything else."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def currencies(text: Column) -> Column:
    """Declared currencies, written as a JSON list or as one name."""
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.when(text.isNotNull(), F.array(text)))


def row_columns() -> list[Column]:
    """The 22 columns of a list's row."""
    c = F.col
    field = lambda name: said(c("campos")[name])
    value = lambda name: number(c("campos")[name]).alias(name)
    note = F.from_json("segunda_lectura", "confirmable boolean, desvio boolean")
    yes = lambda name: F.coalesce(note[name], F.lit(False)).alias(name)
    return [
        c("file_id"),
        c("result").alias("resultado"),
        main_reason(c("motivos"), c("hechos")).alias("motivo_principal"),
        *[field(n).alias(n) for n in ("proveedor", "proveedor_id")],
        F.coalesce(field("nif_maestro"), field("nif_asiento")).alias("nif"),
        *[field(n).alias(n) for n in ("asiento", "pedido", "fecha")],
        value("total"),
        value("importe_erp"),
        value("desvio_importe"),
        field("estado_erp").alias("estado_erp"),
        principal_currency(currencies(c("campos")["divisa_documento"]), c("campos")["divisa_erp"]).alias("divisa"),
        *[c(n) for n in ("lote", "metodo_lectura", "escalon_lectura")],
        number(c("calidad_lectura")).alias("calidad_lectura"),
        number(c("segundos_lectura")).alias("segundos_lectura"),
        c("identificacion_fiable"),
        c("version_norma"),
        F.when(F.size(F.json_object_keys("segunda_lectura")) > 0, F.struct(yes("confirmable"), yes("desvio"))).alias("segunda_lectura"),
    ]


def listed(records: DataFrame) -> DataFrame:
    """One row of 22 columns a record (sources.logs.trace_records)."""
    return records.select(*row_columns())


def detailed(records: DataFrame) -> DataFrame:
    """The whole of each record, with what concerns its reading together and its row of the list as `resumen`."""
    c = F.col
    some = lambda name: F.coalesce(name, F.array().cast("array<string>")).alias(name)
    reading = F.struct("metodo_lectura", "escalon_lectura", number(c("calidad_lectura")).alias("calidad_lectura"), number(c("segundos_lectura")).alias("segundos_lectura"), some("sospechosos"), some("sospechosos_meta"))
    return records.select(
        "file_id",
        c("result").alias("resultado"),
        main_reason(c("motivos"), c("hechos")).alias("motivo_principal"),
        some("motivos"),
        F.coalesce("hechos", F.array().cast(records.schema["hechos"].dataType)).alias("hechos"),
        F.coalesce("campos", F.create_map().cast("map<string,string>")).alias("campos"),
        reading.alias("lectura"),
        *["lote", "sha256", "identificacion_fiable", "version_norma", "nota_documento", "segunda_lectura"],
        F.struct(*row_columns()).alias("resumen"),
    )
