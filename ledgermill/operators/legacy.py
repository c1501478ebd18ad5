"""The older reconciliation: an invoice's ledger row by three strategies, what contradicts it, and the rules that were looked at.

An invoice meets counts, not rows: ledger and workbook are grouped by key (and by key and amount) first, so that a tax id with very many rows on both sides costs one row a document. What a document's related rows are is a join of its own (`related`), for the documents that someone looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.normalize import MONEY, folded

PAY, ESCALATE, REFUSE = "PAGAR", "ESCALAR", "NO_PAGAR"
#: Ways in which a ledger row is found, the strong ones first.
BY_ORDER, BY_AMOUNT, BY_ONLY, BY_NONE = "pedido", "nif_importe", "nif_unico", "ninguno"
# The rules' names, in the order in which they are looked at.
RULES = ["R1_sin_identificadores", "R1_sin_cif_cliente", "R2_prohibido_pagar_proveedor", "R3_erp_pagada", "R4_conflicto_fuentes", "R5_extraccion_dudosa", "R10_erp_sin_nif", "R6_erp_pendiente_conciliado", "R7_erp_pendiente_descuadre", "R8_sin_erp_con_excel", "R9_sin_match"]


def order_key(order: Column) -> Column:
    """Letters and digits of an order's id, in capitals and without accents; null if there are none."""
    return F.nullif(F.regexp_replace(folded(order), r"(?U)[^\p{L}\p{N}]", ""), F.lit(""))


def keyed(rows: DataFrame, **keys: Column) -> DataFrame:
    """rows once for each key that isn't null, with `kind` and `key`."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()]))
    return rows.select("*", each.alias("_e")).select(*rows.columns, "_e.kind", "_e.key").where("key is not null")


def near(wanted: DataFrame, counted: DataFrame, keys: list[str], amount: str, tolerance: str) -> DataFrame:
    """wanted (distinct keys and `amount`) with counted's rows (the same columns, `n`, and maybe `row`) whose amount is within the tolerance: `n` in all and the least `row`. Amounts meet in slots as wide as the tolerance, so only neighbours meet."""
    width = F.greatest(F.lit(tolerance).cast(MONEY), F.lit("0.01").cast(MONEY))
    slot = F.floor(F.col(amount) / width)
    theirs = counted.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1))).withColumnRenamed(amount, "_theirs")
    met = wanted.withColumn("_slot", slot).join(theirs, [*keys, "_slot"]).where(F.abs(F.col(amount) - F.col("_theirs")) <= F.lit(tolerance).cast(MONEY))
    least = [F.min("row").alias("row")] if "row" in counted.columns else []
    return met.groupBy(*keys, amount).agg(F.sum("n").alias("n"), *least)


def evidence(invoices: DataFrame, ledger: DataFrame, workbook: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """What the ledger and the workbook say of each invoice.

    invoices: file_id (unique), nif, pedido, total. ledger: asiento_id, nif (may be null), pedido, importe, estado, seq. workbook: id, nif, pedido, estado (as written), importe, seq. Ids are unique; seq is the row's place.
    Gives file_id, match_por, asiento (a struct, or null), n_filas (workbook rows with the invoice's order or tax id) and primera_fila (the first of them, those with the order before the others), and counts of contradictions: n_mismo_pedido and n_mismo_importe (how many ledger rows share what should tell them apart, 0 if not ambiguous), nif_distinto, pedido_distinto (0 or 1), n_estado and n_importe (workbook rows that contradict the ledger's state or amount).
    """
    c = F.col
    inv = invoices.select("file_id", "nif", order_key(c("pedido")).alias("pedido"), c("total").cast(MONEY).alias("total"))
    led = ledger.select(F.struct("seq", "asiento_id", "nif", "pedido", c("importe").cast(MONEY).alias("importe"), "estado").alias("row"), "nif", order_key(c("pedido")).alias("pedido"), c("importe").cast(MONEY).alias("total"))
    groups = keyed(led, p=c("pedido"), n=c("nif")).groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    met = keyed(inv.select("file_id", "pedido", "nif"), p=c("pedido"), n=c("nif")).join(groups, ["kind", "key"])
    of = lambda kind, name: F.max(F.when(c("kind") == kind, c(name)))
    met = met.groupBy("file_id").agg(of("p", "n").alias("n_p"), of("p", "row").alias("row_p"), of("n", "n").alias("n_n"), of("n", "row").alias("row_n"))
    amounts = led.where("nif is not null and total is not null").groupBy("nif", "total").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    wanted = inv.where("nif is not null and total is not null").select("nif", "total").distinct()
    band = near(wanted, amounts, ["nif"], "total", tolerance).select("nif", "total", c("n").alias("n_b"), c("row").alias("row_b"))
    # Invoices without tax id or total have no partner there; keys of their own keep them apart.
    apart = F.coalesce("nif", F.concat(F.lit("\x00"), "file_id"))
    found = inv.withColumn("_nif", apart).join(band.withColumnRenamed("nif", "_nif"), ["_nif", "total"], "left").drop("_nif").join(met, "file_id", "left")
    by_order, by_amount, by_only = c("n_p") == 1, c("n_b") == 1, c("n_n") == 1
    found = found.withColumns(
        {
            "asiento": F.when(by_order, c("row_p")).when(by_amount, c("row_b")).when(by_only, c("row_n")),
            "match_por": F.when(by_order, BY_ORDER).when(by_amount, BY_AMOUNT).when(by_only, BY_ONLY).otherwise(BY_NONE),
        }
    ).select("file_id", "nif", "pedido", "match_por", "asiento", F.when(c("n_p") > 1, c("n_p")).otherwise(0).alias("n_mismo_pedido"), F.when(~F.coalesce(by_order, F.lit(False)) & (c("n_b") > 1), c("n_b")).otherwise(0).alias("n_mismo_importe"))

    # A row with both the order and the tax id is in two groups; the group of both takes it out once.
    both = lambda: F.concat_ws("\x00", F.when(c("nif").isNotNull(), c("pedido")), F.when(c("pedido").isNotNull(), c("nif")))
    ways = lambda: {"p": c("pedido"), "n": c("nif"), "b": F.nullif(both(), F.lit(""))}
    state = folded(c("estado"))
    book = workbook.select(F.struct("seq", "id").alias("row"), "nif", order_key(c("pedido")).alias("pedido"), state.contains("PAGAD").alias("paid"), state.contains("PENDIENT").alias("due"), c("importe").cast(MONEY).alias("importe"))
    book = keyed(book, **ways())
    known = book.groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_if("paid").alias("n_paid"), F.count_if("due").alias("n_due"), F.count("importe").alias("n_amounts"), F.min("row").alias("row"))
    sums = book.where("importe is not null").groupBy("kind", "key", "importe").agg(F.count("*").alias("n"))
    mine = keyed(found.select("file_id", "nif", "pedido", c("asiento.importe").alias("importe"), (c("asiento.estado") == "PAGADA").alias("settled")), **ways()).drop("nif", "pedido").join(known, ["kind", "key"])
    same = near(mine.where("importe is not null").select("kind", "key", "importe").distinct(), sums, ["kind", "key"], "importe", tolerance).withColumnRenamed("n", "n_same")
    sign = F.when(c("kind") == "b", -1).otherwise(1)
    off = F.when(c("importe").isNotNull(), c("n_amounts") - F.coalesce("n_same", F.lit(0))).otherwise(0)
    against = F.when(c("settled"), c("n_due")).when(~c("settled"), c("n_paid")).otherwise(0)
    told = mine.join(same, ["kind", "key", "importe"], "left").groupBy("file_id").agg(
        F.sum(sign * c("n")).alias("n_filas"),
        F.min(F.when(c("kind") != "b", F.struct((c("kind") == "n").alias("later"), "row")))["row"]["id"].alias("primera_fila"),
        F.sum(sign * against).alias("n_estado"),
        F.sum(sign * off).alias("n_importe"),
    )
    theirs = order_key(c("asiento.pedido"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    flag = lambda cond, name: F.coalesce(cond, F.lit(False)).cast("long").alias(name)
    return found.join(told, "file_id", "left").select(
        "file_id",
        "match_por",
        "asiento",
        zero("n_filas"),
        "primera_fila",
        zero("n_mismo_pedido"),
        zero("n_mismo_importe"),
        flag((c("match_por") == BY_ORDER) & (c("nif") != c("asiento.nif")), "nif_distinto"),
        flag(c("match_por").isin(BY_AMOUNT, BY_ONLY) & (c("pedido") != theirs), "pedido_distinto"),
        zero("n_estado"),
        zero("n_importe"),
    )


def related(invoices: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id with each of rows (nif, pedido and others) that has its order or its tax id, once. For chosen documents: a frequent tax id has many rows."""
    c = F.col
    theirs = rows.withColumn("_row", F.struct(*rows.columns)).select("_row", "nif", order_key(c("pedido")).alias("pedido"))
    mine = keyed(invoices.select("file_id", "nif", order_key(c("pedido")).alias("pedido")), p=c("pedido"), n=c("nif")).select("file_id", "kind", "key")
    return mine.join(keyed(theirs, p=c("pedido"), n=c("nif")).select("_row", "kind", "key"), ["kind", "key"]).select("file_id", "_row").distinct().select("file_id", "_row.*")


def decisions(invoices: DataFrame, found: DataFrame, blocked: list[str], least_score: float = 0.85, tolerance: str = "0.01") -> DataFrame:
    """file_id, resultado, motivo, and evaluadas, the rules looked at up to the one that decides.

    invoices: as for evidence, with nif_ilegible, cif_cliente, cif_ilegible, and campos: structs of nombre, ilegible, crudo, donde, score of the fields a decision rests on (fields that weren't found aren't among them). found: what evidence gives.
    """
    c, lit = F.col, F.lit
    rows = invoices.join(found, "file_id")
    told = lambda *parts: F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    euros = lambda x: F.replace(x.cast(MONEY).cast("string"), lit("."), lit(","))
    yes = lambda x: F.coalesce(x, lit(False))
    row, total = c("asiento"), c("total").cast(MONEY)
    has, supplier = c("asiento.asiento_id").isNotNull(), F.coalesce("nif", "asiento.nif")
    several = lambda n, *text: F.when(n > 0, told(*text))
    conflicts = F.array_compact(
        F.array(
            several(c("n_mismo_pedido"), c("n_mismo_pedido"), " asientos con el pedido ", c("pedido")),
            several(c("n_mismo_importe"), c("n_mismo_importe"), " asientos con el NIF ", c("nif"), " y el importe ", euros(total)),
            several(c("nif_distinto"), "NIF ", c("nif"), " frente a ", row["nif"], " en ", row["asiento_id"]),
            several(c("pedido_distinto"), "pedido ", c("pedido"), " frente a ", row["pedido"], " en ", row["asiento_id"]),
            several(c("n_estado"), c("n_estado"), " filas del Excel con otro estado que ", row["asiento_id"]),
            several(c("n_importe"), c("n_importe"), " filas del Excel con otro importe que ", row["asiento_id"]),
        )
    )
    where = lambda f: F.concat(F.coalesce(f["crudo"], lit("¿?")), F.when(F.coalesce(f["donde"], lit("")) != "", F.concat(lit(", "), f["donde"])).otherwise(""))
    doubt = F.array_compact(F.transform("campos", lambda f: F.when(yes(f["ilegible"]), told(f["nombre"], " ilegible (", where(f), ")")).when(f["score"] < least_score, told(f["nombre"], " (", F.format_string("%.2f", f["score"]), ")"))))
    fits = F.abs(total - row["importe"]) <= lit(tolerance).cast(MONEY)
    yes_, any_ = lit(True), has | ~has
    # Of each rule: whether it is looked at, whether it decides, the result, and why.
    ladder = [
        (any_, c("nif").isNull() & c("pedido").isNull(), ESCALATE, F.when(yes(c("nif_ilegible")), "NIF ilegible y ningún pedido").otherwise("ni NIF ni pedido")),
        (any_, c("cif_cliente").isNull(), ESCALATE, F.when(yes(c("cif_ilegible")), "CIF del cliente ilegible").otherwise("sin CIF del cliente")),
        (any_, supplier.isin(blocked), REFUSE, told("proveedor ", supplier, " en la lista de pago prohibido")),
        (any_, has & (row["estado"] == "PAGADA"), REFUSE, told("asiento ", row["asiento_id"], " PAGADA")),
        (has, F.size(conflicts) > 0, ESCALATE, told("conflicto entre fuentes: ", F.array_join(conflicts, "; "))),
        (has, F.size(doubt) > 0, ESCALATE, told("extracción dudosa en ", F.array_join(doubt, ", "))),
        (has, row["nif"].isNull(), ESCALATE, told("asiento ", row["asiento_id"], " sin NIF en el ERP")),
        (has, fits, PAY, told("asiento ", row["asiento_id"], " PENDIENTE, importes conciliados")),
        (has, yes_, ESCALATE, F.when(total.isNull(), told("asiento ", row["asiento_id"], " PENDIENTE y ningún importe en el documento")).otherwise(told("descuadre: documento ", euros(total), ", ERP ", euros(row["importe"])))),
        (~has, c("n_filas") > 0, ESCALATE, told("no consta en el ERP; ", c("n_filas"), " filas del Excel desde ", c("primera_fila"))),
        (~has, yes_, ESCALATE, lit("en ninguna fuente")),
    ]
    fired = F.coalesce(*[F.when(yes(seen) & yes(hit), i) for i, (seen, hit, _, _) in enumerate(ladder)])
    rows = rows.withColumn("_at", fired)
    pick = lambda values: F.coalesce(*[F.when(c("_at") == i, v) for i, v in enumerate(values)])
    looked = F.array_compact(F.array(*[F.when(seen & (c("_at") >= i), lit(name)) for i, ((seen, _, _, _), name) in enumerate(zip(ladder, RULES))]))
    return rows.select("file_id", pick([lit(r) for _, _, r, _ in ladder]).alias("resultado"), pick([why for _, _, _, why in ladder]).alias("motivo"), looked.alias("evaluadas"))
