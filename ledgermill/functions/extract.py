"""Fields of an invoice's text: every match of every pattern, normalised, in order of the patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions import normalize as N

# Where fields stand, most telling pattern first.
PATTERNS = {
    "pedido": [r"(?i)(?:pedido|order|po)[^A-Za-z0-9]{0,10}(PO[-. ]?[0-9OIZSB]{4}[-. ]?[0-9OIZSB]{1,4})", r"\b(PO-[0-9OIZSB]{4}-[0-9OIZSB]{4})\b"],
    "nif": [r"(?i)(?:nif|cif|vat)[^A-Za-z0-9]{0,6}((?:ES)?[A-Z][-. ]?[0-9]{7}[A-Z0-9]|[0-9]{8}[-. ]?[A-Z])", r"\b([A-Z][0-9]{8})\b"],
    "iban": [r"(?i)iban[^A-Za-z0-9]{0,6}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,4})?)", r"\b([A-Z]{2}[0-9]{20,22})\b"],
    "fecha": [r"(?i)(?:fecha|date)[^0-9]{0,12}([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4})", r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b"],
    "base": [r"(?i)base(?: imponible)?[^0-9\n-]{0,20}([0-9][0-9.,]*)"],
    "iva": [r"(?i)(?:cuota )?iva(?:[ ]*\(?[0-9.,]+[ ]*%\)?)?[^0-9\n-]{0,20}([0-9][0-9.,]*)(?![0-9.,]*[ ]*%)"],
    "total": [r"(?i)total(?: factura| a pagar)?[^0-9\n-]{0,20}([0-9][0-9.,]*)"],
}
_NORMAL = {"pedido": N.repaired_order, "nif": N.tax_id, "iban": N.iban, "fecha": lambda c: F.coalesce(N.civil_date(c).cast("string"), c), "base": lambda c: N.cents(N.amount(c)).cast("string")}


def candidates(text: Column, field: str) -> Column:
    """Distinct candidates of a field with their confidence (0.95, less 0.1 for each before, at least 0.4). Dates that don't exist stay as they are written."""
    normal = _NORMAL.get(field, _NORMAL["base"])
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in PATTERNS[field]]))
    values = F.array_distinct(F.filter(F.transform(found, normal), lambda v: v.isNotNull()))
    return F.transform(values, lambda v, i: F.struct(v.alias("valor"), F.greatest(F.lit(0.4), F.lit(0.95) - i * F.lit(0.1)).alias("confianza")))


def first(text: Column, field: str) -> Column:
    """The best candidate; null if there is none."""
    return F.get(candidates(text, field), 0)["valor"]


def fields(text: Column) -> Column:
    """The best candidate of every field."""
    return F.struct(*[first(text, f).alias(f) for f in PATTERNS])
