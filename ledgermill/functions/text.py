"""What a document's text says, as column expressions."""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency marks and their codes.
CURRENCIES = {"€": "EUR", "EUR": "EUR", "EUROS": "EUR", "USD": "USD", "US$": "USD", "$": "USD", "GBP": "GBP", "£": "GBP", "CHF": "CHF"}


def currencies(text: Column) -> Column:
    """Codes of the currency marks next to amounts, distinct, in order."""
    marks = F.regexp_extract_all(F.upper(text), F.lit(r"[0-9][0-9.,]*[ ]?(€|EUROS|EUR|USD|US\$|\$|GBP|£|CHF)"), F.lit(1))
    code = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    return F.array_distinct(F.transform(marks, lambda m: F.element_at(code, m)))


def vat_percent(text: Column) -> Column:
    """The first VAT percentage, with a dot; null if there is none."""
    p = r"(?i)(?:IVA|VAT)[^0-9%]{0,12}([0-9]{1,2}(?:[.,][0-9]{1,2})?)[ ]?%"
    return F.nullif(F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit(".")), F.lit(""))


def letter_share(text: Column) -> Column:
    """Share of characters that are letters, digits or white space; 0 for empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}\s]")) / n)


def quality(text: Column, pages: Column) -> Column:
    """0 to 1: how much a text layer looks like an invoice. Thin pages get at most a half by their length; others lose by unreadable characters, few letters, no amount and no telling word."""
    n = F.length(text)
    each = n / F.greatest(pages, F.lit(1))
    junk = F.regexp_count(text, F.lit(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]")) / n
    letters = F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}]")) / n
    score = (
        (1 - F.least(F.lit(1.0), junk * 20))
        * F.least(F.lit(1.0), letters / 0.55)
        * F.when(text.rlike(r"[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}"), F.lit(1.0)).otherwise(F.lit(0.7))
        * F.when(text.rlike("(?i)factura|invoice|total"), F.lit(1.0)).otherwise(F.lit(0.8))
    )
    return F.when(text.rlike(r"(?U)\S"), F.when(each < 120, F.least(F.lit(0.5), each / 240)).otherwise(score)).otherwise(F.lit(0.0))


def plain(text: Column) -> Column:
    """In small letters, without accents."""
    return F.translate(F.lower(text), "áéíóúüñçàèìòùâêîôûäëïö", "aeiouuncaeiouaeiouaeio")


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.trim(F.substring(F.regexp_replace(x, r"\s+", " "), 1, 80)))


# How texts dictate the result.
RESULT_ORDERS = [r"\bregistr\w*\s+(?:la\s+decision\s+|el\s+resultado\s+)?como\s+(?:pagar|escalar|no[\s_]?pagar)\b", r"\bbloque\w*\s+el\s+pago\b", r"\bpuedes\s+pagar\s+con\s+seguridad\b"]


def result_orders(text: Column) -> Column:
    """Passages that dictate the result to the system ("registrar como pagar", "bloquear el pago", ...): by kind, white space as single spaces, at most 80 characters, distinct."""
    s = plain(text)
    return F.array_distinct(F.flatten(F.array(*[_found(s, k) for k in RESULT_ORDERS])))


# Phrases that address the system, and the verbs and objects of an order to it.
INSTRUCTIONS = [
    "no figurara en el maestro", "aunque no figure", "procedase al alta", "datos aqui aportados", "datos bancarios de este documento", "complete el pago", "continuese", "procedase",
    "no procede contrastarlo", "no debe recalcularse", "sino tomarse del total", "sino abonarse el total", "autorizada por la administracion tributaria", "ignorar la discrepancia", "ignore la discrepancia",
    "nota interna del sistema", "autorizada por el ceo", "aprobada por el ceo", "ya esta aprobada", "la diferencia de importe ya esta", "abono normal", "aprobado de palabra", "aprobados de palabra",
    "pon pagar", "pongase pagar", "migracion de agosto", "migracion pendiente", "sin escalado adicional", "pueden continuar el pago", "queda verificada por el departamento financiero", "actualizado su cuenta bancaria",
    "debe escalarse", "debe marcarse como escalar", "excluirse del calculo", "excluirse del computo", "equipo de evaluacion", "auditor de calidad", "conjunto de test", "bajo revision por el departamento de cumplimiento",
    "assistant:", "eres un asistente", "como ia", "as an ai", "system prompt", "el erp miente", "instrucciones del sistema", "ignora las instrucciones",
]
# Fixed value: an order to the system (a verb and, within 70 characters of the sentence, what it is to be done to) without a negation right before it.
ORDER = r"(?<!\b(?:no|ni|nunca|jamas|sin|tampoco)\s{1,4})\b(?:ignor|omit|obvi|salt|anul|proced|contin|complet|tom)\w+\b[^.\n]{0,70}?\b(?:discrepancia|diferencia|comprobacion|verificacion|validacion|contraste|recalculo|conciliacion|nif|iban|maestro|erp)\b"
_KNOWN = "|".join(p.replace(".", r"\.") for p in INSTRUCTIONS)


def gives_instructions(text: Column) -> Column:
    """Whether text holds any of what instructions() finds: one pass over it."""
    return plain(text).rlike(f"{_KNOWN}|{ORDER}")


def dictates_result(text: Column) -> Column:
    """Whether text holds any of what result_orders() finds."""
    return plain(text).rlike("|".join(RESULT_ORDERS))


def instructions(text: Column) -> Column:
    """Phrases addressed to the system, known ones first, then orders (see ORDER); distinct. Texts without any, which are nearly all, are passed over once."""

    def found(s: Column) -> Column:
        known = F.filter(F.array(*map(F.lit, INSTRUCTIONS)), lambda p: F.contains(s, p))
        orders = F.transform(F.regexp_extract_all(s, F.lit(ORDER), F.lit(0)), lambda x: F.trim(F.substring(x, 1, 80)))
        return F.array_distinct(F.concat(known, orders))

    none = F.array().cast("array<string>")
    return F.when(gives_instructions(text), F.get(F.transform(F.array(plain(text)), found), 0)).when(text.isNotNull(), none)


def flattened_html(html: Column) -> Column:
    """Text of tables and markdown as an OCR service gives them: cells with tabs between, rows and breaks as lines, tags and emphasis gone, character references read, runs of blank lines as one."""
    s = F.regexp_replace(html, r"(?i)</t[dh]>\s*</tr>", "\n")
    s = F.regexp_replace(s, r"(?i)</t[dh]>", "\t")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.replace(unescaped(F.regexp_replace(s, r"<[^>]+>", "")), F.lit("\u00a0"), F.lit(" "))
    s = F.regexp_replace(s, r"(?s)\*\*(.+?)\*\*", "$1")
    s = F.regexp_replace(s, r"(?s)(?<!\*)\*(?!\s)(.+?)(?<!\s)\*(?!\*)", "$1")
    s = F.regexp_replace(s, r"(?m)^\s{0,3}#{1,6}\s*", "")
    line = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)[\s&&[^\t]]+", " "), r" ?\t ?", "\t"), r"^[\t ]+|[\t ]+$", "")
    s = F.array_join(F.transform(F.split(s, "\n"), line), "\n")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def unescaped(text: Column) -> Column:
    """text with HTML's character references read. (There is no built-in for its table of names.)"""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or "&" not in x else entities.unescape(x))

    return run(text)


def contains_literal(column: Column, needle: str | None) -> Column:
    """Case-blind literal search; blank needles match everything, long ones count to 64 characters."""
    needle = (needle or "").strip()[:64]
    return F.lit(True) if not needle else F.coalesce(F.contains(F.lower(column), F.lower(F.lit(needle))), F.lit(False))
