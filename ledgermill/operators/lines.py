"""The older extraction, line by line: a value is on its label's line, or an amount on the next one; totals by priority, then the last; the client's id within three lines of its label.

A document's lines are an array in its row, in their order, so that looking at
the next line, at a window of lines or for the first and the last is done in
place: nothing is shuffled, and a document's lines never leave it.

Every field has a state: ENCONTRADO (with its value), ILEGIBLE (something is
printed that gives no value; amounts that are negative count as such) or
NO_APARECE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.functions import normalize as N
from ledgermill.functions.readings import searchable

# Labels and forms of the fields.
NIF_LABEL = r"\b(?:N\.?\s?I\.?\s?F\.?|C\.?\s?I\.?\s?F\.?|D\.?\s?N\.?\s?I\.?|N\.?\s?I\.?\s?E\.?)\b"
NIF_FORM = r"\b(?:[A-Z]\d{7}[A-Z0-9]|\d{8}[A-Z])\b"
ORDER = r"\b(?:PED|PO|PE)[-\s]?\d{2,4}[-/]\d{3,4}\b"
INVOICE_LABEL = r"\b(?:REF\s+FACTURA|N[º°o]\s+DE\s+FACTURA|N[º°o]\s+FACTURA|FACTURA\s+SIMPLIFICADA|FACTURA|INVOICE)\s*(?:N[º°o]\.?)?\s*[:#.]?\s*"
DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
TOTAL_LABEL = r"^\s*(?:IMPORTE\s+TOTAL|TOTAL\s+A\s+PAGAR|TOTAL\s+FACTURA|TOTAL)\b"
BASE_LABEL = r"^\s*(?:BASE\s+IMPONIBLE|IMPORTE\s+BASE|SUBTOTAL|BASE)\b"
VAT_LABEL = r"^\s*(?:CUOTA\s+IVA|I\.?\s*V\.?\s*A\.?)\b"
AMOUNT = r"\d{1,3}(?:\.\d{3})+,\s*\d{1,2}|\d{1,3}(?:,\d{3})+\.\s*\d{1,2}|\d{1,3}(?:\.\d{3})+|\d+,\s*\d{1,2}|\d+\.\d{1,2}"
CLIENT = "CLIENTE|DESTINATARIO|FACTURAR A|BILL TO|CUSTOMER"
TOTALS_FIRST = "TOTAL A PAGAR|IMPORTE TOTAL|TOTAL FACTURA"
CLIENT_LINES = 3

FIELDS = ("nif", "cif_cliente", "pedido", "numero", "fecha", "base", "iva", "total")


def _re(pattern: str) -> str:
    """A pattern, blind to case, with Unicode's letters and spaces, as a string of SQL."""
    return "'(?iU)" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(value: str, name: str, body: str) -> str:
    """body, with value computed once under that name: inside lambdas Spark shares no work."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _found(value: str, otherwise: str = "'ILEGIBLE'") -> str:
    return _once(value, "_v", f"named_struct('estado', if(_v is null, {otherwise}, 'ENCONTRADO'), 'valor', _v)")


def _fiscal(rest: str) -> str:
    """The first token of rest in the form of a tax id, else the first with a digit."""
    tokens = f"regexp_extract_all({rest}, {_re('[A-Z0-9][A-Z0-9-]*')}, 0)"
    return _once(tokens, "_ts", f"coalesce(get(filter(_ts, t -> t rlike {_re(NIF_FORM)}), 0), get(filter(_ts, t -> t rlike '[0-9]'), 0))")


def _canonical(token: str) -> str:
    return _once(f"regexp_replace(upper({token}), '(?U)[^\\\\p{{L}}\\\\p{{N}}]', '')", "_k", "nullif(_k, '')")


def _after(pattern: str, text: str = "l.n") -> str:
    """What follows the first match."""
    return f"regexp_replace({text}, '(?iUs)^.*?' || {_re(pattern).replace('(?iU)', '', 1)}, '')"


def fields(docs: DataFrame, text: str = "texto") -> DataFrame:
    """docs with a struct (estado, valor) for each of FIELDS. A null text has none of them."""
    raw = F.split(searchable(F.coalesce(F.col(text), F.lit(""))), "\n")
    # Of every line the last amount, and whether a sign stands right before it. A step at a time, since inside lambdas Spark shares no work.
    signed = F.lit(f"(?U)[-(−]?(?:{AMOUNT})")
    last = lambda n: F.when(n.rlike(r"(?U)\d"), F.try_element_at(F.regexp_extract_all(n, signed, F.lit(0)), F.lit(-1)))
    bare = lambda m: F.regexp_replace(F.regexp_replace(m, "^[-(−]", ""), r"[^0-9.,\-]", "")
    steps = [
        lambda n, i: F.struct(i.alias("i"), n.alias("n"), last(n).alias("m")),
        lambda x: F.struct(x["i"], x["n"], F.regexp_extract(x["m"], "^[-(−]", 0).alias("sign"), bare(x["m"]).alias("m")),
        lambda x: F.struct(x["i"], x["n"], x["sign"], N.plain_amount(x["m"]).alias("m")),
        lambda x: F.struct(x["i"], x["n"], x["sign"], N.parsed(x["m"]).alias("amount")),
    ]
    lines = raw
    for f in steps:
        lines = F.transform(lines, f)
    step = docs.withColumn("_l", lines)
    is_ = lambda p: f"l.n rlike {_re(p)}"
    marks = f"named_struct('i', l.i, 'n', l.n, 'client', {is_(CLIENT)}, 'iban', {is_('IBAN')}, 'label', {is_(NIF_LABEL)}, 'sign', coalesce(l.sign, get(_l, l.i + 1).sign), 'amount', if(l.sign is null, get(_l, l.i + 1).amount, l.amount))"
    step = step.withColumn("_l", F.expr(f"transform(_l, l -> {marks})"))
    step = step.withColumn("_c", F.expr("transform(filter(_l, l -> l.client), l -> l.i)"))

    def first(where: str, value: str, otherwise: str = "'ILEGIBLE'") -> str:
        """Of the first line where it holds, the value."""
        return f"get(transform(slice(filter(_l, l -> {where}), 1, 1), l -> {_found(value, otherwise)}), 0)"

    amount = "if(l.sign = '', cast(cast(l.amount as decimal(18,2)) as string), null)"
    labelled = lambda p: first(f"l.amount is not null and {is_(p)}", amount)
    rank = f"named_struct('p', if({is_(TOTALS_FIRST)}, 3, 2), 'i', l.i, 'v', {amount})"
    total = f"array_max(transform(filter(_l, l -> l.amount is not null and {is_(TOTAL_LABEL)} and not {is_('SUBTOTAL|BASE')}), l -> {rank}))"
    token = f"get(filter(regexp_extract_all({_after(INVOICE_LABEL)}, {_re('[A-Z0-9][A-Z0-9/-]*')}, 0), t -> t rlike '[0-9]'), 0)"
    number = f"upper({token})"
    order = f"regexp_replace(regexp_replace(upper(regexp_extract(l.n, {_re(ORDER)}, 0)), '(?U)[-/\\\\s]+', '-'), '-$', '')"
    none = "named_struct('estado', 'NO_APARECE', 'valor', cast(null as string))"
    by_label = first("not l.client and l.label", _canonical(_fiscal(_after(NIF_LABEL))))
    by_form = first(f"not l.client and not l.iban and {is_(NIF_FORM)}", _canonical(f"regexp_extract(l.n, {_re(NIF_FORM)}, 0)"))
    step = step.withColumns(
        {
            "nif": F.expr(f"coalesce({by_label}, {by_form}, {none})"),
            "pedido": F.expr(f"coalesce({first(is_(ORDER), order)}, {none})"),
            "numero": F.expr(f"coalesce({first(f'{is_(INVOICE_LABEL)} and {token} is not null', number)}, {none})"),
            "base": F.expr(f"coalesce({labelled(BASE_LABEL)}, {none})"),
            "iva": F.expr(f"coalesce({labelled(VAT_LABEL)}, {none})"),
            "_t": F.expr(total),
        }
    )
    step = step.withColumn("total", F.expr(f"if(_t is null, {none}, {_found('_t.v')})"))
    day = F.transform(F.expr(f"slice(filter(_l, l -> l.n rlike {_re('\\bFECHA\\b')} and l.n rlike {_re(DATE)}), 1, 1)"), lambda x: N.civil_date(F.regexp_extract(x["n"], f"(?U){DATE}", 0)).cast("string"))
    step = step.withColumn("_d", day).withColumn("fecha", F.expr(f"if(size(_d) = 0, {none}, {_found('_d[0]')})"))
    # Ids of the client: on its line or the three after it; the issuer's own is passed over.
    own = "t -> not (t <=> nif.valor)"
    parts = f"split(l.n, {_re(NIF_LABEL)})"
    after = f"transform(sequence(1, size({parts}) - 1), k -> array_join(slice({parts}, k + 1, size({parts})), ' '))"
    labels = f"if(l.label, filter(transform({after}, r -> {_fiscal('r')}), t -> t is not null), cast(array() as array<string>))"
    forms = f"regexp_extract_all(l.n, {_re(NIF_FORM)}, 0)"
    seen = f"transform(filter(_l, l -> not l.iban and exists(_c, c -> l.i - c between 0 and {CLIENT_LINES})), l -> named_struct('label', l.label, 'v', {_canonical(f'get(filter(concat({labels}, {forms}), {own}), 0)')}))"
    step = step.withColumn("_w", F.expr(f"get(filter({seen}, w -> w.v is not null or w.label), 0)"))
    step = step.withColumn("cif_cliente", F.expr(f"if(_w is null, {none}, {_found('_w.v')})"))
    return step.select(*docs.columns, *FIELDS)
