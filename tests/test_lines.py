"""The older extraction against a plain reading of the same rules, on written and on random documents."""

import datetime
import random
import re

from ledgermill.operators import lines as L
from ledgermill.functions.readings import INVISIBLE, MOJIBAKE

_OFF = {**{ord(a): b for a, b in MOJIBAKE.items()}, **{ord(c): None for c in INVISIBLE}}


def _amount(line):
    found = list(re.finditer(L.AMOUNT, line))
    if not found:
        return None
    m = found[-1]
    s = re.sub(r"\s", "", m.group())
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", ".")
    elif "." in s and not re.search(r"\.\d{1,2}$", s):
        s = s.replace(".", "")
    return None if line[: m.start()][-1:] in ("-", "(", "−") else f"{float(s):.2f}", True


def plain(text):
    has = lambda p, x: re.search(p, x, re.I)
    ls = [x.translate(_OFF) for x in (text or "").split("\n")]
    out = {f: ("NO_APARECE", None) for f in L.FIELDS}
    state = lambda v: ("ENCONTRADO", v) if v else ("ILEGIBLE", None)

    def fiscal(rest):
        tokens = re.findall(r"[A-Z0-9][A-Z0-9-]*", rest, re.I)
        t = next((t for t in tokens if has(L.NIF_FORM, t)), None) or next((t for t in tokens if re.search("[0-9]", t)), None)
        return t

    clean = lambda t: re.sub(r"[^A-Z0-9]", "", t.upper()) if t else None
    for x in ls:
        if not has(L.CLIENT, x) and (m := has(L.NIF_LABEL, x)):
            out["nif"] = state(clean(fiscal(x[m.end() :])))
            break
    else:
        for x in ls:
            if not has(L.CLIENT, x) and not has("IBAN", x) and (m := has(L.NIF_FORM, x)):
                out["nif"] = state(clean(m.group()))
                break
    left = 0
    for x in ls:
        if has(L.CLIENT, x):
            left = L.CLIENT_LINES
        elif left == 0:
            continue
        else:
            left -= 1
        if has("IBAN", x):
            continue
        found = [fiscal(x[m.end() :]) for m in re.finditer(L.NIF_LABEL, x, re.I)] + [m.group() for m in re.finditer(L.NIF_FORM, x, re.I)]
        if t := next((t for t in found if t and t != out["nif"][1]), None):
            out["cif_cliente"] = state(clean(t))
            break
        if has(L.NIF_LABEL, x):
            out["cif_cliente"] = state(None)
            break
    for x in ls:
        if m := has(L.ORDER, x):
            out["pedido"] = state(re.sub(r"[-/\s]+", "-", m.group().upper()))
            break
    for x in ls:
        if (m := has(L.INVOICE_LABEL, x)) and (t := next((t for t in re.findall(r"[A-Z0-9][A-Z0-9/-]*", x[m.end() :], re.I) if re.search("[0-9]", t)), None)):
            out["numero"] = state(t.upper())
            break
    for x in ls:
        if has(r"\bFECHA\b", x) and (m := re.search(L.DATE, x)):
            d, mo, y = map(int, m.group().split("/"))
            try:
                out["fecha"] = state(datetime.date(y, mo, d).isoformat())
            except ValueError:
                out["fecha"] = state(None)
            break
    value = lambda i: _amount(ls[i]) or (_amount(ls[i + 1]) if i + 1 < len(ls) else None)
    for field, label in (("base", L.BASE_LABEL), ("iva", L.VAT_LABEL)):
        if v := next((v for i, x in enumerate(ls) if has(label, x) and (v := value(i))), None):
            out[field] = state(v[0])
    totals = [((3 if has(L.TOTALS_FIRST, x) else 2, i), v) for i, x in enumerate(ls) if has(L.TOTAL_LABEL, x) and not has("SUBTOTAL|BASE", x) and (v := value(i))]
    if totals:
        out["total"] = state(max(totals)[1][0])
    return out


WRITTEN = [
    None,
    "",
    "TOTAL 1.234,56",
    "TOTAL A PAGAR ....... EUR 12,874.40\nTOTAL 99,00",
    "Total\n1.047,51 Ç\nTOTAL FACTURA: (88,00)",
    "SUBTOTAL 10,00\nTOTAL BASE 3,00\nI.V.A. 21% 2,10\nTOTAL 1.234",
    "NIF / CIF: B46102331\nCliente: ACME\nCalle 1\nCIF: A58231074",
    "Destinatario\nNIF: B46102331 CIF: A58231074\nN.I.F. B46102331",
    "Cliente X\n\n\n\nA58231074",
    "NIF: ilegible\nFECHA 31/04/2026\nFactura nº 12/A-7",
    "IBAN ES12 A58231074\nB46102331 sl\nPED 2026/0123 y PO-26-123",
    "BILL TO: X\nCIF:\nfecha: 05/01/2026",
    "T​OTAL 7,5",
    "Base imponible\n-12,00",
]


def test_extraction_equals_plain_reading(spark):
    r = random.Random(3)
    bits = ["NIF:", "CIF", "B46102331", "A58231074", "12345678Z", "Cliente", "IBAN", "TOTAL", "TOTAL A PAGAR", "BASE", "IVA", "1.234,56", "12,5", "-3,10", "(4.00)", "1.234", "FECHA", "05/01/2026", "31/02/2026", "PO-2026-0123", "PED 26/123", "FACTURA", "F-77", "\n", "\n", "\n", "x"]
    texts = WRITTEN + [" ".join(r.choice(bits) for _ in range(r.randrange(3, 40))).replace(" \n ", "\n") for _ in range(500)] + ["x " * 50_000 + "\nTOTAL 5,00"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, texto string")
    got = {x["id"]: {f: (x[f]["estado"], x[f]["valor"]) for f in L.FIELDS} for x in L.fields(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), (t, {f: (got[i][f], plain(t)[f]) for f in L.FIELDS if got[i][f] != plain(t)[f]})
    assert L.fields(df.limit(0)).count() == 0


def test_amounts_are_looked_for_once_a_line(spark):
    """Lambdas share no work: written out, the search stood in the plan once for every use of what it finds."""
    docs = spark.createDataFrame([("a", "TOTAL 1,00\n(2,50)")], "file_id string, texto string")
    plan = L.fields(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(L.AMOUNT[:40]) == 1
