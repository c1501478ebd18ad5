"""The older reconciliation against a plain reading of it, row by row."""

from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgermill.operators import legacy

INVOICE = "file_id string, nif string, pedido string, total decimal(18,2), nif_ilegible boolean, cif_cliente string, cif_ilegible boolean, campos array<struct<nombre:string,ilegible:boolean,crudo:string,donde:string,score:double>>"
LEDGER = "asiento_id string, nif string, pedido string, importe decimal(18,2), estado string, seq long"
BOOK = "id string, nif string, pedido string, estado string, importe decimal(18,2), seq long"
nifs, orders = st.sampled_from([None, "B1", "B2", "B3"]), st.sampled_from([None, "PO-1", "po 1", "PO-2", "PO-3", "-"])
money = st.sampled_from([None, D("10.00"), D("10.01"), D("10.02"), D("-3.00")])


def plain(invoice, ledger, book):
    key = lambda x: "".join(c for c in (x or "").upper() if c.isalnum()) or None
    _, nif, order, total = invoice
    order = key(order)
    close = lambda a, b: abs(a - b) <= D("0.01")
    one = [a for a in ledger if order and key(a[2]) == order]
    two = [a for a in ledger if nif and a[1] == nif and total is not None and a[3] is not None and close(a[3], total)]
    three = [a for a in ledger if nif and a[1] == nif]
    way, row = next(((w, x[0]) for w, x in (("pedido", one), ("nif_importe", two), ("nif_unico", three)) if len(x) == 1), ("ninguno", None))
    rows = [b for b in book if order and key(b[2]) == order]
    rows += [b for b in book if nif and b[1] == nif and b not in rows]
    state = off = 0
    for b in rows if row else []:
        text = (b[3] or "").upper()
        state += ("PENDIENT" in text) if row[4] == "PAGADA" else row[4] is not None and "PAGAD" in text
        off += b[4] is not None and row[3] is not None and not close(b[4], row[3])
    other_nif = way == "pedido" and nif and row[1] and nif != row[1]
    other_order = way.startswith("nif") and order and key(row[2]) and order != key(row[2])
    return (way, row and row[0], len(rows), rows[0][0] if rows else None, len(one) if len(one) > 1 else 0, len(two) if way != "pedido" and len(two) > 1 else 0, int(bool(other_nif)), int(bool(other_order)), state, off)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(nifs, orders, money), max_size=12), st.lists(st.tuples(nifs, orders, money, st.sampled_from(["PAGADA", "PENDIENTE", None])), max_size=8), st.lists(st.tuples(nifs, orders, st.sampled_from([None, "Pagado", "Pendiente", "pagada, no pendiente"]), money), max_size=8))
def test_evidence(spark, invoices, ledger, book):
    inv = [(f"f{i}", *x) for i, x in enumerate(invoices)]
    led = [(f"A{i}", a, b, c, s, i) for i, (a, b, c, s) in enumerate(ledger)]
    wb = [(f"w{i}", *x, i) for i, x in enumerate(book)]
    make = spark.createDataFrame
    found = legacy.evidence(make(inv, "file_id string, nif string, pedido string, total decimal(18,2)"), make(led, LEDGER), make(wb, BOOK))
    names = "match_por, asiento.asiento_id, n_filas, primera_fila, n_mismo_pedido, n_mismo_importe, nif_distinto, pedido_distinto, n_estado, n_importe".split(", ")
    got = {r[0]: tuple(r[1:]) for r in found.select("file_id", *names).collect()}
    assert got == {x[0]: plain(x, led, wb) for x in inv}


def test_rules_and_reasons(spark):
    campos = [("total", True, "1x0", "pág. 2", None), ("nif_emisor", False, None, None, 0.5)]
    invoices = [
        ("a", None, None, None, True, None, True, []),
        ("b", "B1", None, D("1.00"), False, None, False, []),
        ("c", None, "PO-9", D("1.00"), False, "A5", False, None),
        ("d", "B1", "PO-1", D("10.01"), False, "A5", False, []),
        ("e", "B1", "PO-1", D("11.50"), False, "A5", False, campos),
        ("f", "B7", "PO-1", None, False, "A5", False, []),
        ("g", None, "PO-2", D("2.00"), False, "A5", False, []),
        ("h", "B8", "PO-5", D("2.00"), False, "A5", False, []),
        ("i", "B6", None, D("2.00"), False, "A5", False, []),
    ]
    ledger = [("A1", "B1", "PO-1", D("10.00"), "PENDIENTE", 1), ("A2", None, "PO-2", D("2.00"), "PENDIENTE", 2), ("A3", "B9", "PO-9", D("1.00"), "PENDIENTE", 3), ("A4", "B4", "PO-4", D("1.00"), "PAGADA", 4)]
    book = [("w1", "B8", None, None, None, 1), ("w2", None, "po5", None, None, 2)]
    make = spark.createDataFrame
    inv = make(invoices, INVOICE)
    out = legacy.decisions(inv, legacy.evidence(inv.select("file_id", "nif", "pedido", "total"), make(ledger, LEDGER), make(book, BOOK)), ["B9"])
    got = {r.file_id: (r.resultado, r.motivo, r.evaluadas[-1], len(r.evaluadas)) for r in out.collect()}
    assert got == {
        "a": ("ESCALAR", "NIF ilegible y ningún pedido", "R1_sin_identificadores", 1),
        "b": ("ESCALAR", "sin CIF del cliente", "R1_sin_cif_cliente", 2),
        "c": ("NO_PAGAR", "proveedor B9 en la lista de pago prohibido", "R2_prohibido_pagar_proveedor", 3),
        "d": ("PAGAR", "asiento A1 PENDIENTE, importes conciliados", "R6_erp_pendiente_conciliado", 8),
        "e": ("ESCALAR", "extracción dudosa en total ilegible (1x0, pág. 2), nif_emisor (0.50)", "R5_extraccion_dudosa", 6),
        "f": ("ESCALAR", "conflicto entre fuentes: NIF B7 frente a B1 en A1", "R4_conflicto_fuentes", 5),
        "g": ("ESCALAR", "asiento A2 sin NIF en el ERP", "R10_erp_sin_nif", 7),
        "h": ("ESCALAR", "no consta en el ERP; 2 filas del Excel desde w2", "R8_sin_erp_con_excel", 5),
        "i": ("ESCALAR", "en ninguna fuente", "R9_sin_match", 6),
    }
    seen = legacy.related(inv.where("file_id = 'h'"), make(book, BOOK)).collect()
    assert sorted(r.id for r in seen) == ["w1", "w2"]
