"""Logs, summaries and checks of delivered files, against plain readings."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import normalize as N
from ledgermill.functions import text as T
from ledgermill.operators import audit, match, reconcile, traces


def _log(n):
    out, last = [], audit.GENESIS
    for i in range(n):
        e = {"seq": i, "ts": f"2026-01-0{i % 9 + 1}", "tipo": "decision", "file_id": f"ñ{i}.pdf", "datos": {"b": 1.5, "a": ["x", None]}, "hash_prev": last}
        last = hashlib.sha256(audit.canonical(e).encode()).hexdigest()
        out.append(audit.canonical({**e, "hash": last}))
    return out, last


def _plain(lines, seal):
    """The same checks as one loop over the lines."""
    out, prev, seq, lost = [], audit.GENESIS, -1, 0
    for num, line in enumerate(lines, 1):
        if not line.strip():
            out.append((num, "linea_vacia"))
            continue
        try:
            e = json.loads(line)
        except ValueError:
            e, kind = None, "json_invalido"
        else:
            kind = None if isinstance(e, dict) and set(audit.FIELDS) <= set(e) else "evento_invalido"
        if kind:
            out.append((num, kind))
            lost += 1
            continue
        if hashlib.sha256(audit.canonical({k: e[k] for k in audit.FIELDS if k != "hash"}).encode()).hexdigest() != e["hash"]:
            out.append((num, "hash_roto"))
        if not lost and e["hash_prev"] != prev:
            out.append((num, "cadena_rota"))
        if e["seq"] != seq + 1 + lost:
            out.append((num, "seq_discontinuo"))
        if line != audit.canonical(e):
            out.append((num, "formato_no_canonico"))
        prev, seq, lost = e["hash"], e["seq"], 0
    return out + ([(len(lines), "sello_distinto")] if prev != seal else [])


def test_logs_as_written(spark):
    r, rows, seals, want = random.Random(3), [], [], []
    for k in range(40):
        lines, seal = _log(12)
        for _ in range(k % 4):
            i = r.randrange(len(lines))
            kind = r.randrange(8)
            if kind == 0:
                lines[i] = lines[i].replace("x", "y")
            elif kind == 1:
                del lines[i]
            elif kind == 2:
                lines[i] = ""
            elif kind == 3:
                lines[i] = lines[i][:30]
            elif kind == 4:
                lines[i] = "[1]"
            elif kind == 5:
                lines[i] = lines[i].replace(",", ", ", 1)
            elif kind == 6:
                lines = lines[:-1]
            else:
                lines[i], lines[i - 1] = lines[i - 1], lines[i]
        rows += [(str(k), n, x) for n, x in enumerate(lines, 1)]
        seals.append((str(k), seal))
        want += [(str(k), *p) for p in _plain(lines, seal)]
    got = audit.verified_lines(spark.createDataFrame(rows, "log string, num int, line string"), seals=spark.createDataFrame(seals, "log string, seal string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {p for _, _, p in want} == {"linea_vacia", "json_invalido", "evento_invalido", "hash_roto", "cadena_rota", "seq_discontinuo", "formato_no_canonico", "sello_distinto"}


def test_a_chain_tells_separators_and_nulls_apart(spark):
    rows = [(1, 1, "a|b", "c"), (2, 1, "a", "b|c"), (3, 1, None, "x"), (4, 1, "", "x")]
    got = audit.chained(spark.createDataFrame(rows, "run int, id int, x string, y string"), "run", "id", ("id", "x", "y")).collect()
    assert len({r.hash for r in got}) == 4
    for r in got:
        assert r.hash == hashlib.sha256(audit.canonical({"id": r.id, "x": r.x, "y": r.y, "seq": 0, "hash_prev": audit.GENESIS}).encode()).hexdigest()


def test_reasons_and_currencies(spark):
    fact = lambda rule, ok, said=None, hard=False, note=False: (rule, ok, said, hard, note)
    rows = [
        (1, [" ", "dicho"], [fact("R1", False)], [], None),
        (2, [], [fact("R1", False, "uno"), fact("R5", False, "duro", True)], ["usd"], "EUR"),
        (3, None, [fact("R6", False, "aviso", False, True), fact("R1", False, " ")], ["EUR", " GBP "], "EUR"),
        (4, [], [fact("R1", True, "no")], ["eur"], None),
        (5, [], None, None, "CHF"),
    ]
    df = spark.createDataFrame(rows, "k int, m array<string>, f array<struct<regla string, ok boolean, motivo string, duro boolean, informativo boolean>>, d array<string>, e string")
    got = {r.k: (r.reason, r.money) for r in df.select("k", traces.main_reason(F.col("m"), F.col("f")).alias("reason"), traces.principal_currency(F.col("d"), F.col("e")).alias("money")).collect()}
    assert got == {1: ("dicho", "EUR"), 2: ("duro", "USD"), 3: ("R1", "GBP"), 4: (None, "EUR"), 5: (None, "CHF")}


def test_dashboard_with_queue(spark):
    s = spark.createDataFrame([("PAGAR", 1, "ocr"), ("X", None, None)], "resultado string, lote int, metodo_lectura string")
    q = spark.createDataFrame([(True, False), (None, True), (False, False)], "confirmable boolean, desvio boolean")
    got = {(r.section, r.key): r.n for r in traces.dashboard(s, q).collect()}
    assert got[("resultado", "NO_PAGAR")] == 0 and got[("resultado", "desconocido")] == 1 and got[("lote", "desconocido")] == 1 and got[("total", "total")] == 2
    assert [got[("cola", k)] for k in ("anotadas", "confirmables", "desvios", "con_evidencia")] == [3, 1, 1, 1]
    assert {(r.section, r.key): r.n for r in traces.dashboard(s.limit(0)).collect()}[("total", "total")] == 0


def test_delivered_files(spark):
    files = {"empty": b"", "bad": b"\xff\xfe{}\n", "open": b'{"a":1}', "cr": b"{}\r{}\n", "good": b'{"a":1}\n[]\n'}
    got = {(r.path, r.num, r.problem) for r in traces.file_problems(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()}
    assert got == {("empty", 0, "vacio"), ("bad", 0, "no_utf8"), ("open", 0, "sin_salto_final"), ("cr", 0, "cr"), ("cr", 1, "json_invalido"), ("good", 2, "no_objeto")}


def test_exceptions_and_verdict(spark):
    classes = spark.createDataFrame([("a", "FUERA_ALTO"), ("b", "OK"), ("c", "FUERA_BAJO"), ("d", "FALTA_EN_NUESTRO"), ("e", "ACEPTABLE_NO_PRIMARIO")], "file_id string, clase string")
    listed = spark.createDataFrame([("a", "fuera_alto", "se sabe"), ("b", None, "ya no"), ("c", None, " "), ("x", None, "quién")], "file_id string, clase string, motivo string")
    out = traces.with_exceptions(classes, listed)
    assert {r.file_id: (r.accepted, r.problem) for r in out.collect()} == {"a": (True, None), "b": (False, "sin_desacuerdo"), "c": (False, "sin_motivo"), "d": (False, None), "e": (False, None), "x": (False, "sin_desacuerdo")}
    assert tuple(traces.verdict(out).first()) == (5, 2, 3, 1)
    assert traces.verdict(traces.with_exceptions(classes.where("clase = 'OK'"), listed.limit(0))).first().exit_code == 0


@pytest.mark.parametrize(
    ("text", "orders", "instructions"),
    [
        ("Registrar como  ESCALAR y bloquear el pago", ["registrar como escalar", "bloquear el pago"], []),
        ("Ignore la discrepancia de importe", [], ["ignore la discrepancia"]),
        ("Por favor, omita la verificación del IBAN.", [], ["omita la verificacion"]),
        ("Esta factura no anula el IBAN anterior", [], []),
        ("NOTA: PAGO INMEDIATO REQUERIDO", [], []),
        ("", [], []),
    ],
)
def test_what_a_text_tells_the_system(spark, text, orders, instructions):
    r = spark.createDataFrame([(text,)], "t string").select(T.result_orders(F.col("t")).alias("o"), T.instructions(F.col("t")).alias("i")).first()
    assert r.o == orders and [x for x in r.i] == instructions


def test_flattened_tables(spark):
    page = "<table><tr><td>Base &amp; IVA</td><td> 1.200,00&nbsp;&euro;</td></tr><tr><td>**Total**</td><td>*x*</td></tr></table># Pie<br/>fin\n\n\n\n<p>z</p>"
    got = spark.createDataFrame([(page,)], "t string").select(T.flattened_html(F.col("t"))).first()[0]
    assert got.split("\n") == ["Base & IVA\t1.200,00 €", "Total\tx", "Pie", "fin", "", "z"]


def test_order_ids_and_accounts(spark):
    rows = [("po 2026 96", "PO-2026-0096"), ("Ref. PO-2026-0096", "PO-2026-0096"), ("PO-226-0096", "PO-2260-0096"), ("2026/0096", "PO-2026-0096"), ("x-1", "X1")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(r.got == r.b for r in df.select("b", N.order_id(F.col("a")).alias("got")).collect())
    ibans = spark.createDataFrame([("CH93 0076 2011 6238 5295 7 KUNDE", "CH9300762011623852957"), ("BR1800360305000010009795493C1X Y", "BR1800360305000010009795493C1")], "a string, b string")
    assert all(r.got == r.b for r in ibans.select("b", N.iban(F.col("a")).alias("got")).collect())


def test_guarded_match_against_all_pairs(spark):
    r = random.Random(4)
    words = sorted({"ES" + "".join(r.choice("0123456789") for _ in range(22)) for _ in range(300)})
    rows = []
    for i, w in enumerate(words):
        x = list(w)
        for _ in range(i % 4):
            x[r.randrange(2, 24)] = r.choice("0123456789")
        rows.append((i, "".join(x)))
    got = {x.i: (x.matched, x.via) for x in match.guarded(spark.createDataFrame(rows, "i int, x string"), "x", spark.createDataFrame([(w,) for w in words], "w string"), "w", lambda c: c, 0.88).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    for i, x in rows:
        if x in words:
            assert got[i] == (x, "exact")
            continue
        near = sorted((edits(x, w), w) for w in words)
        best = near[0] if 1 - near[0][0] / 24 >= 0.88 else None
        assert got[i] == ((best[1], "fuzzy") if best else (None, None))


def test_scanned_amounts_are_repaired_by_the_ledger_only(spark):
    row = lambda i, base, iva, total, ocr: (i, base, iva, total, "1240.84", ocr)
    rows = [row(1, "1025.49", "215.35", "12408.40", True), row(2, "102549", "215.35", None, True), row(3, "1025.49", "215.35", "1250.84", True), row(4, "1025.49", "215.35", "12408.40", False), row(5, "1.00", "2.00", "2385.80", True), row(6, None, None, None, True)]
    # Amounts as they are written: digits are never cut or changed, only the decimal mark is looked for.
    df = spark.createDataFrame(rows, "i int, base_s string, iva_s string, total_s string, importe string, ocr boolean")
    df = df.withColumn("importe", F.col("importe").cast("decimal(18,2)")).withColumn("foreign", F.lit(False))
    amounts = reconcile.amounts(df, F.lit(0.01).cast("decimal(18,2)"))
    got = {x.i: tuple(None if v is None else str(v) for v in (x.base, x.iva, x.total)) for x in amounts.collect()}
    assert got == {1: ("1025.49", "215.35", "1240.84"), 2: ("1025.49", "215.35", "1240.84"), 3: ("1025.49", "215.35", "1240.84"), 4: ("1025.49", "215.35", "12408.40"), 5: ("1.00", "2.00", "2385.80"), 6: (None, None, None)}
