"""Traces that go on, log files with defects, lineage, and what-if runs against deciding everything twice."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import audit, reconcile, review, trace_log

EVENT = "log string, num long, ts string, tipo string, file_id string, datos string"


def _events(spark, numbers):
    rows = [(f"log{n % 3}", n, f"2026-01-{n % 28 + 1:02}", ("lectura", "decision", 'x"ñ')[n % 3 if n % 2 else 1], f"f{n % 5}", f'{{"result":"R{n}"}}') for n in numbers]
    return spark.createDataFrame(rows, EVENT)


def test_batches_give_the_chain_of_one_run(spark, tmp_path):
    one, some = str(tmp_path / "one"), str(tmp_path / "some")
    trace_log.append(_events(spark, range(30)), one, 0)
    trace_log.append(_events(spark, range(10)), some, 0)
    for _ in range(2):  # a run that was stopped and is started again
        trace_log.append(_events(spark, range(10, 21)), some, 1)
    trace_log.append(_events(spark, []), some, 2)
    trace_log.append(_events(spark, range(21, 30)), some, 3)
    rows = lambda p: sorted(map(tuple, trace_log.read(spark, p).collect()))
    assert rows(one) == rows(some) and len(rows(one)) == 30
    assert trace_log.defects(trace_log.read(spark, some)).count() == 0
    lines = trace_log.read(spark, some).select("log", (F.col("seq") + 1).alias("num"), trace_log.line().alias("line"))
    assert audit.verified_lines(lines).count() == 0
    assert trace_log.read(spark, str(tmp_path / "none")).count() == 0


def test_a_broken_trace_does_not_go_on(spark, tmp_path):
    path = str(tmp_path / "t")
    trace_log.append(_events(spark, range(30)), path, 0)
    rows = trace_log.read(spark, path)
    for flaw, problems in (
        (rows.withColumn("datos", F.when(F.expr("log = 'log0' and seq = 4"), "{}").otherwise(F.col("datos"))), {("log0", 4, "hash_roto")}),
        (rows.where("not (log = 'log0' and seq = 4)"), {("log0", 5, "seq_discontinuo")}),
        (rows.withColumn("hash", F.when(F.expr("log = 'log0' and seq = 4"), "0").otherwise(F.col("hash"))), {("log0", 4, "hash_roto"), ("log0", 5, "cadena_rota")}),
        (rows.unionByName(rows.where("log = 'log0' and seq = 9")), {("log0", 9, "seq_discontinuo")}),
    ):
        assert {tuple(r) for r in trace_log.defects(flaw).collect()} == problems
        other = str(tmp_path / f"b{len(problems)}{random.random()}")
        flaw.write.parquet(f"{other}/batch=0")
        with pytest.raises(trace_log.BrokenTrace, match="log0"):
            trace_log.append(_events(spark, range(30, 33)), other, 1)
        trace_log.append(_events(spark, [31, 34]), other, 1)  # another log goes on
        assert trace_log.read(spark, other).where("log = 'log1'").count() == 12


def test_lineage_and_what_is_left_to_do(spark):
    said = '{"result":"PAGAR","version_norma":"3","motivos":["m"],"hechos":[{"ok":false,"nombre":"iban","motivo":"otro"},{"ok":true,"regla":"R1"},{"ok":null,"regla":"R2"},{}]}'
    rows = [("a", 0, "lectura", "f", '{"sha256":"1"}'), ("a", 1, "decision", "f", '{"result":"ESCALAR"}'), ("a", 2, "decision", "f", said), ("a", 3, "otro", "g", "?"), ("b", 0, "decision", "h", "{x"), ("b", 1, "fin", "", None), ("b", 2, "fin", None, None)]
    trace = spark.createDataFrame(rows, "log string, seq long, tipo string, file_id string, datos string")
    got = {r.file_id: r for r in trace_log.lineage(trace).collect()}
    assert set(got) == {"f", "g", "h"} and got["g"].resultado is None and got["h"].por_que == []
    f = got["f"]
    assert (f.resultado, f.version_norma, f.sha256, f.motivos, f.n_events) == ("PAGAR", "3", "1", ["m"], 3)
    assert f.por_que == ["iban: otro", "R2: sin motivo declarado", "?: sin motivo declarado", "m"]
    assert [r.file_id for r in trace_log.pending(spark.createDataFrame([("f",), ("g",)], "file_id string"), trace).collect()] == ["g"]


def test_ranges_of_lines_carry_on(spark, monkeypatch):
    chain = audit.chained(spark.createDataFrame([(f"l{n % 2}", n, "t", "k", "f", "d") for n in range(80)], "log string, n long, ts string, tipo string, file_id string, datos string"), "log", "n", ("datos", "file_id", "tipo", "ts"))
    text = F.to_json(F.struct("datos", "file_id", "hash", "hash_prev", "seq", "tipo", "ts"))
    rows = {(r.log, r.seq): r.line for r in chain.select("log", "seq", text.alias("line")).collect()}
    g = random.Random(1)
    flawed = [(log, seq + 1, g.choice([line] * 6 + ["", "{x", "[1]", line.replace('"k"', '"K"'), line.replace(":", ": ", 1)])) for (log, seq), line in rows.items() if g.random() > 0.05]
    df = spark.createDataFrame(flawed, "log string, num long, line string")
    whole = sorted(map(tuple, audit.verified_lines(df).collect()))
    monkeypatch.setattr(audit, "RANGE_LINES", 3)
    assert sorted(map(tuple, audit.verified_lines(df).collect())) == whole and len(whole) > 20


def test_log_files(spark):
    rows = [("cut", b"\n{x"), ("bytes", b"\xc3\x28"), ("empty", b""), ("blank", b" \n"), ("null", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {tuple(r) for r in audit.verified_files(files, spark.createDataFrame([("cut",), ("gone",)], "path string"), spark.createDataFrame([("empty", "x")], "log string, seal string")).collect()}
    assert got == {("cut", 2, "truncado"), ("cut", 1, "linea_vacia"), ("cut", 2, "json_invalido"), ("bytes", 0, "ilegible"), ("null", 0, "ilegible"), ("blank", 1, "linea_vacia"), ("gone", 0, "no_existe")}


def test_what_if_equals_deciding_twice(spark):
    nif, iban = [f"B{i}{i}{i}45678" for i in range(4)], ["ES" + str(i) * 22 for i in range(4)]
    rows = [(f"f{n}", "Factura", False, n % 7 == 0, [f"PO-2026-{n % 23:04}"] if n % 11 else [], [nif[n % 4]], [iban[n % 4]], ["01/09/2026"], ["100.00"], ["21.00"], ["121.00" if n % 11 else f"{n}.00"], []) for n in range(40)]
    schema = "file_id string, texto string, ilegible boolean, ocr boolean, pedidos array<string>, nifs array<string>, ibans array<string>, fechas array<string>, bases array<string>, ivas array<string>, totales array<string>, divisas array<string>"
    readings = spark.createDataFrame(rows, schema)
    row = lambda n, amount="121.00", state="PENDIENTE", seq=0: (f"PO-2026-{n:04}", Decimal(amount), state, nif[n % 4], seq)
    form = "pedido string, importe decimal(18,2), estado string, nif string, seq long"
    ledger = spark.createDataFrame([row(n) for n in range(23)] + [row(30, "11.00"), row(31, "22.00")], form)
    orders = spark.createDataFrame([(f"PO-2026-{n:04}", f"P{n % 4}", 0) for n in [*range(23), 30, 31]], "pedido string, proveedor_id string, seq long")
    master = spark.createDataFrame([(f"P{i}", nif[i], iban[i]) for i in range(4)], "proveedor_id string, nif string, iban string")
    tables = (readings, ledger, orders, master, spark.createDataFrame([("PO-2026-0005",)], "pedido string"))
    new_ledger = spark.createDataFrame([row(3, state="PAGADA", seq=1), row(30, "33.00", seq=1), row(4, "5.00", seq=1)], form)
    new_master = spark.createDataFrame([("P2", "B99999999", iban[2])], "proveedor_id string, nif string, iban string")
    new_readings = spark.createDataFrame([(*r[:4], ["PO-2026-0007"], *r[5:]) for r in rows[8:10]], schema)
    got = {r.file_id: (r.before, r.after, sorted(r.gained), sorted(r.lost)) for r in review.what_if_rows(tables, None, new_ledger, new_master, new_readings).collect()}
    then = (review.put_in(readings, new_readings, "file_id"), ledger.unionByName(new_ledger), orders, review.put_in(master, new_master, "proveedor_id"), tables[4])
    full = {r.file_id: (r.before, r.after, sorted(r.gained), sorted(r.lost)) for r in review.moved(reconcile.decide(*tables), reconcile.decide(*then)).collect()}
    assert got == full and {"f8", "f9", "f3"} <= set(got) and len(got) < 40
