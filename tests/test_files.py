"""Files of JSON lines: numbers of lines over splits, traces of several lots, the strict contract."""

import json

from ledgermill.operators import contract, trace_rows
from ledgermill.sources import logs


def test_numbers_hold_over_splits(spark, tmp_path):
    texts = {"a.jsonl": ["x" * (i % 17) for i in range(500)], "b.jsonl": ["é" * (i % 5) + str(i) for i in range(300)], "c.jsonl": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = logs.numbered_lines(spark, str(tmp_path)).collect()
        through = logs.numbered_lines(spark, str(tmp_path), across=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.path.rsplit("/", 1)[1], r.num): r.value for r in rows}
    assert got == {(name, i + 1): x for name, lines in texts.items() for i, x in enumerate(lines)}
    assert [r.value for r in sorted(through, key=lambda r: r.num)] == texts["a.jsonl"] + texts["b.jsonl"]


def test_traces_of_two_lots(spark, tmp_path):
    campos = {"proveedor": " ACME ", "nif_maestro": " ", "nif_asiento": "B1", "total": "1 234,5", "importe_erp": 12.5, "desvio_importe": True, "divisa_documento": ["eur", " usd "]}
    fact = {"regla": "R4", "ok": False, "duro": False, "motivo": " "}
    one = [json.dumps({"file_id": " a.pdf ", "result": "PAGAR", "campos": campos, "hechos": [fact], "lote": 1}), "", "   ", "{broken", "[1]", json.dumps({"result": "PAGAR"}), json.dumps({"file_id": "a.pdf", "result": "ESCALAR"})]
    event = lambda kind, file_id, data: json.dumps({"seq": 1, "tipo": kind, "file_id": file_id, "datos": data})
    two = [event("lectura", "b.pdf", {"result": "no"}), event("decision", "b.pdf", {"result": "NO_PAGAR", "motivos": [" ", "ya pagado"], "segunda_lectura": {"desvio": True}}), event("decision", "a.pdf", {"result": "NO_PAGAR"}), event("decision", "", {"file_id": "c.pdf", "result": "PAGAR"}), event("decision", "d.pdf", None), json.dumps({"tipo": None, "file_id": "e.pdf"})]
    for name, lines in (("one", one), ("two", two)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.jsonl").write_text("\n".join(lines))
    notes = tmp_path / "notes.jsonl"
    notes.write_text("\n".join([json.dumps({"file_id": "a.pdf", "segunda_lectura": {"desvio": True}}), json.dumps({"file_id": "a.pdf", "segunda_lectura": {"confirmable": True}}), "x", json.dumps({"file_id": "b.pdf", "segunda_lectura": 3})]))
    rows = logs.trace_records(spark, [str(tmp_path / "one"), str(tmp_path / "two")], logs.queue_notes(spark, str(notes)))
    got = sorted(((r.src, r.num, r.problem, r.first, r.file_id, r.result) for r in rows.collect()), key=lambda r: r[:2])
    assert got == [
        (0, 1, None, True, "a.pdf", "PAGAR"), (0, 4, "ilegible", False, None, None), (0, 5, "ilegible", False, None, None), (0, 6, "sin_file_id", False, None, None), (0, 7, None, False, "a.pdf", "ESCALAR"),
        (1, 2, None, True, "b.pdf", "NO_PAGAR"), (1, 3, None, False, "a.pdf", "NO_PAGAR"), (1, 4, None, True, "c.pdf", "PAGAR"),
    ]
    first = rows.where("first")
    a, b, c = sorted(trace_rows.listed(first).collect(), key=lambda r: r.file_id)
    assert len(a) == 22
    assert (a.motivo_principal, a.proveedor, a.nif, a.total, a.importe_erp, a.desvio_importe, a.divisa, a.lote) == ("R4", "ACME", "B1", 1234.5, 12.5, None, "USD", "1")
    assert tuple(a.segunda_lectura) == (True, False) and tuple(b.segunda_lectura) == (False, True) and c.segunda_lectura is None
    assert (b.motivo_principal, b.divisa, b.total) == ("ya pagado", "EUR", None)
    d = {r.file_id: r for r in trace_rows.detailed(first).collect()}
    assert d["a.pdf"].resumen.total == 1234.5 and d["a.pdf"].hechos[0].regla == "R4" and d["c.pdf"].motivos == [] and d["c.pdf"].campos == {} and d["c.pdf"].lectura.sospechosos == []


def test_strict_contract(spark):
    row = lambda x, r="PAGAR": json.dumps({"file_id": x, "result": r})
    lines = ["\ufeff" + row("a.pdf"), row("A.pdf") + "\r", "", "\t", "{", "3", row("a.pdf"), row("dir\\b.pdf"), row("b.pdf", "pagar"), '{"file_id": null, "resultado": "PAGAR"}', '{"result": null, "file_id": "nope"}', '{"file_id":"b.pdf","result":"PAGAR"} x']
    made = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "num long, value string")
    names = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "name string")
    problems = contract.line_problems(made, names)
    got = {(r.severity, r.message, r.n, r.first) for r in contract.grouped(problems).collect()}
    assert got == {
        ("error", "empieza con BOM", 1, None), ("aviso", "termina en CRLF", 1, 2), ("error", "línea vacía", 2, 3), ("error", "no es JSON", 2, 5), ("error", "no es un objeto JSON", 1, 6), ("error", "a.pdf repetido (ya en la línea 1)", 1, 7),
        ("error", "A.pdf no existe, el documento es a.pdf", 1, 2), ("error", "file_id con ruta: dir\\b.pdf", 1, 8), ("error", "result fuera del contrato: pagar", 1, 9), ("error", "file_id no es un texto o está vacío", 1, 10),
        ("error", "falta result y aparece resultado", 1, 10), ("aviso", "campos de más: resultado", 1, 10), ("error", "result fuera del contrato: null", 1, 11), ("error", "nope no es un documento", 1, 11), ("error", "c.pdf sin línea", 1, None),
    }
    assert tuple(contract.outcome(problems).first()) == (15, 2, 1)
    assert tuple(contract.outcome(contract.line_problems(made.limit(0), names.limit(0))).first()) == (0, 0, 0)
