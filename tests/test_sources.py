import json

import pytest

from ledgermill.sources import readers
from ledgermill.streaming import decisions


def test_ledger_formats(spark, tmp_path):
    want = [("AS-00001", "PO-2026-0007", "6199.54", "PENDIENTE")]
    (tmp_path / "l.csv").write_text("asiento_id,fecha_registro,proveedor_id,nif,pedido,importe_esperado,estado\nAS-00001,2026-01-02,P1,B12345678,PO-2026-0007,6199.54,pendiente\nAS-00002,2026-01-02,P1,,PO-2026-0008,?,PAGADA\n")
    (tmp_path / "l.xml").write_bytes("<respuesta><asientos><asiento><id>AS-00001</id><fecha>02/01/2026</fecha><proveedor>Ñ</proveedor><nif>B12345678</nif><pedido>PO-2026-0007</pedido><importe>6.199,54</importe><estado>PENDIENTE</estado></asiento></asientos></respuesta>".encode("latin-1"))
    row = {"asiento_id": "AS-00001", "fecha": "2026-01-02", "proveedor": "P1", "nif": "B12345678", "pedido": "PO-2026-0007", "importe": 6199.54, "estado": "PENDIENTE"}
    (tmp_path / "a.json").write_text(json.dumps([row]))
    (tmp_path / "b.json").write_text(json.dumps({"snapshot_id": "x", "asientos": [row]}))
    for read, name in ((readers.ledger_csv, "l.csv"), (readers.ledger_xml, "l.xml"), (readers.ledger_snapshot, "a.json"), (readers.ledger_snapshot, "b.json")):
        got = read(spark, str(tmp_path / name)).collect()
        assert [(r.asiento_id, r.pedido, str(r.importe), r.estado) for r in got] == want


def test_deliverable(spark, tmp_path):
    out = str(tmp_path / "d")
    df = spark.createDataFrame([("b.pdf", "PAGAR"), ("a.pdf", "ESCALAR")], "file_id string, result string")
    readers.write_deliverable(df, out)
    good, bad = readers.deliverable(spark, out)
    assert sorted(map(tuple, good.collect())) == [("a.pdf", "ESCALAR"), ("b.pdf", "PAGAR")] and bad.count() == 0
    (tmp_path / "x.jsonl").write_text('{"file_id":"a","result":"PAGAR"}\n{"file_id":"a","result":"ESCALAR"}\nnope\n\n')
    good, bad = readers.deliverable(spark, str(tmp_path / "x.jsonl"))
    assert [tuple(r) for r in good.collect()] == [("a", "ESCALAR")] and bad.count() == 1
    with pytest.raises(Exception, match="bad row"):
        readers.write_deliverable(df.selectExpr("' ' || file_id AS file_id", "result"), out)


def test_reference_and_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"meta": {}, "files": {"a": {"verdict": {"primary": "PAGAR", "acceptable": ["ESCALAR"]}}}}))
    assert [tuple(r) for r in readers.reference(spark, str(tmp_path / "r.json")).collect()] == [("a", "PAGAR", ["ESCALAR"])]
    (tmp_path / "f.pdf").write_bytes(b"x")
    assert [r.file_id for r in readers.binaries(spark, str(tmp_path)).collect()] == ["f.pdf"]


def test_stream_counts_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"ts": f"2026-01-01T0{h}:10:00", "file_id": f, "resultado": "PAGAR"} for h, f in ((1, "a"), (1, "a"), (1, "b"), (2, "c"))]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("ts timestamp, file_id string, resultado string").json(str(src))
    q = decisions.counted(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.n) for r in spark.table("counted").collect()) == [(1, 2), (2, 1)]
