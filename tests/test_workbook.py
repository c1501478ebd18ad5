"""Workbooks as they are written."""

import zipfile
from datetime import date
from decimal import Decimal as D

from ledgermill.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def written(path, sheets):
    """A workbook: texts as shared strings in even columns, inline in odd ones, numbers as numbers."""
    shared, parts = [], []
    for rows in sheets.values():
        out = ""
        for i, row in enumerate(rows, 1):
            out += f'<row r="{i}">'
            for j, v in enumerate(row):
                at = f'r="{chr(65 + j)}{i}"'
                if v is None:
                    out += f"<c {at}/>"
                elif not isinstance(v, str):
                    out += f"<c {at}><v>{v}</v></c>"
                elif j % 2:
                    out += f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
                else:
                    shared.append(v)
                    out += f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
            out += "</row>"
        parts.append(f"<worksheet {NS}><sheetData>{out}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        for i, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", part)


def test_workbook(spark, tmp_path):
    written(
        tmp_path / "libro.xlsx",
        {
            "NO_TOCAR": [["id"], ["P9"]],
            "Proveedores": [["Razon Social", "ID", "C.I.F.", "IBAN"], ["ACME", "p1", "B-12345678", "ES00 1"], ["ACME", " P1 ", "B12345678", "ES001"], ["ACME", "P1", "B12345678", "ES002"], [None, None, "x", "y"], ["BETA", "P2", None, None]],
            "Pedidos_2026": [["pedido", "Proveedor", "importe total", "Estado", "fecha_pedido"], ["PO 2026 12", "p1", 10.5, "pendiente", 46023], ["PO-2026-0012", "p2", "1.234,50", "pagada", "02/01/2026"], ["", "p3", 1, "x", None]],
            "Norma_Pagos_v3": [["Uno"], [None], [" Dos "]],
            "pendiente_revisar": [["ver PO-2026-0012 y PO20267"], [None, "PO 2026 0012"]],
        },
    )
    found = workbook.cells(spark, str(tmp_path)).cache()
    assert {r.sheet for r in found.select("sheet").distinct().collect()} == {"Proveedores", "Pedidos_2026", "Norma_Pagos_v3", "pendiente_revisar"}
    kept, again = workbook.suppliers(found)
    assert sorted(tuple(r)[1:] for r in kept.collect()) == [("P1", "ACME", "B12345678", "ES001", "", ""), ("P2", "BETA", "", "", "", "")]
    assert sorted(tuple(r)[1:] for r in again.collect()) == [("P1", 3, "ES001", "ES001", True), ("P1", 4, "ES002", "ES001", False)]
    (order,) = workbook.orders(found).collect()
    assert (order.pedido, order.proveedor_id, order.importe, order.estado, order.fecha) == ("PO-2026-0012", "P2", D("1234.50"), "PAGADA", date(2026, 1, 2))
    first = workbook.orders(found.where("sheet <> 'Pedidos_2026' or row < 3")).first()
    assert (first.importe, first.fecha) == (D("10.5"), date(2026, 1, 1))
    assert {r.pedido for r in workbook.listed_for_review(found).collect()} == {"PO-2026-0012", "PO-2026-0007"}
    assert [r.texto for r in workbook.policy_lines(found).orderBy("row").collect()] == ["Uno", "Dos"]
    assert workbook.suppliers(found.limit(0))[0].count() == 0
