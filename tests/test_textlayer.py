"""Text layers against plain readings of their boxes."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from ledgermill.operators import textlayer

SCHEMA = f"file_id string, pagina int, texto string, cajas {textlayer.BOXES}, ink double"


def plain_order(boxes):
    items = sorted(enumerate(boxes), key=lambda b: -(b[1][4] + b[1][2]) / 2)
    lines = []
    for at, b in items:
        mid, h = (b[4] + b[2]) / 2, max(b[4] - b[2], 0.1)
        if lines:
            cur = lines[-1]
            mean = sum((x[4] + x[2]) / 2 for _, x in cur) / len(cur)
            if abs(mid - mean) <= 0.6 * max(h, max(max(x[4] - x[2], 0.1) for _, x in cur)):
                cur.append((at, b))
                continue
        lines.append([(at, b)])
    return [at for line in lines for at, _ in sorted(line, key=lambda b: b[1][1])]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_reading_order_and_displaced(spark):
    rng = random.Random(4)
    pages = []
    for i in range(60):
        n = rng.randrange(0, 9)
        boxes = []
        for j in range(n):
            left, bottom = rng.choice([0.0, 50.0, 90.0]) + j / 10, rng.choice([10.0, 13.0, 16.0, 40.0, 47.0, 80.0]) + j / 100
            boxes.append((f"w{j}", left, bottom, left + 20, bottom + rng.choice([0.0, 8.0, 10.0, 14.0])))
        pages.append((f"f{i}", 1, "", boxes, 0.1))
    df = textlayer.in_reading_order(spark.createDataFrame(pages, SCHEMA), "cajas")
    got = {r.file_id: (r.at, r.d) for r in df.select("file_id", F.transform("leidas", lambda b: b["at"]).alias("at")).withColumn("d", textlayer.displaced(F.col("at"))).collect()}
    for name, _, _, boxes, _ in pages:
        order = plain_order(boxes)
        assert got[name][0] == order, name
        best = max(len(c) for k in range(len(order) + 1) for c in combinations(order, k) if list(c) == sorted(c))
        assert got[name][1] == (round(1 - best / len(order), 4) if order else 0.0)


def test_flags_and_report(spark):
    line = lambda text, y, x=0.0: (text, x, float(y), x + 100, y + 10.0)
    long = ["una linea de texto que basta", "otra linea con otras palabras", "y la tercera del documento"]
    good = [line(t, 90 - 20 * i) for i, t in enumerate(long)]
    rows = [
        ("limpio", 1, "\n".join(long), good, 0.02),
        ("girado", 1, "\n".join(reversed(long)), good[::-1], 0.02),
        ("girado", 2, None, None, None),
        ("fantasma", 1, "\n".join(long), good, 0.0),
        ("roto", 1, "\ufffd\ue000\x07 " + "\n".join(long), good, 0.02),
        ("foto", 1, "", [], 0.3),
        ("nada", 1, None, None, None),
        ("espacios", 1, " \t\r\n ", None, 0.3),
    ]
    measures = textlayer.page_measures(spark.createDataFrame(rows, SCHEMA))
    flags = textlayer.document_flags(measures)
    got = {r.file_id: r for r in flags.collect()}
    assert {k: v.flags for k, v in got.items()} == {"limpio": [], "girado": ["desorden"], "fantasma": ["fantasma"], "roto": ["basura"], "foto": ["escaneo"], "nada": [], "espacios": ["escaneo"]}
    turned = measures.where("file_id = 'girado' and pagina = 1").first()
    assert turned.order_content == 0.0 and turned.order_cer == round(edits("".join(reversed(long)).replace(" ", ""), "".join(long).replace(" ", "")) / 70, 4) and turned.displaced == 0.6667
    assert (got["girado"].pages, got["roto"].weird, got["nada"].chars) == (2, 3, 0)
    report = {r.name: r.value for r in textlayer.layer_report(flags, {"p0": 0.0, "p100": 1.0}).collect()}
    assert report == {"documentos": 7.0, "con_capa": 4.0, "sin_capa": 3.0, "basura": 1.0, "desorden": 1.0, "fantasma": 1.0, "escaneo": 2.0, "ink_p0": 0.0, "ink_p100": 0.02, "order_cer_p0": 0.0, "order_cer_p100": turned.order_cer}


def test_pages_are_sorted_without_lambdas(spark):
    """A lambda a comparison for every character of a page took most of the time."""
    from ledgermill.operators import textlayer

    pages = spark.createDataFrame([("a", 1, "b a", [("b", 10.0, 0.0, 20.0, 10.0), ("a", 0.0, 0.0, 5.0, 10.0)], 0.1)], f"file_id string, pagina int, texto string, cajas {textlayer.BOXES}, ink double")
    measured = textlayer.page_measures(pages)
    assert "array_sort(" not in measured._jdf.queryExecution().optimizedPlan().toString().replace("sort_array(", "")
    assert [tuple(r)[2:] for r in measured.collect()] == [(2, 0, 1.0, 0.0, 0.5, 0.1)]
