"""Scores of readings against plain Python."""

import difflib
import random
import re

from ledgermill.operators import reports


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _fields(t):
    up = (t or "").upper()
    money = {f"{float(m.replace('.', '').replace(',', '.')):.2f}" for m in re.findall(r"\d{1,3}(?:\.\d{3})+,\d\d|\d+,\d\d", t or "")}
    return {"nif": set(re.findall(r"\b(?:[0-9]{8}[A-Z]|[A-Z][0-9]{7}[0-9A-Z])\b", up)), "iban": {re.sub(" ", "", x) for x in re.findall(r"\bES[0-9]{2}(?: ?[0-9]{4}){5}\b", up)}, "fechas": set(re.findall(r"\b\d\d/\d\d/\d{4}\b", up)), "importes": {m for m in money if 1 <= float(m) <= 1e7}}


def _score(pages):
    norm = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    chars = cer = cers = checked = hits = produced = true = 0
    gone = set()
    for t, g in pages:
        a, b = norm(t), norm(g)
        chars += len(a)
        if a:
            cer += round(_distance(a, b) / len(a), 4) * len(a)
            cers += round(_distance("".join(sorted(a)), "".join(sorted(b))) / len(a), 4) * len(a)
        real, got = _fields(t), _fields(g)
        for n in real:
            if real[n]:
                like = lambda v: any(difflib.SequenceMatcher(None, norm(v), norm(r), autojunk=False).ratio() >= 0.8 for r in real[n])  # noqa: E731, B023
                checked, hits, produced = checked + len(real[n]), hits + len(real[n] & got[n]), produced + len(got[n])
                true += sum(v in real[n] or like(v) for v in got[n])
                gone |= {f"{n}:{v}" for v in real[n] - got[n]}
    r, p = round(hits / checked, 4) if checked else None, round(true / produced, 4) if produced else None
    f1 = None if r is None or p is None else 0.0 if r + p == 0 else round(2 * r * p / (r + p), 4)
    return chars, round(cer / chars, 4) if chars else 0.0, round(cers / chars, 4) if chars else 0.0, checked, produced, r, p, f1, sorted(gone)


def test_scores_equal_plain_python(spark):
    r = random.Random(2)
    bits = ["B46102331", "B4610233I", "12345678Z", "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051333", "05/01/2026", "06/01/2026", "1.234,56", "1.234,57", "77,00", "Ñandú", "total", "x" * 40]
    rows = [(f"f{i % 40}", i, " ".join(r.choice(bits) for _ in range(r.randrange(0, 8))), " ".join(r.choice(bits) for _ in range(r.randrange(0, 8)))) for i in range(120)]
    rows += [("none", 0, None, None), ("blank", 0, "", "B46102331"), ("blind", 0, "B46102331", None), ("wrong", 0, "B46102331", "X9999999Y"), ("long", 0, "abcde " * 1000, "abcd " * 1000)]
    got = {x.file_id: x for x in reports.reading_scores(spark.createDataFrame(rows, "file_id string, page int, truth string, guess string")).collect()}
    for f in {x[0] for x in rows}:
        want = _score([(t, g) for file, _, t, g in rows if file == f])
        x = got[f]
        mine = (x.chars, x.cer, x.cer_sorted, x.checked, x.produced, x.recall, x.precision, x.f1, x.missing)
        near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-4)  # noqa: E731  rounding of halves
        assert all(near(a, b) for a, b in zip(mine, want)), (f, mine, want)


def test_lines_of_one_reader_alone(spark):
    from pyspark.sql import functions as F

    from ledgermill.functions import evaluate

    r = random.Random(9)
    bits = ["Servicio mensual", "460.00", "460,00", "Pedido PO-1", "Pedldo P0-1", "", "  ", "ab", "Gracias", "GRACIAS!", "x" * 30, "Ñandú 7"]
    rows = [(i, *("\n".join(" ".join(r.choice(bits) for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(0, 8))) for _ in range(2))) for i in range(200)] + [(900, None, "a"), (901, "abc", None), (902, "", "")]
    got = {x.i: x.o for x in spark.createDataFrame(rows, "i int, a string, b string").select("i", evaluate.only_in(F.col("a"), F.col("b")).alias("o")).collect()}
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    lines = lambda t: [x.strip() for x in (t or "").splitlines() if x.strip()]
    for i, a, b in rows:
        others, blob = lines(b), norm("".join(lines(b)))
        want = [x for x in lines(a) if all(difflib.SequenceMatcher(None, x, o, autojunk=False).ratio() < 0.6 for o in others) and len(norm(x)) >= 3 and norm(x) not in blob]
        assert got[i] == want, (a, b)


def test_ladder_is_the_same_at_any_partitioning(spark, monkeypatch):
    from ledgermill.operators import ladder, tables

    r = random.Random(4)
    some = lambda x: r.choice([None, x])
    rows = [(f"f{i}", i % 50, "capa", r.random(), r.choice([None, None, "cache"]), some("local"), r.random(), r.choice([None, False, True]), some("nube"), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "file_id string, seq long, capa string, q_capa double, cache string, local string, q_local double, ilegible boolean, nube string, q_nube double")
    left, want = 40, {}
    for f, _, capa, qc, cache, local, ql, bad, nube, qn in sorted(rows, key=lambda x: (x[1], x[0])):
        if qc >= 0.6:
            want[f] = ("capa_texto", capa, "")
        elif cache:
            want[f] = ("cache_ocr", cache, "")
        else:
            q, rung, error = (ql if local else 0.0), "vision_ocr" if local else "degradado", ""
            if not local or q < 0.6 or bad:
                left, paid = left - 1, left > 0
                if paid and nube and qn > q:
                    rung, local = "vision_nube", nube
                else:
                    error = "presupuesto agotado" if not paid else "sin mejora" if nube else "sin respuesta"
            want[f] = (rung, local or "", error)
    monkeypatch.setattr(tables, "RANGE_ROWS", 7)
    for n in (1, 5):
        got = {x.file_id: (x.escalon, x.texto, x.error) for x in ladder.ladder(df.repartition(n), 40).collect()}
        assert got == want
    assert ladder.ladder(df.limit(0), 5).count() == 0 and "vision_nube" not in {x.escalon for x in ladder.ladder(df, 5, paid=False).collect()}


def test_planted_lines_are_like_no_amount(spark, tmp_path):
    """zzz1383912zzz is like a line that has 131839,12 alone, and only_in says so; the query plants lines that only one reader has."""
    import datetime

    import duckdb
    from pyspark.sql import functions as F

    from ledgermill.functions import evaluate
    from ledgermill.plans import catalog, texts

    like = spark.createDataFrame([("zzz1383912zzz", "131839,12"), ("zzz1383912zzz", "mensual 131839,12")], "a string, b string")
    assert [r[0] for r in like.select(evaluate.only_in(F.col("a"), F.col("b"))).collect()] == [[], ["zzz1383912zzz"]]
    day = datetime.datetime(1998, 2, 6)
    spark.createDataFrame([(1383912, 0, "O", 159525.33, day, "5-LOW"), (30, 0, "O", 100.0, day, "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "s", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    for t in ("orders", "supplier"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, texts.exclusive_lines(spark, str(tmp_path)).collect())) == sorted(c.execute(catalog.ORACLES["exclusive_lines"]).fetchall())
