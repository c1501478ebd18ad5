"""Anchors against brute force: every token with every window of every line."""

import random
import re
import unicodedata

from ledgermill.operators import anchors as A


def _bare(s):
    return re.sub("[^0-9a-z]", "", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _tokens(field, value):
    if value is None:
        return []
    m = re.match(r"^\s*(\d{4})-(\d\d)-(\d\d)\s*$", value)
    if field == "fecha" and m:
        y, mo, d = m.groups()
        name = A.MONTHS[int(mo) - 1]
        ways = {y + mo + d, d + mo + y, f"{int(d)}{mo}{y}", f"{d}{int(mo)}{y}", f"{int(d)}{int(mo)}{y}", f"{int(d)}de{name}de{y}", f"{d}de{name}de{y}", f"{int(d)}de{name[:3]}de{y}"}
        return sorted(ways)
    return [t for t in [_bare(value)] if len(t) >= A.LEAST]


def _edits(token, line):
    if token in line:
        return 0
    k = 0 if len(token) < A.LEAST_MISREAD else 1 if len(token) < A.TWO_EDITS else 2
    if not k:
        return None
    n = len(token)
    found = [d for w in (n - 1, n, n + 1) for s in range(len(line) - w + 1) if (d := _distance(token, line[s : s + w])) <= k]
    return min(found, default=None)


def brute(values, lines):
    out = set()
    for file, field, value in values:
        best, most = [], 0
        for token in _tokens(field, value):
            hits = []
            for f, page, num, text in sorted(x for x in lines if x[0] == file and x[3] is not None):
                e = _edits(token, _bare(text))
                if e is not None:
                    hint = any(h in _bare(text) for h in A.HINTS.get(field, []))
                    hits.append((file, field, page, num, text, e, A.MISREAD if e else A.WITH_HINT if hint else A.WITHOUT_HINT))
            hits = hits[: A.MOST_HITS]
            if hits and max(h[-1] for h in hits) > most:
                best, most = hits, max(h[-1] for h in hits)
        out |= set(best)
    return out


def test_anchors_equal_brute_force(spark):
    r = random.Random(5)
    values, lines = [], []
    for i in range(60):
        file = f"f{i}"
        v = {"pedido": f"PO-2026-{i:04}", "nif": f"B{i:02}345678", "iban": "ES" + "".join(r.choice("0123456789") for _ in range(22)), "fecha": f"2026-{i % 12 + 1:02}-{i % 28 + 1:02}", "total": r.choice(["1234.56", "12", "999.99"]), "otro": r.choice([None, "", "Ñandú & Cía"])}
        values += [(file, k, x) for k, x in v.items()]
        for num in range(r.randrange(1, 14)):
            k = r.choice(list(v))
            x = v[k] or "nada"
            if k == "fecha" and r.random() < 0.7:
                y, m, d = x.split("-")
                x = r.choice([f"{d}/{m}/{y}", f"{int(d)}/{int(m)}/{y}", f"{int(d)} de {A.MONTHS[int(m) - 1]} de {y}"])
            for _ in range(r.choice([0, 0, 1, 2, 3])):  # misread, lost or added characters
                p = r.randrange(max(len(x), 1))
                x = x[:p] + r.choice(["", "7", "x", x[p : p + 1] + "O"]) + x[p + 1 :]
            lines.append((file, num // 5, num, r.choice(["", k + ": ", "ref. "]) + x + r.choice(["", " €", " " + (v["pedido"])])))
    lines += [("f1", 9, 0, None), ("f2", 9, 0, ""), ("zz", 0, 0, "PO-2026-0001")]
    values += [("yy", "pedido", "PO-2026-0001"), ("f1", "pedido", "PO-2026-0001")]  # one twice
    df = spark.createDataFrame(lines, "file_id string, pagina int, num int, texto string")
    got = {tuple(x) for x in A.anchors(spark.createDataFrame(values, "file_id string, campo string, valor string"), df).collect()}
    assert got == brute(values, lines) and len({x[5] for x in got}) == 3 and len({x[6] for x in got}) == 3
    assert A.anchors(spark.createDataFrame(values, "file_id string, campo string, valor string"), df.limit(0)).count() == 0


def test_lines_are_not_cut_up_for_the_join(spark):
    """Pieces of all lines, shuffled by document and piece, filled the disk: tokens meet lines by document, and what follows stays where it is."""
    values = spark.createDataFrame([("f1", "pedido", "PO-2026-0001")], "file_id string, campo string, valor string").hint("merge")
    lines = spark.createDataFrame([("f1", 0, 0, "PO-2026-0001")], "file_id string, pagina int, num int, texto string")
    plan = A.anchors(values, lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3
