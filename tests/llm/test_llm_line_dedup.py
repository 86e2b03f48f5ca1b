import random

import edge_cases

from paperloom.llm import line_dedup


def brute_force(rows, least=line_dedup.LEAST_CHARS):
    seen, kept = {}, {}
    for i, text in rows:
        out = []
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                near = line in seen or len(line) >= least and any(len(y) >= least and edits(line, y) <= 1 for y in seen if abs(len(y) - len(line)) < 2)
                seen[line] = True
                if near:
                    continue
            out.append(line)
        kept[i] = "\n".join(out)
    return kept


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(draw, line):
    at, kind = draw.randrange(len(line) + 1), draw.randrange(3)
    return line[:at] + draw.choice(["", "xé", "é"][kind] or "") + line[at + (kind != 1) :] if kind else line[:at] + line[at + 1 :]


def test_equals_brute_force(spark):
    draw = random.Random(7)
    base = ["".join(draw.choice("ab cé") for _ in range(draw.randrange(1, 40))) for _ in range(40)] + ["", "  "]
    pool = base + [changed(draw, b) for b in base * 4] + [changed(draw, changed(draw, b)) for b in base]
    rows = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randrange(9)))) for k in range(120)]
    found = line_dedup.deduplicated(spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == brute_force(rows)


def test_distance_of_one():
    draw = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randrange(6))) for _ in range(2))
        assert line_dedup.within_one_edit(a, b) == (edits(a, b) <= 1)


def test_edge_cases(spark):
    docs = edge_cases.documents(spark)
    found = line_dedup.deduplicated(docs).collect()
    assert len(found) == len(edge_cases.ROWS)
    texts = {}
    for r in found:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [edge_cases.ROWS[0][1]] and texts[9] == [""] and texts[2] == texts[3] == [""]
    assert texts[5] == [edge_cases.ROWS[7][1]] * 2  # wholly equal rows count as one
    assert texts[8] == [edge_cases.ROWS[11][1]] and texts[7] == [" \n\t "] and texts[6] == [edge_cases.LONG]
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
