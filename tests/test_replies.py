"""Reply parsing against a plain reading of the same rules."""

import json
import random

from pyspark.sql import functions as F

from paperloom.functions.lists import parse_list, sorted_combination
from paperloom.functions.replies import MATERIAL_REPLY, METHOD_REPLY, reply_columns

FENCE = "`" * 3
GOOD = '{"material_categories": ["A", "B"], "confidence": "high", "primary_category": "A"}'
DEFAULT = (["Other Materials"], "low", "Other Materials")


def parse(spark, replies, fmt):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = df.select("i", *reply_columns(F.col("reply"), fmt)).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_material_goldens(spark):
    goldens = {
        GOOD: (["A", "B"], "high", "A"),
        f"{FENCE}json\n{GOOD}\n{FENCE}": (["A", "B"], "high", "A"),
        f"{FENCE}\n{GOOD}\n{FENCE}": (["A", "B"], "high", "A"),
        f"{FENCE}json{GOOD}": (["A", "B"], "high", "A"),
        f" \n {GOOD}　": (["A", "B"], "high", "A"),
        f"Sure! {FENCE}json\n{GOOD}\n{FENCE}": DEFAULT,
        f"{GOOD} done": DEFAULT,
        GOOD[:-1]: DEFAULT,
        GOOD + GOOD: DEFAULT,
        f"{GOOD}, {GOOD}": DEFAULT,
        f"{GOOD}] {{}}": DEFAULT,
        f"{GOOD},": DEFAULT,
        GOOD.replace('"', "'"): DEFAULT,
        "null": DEFAULT, "5": DEFAULT, '"text"': DEFAULT, "[1]": DEFAULT, "": DEFAULT, "]": DEFAULT,
        '["A"]': DEFAULT, "\ufeff" + GOOD: DEFAULT, GOOD.replace("A", "A\n"): DEFAULT,
        "{}": ([], "low", "Other Materials"),
        '{"material_categories": ["A"]}': (["A"], "low", "Other Materials"),
        '{"confidence": "high"}': ([], "high", "Other Materials"),
        '{"material_categories": null, "confidence": null, "primary_category": null}': (None, None, None),
        '{"material_categories": "A", "confidence": "high"}': (None, "high", "Other Materials"),
        '{"confidence": "low", "confidence": "high"}': ([], "high", "Other Materials"),
        '{"extra": {"deep": [1, {"x": null}]}, "primary_category": "A"}': ([], "low", "A"),
        '{"primary_category": "a\\u00e9\\n"}': ([], "low", "aé\n"),
    }
    replies = [*goldens, None]
    for reply, got, want in zip(replies, parse(spark, replies, MATERIAL_REPLY), [*goldens.values(), DEFAULT]):
        assert got == want, reply


def test_method_defaults(spark):
    got = parse(spark, ["not json", "{}", '{"specific_models": ["BERT", "BERT"], "primary_category": "X"}'], METHOD_REPLY)
    assert got == [
        ("Other/Unspecified", [], [], "low"),
        ("Other/Unspecified", [], [], "low"),
        ("X", ["BERT", "BERT"], [], "low"),
    ]


def plain_list(value):
    """Anything but a list counts as no list."""
    return value if isinstance(value, list) else None


def plain_text(value):
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def plain_reading(reply):
    text = reply.strip()
    if text.startswith(FENCE):
        text = text.split(FENCE)[1].removeprefix("json").strip()
    try:
        record = json.loads(text)
    except ValueError:
        return DEFAULT
    if not isinstance(record, dict):
        return DEFAULT
    items = plain_list(record.get("material_categories", []))
    if items is not None:
        items = [plain_text(v) for v in items]
    return items, plain_text(record.get("confidence", "low")), plain_text(record.get("primary_category", "Other Materials"))


def damaged(rng, samples, marks):
    text = rng.choice(samples)
    for _ in range(rng.randint(0, 3)):
        text = text or "x"
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice(marks) + text[at:], text[:at] + text[at] + text[at:]])
    return text or "x"


def test_damaged_replies(spark):
    """Characters removed, doubled or put in at random places."""
    rng = random.Random(11)
    samples = [
        GOOD, f"{FENCE}json\n{GOOD}\n{FENCE}", '{"material_categories": [], "confidence": "low"}',
        '{"material_categories": ["A", {"x": [1, null]}, null, 2], "other": {"y": "z"}, "confidence": true}',
    ]
    replies = [damaged(rng, samples, '{}[],:"\'`\n\\x') for _ in range(6000)]
    for reply, got in zip(replies, parse(spark, replies, MATERIAL_REPLY)):
        assert got == plain_reading(reply), reply


def test_damaged_lists(spark):
    rng = random.Random(5)
    samples = ['["A", "B"]', '["A", {"x": [1, null]}, null, 2]', "[]", '["a\\n", ["b"]]']
    cells = [damaged(rng, samples, '{}[],:"\'\nx') for _ in range(6000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = df.select("i", parse_list(F.col("c")).alias("v")).orderBy("i").collect()
    for cell, row in zip(cells, rows):
        try:
            want = plain_list(json.loads(cell))
        except ValueError:
            want = None
        assert row.v == (None if want is None else [plain_text(v) for v in want]), cell


def test_list_cells(spark):
    cells = ['["A","A"]', "[]", "null", "5", '"s"', '["A"', '["A"] x', '["A"], ["B"]', "['A']", '["A",null]', '{"a":1}', None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", parse_list(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [["A", "A"], [], None, None, None, None, None, None, None, ["A", None], None, None, None]


def test_sorted_combination(spark):
    df = spark.createDataFrame([(0, ["B", "A", "B"]), (1, ["A"]), (2, ["B", None]), (3, None), (4, [])], "i int, v array<string>")
    got = [r.c for r in df.select("i", sorted_combination(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [["A", "B", "B"], None, None, None, None]
