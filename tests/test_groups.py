"""Tags and duplicate flags against plain Python, with a group that holds a third of all rows; what a group keeps must not depend on its size."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quartzite.operators import clean, entity

IDENTITY = ("legal_name", "owner_first", "state")
SCHEMA = "rid long, tin string, mid string, legal_name string, owner_first string, state string, postal string, open_date date, is_fraud int"


def rows_of(n: int) -> list[tuple]:
    draw = random.Random(7)
    out = []
    for i in range(n):
        if i % 3 == 0:  # the hot group: the same row again and again
            out.append((i, "111", "222", "ACME", "ANN", "TX", "75201", datetime.date(2020, 1, 1), 0))
        elif i % 3 == 1 and i % 2:  # neither TIN nor MID
            out.append((i, draw.choice([None, ""]), None, draw.choice("AB"), "X", None, "1", draw.choice([None, datetime.date(2021, 1, 1 + i % 9)]), draw.choice([0, None])))
        else:
            out.append((i, str(draw.randrange(9)), str(draw.randrange(4)), draw.choice(["A", "B", None]), draw.choice("XY"), draw.choice(["TX", None]), draw.choice(["1", ""]), draw.choice([None, datetime.date(2021, 1, 1 + i % 5)]), draw.choice([0, 0, 0, 1, None])))
    return out


def expected(rows: list[tuple]) -> dict[int, tuple[str, bool]]:
    names = SCHEMA.split()[::2]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    late = lambda r: (r["open_date"] is None, r["open_date"] or datetime.date.min)
    new = lambda r: (r["open_date"] is None, -(r["open_date"] or datetime.date.min).toordinal())

    def groups(key):
        out = {}
        for r in dicts:
            out.setdefault(key(r), []).append(r)
        return out

    whole = groups(lambda r: tuple(r[c] for c in names[1:]))
    pair = groups(lambda r: (r["tin"] or "", r["mid"] or ""))
    ident = groups(lambda r: tuple(r[c] if r[c] is not None else "__NA__" for c in IDENTITY))
    result = {}
    for r in dicts:
        g = ident[tuple(r[c] if r[c] is not None else "__NA__" for c in IDENTITY)]
        fraud = sum(x["is_fraud"] or 0 for x in g)
        bad = min(g, key=lambda x: (x["is_fraud"] is None, -(x["is_fraud"] or 0), *late(x), x["rid"]))["rid"]
        good = min(g, key=lambda x: (*new(x), x["rid"]))["rid"]
        first = min(pair[(r["tin"] or "", r["mid"] or "")], key=lambda x: (*late(x), x["rid"]))["rid"] == r["rid"]
        if r["rid"] != min(x["rid"] for x in whole[tuple(r[c] for c in names[1:])]):
            tag = entity.TAGS[0]
        elif fraud and r["rid"] != bad:
            tag = entity.TAGS[1]
        elif r["tin"] and r["mid"] and not first:
            tag = entity.TAGS[2]
        elif not (r["tin"] and r["legal_name"] and r["postal"]):
            tag = entity.TAGS[3]
        elif not fraud and r["rid"] != good:
            tag = entity.TAGS[4]
        else:
            tag = entity.TAGS[5]
        result[r["rid"]] = (tag, first)
    return result


@pytest.mark.parametrize("dates", ["date", "timestamp", "string"])
def test_tags_equal_plain_python(spark, dates):
    rows = rows_of(600)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("open_date", F.col("open_date").cast(dates)).repartition(5)
    got = {r.rid: (r.duplicate_tag, r.is_first_of_group) for r in entity.tagged(df, identity=IDENTITY).collect()}
    assert got == expected(rows)
    assert len({tag for tag, _ in got.values()}) >= 5


def test_few_identity_columns_make_no_groups(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA)
    tags = {r.duplicate_tag for r in entity.tagged(df, identity=("legal_name", "state")).collect()}
    assert not tags & {"IDENTITY_GROUP_FRAUD", "IDENTITY_GROUP_CLEAN"}
    assert entity.tagged(df.limit(0)).count() == 0


def test_tags_need_no_window(spark):
    plan = entity.tagged(spark.createDataFrame(rows_of(9), SCHEMA))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_duplicate_flag(spark):
    keys = [("hot", "1")] * 200 + [("", "1")] * 200 + [(None, "2"), ("one", "1"), ("two", "1"), ("two", "2"), ("pair", "3"), ("pair", "3")]
    df = spark.createDataFrame([(i, a, b, "old") for i, (a, b) in enumerate(keys)], "i int, a string, b string, dup string").repartition(4)
    out = clean.duplicate_flag(df, [F.col("a"), F.col("b")], "dup")
    assert out.columns == ["i", "a", "b", "dup"]
    got = {r.i: r.dup for r in out.collect()}
    assert got == {i: "Yes" if a and keys.count((a, b)) > 1 else "No" for i, (a, b) in enumerate(keys)}
