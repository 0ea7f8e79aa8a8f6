"""First values, date formats, TIN summaries of one large TIN and corrected association against plain Python."""

import collections
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import date_formats, entity, heads, profile


def test_formats_by_elimination(spark):
    columns = {
        "either": ["1/2/2020", "3/4/2021", None], "us": ["1/2/2020", "1/13/2020"], "eu": ["1/2/2020", "31/1/2020"], "none": ["13/1/2020", "1/13/2020"], "leap": ["2020-02-29", " 2021-1-1 "],
        "bad": ["2021-02-29", "2020-01-01"], "blank": ["", "  "], "word": ["March", "2020-01-01"], "long": ["Jan 5, 2020", "dec 31, 1999"], "time": ["2020-01-01 9:00:00", "2020-01-01 23:59:59"],
    }
    n = max(map(len, columns.values()))
    rows = list(zip(*[[*v, *[None] * (n - len(v))] for v in columns.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    got = {r.feature: r for r in date_formats.date_formats(df).collect()}
    assert {c: got[c].format for c in columns} == {
        "either": "MM/dd/yyyy", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "none": None, "leap": "yyyy-MM-dd", "bad": None, "blank": None, "word": None, "long": "MMM dd, yyyy", "time": "yyyy-MM-dd HH:mm:ss",
    }
    assert [c for c in columns if got[c].ambiguous] == ["either"] and got["either"].formats == ["MM/dd/yyyy", "dd/MM/yyyy"] and got["blank"].n == 0
    dated = date_formats.with_dates(df)
    assert dict(dated.dtypes)["eu"] == "date" and dict(dated.dtypes)["none"] == "string"
    assert sorted(r.eu for r in dated.filter("eu is not null").collect()) == [datetime.date(2020, 1, 31), datetime.date(2020, 2, 1)]
    assert sorted(r.leap for r in dated.filter("leap is not null").collect()) == [datetime.date(2020, 2, 29), datetime.date(2021, 1, 1)]
    assert date_formats.date_formats(df.limit(0)).filter("format is not null").count() == 0


def test_first_values_of_many_columns(spark):
    rng = np.random.default_rng(5)
    names = [f"c.{k}" for k in range(200)]
    ids = rng.permutation(900).tolist()
    rows = [(i, *[None if (i * 31 + k) % (k % 9 + 2) else f"{i}-{k}" for k in range(200)]) for i in ids]
    df = spark.createDataFrame(rows, "rid long, " + ", ".join(f"`{n}` string" for n in names)).repartition(7)
    got = collections.defaultdict(list)
    for r in heads.first_values(df, 12).orderBy("feature", "place").collect():
        got[r.feature].append((r.place, r.rid, r.value))
    for k, name in enumerate(names):
        known = sorted((r[0], r[k + 1]) for r in rows if r[k + 1] is not None)[:12]
        assert got[name] == [(p, i, v) for p, (i, v) in enumerate(known, 1)]
    assert heads.first_values(df.limit(0), 3).count() == 0
    plan = heads.first_values(df, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hash") == 1


def test_known_dates_by_their_heads(spark):
    rows = [(i, 44000.5 + i if i > 3 else None, 44000 if i > 250 else i, "44000", 44000.0) for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, open_date double, closed_date int, `Fraud.Opened Date` string, other double")
    assert heads.serial_in_head(df) == ["open_date"]
    out = heads.known_dates(df)
    assert dict(out.dtypes) == {"rid": "bigint", "open_date": "date", "closed_date": "int", "Fraud.Opened Date": "string", "other": "double"}
    assert out.filter("rid = 4").first().open_date == datetime.date(1899, 12, 30) + datetime.timedelta(44004)
    assert heads.known_dates(df.drop("open_date", "closed_date")).columns == ["rid", "Fraud.Opened Date", "other"]


def test_load_without_types(spark, sf_dir):
    from quartzite.plans.entities import applications

    raw = applications(spark, sf_dir).withColumn("open_date", F.datediff("open_date", F.lit("1899-12-30").cast("date"))).withColumn("closed", F.lit("2020-01-01 10:00:00").cast("timestamp"))
    got = entity.load_and_tag(raw, classify=False)
    assert dict(got.dtypes)["open_date"] == "date" and got.filter("closed <> timestamp'2020-01-01 00:00:00'").count() == 0
    want = entity.load_and_tag(applications(spark, sf_dir), classify=False)
    count = lambda df: sorted(map(tuple, df.groupBy("duplicate_tag").count().collect()))
    assert count(got) == count(want)


def test_summary_of_a_large_tin(spark):
    """A TIN with a third of the rows: its values stay spread, each task sends five of a kind at most."""
    rng = np.random.default_rng(7)
    rows = [("1" if i % 3 == 0 else str(2 + i % 50), i, f"m{rng.integers(400)}", rng.choice(["", *(f"name {k}" for k in range(60))]), f"s{rng.integers(9)}" if i % 4 else None, f"c{rng.integers(30)}", "B" if i % 5 else "A", int(i % 7 == 0)) for i in rng.permutation(3000).tolist()]
    rows = [tuple(str(x) if k in (3,) else x for k, x in enumerate(r)) for r in rows] + [(None, 9999, "m", "n", "s", "c", "A", 1)]
    df = spark.createDataFrame(rows, "tin string, rid long, mid string, legal_name string, state string, city string, duplicate_tag string, is_fraud int").repartition(6)
    found = entity.tin_summary(df)
    got = {r.tin: r for r in found.collect()}
    own = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
        own[r[0]].append(r)
    assert set(got) == set(own)
    for tin, mine in own.items():
        first = lambda k, n: ", ".join(list(dict.fromkeys(r[k] for r in mine if r[k]))[:n])  # noqa: E731, B023
        distinct = lambda k: len({r[k] or "" for r in mine})  # noqa: E731, B023
        r = got[tin]
        assert (r.record_count, r.n_mid, r.n_state, r.n_city, r.fraud_count) == (len(mine), distinct(2), distinct(4), distinct(5), sum(x[7] for x in mine))
        assert (r.legal_name, r.state, r.city, r.tags) == (first(3, 3), first(4, 5), first(5, 5), ", ".join(sorted({x[6] for x in mine})))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Exchange hashpartitioning(tin" in plan


@pytest.mark.parametrize("sizes", [(2, 2), (3, 2), (50, 40), (1, 2)])
def test_corrected_association(spark, sizes):
    rng = np.random.default_rng(8)
    a, b = rng.integers(sizes[0], size=800), rng.integers(sizes[1], size=800)
    df = spark.createDataFrame(list(zip(a.tolist(), (b | (a % 2)).tolist(), strict=True)), "a int, b int")
    table = np.zeros((sizes[0], 64))
    np.add.at(table, (a, b | (a % 2)), 1)
    table = table[:, table.any(axis=0)][table.any(axis=1)]
    expected = np.outer(table.sum(1), table.sum(0)) / 800
    gap = abs(table - expected)
    chi2 = ((np.maximum(gap - 0.5, 0) if table.shape == (2, 2) else gap) ** 2 / expected).sum()
    found = profile.cramers_v_corrected(df, "a", "b")
    r = found.first()
    assert r.chi2 == pytest.approx(chi2, abs=1e-6) and (r.n, "collect_list" in found._jdf.queryExecution().executedPlan().toString()) == (800, False)
