"""Conversation repair against enumeration, a row-by-row rule and its SQL twin, whole and in blocks."""

import itertools
import random
import re

import duckdb
import pytest

from quartzite.llm import conversation_repair as repair
from quartzite.llm.conversation_sql import SQL

SCHEMA = "conv_id long, turn long, role string, text string, block int, state string"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def enumerated(roles, fault):
    """Least (cost, audit) over all edits with up to three inserts at a place."""
    best = None
    gaps = ["", "u", "a", "ua", "au", "uau", "aua"]
    for places in itertools.product(gaps, repeat=len(roles) + 1):
        for edits in itertools.product(*[["D"] if f in (repair.BLANK, repair.DUPLICATE) else ["D", "K", "Ru", "Ra"] for f in fault]):
            shown, audit, cost = places[0], "I" * len(places[0]), 5 * len(places[0])
            for edit, role, f, gap in zip(edits, roles, fault, places[1:], strict=True):
                shown += {"D": "", "K": role[:1] or " ", "Ru": "u", "Ra": "a"}[edit] + gap
                audit += edit[0] + "I" * len(gap)
                cost += COST[edit[0]] + 5 * (f == repair.CUT and edit != "D") + 5 * len(gap)
            if re.fullmatch("(s?(ua)+)?", shown) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_search_is_least(n):
    for roles in itertools.product(["user", "assistant", "system", "", "tool"], repeat=n):
        for fault in itertools.product(range(4), repeat=n):
            initials = [repair.initial(r) for r in roles]
            assert repair.finish(repair.search(initials, list(fault), repair.EMPTY)) == enumerated(roles, fault)


def test_search_of_three():
    rng = random.Random(3)
    for _ in range(12):
        roles, fault = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(3)], [rng.randrange(4) for _ in range(3)]
        assert repair.finish(repair.search([r[0] for r in roles], fault, repair.EMPTY)) == enumerated(roles, fault)


def test_chain_equals_whole_search():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 30)
        initials, fault = [rng.choice("usa ") for _ in range(n)], [rng.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        whole, cuts = repair.finish(repair.search(initials, fault, repair.EMPTY)), [*range(0, n, 4), n]
        tables = [[x for q in range(4) for x in repair.search(initials[a:b], fault[a:b], q)] for a, b in itertools.pairwise(cuts)]
        order = [{x[1]: r for r, x in enumerate(sorted((y for y in t if y), key=lambda y: y[1]))} for t in tables]
        cost, path = repair.chained([[x[0] if x else repair.FAR for x in t] for t in tables], [[o[x[1]] if x else 0 for x in t] for t, o in zip(tables, order, strict=True)])
        assert whole == (cost, "".join(t[4 * q + r][1] for t, (q, r) in zip(tables, path, strict=True)) + repair.TAIL[path[-1][1]])


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(1)
    texts = ["Hello.", "Well?", "no end", " \t\n", "", None, "Yes!", "One.\n", "éàé.", "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), 1, "clash") for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.", 1, None) for c in range(40, 60) for t in range(8)]
    rows += [(None, None, "user", "Null.", None, None), (None, None, "user", "Null.", None, None), (None, 3, "assistant", "Null?", None, None)]
    rows += [(7000, t, rng.choice(roles[:4]), rng.choice([f"Long {t}.", "Again.", "cut"]), 1, "x") for t in range(300) if t % 50]
    rows += [(7001, None, None, None, 1, "x"), (7001, 5, "assistant", "a.", 1, "x"), (7001, 5, "assistant", "a.", 1, "x"), (7001, 5, "user", "b.", 1, "x"), (7001, -2, "user", "c.", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def expected(conversations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conv") / "c.parquet")
    conversations.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return sorted(map(str, con.execute(SQL).fetchall()))


@pytest.mark.parametrize("block_rows", [1, 2, 5, 1024])
def test_blocks_equal_sql(conversations, expected, block_rows):
    got = repair.repair_report(conversations, repair.damaged(conversations), block_rows=block_rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected


def test_repaired_turns(conversations):
    for block_rows in (3, 1024):
        damaged = repair.damaged(conversations)
        audits = {r.conv_id: r for r in repair.audits(damaged, block_rows).collect()}
        rows = sorted(repair.repaired(damaged, block_rows).collect(), key=lambda r: (str(r.conv_id), r.block, r.seq))
        for conv, group in itertools.groupby(rows, key=lambda r: r.conv_id):
            turns = list(group)
            assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns))
            assert "".join(r.edit for r in turns) == audits[conv].audit.replace("D", "")
            kept = [r.turn for r in turns if r.turn is not None]
            assert kept == sorted(kept)


def test_queries_twin(spark, sf_dir):
    from quartzite.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = queries.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL).fetchall())


def test_empty(conversations):
    none = conversations.limit(0)
    assert repair.repair_report(none, repair.damaged(none)).count() == 0
    assert repair.repaired(repair.damaged(none)).count() == 0
    report = repair.repair_report(conversations, repair.damaged(none)).collect()
    assert {(r.gaps, r.cost, r.audit, r.repaired_sha256[:8]) for r in report} == {(0, 0, "", "e3b0c442")}
