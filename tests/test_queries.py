"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their columns."""

import math
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from groundwork.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_near_dup_pairs_are_among_all_documents(spark, tmp_path):
    """Near documents of other sources and lengths, without a source, without a text; white space as in the SQL."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(2, 7)))
    base = [", ".join(word() for _ in range(rnd.choice([3, 12, 20, 60]))) for _ in range(40)]
    texts = [t for b in base for t in (b, b + " " + word(), b[3:].replace(",", rnd.choice([",", "\x0b", " ", "\r"]), 2), "yes, " + b * 2)]
    texts += [None, None, "", " \n", "a", "a ", "\x0b", "12" * 60, "12" * 600]
    docs = pa.table({"doc_id": range(len(texts)), "text": texts, "source": [rnd.choice(["x", "y", None]) for _ in texts], "n_chars": [None if t is None else len(t) for t in texts]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    want = con.execute(plans.SQL["near_dup_pairs"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    got = plans.QUERIES["near_dup_pairs"](spark, str(tmp_path))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want)
    n, last = docs["n_chars"].to_pylist(), len(texts) - 1
    assert (last - 1, last) in want and sum(n[a] is not None and n[a] // 100 != n[b] // 100 for a, b in want) > 20


def test_interval_union_months_of_odd_orders(spark, tmp_path):
    """Orders without a key, customer or date, and keys below zero, as in the SQL on one thread, where equal intervals keep one order."""
    rnd = random.Random(6)
    day = lambda: f"{rnd.randrange(1995, 2000)}-{rnd.randrange(1, 13):02d}-03"
    values = [f"({rnd.choice(['null', rnd.randrange(-40, 40)])}, {rnd.choice(['null', 1, 2, 3, *range(4, 40)])}, {rnd.choice(['null', repr(day()), repr(day())])})" for _ in range(150)]
    values += ["(1, 100, null)", "(null, 101, '1995-01-03')", "(-5, 102, '1996-01-03')", "(6, 102, '1996-01-03')"]
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"copy (select k::bigint as o_orderkey, c::bigint as o_custkey, d::timestamp as o_orderdate from (values {', '.join(values)}) t(k, c, d)) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    want = con.execute(plans.SQL["interval_union_months"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    got = plans.QUERIES["interval_union_months"](spark, str(tmp_path))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want)
    assert {(100, None, 1), (101, None, 1), (102, -3, 1)} <= set(want)
