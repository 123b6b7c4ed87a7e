"""Every catalogue query against its SQL on DuckDB."""

import math
import os

import pytest

from tarnfield.plans.catalog import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


def test_nothing_imports_the_training_data_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/tarnfield"):
        if f"{os.sep}llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{n}").read(), n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_codec_choice_has_the_whole_majority(spark, sf_dir):
    rows = QUERIES["codec_window_choice"](spark, sf_dir).collect()
    n = {c: sum(r.codec == c for r in rows) for c in {r.codec for r in rows}}
    top = max(n, key=lambda c: (n[c], c))
    assert {(r.majority, r.majority_n, r.majority_share, r.coalesce) for r in rows} == {(top, n[top], n[top] / len(rows), n[top] / len(rows) >= 0.9)}


def test_key_codes_of_up_to_four_letters(spark):
    import itertools
    import string

    from pyspark.sql import functions as F

    from tarnfield.functions import values as V

    places = [0, 25, 26, 701, 702, 703, 18277, 18278, 18279, 100_000, 475_253]
    want = {}
    codes = ("".join(t) for k in range(1, 5) for t in itertools.product(string.ascii_lowercase, repeat=k))
    for i, code in enumerate(codes):
        if i in places:
            want[i] = code
    df = spark.createDataFrame([(i,) for i in places], "n long")
    assert {r.n: r.code for r in df.select("n", V.base26(F.col("n")).alias("code")).collect()} == want
