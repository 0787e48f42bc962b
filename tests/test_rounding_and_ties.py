"""Results that hang on a number's last bit or on which of two equal rows comes first, against the queries' SQL."""

import math

import duckdb
import pytest
from comparing import same_rows

from quarrymill import catalog
from quarrymill.functions.numbers import rounded


def _compare(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    ours, theirs = same_rows(catalog.QUERIES[name](spark, str(folder)), con, catalog.ORACLE_SQL[name], 9)
    assert ours == theirs


def test_rounding_as_in_the_sql(spark):
    numbers = [-1e-9, 1e-9, -0.0, 0.5, -0.0000005, 0.43791249999999995, 0.4379125, -0.4379125, 1e300, -1e305, math.inf, None]
    got = [r.r for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(rounded("x", 6).alias("r")).collect()]
    want = [r[0] for r in duckdb.execute("select round(unnest(?::double[]), 6)", [numbers]).fetchall()]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_index_rows_keep_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(1, [-1e-9, 1e-9, -0.25])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    vector = catalog.QUERIES["index_rows"](spark, str(tmp_path)).first().vector
    assert [repr(x) for x in vector] == ["-0.0", "0.0", "-0.25"]


@pytest.mark.parametrize("first", ["F", "O"])
def test_holder_of_two_rows_as_near_is_the_first(spark, tmp_path, first):
    teams = [first, "O" if first == "F" else "F"]
    con = duckdb.connect()
    con.execute(f"copy (select 1::bigint as l_orderkey, n::int as l_linenumber, t as l_linestatus, 11.0::double as l_quantity, p::double as l_extendedprice from (values (1, '{teams[0]}', 78247.0), (1, '{teams[1]}', 78247.0), (2, 'F', 17531.0), (3, 'O', 17540.0)) v(n, t, p)) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"copy (select 1::bigint as o_orderkey, 78247.0::double as o_totalprice) to '{tmp_path}/orders.parquet'")
    _compare(spark, tmp_path, "ball_holder", "lineitem", "orders")
    _compare(spark, tmp_path, "shape_rules", "lineitem", "orders")


def test_mean_probabilities_add_up_in_the_order_of_the_table(spark, tmp_path):
    rows = "select i as event_id, i % 997 as user_id, ((i * 7919 + i // 997 * 31) % 10000) / 100.0::double as value from range(63808) r(i)"
    duckdb.execute(f"copy ({rows}) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    ours = sorted(tuple(r) for r in catalog.QUERIES["mean_probabilities"](spark, str(tmp_path)).collect())
    assert ours == sorted(con.execute(catalog.ORACLE_SQL["mean_probabilities"]).fetchall())
