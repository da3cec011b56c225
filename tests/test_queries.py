import oracle
import pytest

from lodestream.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    oracle.compare(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, oracle.SF_DIR).count() > 0


def test_chained_joins_with_repeated_suppliers_and_dealt_sides(spark, tmp_path, monkeypatch):
    from lodestream.operators import relational as R
    from lodestream.plans import relational

    monkeypatch.setattr(R, "ROWS_A_TASK", 50)
    monkeypatch.setattr(R, "DEALT_FROM", 2)
    spark.createDataFrame([(i, "F" if i % 3 else "O") for i in range(300)] + [(None, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 310, i % 7 if i % 11 else None, float(i % 5)) for i in range(900)] + [(1, 2, None), (None, 1, 1.0)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "d"), (4, None), (None, "n")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("orders", "lineitem", "supplier"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(f"chained_{name}")
    want = spark.sql("""SELECT o_orderkey, l_suppkey, s_name, round(sum(l_quantity), 4) AS qty FROM chained_orders JOIN chained_lineitem ON l_orderkey = o_orderkey
        LEFT JOIN chained_supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
    got = relational.chained_joins(spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(want.collect())
    left, right = R.dealt(spark.range(0, 400, 1, 2), spark.range(0, 600, 1, 2), "id", "id")
    assert (left.rdd.getNumPartitions(), right.rdd.getNumPartitions()) == (21, 21)
    assert R.dealt(spark.range(0, 9, 1, 2), spark.range(0, 9, 1, 2), "id", "id")[0].rdd.getNumPartitions() == 2
