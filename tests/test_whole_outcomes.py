"""The outcome queries over all rows of outcomes: their SQL without its row filters."""

import pytest

from compare import connect, differences
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"
CUTS = {"winsorize": " where order_id % 10 = 0", "underpricing_outcome": " where line = 1"}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_all_rows(spark, name):
    whole = registry.oracle_sql()[name].replace(CUTS[name], "")
    assert differences(registry.queries()[name](spark, SF), connect(SF), whole) is None


def test_mann_whitney_takes_every_offer(spark, tmp_path):
    spark.createDataFrame([(i, 600.0 + 100 * i, i, "b", "k") for i in range(10)], "p_partkey long, p_retailprice double, p_size int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame([(i, i % 10, 1, 1.0, 500.0 + 37 * (i % 11), 0.0) for i in range(40)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    lines.selectExpr("*", "timestamp'2024-01-01' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["mann_whitney"](spark, str(tmp_path)).first()
    assert (got.n1, got.n0) == (16, 24)
