"""Declared schemas (S1), named views (S2), report titles."""

import pytest

from tallyspark.sources.sinks import display_names
from tallyspark.sources.tables import SCHEMAS, load, register


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_schema_fits_the_data(spark, name):
    df = load(spark, "/root/testdata/sf0.001", name)
    assert df.columns == [c.split()[0] for c in SCHEMAS[name].split(", ")]


def test_wrong_tables_are_named(spark, tmp_path):
    spark.sql("select 'x' as n_nationkey, 'a' as n_name").write.parquet(f"{tmp_path}/nation.parquet")
    with pytest.raises(ValueError, match="n_nationkey: string, not int; n_regionkey: missing, not int"):
        load(spark, str(tmp_path), "nation")


def test_same_kind_is_cast_and_extra_columns_left_out(spark, tmp_path):
    spark.sql("select 3L as r_regionkey, 'a' as r_name, 1 as extra").write.parquet(f"{tmp_path}/region.parquet")
    df = load(spark, str(tmp_path), "region")
    assert dict(df.dtypes) == {"r_regionkey": "int", "r_name": "string"}
    assert [tuple(r) for r in df.collect()] == [(3, "a")]


def test_register_replaces_a_view(spark):
    register(spark.range(3), "tallyspark_view")
    register(spark.range(5), "tallyspark_view")
    assert spark.sql("select count(*) from tallyspark_view").first()[0] == 5


def test_display_names(spark):
    df = spark.sql("select 1 as fiscal_period, 2 as act_budname")
    assert display_names(df, {"act_budname": "Budget Name"}).columns == ["Fiscal Period", "Budget Name"]
    with pytest.raises(ValueError):
        display_names(df, {"act_budname": "Fiscal Period"})
