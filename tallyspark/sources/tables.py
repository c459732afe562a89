"""Base tables with declared schemas (S1) and named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that the ledger bindings read, by table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_FAMILIES = ((T.IntegralType,), (T.FractionalType,), (T.TimestampType, T.TimestampNTZType, T.DateType))


def _compatible(found: T.DataType, wanted: T.DataType) -> bool:
    return found == wanted or any(isinstance(found, f) and isinstance(wanted, f) for f in _FAMILIES)


def load(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The declared columns of ``folder``/``name``.parquet.

    A missing column, or one whose type is of another kind (text for a
    number, a date for text), is an error that names all of them; a type of
    the same kind is cast.  Columns beyond the schema are left out.
    """
    wanted = schema if schema is not None else SCHEMAS[name]
    if isinstance(wanted, str):
        wanted = T.StructType.fromDDL(wanted)
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()}"
             for f in wanted.fields if f.name not in have or not _compatible(have[f.name], f.dataType)]
    if wrong:
        raise ValueError(f"table {name}: " + "; ".join(wrong))
    return df.select(*[F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in wanted.fields])


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` readable as ``name`` in the session's SQL (replacing a view of that name); returns ``df``."""
    df.createOrReplaceTempView(name)
    return df
