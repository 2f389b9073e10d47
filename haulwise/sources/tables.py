"""Source tables with checked schemas, paging, change detection and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampNTZType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_I, _L, _D, _S, _T = IntegerType(), LongType(), DoubleType(), StringType(), TimestampNTZType()

SCHEMAS = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D,
                      o_orderdate=_T, o_orderpriority=_S),
    "lineitem": _schema(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I,
                        l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D,
                        l_returnflag=_S, l_linestatus=_S, l_shipdate=_T),
    "events": _schema(event_id=_L, ts=_T, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "embeddings": _schema(vec_id=_L, embedding=ArrayType(FloatType()), label=_I),
    "pages": _schema(page_id=_L, url=_S, html=_S),
    "benchmark": _schema(item_id=_L, text=_S),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one source table under its declared schema; no inference pass."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted(SCHEMAS)}")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_fixture(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv",
                 header: bool = True) -> DataFrame:
    """CSV or JSON-lines scenario file; bad lines are kept in ``_corrupt``."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    reader = (spark.read.schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt"))
    if fmt == "csv":
        return reader.option("header", str(header).lower()).csv(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unsupported fixture format {fmt!r}")


def changed_since(frames: dict[str, tuple[DataFrame, str, str, str]], last_run) -> DataFrame:
    """Rows touched after the last successful run, as (table_name, row_id, operation).

    ``frames`` maps a table name to (frame, id column, created column, updated
    column). A row created after ``last_run`` is an insert, otherwise an update.
    The date filter sits directly on the scan, so it is pushed down.
    """
    out = None
    for name, (df, key, created, updated) in frames.items():
        part = df.filter((F.col(updated) > last_run) | (F.col(created) > last_run)).select(
            F.lit(name).alias("table_name"),
            F.col(key).cast("bigint").alias("row_id"),
            F.when(F.col(created) > last_run, "insert").otherwise("update").alias("operation"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def row_digest(df: DataFrame) -> Column:
    """Digest of a whole row; a null differs from any value and from a null elsewhere."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def snapshot_changes(frames: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Inserts, updates and deletes between two states of tables, as (table_name, row_id, operation).

    ``frames`` maps a table name to (before, after, id column). Both states are reduced to digests and meet in one
    shuffle by id; of several rows with one id the smallest digest stands.
    """
    out = None
    for name, states in frames.items():
        *both, key = states
        for side, df in enumerate(both):
            digest = row_digest(df)
            part = df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_id"),
                             *[(digest if i == side else F.lit(None).cast("string")).alias(c) for i, c in enumerate(("old", "new"))])
            out = part if out is None else out.unionByName(part)
    met = out.groupBy("table_name", "row_id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
    operation = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return met.select("table_name", "row_id", operation.alias("operation")).filter(F.col("operation").isNotNull())


def page(df: DataFrame, order: list[Column], page_no: int, page_size: int = 20) -> DataFrame:
    """One page of rows with ``page``, ``page_size`` and ``total`` columns.

    Sort + offset + limit is planned as a bounded top-k, not a global window.
    """
    if page_no < 1 or not 1 <= page_size <= 1000:
        raise ValueError("page starts at 1 and page_size is between 1 and 1000")
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)
        .select("*", F.lit(page_no).alias("page"), F.lit(page_size).alias("page_size"),
                total.alias("total"))
    )
