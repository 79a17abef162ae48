"""Tables encrypted at rest, and encrypted literals, by AES-GCM in the JVM.

A sealed table is Parquet of one binary column (each row's JSON under AES-GCM with a random nonce) in ``<path>/data``
and the schema in ``<path>/schema``. Encryption is at rest only: while a query runs, the cluster sees plain rows, and
the key is a literal of the plan, so plans and event logs must be protected like the key.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from loomspark.catalogue import Catalogue, Tables
from loomspark.scratch import scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: Exact to the microsecond, with and without a zone.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def key_from_file(path: str) -> bytes:
    """A key of 16, 24 or 32 bytes."""
    key = Path(path).read_bytes()
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return key


def _plain_map(kind: DataType) -> bool:
    """Whether JSON can hold the type's maps: their keys are strings."""
    if isinstance(kind, MapType):
        return isinstance(kind.keyType, StringType) and _plain_map(kind.valueType)
    if isinstance(kind, ArrayType):
        return _plain_map(kind.elementType)
    return not isinstance(kind, StructType) or all(_plain_map(f.dataType) for f in kind)


def _entries(kind: DataType) -> ArrayType | None:
    """For a column whose type is a map with other keys, the array of entries that stands for it."""
    if _plain_map(kind):
        return None
    if isinstance(kind, MapType) and _plain_map(kind.keyType) and _plain_map(kind.valueType):
        return ArrayType(StructType([StructField("key", kind.keyType, False), StructField("value", kind.valueType)]))
    raise ValueError(f"a map whose keys aren't strings can't be sealed inside {kind.simpleString()}")


def seal(df: DataFrame, key: bytes, name: str = "payload") -> DataFrame:
    """One binary column: each row encrypted. A map column with keys that aren't strings goes as its entries."""
    cell = lambda f: F.map_entries(F.col(f"`{f.name}`")).alias(f.name) if _entries(f.dataType) else F.col(f"`{f.name}`")
    row = F.to_json(F.struct(*map(cell, df.schema)), FORMATS)
    return df.select(F.aes_encrypt(row, F.lit(key), F.lit("GCM")).alias(name))


def unseal(df: DataFrame, schema: StructType, key: bytes, name: str = "payload") -> DataFrame:
    text = F.aes_decrypt(F.col(name), F.lit(key), F.lit("GCM")).cast("string")
    held = StructType([StructField(f.name, _entries(f.dataType) or f.dataType) for f in schema])
    row = df.select(F.from_json(text, held, FORMATS).alias("row"))
    return row.select(*[(F.map_from_entries(F.col("row")[f.name]) if _entries(f.dataType) else F.col("row")[f.name]).alias(f.name) for f in schema])


def write_sealed(df: DataFrame, path: str, key: bytes, mode: str = "errorifexists") -> None:
    """Save ``df`` encrypted; ``mode`` as in DataFrameWriter."""
    seal(df, key).write.mode(mode).parquet(f"{path}/data")
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
    schema.coalesce(1).write.mode("overwrite" if mode in ("overwrite", "append") else mode).text(f"{path}/schema")


def read_sealed(spark: SparkSession, path: str, key: bytes, schema: StructType | None = None) -> DataFrame:
    """The table under ``path``, by its own schema or the given one (of which absent columns are null)."""
    if schema is None:
        schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return unseal(spark.read.parquet(f"{path}/data"), schema, key)


def create_sealed_view(spark: SparkSession, view: str, path: str, key: bytes, schema: StructType | str | None = None) -> None:
    """A temporary view of a sealed table, for SQL."""
    read_sealed(spark, path, key, schema).createOrReplaceTempView(view)


def encrypt_scalar(spark: SparkSession, value: object, key: bytes) -> str:
    """A value as base64 ciphertext, to stand in a query in its place."""
    cell = F.lit(value).cast("string").cast("binary")
    return spark.range(1).select(F.base64(F.aes_encrypt(cell, F.lit(key), F.lit("GCM")))).first()[0]


def decrypt(cipher: Column, kind: str, key: bytes) -> Column:
    """The value of type ``kind`` in a base64 ciphertext."""
    return F.aes_decrypt(F.unbase64(cipher), F.lit(key), F.lit("GCM")).cast("string").cast(kind)


def encrypted(df: DataFrame, key: bytes) -> DataFrame:
    """The table after a round trip through ciphertext: rows equal ``df``'s, read as one sealed and opened."""
    return unseal(seal(df, key), df.schema, key)


def decrypt_scalar(spark: SparkSession, cipher: str, kind: str, key: bytes) -> object:
    """The value of type ``kind`` in a base64 ciphertext (see ``encrypt_scalar``), on the driver."""
    return spark.range(1).select(decrypt(F.lit(cipher), kind, key)).first()[0]


_KEY = bytes(range(32))  # for the registered queries only


def _sealed(t: Tables, df: DataFrame) -> DataFrame:
    path = scratch(t.spark, "sealed")
    write_sealed(df, path, _KEY)
    return read_sealed(t.spark, path, _KEY)


@query("SELECT * FROM customer")
def sealed_roundtrip(t: Tables) -> DataFrame:
    return _sealed(t, t.customer)


@query("SELECT event_id, ts, value FROM events")
def sealed_timestamps(t: Tables) -> DataFrame:
    return _sealed(t, t.events.select("event_id", "ts", "value"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def sealed_filter_agg(t: Tables) -> DataFrame:
    opened = _sealed(t, t.orders)
    return opened.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def sealed_cached_agg(t: Tables) -> DataFrame:
    """Over a sealed table that is cached as ciphertext, so no plain rows are kept."""
    path = scratch(t.spark, "sealed")
    write_sealed(t.customer, path, _KEY)
    held = t.spark.read.parquet(f"{path}/data").cache()
    opened = unseal(held, t.customer.schema, _KEY)
    return opened.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def sealed_sql_view(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sealed")
    write_sealed(t.supplier, path, _KEY)
    create_sealed_view(t.spark, "sealed_supplier", path, _KEY, "s_suppkey long, s_nationkey int")
    return t.spark.sql("SELECT s_nationkey, count(*) AS n FROM sealed_supplier GROUP BY s_nationkey")


@query("SELECT n_name FROM nation WHERE n_nationkey > 12")
def encrypted_literal_filter(t: Tables) -> DataFrame:
    cipher = encrypt_scalar(t.spark, 12, _KEY)
    return t.nation.where(F.col("n_nationkey") > decrypt(F.lit(cipher), "int", _KEY)).select("n_name")


@query("SELECT r_regionkey, r_name FROM region")
def encrypt_in_plan(t: Tables) -> DataFrame:
    return encrypted(t.region, _KEY)
