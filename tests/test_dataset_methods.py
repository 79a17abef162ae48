"""Methods of DataFrames that no registered query stands for, over the given tables."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from loomspark.sources.sealed import decrypt_scalar, encrypt_scalar, read_sealed, write_sealed
from loomspark.submit import submit
from loomspark.tables import table

KEY = bytes(range(16))


@pytest.fixture
def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").orderBy("n_nationkey")


def test_actions(nations, capsys, tmp_path):
    assert nations.count() == 25 and nations.first().n_nationkey == 0 and nations.head(2)[1].n_nationkey == 1
    assert [r.n_nationkey for r in nations.take(3)] == [0, 1, 2] and [r.n_nationkey for r in nations.tail(2)] == [23, 24]
    assert sum(r.n_nationkey for r in nations.toLocalIterator()) == 300
    total, rows = nations.sparkSession.sparkContext.accumulator(0), nations.sparkSession.sparkContext.accumulator(0)
    nations.foreach(lambda r: total.add(r.n_nationkey))
    nations.foreachPartition(lambda part: rows.add(sum(1 for _ in part)))
    assert (total.value, rows.value) == (300, 25)
    nations.show(1)
    assert "n_nationkey" in capsys.readouterr().out
    summary = {r.summary: r.n_nationkey for r in nations.describe("n_nationkey").collect()}
    assert (summary["count"], summary["max"]) == ("25", "24")
    assert {r.summary for r in nations.summary("min", "50%").collect()} == {"min", "50%"}
    assert nations.rdd.map(lambda r: r.n_nationkey).reduce(lambda a, b: a + b) == 300
    nations.write.parquet(str(tmp_path / "n"))
    assert nations.sparkSession.read.parquet(str(tmp_path / "n")).count() == 25


def test_properties(nations, capsys):
    assert nations.dtypes[0] == ("n_nationkey", "int") and not nations.isEmpty() and not nations.isStreaming and not nations.isLocal()
    assert len(nations.inputFiles()) == 1 and nations.sameSemantics(nations) and nations.semanticHash() == nations.semanticHash()
    nations.printSchema()
    nations.explain("formatted")
    out = capsys.readouterr().out
    assert "n_name: string" in out and "Scan parquet" in out
    held = nations.persist(StorageLevel.MEMORY_AND_DISK)
    assert held.storageLevel.useMemory and held.unpersist() is held and not held.storageLevel.useMemory


def test_views(nations, spark):
    nations.createOrReplaceGlobalTempView("g_nations")
    assert spark.sql("SELECT count(*) FROM global_temp.g_nations").first()[0] == 25
    spark.catalog.dropGlobalTempView("g_nations")
    nations.createGlobalTempView("g_nations")
    nations.createTempView("t_nations")
    assert spark.table("t_nations").count() == 25
    spark.catalog.dropTempView("t_nations")
    spark.catalog.dropGlobalTempView("g_nations")


def test_transformations(nations):
    assert nations.toDF("a", "b", "c").columns == ["a", "b", "c"] and nations.select(nations.colRegex("`n_n.*`")).columns == ["n_nationkey", "n_name"]
    assert nations.selectExpr("n_nationkey * 2 AS k").agg(F.sum("k")).first()[0] == 600
    assert nations.transform(lambda d: d.where("n_nationkey < 5")).count() == 5 and nations.sort(nations["n_nationkey"].desc()).first().n_nationkey == 24
    assert nations.repartition(3).rdd.getNumPartitions() == 3 and nations.repartition(3).coalesce(1).rdd.getNumPartitions() == 1
    assert json.loads(nations.toJSON().first())["n_nationkey"] == 0
    gaps = nations.select(F.when(F.col("n_nationkey") > 2, F.col("n_nationkey")).alias("k"))
    assert gaps.na.drop().count() == 22 and gaps.na.fill(7).where("k = 7").count() == 4 and gaps.na.replace(24, 5).where("k = 5").count() == 2
    assert nations.stat.corr("n_nationkey", "n_nationkey") == pytest.approx(1.0) and nations.stat.approxQuantile("n_nationkey", [0.5], 0.0) == [12.0]
    seen = nations.observe("seen", F.count(F.lit(1)).alias("rows"))
    assert seen.count() == 25
    assert nations.rdd.flatMap(lambda r: [r.n_regionkey] * 2).count() == 50 and nations.rdd.mapPartitions(lambda p: [len(list(p))]).sum() == 25
    pairs = nations.alias("a").join(nations.alias("b"), F.col("a.n_nationkey") == F.col("b.n_nationkey")).select(F.struct("a.*").alias("_1"), F.struct("b.*").alias("_2"))
    assert pairs.where("_1.n_name = _2.n_name").count() == 25  # as joinWith gives them
    assert nations.rdd.groupBy(lambda r: r.n_regionkey).mapValues(len).count() == 5


def test_sealed_types(spark, tmp_path):
    """One column of each type, a row of values and a row of nulls."""
    made = spark.sql("""SELECT true AS a, cast(-7 AS tinyint) AS b, cast(300 AS smallint) AS c, 70000 AS d, 9007199254740993 AS e, cast(1.5 AS float) AS f,
      cast('NaN' AS double) AS g, cast('-Infinity' AS double) AS h, cast(12345678901234567890.123456789012345678 AS decimal(38,18)) AS i, 'é"\\n' AS j, X'00FF' AS k, date'2020-02-29' AS l,
      timestamp'2020-01-01 00:00:00.123456' AS m, timestamp_ntz'2020-01-01 00:00:00.123456' AS n, array(1, NULL) AS o, array(array(1), array()) AS p,
      map('x', 1) AS q, map(1, 'y', 2, NULL) AS r, named_struct('s', 1, 't', array('u')) AS s""")
    both = made.union(made.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema]))
    write_sealed(both, str(tmp_path / "t"), KEY)
    got = read_sealed(spark, str(tmp_path / "t"), KEY)
    assert got.dtypes == both.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, both.collect()))
    with pytest.raises(ValueError):
        write_sealed(spark.sql("SELECT array(map(1, 2)) AS x"), str(tmp_path / "u"), KEY)


def test_scalars_and_submission(spark):
    for value, kind in ((12, "int"), ("a b", "string"), (Decimal("1.50"), "decimal(5,2)"), (True, "boolean")):
        assert decrypt_scalar(spark, encrypt_scalar(spark, value, KEY), kind, KEY) == value
    assert not submit(spark, "SELECT id FROM range(5)", 5).cut and submit(spark, "SELECT id FROM range(6)", 5).cut
    assert submit(spark, "SELECT nothing").status == "error"
