"""Volumes as tables, derived from the driver's tables by integer arithmetic; SQL holds the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT = ["volume_id", "z", "y", "x"]


class Views:
    """Lazily read views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def vox(self) -> DataFrame:
        """Intensity: a slice has 25 rows of 64 values."""
        rows = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
        i = F.floor((F.col("v").cast("double") + F.lit(1.0)) * 128).cast("int")
        return rows.select(F.lit("v0").alias("volume_id"), F.expr("int(vec_id div 25)").alias("z"), F.expr("int(vec_id % 25)").alias("y"), "x", i.alias("i"))

    def _block(self) -> F.Column:
        return F.expr("1 + (z div 5) * 40 + (y div 5) * 8 + (x div 8)").cast("int")

    def lab(self) -> DataFrame:
        """Labels, foreground only."""
        return self.vox().where("i >= 128").select(*AT, self._block().alias("label"))

    def msk_a(self) -> DataFrame:
        on = F.expr("b % 3 <> 0 AND (x + 2*y + 3*z) % 16 < (CASE WHEN b % 7 = 0 THEN 6 ELSE 12 END)")
        return self.vox().withColumn("b", self._block()).select(*AT, F.when(on, 255).otherwise(2).alias("value"))

    def msk_b(self) -> DataFrame:
        on = F.expr("b % 5 < 2 AND (7*z + 3*y + x) % 11 < 8")
        return self.vox().withColumn("b", self._block()).select(*AT, F.when(on, 255).otherwise(2).alias("value"))

    def masks(self) -> DataFrame:
        return self.msk_a().withColumn("class_name", F.lit("a")).unionByName(self.msk_b().withColumn("class_name", F.lit("b")))

    def rlab(self) -> DataFrame:
        """A second labelling."""
        label = F.expr("1 + (z div 4) * 35 + (y div 5) * 7 + (x div 10)").cast("int")
        return self.vox().where("i % 5 <> 0").select(*AT, label.alias("label"))

    def seeds(self) -> DataFrame:
        return self.vox().where("i >= 160").select(*AT)

    def vmeta(self) -> DataFrame:
        return self.vox().groupBy("volume_id").agg((F.max("z") + 1).alias("size_z"), F.lit(25).alias("size_y"), F.lit(64).alias("size_x"), F.lit(1.0).alias("vz"), F.lit(0.5).alias("vy"), F.lit(0.5).alias("vx"))

    def obs(self) -> DataFrame:
        """Cells of events: a user's day is a cell, the event type a class or marker."""
        cell = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
        return self.table("events").select(cell.alias("cell_id"), F.col("event_type").alias("class_name"), "value", "event_id")

    def feat(self) -> DataFrame:
        row = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return self.table("lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("image"), row.alias("row_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("class"))

    def crops(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("crop_id"), (k % 20).cast("int").alias("z"), (F.col("o_custkey") % 21).cast("int").alias("y"), (F.col("o_custkey") % 57).cast("int").alias("x"), (2 + k % 7).cast("int").alias("height"), (3 + k % 11).cast("int").alias("width")
        )

    def runs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("epoch"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("val_loss"), (F.col("l_discount") * 10).alias("f_score"))


#: The same views for the oracle; a query's own SQL follows "WITH " + SQL + ", ...".
SQL = """
vox AS (SELECT 'v0' AS volume_id, CAST(vec_id // 25 AS INT) AS z, CAST(vec_id % 25 AS INT) AS y, CAST(k - 1 AS INT) AS x,
  CAST(floor((CAST(embedding[k] AS DOUBLE) + 1.0) * 128) AS INT) AS i, CAST(1 + (vec_id // 125) * 40 + ((vec_id % 25) // 5) * 8 + (k - 1) // 8 AS INT) AS b
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)),
lab AS (SELECT volume_id, z, y, x, b AS label FROM vox WHERE i >= 128),
msk_a AS (SELECT volume_id, z, y, x, CASE WHEN b % 3 <> 0 AND (x + 2*y + 3*z) % 16 < (CASE WHEN b % 7 = 0 THEN 6 ELSE 12 END) THEN 255 ELSE 2 END AS value FROM vox),
msk_b AS (SELECT volume_id, z, y, x, CASE WHEN b % 5 < 2 AND (7*z + 3*y + x) % 11 < 8 THEN 255 ELSE 2 END AS value FROM vox),
masks AS (SELECT *, 'a' AS class_name FROM msk_a UNION ALL SELECT *, 'b' AS class_name FROM msk_b),
rlab AS (SELECT volume_id, z, y, x, CAST(1 + (z // 4) * 35 + (y // 5) * 7 + x // 10 AS INT) AS label FROM vox WHERE i % 5 <> 0),
seeds AS (SELECT volume_id, z, y, x FROM vox WHERE i >= 160),
obs AS (SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS cell_id, event_type AS class_name, value, event_id FROM events),
feat AS (SELECT CAST(l_suppkey % 10 AS INT) AS image, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_returnflag = 'R' AS INT) AS class FROM lineitem),
crops AS (SELECT o_orderkey AS crop_id, CAST(o_orderkey % 20 AS INT) AS z, CAST(o_custkey % 21 AS INT) AS y, CAST(o_custkey % 57 AS INT) AS x, CAST(2 + o_orderkey % 7 AS INT) AS height, CAST(3 + o_orderkey % 11 AS INT) AS width FROM orders),
runs AS (SELECT l_suppkey AS run, l_orderkey AS epoch, l_partkey AS part, l_extendedprice AS val_loss, l_discount * 10 AS f_score FROM lineitem)
"""
