"""Rules that annotations must keep, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "rule string, fact string, low double, high double, allowed array<string>"


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """rules: (rule, fact, low, high, allowed). A null bound is none; `allowed` lists texts, or is null."""
    return spark.createDataFrame(rules, RULES)


def annotation_facts(crops: DataFrame, voxels: DataFrame) -> DataFrame:
    """Facts of each of crops(crop_id, z, y, x, height, width, dtype), by their annotated voxels(crop_id, z, dy, dx, value).

    height, width, top, left, bottom and right of all its slices, the largest value, the number of slices with an annotation,
    and dtype. A crop without voxels has 0 for the last two. Both tables are summed once by crop.
    """
    box = crops.groupBy("crop_id").agg(
        F.min("height").alias("height"), F.min("width").alias("width"), F.min("y").alias("top"), F.min("x").alias("left"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("dtype").alias("dtype")
    )
    drawn = voxels.groupBy("crop_id").agg(F.max("value").alias("value"), F.count_distinct(F.when(F.col("value") != 0, F.col("z"))).alias("annotated"))
    return box.join(drawn, "crop_id", "left").na.fill(0, ["value", "annotated"])


def violations(facts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, value) of each fact that breaks a rule: out of its bounds, not in its list, or null.

    Facts become rows (key, fact, value) in one pass and meet the rules by their names; a fact that no rule names goes before the join.
    Rules on facts that the table hasn't are an error.
    """
    names = [c for c in facts.columns if c != key]
    asked = [r["fact"] for r in rules.select("fact").distinct().limit(len(names) + 1).collect()]
    if missing := sorted(set(asked) - set(names)):
        raise ValueError(f"rules on unknown facts: {missing}")
    if not asked:
        return facts.where("false").select(key, F.lit("").alias("rule"), F.lit("").alias("value"))
    long = facts.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("string").alias("value")) for c in sorted(asked)])).alias("f")).select(key, "f.*")
    number = F.col("value").try_cast("double")
    bounded = F.col("low").isNotNull() | F.col("high").isNotNull()
    kept = ~bounded | F.coalesce((number >= F.coalesce("low", number)) & (number <= F.coalesce("high", number)), F.lit(False))
    listed = F.col("allowed").isNull() | F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))
    return long.join(rules, "fact").where(~(kept & listed)).select(key, "rule", "value")
