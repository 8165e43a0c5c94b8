"""The point table, and views of the supplied tables as clouds.

A cloud is a DataFrame with ord (the record's number, unique and semantic: ties and labels
go by it), x, y, z (double) and classification; operators carry any other columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = (
    "entity_id int, chunk_id int, ord bigint, ox double, oy double, oz double, x float, y float, z float, "
    "red smallint, green smallint, blue smallint, classification smallint, treeid int, normal_code int"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each embedding as a point, its label as the class."""
    axis = [F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), *axis, F.col("label").cast("int").alias("classification"))


def cloud_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points without an order: quantity, price and discount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_linenumber").cast("int").alias("classification")
    )


def cloud_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: user, number within a cycle of 24, and value; the user's group is the entity."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), (F.col("user_id") % 20).cast("int").alias("entity_id"), F.col("user_id").cast("double").alias("x"), (F.col("event_id") % 24).cast("double").alias("y"), F.col("value").alias("z"),
        F.when(F.col("event_type") == "click", 4).when(F.col("event_type") == "view", 5).otherwise(2).alias("classification"),
    )


def finite(*names: str) -> Column:
    """All of them finite: NaN compares greater than all numbers, so a plain comparison does not drop it."""
    out = F.lit(True)
    for n in names:
        out = out & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def display(df: DataFrame, base: tuple[float, float, float]) -> DataFrame:
    """Display coordinates: the original ones less the base point, as float; non-finite points go."""
    shifted = [(F.col(f"o{n}") - F.lit(b)).cast("float").alias(n) for n, b in zip("xyz", base, strict=True)]
    return df.where(finite("ox", "oy", "oz")).select("*", *shifted)


def base_point(bbox: DataFrame) -> tuple[float, float, float]:
    """The centre of the first cloud's box (one row)."""
    r = bbox.first()
    return tuple((r[f"min_{n}"] + r[f"max_{n}"]) / 2 for n in "xyz")
