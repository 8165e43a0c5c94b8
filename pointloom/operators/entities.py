"""Entities: merging, splitting, label buckets, numbering, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(points: DataFrame, sources: list[int], target: int) -> DataFrame:
    """The points of two or more entities as one, in the order of the sources; normals go.

    Repeated sources count once; a source without points, or fewer than two, is an error.
    """
    order = list(dict.fromkeys(sources))
    if len(order) < 2:
        raise ValueError("merge takes two or more entities")
    there = points.where(F.col("entity_id").isin(order))
    counts = {r["entity_id"]: (r["n"], r["top"]) for r in there.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("ord").alias("top")).collect()}  # one row for each source
    if set(counts) != set(order):
        raise ValueError("an entity has no points")
    base, at = F.lit(None).cast("long"), 0
    for e in order:
        base = F.when(F.col("entity_id") == e, at).otherwise(base)
        at += counts[e][1] + 1
    out = there.withColumns({"ord": F.col("ord") + base, "entity_id": F.lit(target)})
    return out.withColumn("normal_code", F.lit(32768)) if "normal_code" in out.columns else out


def split(points: DataFrame, part: Column, names: tuple[str, str] = (".filtered", ".removed")) -> DataFrame:
    """points with product: the first name where part holds, else the second."""
    return points.withColumn("product", F.when(F.coalesce(part, F.lit(False)), names[0]).otherwise(names[1]))


def split_many(points: DataFrame, parts: DataFrame) -> DataFrame:
    """points with label by (ord, label); rows of no part go, and empty parts have no rows."""
    return points.join(parts.select("ord", "label"), "ord")


def buckets(points: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """points with bucket: their label if it is kept (label), else 0, the noise."""
    own = labels.join(kept.select("label", F.lit(True).alias("__kept")), "label", "left")
    bucket = F.when(F.col("__kept") & (F.col("label") > 0), F.col("label")).otherwise(0)
    return points.join(own.select("ord", bucket.alias("bucket")), "ord", "left").withColumn("bucket", F.coalesce("bucket", F.lit(0)))


def residual(points: DataFrame, products: DataFrame) -> DataFrame:
    """The source less all its products."""
    return points.join(products.select("ord"), "ord", "left_anti")


def container_labels(points: DataFrame, groups: DataFrame) -> DataFrame:
    """The points of a container's members, with entity_id kept so that labels can be dealt back."""
    members = groups.select("group_id", F.explode("entity_ids").alias("entity_id"))
    return points.join(members, "entity_id")


def guard(df: DataFrame, most: int, what: str) -> DataFrame:
    """Refuse more than so many products."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: change the parameters")
    return df


def delete_entities(points: DataFrame, ids: list[int]) -> DataFrame:
    return points.where(~F.col("entity_id").isin(ids))


def delete_container(entities: DataFrame, groups: DataFrame, group_id: int) -> DataFrame:
    """Entities that are no members of the container."""
    gone = groups.where(F.col("group_id") == group_id).select(F.explode("entity_ids").alias("entity_id"))
    return entities.join(gone, "entity_id", "left_anti")


def delete_project(entities: DataFrame, project_id: int) -> DataFrame:
    return entities.where(F.col("project_id") != project_id)


def number_products(existing: DataFrame, products: DataFrame) -> DataFrame:
    """Products with label_no: the next free numbers of their container, in order of label."""
    top = existing.groupBy("group_id").agg(F.max("label_no").alias("__top"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("label"))
    return products.join(top, "group_id", "left").withColumn("label_no", F.coalesce("__top", F.lit(0)) + rank).drop("__top")


def move(groups: DataFrame, entity_id: int, target: int) -> DataFrame:
    """The entity leaves its container and becomes the last member of the target."""
    rest = F.array_remove("entity_ids", entity_id)
    return groups.withColumn("entity_ids", F.when(F.col("group_id") == target, F.array_append(rest, F.lit(entity_id))).otherwise(rest))


def attach(entities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Entities with their tree metrics as tree_object; those without keep what they have."""
    told = metrics.select("entity_id", F.struct(*[c for c in metrics.columns if c != "entity_id"]).alias("tree_object"))
    return entities.drop("tree_object").join(told, "entity_id", "left")


def pair(entities: DataFrame, ids: list[int]) -> list:
    """Exactly two different loaded entities, in the order of selection."""
    if len(ids) != 2 or ids[0] == ids[1]:
        raise ValueError("select two different entities")
    found = {r["entity_id"]: r for r in entities.where(F.col("entity_id").isin(ids)).collect()}  # two rows
    if len(found) != 2:
        raise ValueError("both entities must be loaded")
    return [found[k] for k in ids]


def merged_name(lead: Column, numbers: Column, new: Column) -> Column:
    """A merged product's name: Tree or Cluster and the new number, else the lead's own; the sources' numbers in brackets."""
    family = F.regexp_extract(lead, r"^(Tree|Cluster)\b", 1)
    base = F.when(family != "", F.concat(family, F.lit(" "), new.cast("string"))).otherwise(lead)
    return F.when(F.size(numbers) > 0, F.concat(base, F.lit(" ("), F.array_join(F.transform(numbers, lambda k: k.cast("string")), "+"), F.lit(")"))).otherwise(base)
