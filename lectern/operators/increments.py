"""What is new since the last run: manifests of published items, archives and files already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What names an item.
KEY = ["slug", "date", "title"]


def unpublished(items: DataFrame, manifest: DataFrame) -> DataFrame:
    return items.join(manifest.select(*KEY), KEY, "left_anti")


def recorded(manifest: DataFrame, attempted: DataFrame, ok_col: str = "ok") -> DataFrame:
    """The manifest with the items that succeeded, once each."""
    return manifest.select(*KEY).union(attempted.where(F.col(ok_col)).select(*KEY)).distinct()


def first_of_category(items: DataFrame, n: int, order: list[str]) -> DataFrame:
    """At most n items of each slug, in the given order."""
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(*order))
    return items.withColumn("rank", rank).where(F.col("rank") <= n)


def title_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def pack_name(date: Column, title: Column, suffix: str = ".pack") -> Column:
    """day-YYYYMMDD-title; suffix: what the reader of the archives expects."""
    return F.concat(F.lit("day-"), F.regexp_replace(F.substring(date, 1, 10), "-", ""), F.lit("-"), title_slug(title), F.lit(suffix))


def archive_target(member: Column) -> Column:
    """A member's path without its first part.  Parts that lead out of the target folder are dropped."""
    safe = F.array_join(F.filter(F.split(member, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    return F.regexp_replace(safe, "^[^/]+/", "")


def to_extract(members: DataFrame, existing: DataFrame, suffix: str = ".pack") -> DataFrame:
    """members(member, file_size) of a kind that aren't there with equal size, as (member, rel_path, file_size)."""
    wanted = members.where(F.col("member").endswith(suffix)).withColumn("rel_path", archive_target(F.col("member")))
    there = existing.select("rel_path", F.col("size").alias("file_size"))
    return wanted.join(there, ["rel_path", "file_size"], "left_anti").select("member", "rel_path", "file_size")


def list_releases(releases: DataFrame, limit: int = 5) -> DataFrame:
    """The newest releases: tag, day, number of assets."""
    newest = releases.orderBy(F.col("created_at").desc(), "tag_name").limit(limit)
    return newest.select("tag_name", F.substring("created_at", 1, 10).alias("day"), F.size("assets").alias("n_assets"))


def release(releases: DataFrame, tag: str | None = None) -> DataFrame:
    """The release with a tag, or the newest."""
    return releases.where(F.col("tag_name") == tag) if tag else releases.orderBy(F.col("created_at").desc(), "tag_name").limit(1)


def zip_assets(releases: DataFrame) -> DataFrame:
    """(tag_name, name, size_kb) of archives among the assets."""
    rows = releases.select("tag_name", F.explode("assets").alias("asset")).where(F.col("asset.name").endswith(".zip"))
    return rows.select("tag_name", F.col("asset.name").alias("name"), (F.col("asset.size") / 1024).alias("size_kb"))
