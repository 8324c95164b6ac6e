"""Folders: reconciling lists, the tree of names and counts below each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import path_prefixes

_KEY = ["account_id", "name"]


def known(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.join(local.select(*_KEY).distinct(), _KEY, "left_semi")


def new(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.join(local, _KEY, "left_anti")


def gone(remote: DataFrame, local: DataFrame) -> DataFrame:
    return local.join(remote, _KEY, "left_anti")


def selected(remote: DataFrame) -> DataFrame:
    """Folders to read: never those that can't be opened; subscribed ones if an account has any, else the inbox and sent folders; see without_folder()."""
    usable = remote.where(F.lower("flag") != "\\noselect")
    any_subscribed = F.max(F.col("subscribed").cast("int")).over(Window.partitionBy("account_id")) == 1
    plain = (F.lower("name") == "inbox") | (F.lower("flag") == "\\sent")
    return usable.withColumn("chosen", F.when(any_subscribed, F.col("subscribed")).otherwise(plain)).where("chosen").drop("chosen")


def without_folder(remote: DataFrame) -> DataFrame:
    """Accounts (account_id, error) of which no folder fits; a run can't begin for them."""
    return remote.select("account_id").distinct().join(selected(remote), "account_id", "left_anti").withColumn("error", F.lit("no subscribed folder, inbox or sent folder"))


def plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What to do with each folder: rebuild, incremental, load, create, skip or keep."""
    r = remote.select(*_KEY, F.col("uid_validity").alias("remote_validity"), F.col("exists").alias("remote_exists"))
    both = r.withColumn("in_remote", F.lit(True)).join(local.select(*_KEY, F.col("uid_validity").alias("local_validity")).withColumn("in_local", F.lit(True)), _KEY, "full")
    action = (
        F.when(F.col("in_remote").isNull(), "keep")
        .when(F.col("in_local").isNull() & (F.col("remote_exists") > 0), "load")
        .when(F.col("in_local").isNull(), "create")
        .when(F.col("remote_validity").isNull(), "skip")
        .when(F.col("remote_validity").eqNullSafe(F.col("local_validity")), "incremental")
        .otherwise("rebuild")
    )
    return both.select(*_KEY, action.alias("action"))


def tree(paths: DataFrame, delimiter: str = "/") -> DataFrame:
    """Every folder and each missing ancestor, with parent, label and depth. paths: account_id, name."""
    nodes = paths.select("account_id", F.explode(path_prefixes(F.col("name"), delimiter)).alias("path")).distinct()
    parts = F.split("path", f"\\Q{delimiter}\\E")
    return nodes.select("account_id", "path", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), delimiter)).alias("parent"), F.element_at(parts, -1).alias("label"), F.size(parts).cast("bigint").alias("depth"))


def subtree_counts(paths: DataFrame, delimiter: str = "/") -> DataFrame:
    """Messages of each folder with all below. paths: account_id, name, messages."""
    return paths.select("account_id", "messages", F.explode(path_prefixes(F.col("name"), delimiter)).alias("path")).groupBy("account_id", "path").agg(F.sum("messages").alias("messages"))
