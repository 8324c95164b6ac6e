"""Row-level access: roles, permissions and the accounts that a user may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ROLES
from .maintenance import sent_if_few

# Names of permissions.
GLOBAL_PERMISSIONS = ["system:access", "system:root", "user:manage", "user:view", "token:manage", "account:create", "account:manage:all", "data:read:all", "data:raw:download:all", "data:delete:all", "data:manage:all", "data:export:batch:all"]
ACCOUNT_PERMISSIONS = ["account:manage", "account:read_details", "data:manage", "data:read", "data:raw:download", "data:delete", "data:export:batch", "data:import:batch"]
# The built-in roles.
ROLE_IDS = {"admin": 100_000_000_000_000, "manager": 100_100_000_000_000, "member": 100_200_000_000_000, "account_manager": 200_100_000_000_000, "account_viewer": 200_200_000_000_000}
ROLE_PERMISSIONS = {
    "admin": [p for p in GLOBAL_PERMISSIONS if p != "system:access"],
    "manager": ["user:view", "account:create"],
    "member": ["system:access"],
    "account_manager": ACCOUNT_PERMISSIONS,
    "account_viewer": ["account:read_details", "data:read"],
}
# Account permission -> the global one that includes it, and the account one that does.
IMPLIED_BY_GLOBAL = {"data:read": "data:read:all", "data:delete": "data:delete:all", "data:raw:download": "data:raw:download:all", "data:export:batch": "data:export:batch:all", "account:manage": "account:manage:all", "account:read_details": "account:manage:all"}
IMPLIED_BY_ACCOUNT = {"data:read": "account:manage", "account:read_details": "account:manage"}


def builtin_roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ROLE_IDS[r], r, "account" if r.startswith("account") else "global", sorted(ROLE_PERMISSIONS[r])) for r in ROLE_IDS], ROLES)


def grants(users: DataFrame) -> DataFrame:
    """(user_id, account_id, role_id); a global role has no account."""
    glob = users.select(F.col("id").alias("user_id"), F.lit(None).cast("bigint").alias("account_id"), F.explode("global_roles").alias("role_id"))
    return glob.unionByName(users.select(F.col("id").alias("user_id"), F.explode("account_access_map").alias("account_id", "role_id")))


def permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, account_id or null, permission), each once."""
    r = roles.select(F.col("id").alias("role_id"), F.explode("permissions").alias("permission"))
    return grants(users).join(r, "role_id").select("user_id", "account_id", "permission").distinct()


def allowed(asked: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """asked (user_id, account_id, permission) with a boolean column allowed."""
    have = permissions(users, roles)
    implied = asked.sparkSession.createDataFrame(
        [(p, p, True) for p in GLOBAL_PERMISSIONS + ACCOUNT_PERMISSIONS] + [(p, p, False) for p in ACCOUNT_PERMISSIONS] + [(p, "system:root", True) for p in GLOBAL_PERMISSIONS + ACCOUNT_PERMISSIONS] + [(p, g, True) for p, g in IMPLIED_BY_GLOBAL.items()] + [(p, a, False) for p, a in IMPLIED_BY_ACCOUNT.items()],
        "permission string, enough string, is_global boolean",
    ).distinct()
    wanted = asked.distinct().join(F.broadcast(implied), "permission")
    h = have.select("user_id", F.col("account_id").alias("on_account"), F.col("permission").alias("enough"))
    hit = wanted.join(h, ["user_id", "enough"]).where("(is_global and on_account is null) or (not is_global and on_account = account_id)")
    hit = hit.select("user_id", "account_id", "permission").distinct().withColumn("hit", F.lit(True)).alias("h")
    a = asked.alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("user_id", "account_id", "permission")]
    return a.join(hit, same[0] & same[1] & same[2], "left").select("a.user_id", "a.account_id", "a.permission", F.coalesce("hit", F.lit(False)).alias("allowed"))


def read_scope(users: DataFrame, roles: DataFrame, all_permission: str = "data:read:all") -> DataFrame:
    """(user_id, account_id, everything): the accounts on which each user has any role, and for those with the global
    permission one row without an account, which stands for all of them."""
    wide = permissions(users, roles).where(F.col("account_id").isNull() & F.col("permission").isin(all_permission, "system:root")).select("user_id").distinct()
    wide = wide.select("user_id", F.lit(None).cast("bigint").alias("account_id"), F.lit(True).alias("everything"))
    return wide.unionByName(grants(users).where("account_id is not null").select("user_id", "account_id", F.lit(False).alias("everything")).distinct())


def scoped(rows: DataFrame, scope: DataFrame, user_id: int) -> DataFrame:
    """The rows of accounts that a user may read: all of them without a join, or a semi join, which opens the folders of
    those accounts only where rows lie by account."""
    mine = scope.where(F.col("user_id") == user_id)
    if mine.where("everything").limit(1).count():
        return rows
    return rows.join(sent_if_few(mine.where("not everything").select("account_id").distinct()), "account_id", "left_semi")


def scope_size(scope: DataFrame, accounts: DataFrame, user_id: int) -> DataFrame:
    """n: how many accounts a user may read."""
    return scoped(accounts.withColumn("account_id", F.col("id")), scope, user_id).agg(F.count("*").alias("n"))


def wrong_permissions(roles: DataFrame) -> DataFrame:
    """(role_id, permission) that the kind of the role may not hold."""
    catalogue = roles.sparkSession.createDataFrame([("global", p) for p in GLOBAL_PERMISSIONS] + [("account", p) for p in ACCOUNT_PERMISSIONS], "kind string, permission string")
    return roles.select(F.col("id").alias("role_id"), "kind", F.explode("permissions").alias("permission")).join(F.broadcast(catalogue), ["kind", "permission"], "left_anti").select("role_id", "permission")


def summaries(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Names of roles and permissions of each user; roles that are gone are unknown."""
    r = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name"), "permissions")
    held = grants(users).join(r, "role_id", "left").withColumn("role_name", F.coalesce("role_name", F.lit("Unknown Role")))
    glob = held.where("account_id is null").groupBy("user_id").agg(F.array_sort(F.collect_set("role_name")).alias("global_roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("permissions")))).alias("global_permissions"))
    own = held.where("account_id is not null").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("account_id", "role_name"))).alias("account_roles"))
    return users.select(F.col("id").alias("user_id"), "username").join(glob, "user_id", "left").join(own, "user_id", "left")
