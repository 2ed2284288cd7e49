"""Accounts, sessions and credentials as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

ROLES = ("user", "officer", "clerk", "admin")  # fixed values
MASTER = "admin"
SESSION_DAYS = 7


def point(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return table.where(F.col(key) == F.lit(value))


def upsert_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users after an upsert; an unknown role is an error, created_at stays."""
    role = F.lower(F.trim("role"))
    checked = incoming.withColumn("role", F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), "role"))))
    return store.upsert(users, checked, "user_id", keep_old=("created_at",))


def reconcile_users(snapshot: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """`store.reconcile` of users; the master account is never deleted."""
    return store.reconcile(snapshot, current, "user_id", columns).where(~((F.col("action") == "delete") & (F.col("user_id") == MASTER)))


def reconcile_owned(snapshot: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`store.reconcile` of sessions or credentials: rows without a user are an
    error, whichever side has them first."""
    owned = F.coalesce(F.trim("user_id"), F.lit("")) != ""
    checked = F.when(owned, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no user of "), F.col(key))))
    return store.reconcile(snapshot, current.withColumn(key, checked), key, columns)


def newest(users: DataFrame, n: int) -> DataFrame:
    """The n users created last, those without a date at the end."""
    return users.orderBy(F.desc_nulls_last("created_at"), "user_id").limit(n)


def linked(identities: Column, kind: Column, identifier: Column) -> Column:
    """Identities with one more, unless they have it, case aside."""
    there = F.exists(identities, lambda x: (F.lower(x["type"]) == F.lower(kind)) & (F.lower(x["identifier"]) == F.lower(identifier)))
    one = F.array(F.struct(F.lower(kind).alias("type"), F.lower(F.trim(identifier)).alias("identifier")))
    return F.when(F.coalesce(there, F.lit(False)), identities).otherwise(F.concat(F.coalesce(identities, F.array().cast("array<struct<type: string, identifier: string>>")), one))


def user_of_identity(asked: DataFrame, credentials: DataFrame, users: DataFrame) -> DataFrame:
    """(ask, type, identifier) -> ask, user_id: by credential key, else by the
    identities of users; of several users the first in order of id."""
    plain = lambda kind, name: F.concat_ws(":", F.lower(kind), F.lower(F.trim(name)))
    keys = asked.select("ask", plain(F.col("type"), F.col("identifier")).alias("key"))
    by_credential = credentials.groupBy(F.lower("credential_key").alias("key")).agg(F.min("user_id").alias("by_credential"))
    each = users.select("user_id", F.explode("identities").alias("i"))
    by_identity = each.groupBy(plain(F.col("i.type"), F.col("i.identifier")).alias("key")).agg(F.min("user_id").alias("by_identity"))
    found = keys.join(by_credential, "key", "left").join(by_identity, "key", "left")
    return found.select("ask", F.coalesce("by_credential", "by_identity").alias("user_id"))


def opened(sessions: DataFrame, now: Column, days: int = SESSION_DAYS) -> DataFrame:
    """Sessions with their times: created now, valid for some days."""
    return sessions.withColumns({"created_at": now, "expires_at": now + F.make_dt_interval(F.lit(days))})


def valid(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions before their end; one without a readable end is over."""
    return sessions.where(F.coalesce(now < F.col("expires_at"), F.lit(False)))


def evicted(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(~F.coalesce(now < F.col("expires_at"), F.lit(False)))


def without_accounts(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of deleted accounts; the master account stays.
    tables: name -> (table, its user column); gone: (user_id)."""
    ids = gone.where(F.col("user_id") != MASTER).select(F.col("user_id").alias("gone_id")).distinct()
    return {name: df.join(ids, F.col(c) == F.col("gone_id"), "left_anti") for name, (df, c) in tables.items()}


def reset_owner(records: DataFrame, owner: str, who: Column) -> DataFrame:
    """Records without those of one owner; rows without an owner stay."""
    return records.where(~F.coalesce(F.col(owner) == who, F.lit(False)))
