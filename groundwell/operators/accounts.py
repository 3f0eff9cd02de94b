"""Accounts and history as table rewrites.

Each statement of an account store becomes a plan over whole tables: new state in, new state out.
Text timestamps sort in time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import epoch_millis, iso_millis, normalise_email, valid_email
from ..schemas import CITATIONS

PAGE_LIMITS = (1, 100)  # fixed value: page sizes outside are brought inside


def register(users: DataFrame, signups: DataFrame) -> DataFrame:
    """Users after sign-ups (id, email, created_at). An address registers once: the first wins."""
    asked = signups.withColumn("email", normalise_email(F.col("email"))).where(valid_email(F.col("email")))
    first = asked.groupBy("email").agg(F.min(F.struct("created_at", "id")).alias("_s"))
    fresh = first.join(users.select("email"), "email", "left_anti").select(
        F.col("_s.id").alias("id"), "email", F.col("_s.created_at").alias("created_at"),
        F.lit(None).cast("string").alias("verified_at"), F.lit(None).cast("string").alias("password_changed_at"),
    )
    return users.select(*fresh.columns).unionByName(fresh)


def first_verified(users: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Users with verified_at set by their first confirmation (user_id, at); a set one stays."""
    first = confirmations.groupBy(F.col("user_id").alias("id")).agg(F.min("at").alias("_at"))
    return users.join(first, "id", "left").withColumn("verified_at", F.coalesce("verified_at", "_at")).drop("_at")


def latest_password(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with password_changed_at moved to their latest change (user_id, at)."""
    last = changes.groupBy(F.col("user_id").alias("id")).agg(F.max("at").alias("_at"))
    return users.join(last, "id", "left").withColumn(
        "password_changed_at", F.greatest("password_changed_at", "_at")
    ).drop("_at")


def users_by_age(users: DataFrame) -> DataFrame:
    return users.orderBy("created_at", "id")


def delete_users(users: DataFrame, turns: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and turns without the doomed (id) and everything they own."""
    return (
        users.join(doomed.select("id"), "id", "left_anti"),
        turns.join(doomed.select(F.col("id").alias("user_id")), "user_id", "left_anti"),
    )


def valid_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions (user_id, issued_at_ms, ...) of known users, not issued before a password change."""
    known = users.select(
        F.col("id").alias("user_id"), epoch_millis(F.col("password_changed_at")).alias("_changed")
    )
    return (
        sessions.join(known, "user_id")
        .where(F.col("_changed").isNull() | (F.col("issued_at_ms") >= F.col("_changed")))
        .drop("_changed")
    )


def newest(turns: DataFrame, keep: int, rank: str = "newest") -> DataFrame:
    """The newest `keep` turns of each user with their place; all of them for keep <= 0.

    Each task drops what cannot be among the newest before the shuffle, so a user holding a large
    share of all turns costs `keep` rows per task.
    """
    window = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    placed = turns.withColumn(rank, F.row_number().over(window))
    return placed.where(F.col(rank) <= keep) if keep > 0 else placed


def prune(turns: DataFrame, keep: int) -> DataFrame:
    return newest(turns, keep).drop("newest") if keep > 0 else turns


def history_page(turns: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """One page per user, newest first: turns before the user's cursor (user_id, before) if given.

    A cursor is the created_at of the last row of the page before; rows sharing that very instant
    are skipped, as in the keyset rule.
    """
    limit = max(PAGE_LIMITS[0], min(limit, PAGE_LIMITS[1]))
    if cursors is not None:
        turns = turns.join(cursors.select("user_id", "before"), "user_id").where(
            F.col("created_at") < F.col("before")
        ).drop("before")
    return newest(turns, limit, "place")


def next_cursors(page: DataFrame, limit: int) -> DataFrame:
    """user_id, before: the cursor after a full page; users at their end have none."""
    return page.where(F.col("place") == limit).select("user_id", F.col("created_at").alias("before"))


def scoped(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Turns asked for by (user_id, id); an id alone is not enough."""
    return turns.join(wanted.select("user_id", "id"), ["user_id", "id"], "left_semi")


def delete_turns(turns: DataFrame, doomed: DataFrame) -> DataFrame:
    return turns.join(doomed.select("user_id", "id"), ["user_id", "id"], "left_anti")


def clear_history(turns: DataFrame, owners: DataFrame) -> DataFrame:
    return turns.join(owners.select("user_id"), "user_id", "left_anti")


def read_citations(stored: Column) -> Column:
    """Stored citation text as an array; text that cannot be read gives an empty one."""
    listed = F.when(F.json_array_length(stored).isNotNull(), F.from_json(stored, CITATIONS))
    return F.coalesce(listed, F.array().cast(CITATIONS))


def as_turns(responses: DataFrame) -> DataFrame:
    """History rows of (user_id, qid, query, answer, answered, refusal_reason, top_score, citations, at)."""
    return responses.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("qid").cast("string"), iso_millis(F.col("at"))), 256), 1, 32).alias("id"),
        "user_id", "query", "answer", "answered", "refusal_reason", "top_score",
        F.to_json("citations").alias("citations"), iso_millis(F.col("at")).alias("created_at"),
    )
