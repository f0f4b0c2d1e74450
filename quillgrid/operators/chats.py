"""Chats, users, images and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import live
from .joins import latest_with_ties


def chat_list(chats: DataFrame, user: str) -> DataFrame:
    """A user's chats by their newest row; a chat whose newest row is deleted is not listed."""
    newest = latest_with_ties(chats, "chat_id", "updated_at")
    return newest.filter((F.col("user_id") == user) & live(F.col("is_deleted"))).orderBy(F.col("updated_at").desc(), "chat_id")


def history(messages: DataFrame, chat: str) -> DataFrame:
    return messages.filter((F.col("chat_id") == chat) & live(F.col("is_deleted"))).orderBy("created_at", "message_id")


def latest_turns(conversations: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last turn of each conversation as one aggregate."""
    kept = [c for c in conversations.columns if c != key]
    g = conversations.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_s"))
    return g.select(key, *[F.col(f"_s.{c}").alias(c) for c in kept])


def touch(chats: DataFrame, chat: str, at: Column) -> DataFrame:
    """Chats with one chat's updated_at set, by chat_id."""
    return chats.withColumn("updated_at", F.when(F.col("chat_id") == chat, at).otherwise(F.col("updated_at")))


def active_session(sessions: DataFrame) -> DataFrame:
    """Each user's newest active session."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("session_id"))
    return sessions.filter("is_active").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def revoke_all(tokens: DataFrame, user: str) -> tuple[DataFrame, Column]:
    """Tokens with all of a user's revoked, and the predicate of those that change."""
    change = (F.col("user_id") == user) & live(F.col("revoked"))
    return tokens.withColumn("revoked", F.col("revoked") | (F.col("user_id") == user)), change


def has_role(user_info: Column, superuser: Column, roles: tuple[str, ...]) -> Column:
    """Superusers, or a role in the JSON among roles; broken JSON has none."""
    role = F.get_json_object(user_info, "$.role")
    return F.coalesce(superuser, F.lit(False)) | F.coalesce(role.isin(*roles), F.lit(False))
