"""Task and batch state from event logs; expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str = "task_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest event of each task (G01): a partial aggregate, so busy tasks do not meet in one place as rows."""
    fields = [c for c in events.columns if c not in (key,)]
    best = events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, tie)).alias("_s"))
    return best.select(key, *[F.col(f"_s.{c}").alias(c) for c in fields])


def snapshot(tasks: DataFrame) -> DataFrame:
    """Task hashes (strings) with numbers cast and defaults filled (G03, H21); an elapsed time that is no number is an error."""
    number = lambda c, d: F.coalesce(F.col(c).try_cast("int"), F.lit(d))
    bad = F.col("elapsed_seconds").isNotNull() & F.col("elapsed_seconds").try_cast("double").isNull()
    return tasks.select(
        "task_id",
        F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown")).alias("status"),
        number("current_step", 0).alias("current_step"),
        number("total_steps", 0).alias("total_steps"),
        F.coalesce(F.nullif(F.trim("step_name"), F.lit("")), F.lit("")).alias("step_name"),
        F.col("elapsed_seconds").try_cast("double").alias("elapsed_seconds"),
        F.coalesce(F.nullif(F.col("error"), F.lit("")), F.when(bad, "invalid elapsed time")).alias("error"),
        (F.col("cancel") == "1").alias("cancelled"),
    )


def with_state(items: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Batch items with their task's state; unknown where there is none."""
    return items.join(tasks.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def expired(df: DataFrame, at: str, now: Column, hours: int = 24) -> DataFrame:
    """Rows older than hours at now."""
    return df.filter(F.col(at) < now - F.expr(f"interval {int(hours)} hours"))


#: What an error message says about its kind.
ERRORS = (("too_large", r"(?i)too large|exceeds? (?:max|limit)|413"), ("connection", r"(?i)connect|refused|unreachable|reset by peer"), ("transient", r"(?i)time ?out|timed out|unavailable|too many requests|429|503"))


def error_kind(message: Column) -> Column:
    """too_large, connection, transient or fatal; null without a message."""
    out = F.lit("fatal")
    for name, pattern in reversed(ERRORS):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return F.when(message.isNotNull(), out)
