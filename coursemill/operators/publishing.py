"""Publishing: activity logs made dense from interactions, and the column layout of published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions.expressions import half_even, stable_fraction
from coursemill.operators.numbering import numbered
from coursemill.session import stash
from coursemill.sources.tables import SCHEMAS, write_csv

JITTER = 0.15


def dense_activity_logs(interactions: DataFrame) -> DataFrame:
    """1 to 4 log rows for every dated interaction, by its tier: dates spread over its span, progress rising to its target, time falling from 1 to 0.7.

    Logs are numbered in the order of (student, event date, course), by ranges of that order. An
    interaction takes as many numbers as it has logs before these are made, so that they are made once
    and never moved.
    """
    start = F.coalesce("first_event_date", "last_event_date")
    end = F.greatest(F.coalesce("last_event_date", "first_event_date"), start)
    tier = F.col("signal_tier")
    reached = F.greatest(F.col("enrollment_progress").cast("double"), F.col("activity_progress").cast("double"))
    target = F.when((tier == "strong") & (reached < 45), 45.0).when((tier == "medium") & (reached < 25), 25.0).when((reached == 0) & F.col("positive_label"), 20.0).otherwise(reached)
    # the first rule of a tier that applies keeps the others from it
    count = F.when(tier == "strong", 4).when(tier == "medium", 3).when(F.col("has_enrollment") | F.col("has_quiz") | F.col("has_activity"), 2).otherwise(1)
    count = F.when(F.col("has_quiz") & (count < 3), 3).otherwise(count)
    pair = [F.col("student_id"), F.col("course_id")]
    minutes = F.when(F.col("total_time_spent") > 0, F.col("total_time_spent").cast("double")).otherwise(20 + 80 * stable_fraction(*pair, "time"))
    base = interactions.filter(start.isNotNull()).select(*pair, "signal_tier", "has_quiz", "recommend_event_date", start.alias("start"), F.datediff(end, start).alias("span"), target.alias("target"), count.alias("n"), minutes.alias("minutes"))
    base = stash(base, "dense")  # the ranges are drawn from a first look at the rows
    base = numbered(base, "first", ["student_id", F.col("recommend_event_date").asc_nulls_last(), "course_id"], copies="n")
    i, n = F.col("i"), F.col("n")

    def day_offset(k):
        ratio = F.least(F.greatest(k / (n - 1) + (stable_fraction(*pair, tier, k) - 0.5) * JITTER, F.lit(0.0)), F.lit(1.0))
        return half_even(F.col("span") * ratio)

    offsets = F.when(n > 1, F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), day_offset))).otherwise(F.array(F.lit(0)))
    rows = base.withColumn("offsets", offsets).select("*", F.posexplode("offsets").alias("i", "offset"))
    part = F.when(n > 1, i / (n - 1)).otherwise(0.0)
    low = F.when(F.col("target") > 0, F.greatest(F.lit(5.0), F.least("target", F.lit(12.0)))).otherwise(5.0)
    progress = half_even(low + (F.greatest("target", F.lit(5.0)) - low) * part)
    weight = (1.0 - 0.3 * part) / F.when(n > 1, 0.85 * n).otherwise(1.0)
    kind = F.when((i == n - 1) & F.col("has_quiz"), "quiz_attempt").when((i == n - 2) & tier.isin("strong", "medium"), "assignment").otherwise("video_watch")
    out = rows.withColumns({"progress": progress, "activity_type": kind, "time_spent_minutes": F.greatest(F.lit(10), half_even(F.col("minutes") * weight)), "activity_date": F.date_format(F.date_add("start", F.col("offset")), "yyyy-MM-dd")})
    out = out.withColumn("number", F.col("first") + F.col("i"))
    kind = F.col("activity_type")
    return out.select(
        F.format_string("L%04d", F.col("number")).alias("log_id"), "student_id", "course_id", "activity_type", "activity_date", "time_spent_minutes",
        F.least("progress", F.lit(100)).alias("progress_percentage"), F.when(F.col("progress") > 0, F.greatest(F.lit(1), F.ceil(F.col("progress") / 25).cast("int"))).otherwise(1).alias("module_completed"),
        (kind == "video_watch").alias("video_watched"), (kind == "assignment").alias("notes_taken"), kind.isin("assignment", "quiz_attempt").alias("resources_downloaded"),
    )


def published(df: DataFrame, columns: list[str], dates: dict[str, str], order: list[str]) -> DataFrame:
    """A table as it is published: chosen columns in order, cleaned dates as yyyy-MM-dd text under their first names, sorted (nulls last)."""
    shown = [F.date_format(dates[c], "yyyy-MM-dd").alias(c) if c in dates else F.col(c) for c in columns]
    out = df.select(*shown)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else out


#: Of each published table the dates that are published in their cleaned form, and the order of its rows.
PUBLISHED: dict[str, tuple[dict[str, str], list[str]]] = {
    "students": ({"enrollment_date": "student_enrollment_date_clean"}, []),
    "ratings": ({"rating_date": "rating_date_clean"}, []),
    "enrollments": ({"enrollment_date": "enrollment_date_clean", "last_accessed": "last_accessed_clean"}, ["student_id", "course_id", "enrollment_date", "enrollment_id"]),
    "quiz_results": ({"quiz_date": "quiz_date_clean"}, ["student_id", "course_id", "quiz_date", "quiz_id"]),
}


def published_tables(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five tables as they are published, from what curation.curate() or sources.read_cleaned() gives: the columns of their schemas, and activity logs made anew."""
    names = {"students": "students", "ratings": "ratings", "enrollments": "enrollments", "quiz_results": "quizzes"}
    out = {}
    for name, (dates, order) in PUBLISHED.items():
        df = cleaned[names[name]]
        columns = [c.strip("`").split()[0] for c in SCHEMAS[name].split(", ")]
        out[name] = published(df, [c for c in columns if c in df.columns], dates, order)
    logs = dense_activity_logs(cleaned["interactions"])
    out["activity_logs"] = logs.orderBy("student_id", "course_id", "activity_date", "log_id")
    return out


def publish(cleaned: dict[str, DataFrame], folder: str) -> None:
    """Write the published tables as CSV under a new folder; a version that exists is never written over."""
    for name, df in published_tables(cleaned).items():
        write_csv(df, f"{folder}/{name}.csv")
