"""Star schema: cleaned tables, three dimensions and three facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.expressions import clip, difficulty_level, experience_level, performance_tier, tercile
from coursemill.operators.numbering import numbered
from coursemill.operators.selection import quantiles


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in a stated order. (dropDuplicates keeps an arbitrary one.)"""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def clean_students(df: DataFrame, ordinal: str = "student_id") -> DataFrame:
    out = first_by(df, ["student_id"], [ordinal])
    return out.withColumns({"age": clip(F.col("age"), 16, 60)} | {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("total_courses_completed", "int"), ("avg_quiz_score", "double"), ("total_time_spent_hours", "double"))})


def clean_courses(df: DataFrame, ordinal: str = "course_id") -> DataFrame:
    """Missing prerequisites are the text None; a missing rating is the mean of the others."""
    out = first_by(df, ["course_id"], [ordinal])
    mean = out.agg(F.avg("rating").alias("_mean"))
    out = out.crossJoin(F.broadcast(mean))  # one row
    return out.withColumns({"prerequisites": F.coalesce("prerequisites", F.lit("None")), "rating": clip(F.coalesce("rating", "_mean"), 0.0, 5.0), "completion_rate": clip(F.col("completion_rate"), 0.0, 100.0)}).drop("_mean")


def clean_activity(df: DataFrame, ordinal: str = "log_id") -> DataFrame:
    """A missing flag counts as true, as any value but zero does."""
    out = first_by(df, ["log_id"], [ordinal])
    flags = {c: F.coalesce(c, F.lit(True)) for c in ("video_watched", "notes_taken", "resources_downloaded")}
    return out.withColumns({"time_spent_minutes": clip(F.col("time_spent_minutes"), 0), "progress_percentage": clip(F.col("progress_percentage"), 0, 100)} | flags)


def clean_quiz(df: DataFrame, ordinal: str = "quiz_id") -> DataFrame:
    out = first_by(df, ["quiz_id"], [ordinal])
    return out.withColumns({"score_percentage": clip(F.col("score_percentage"), 0.0, 100.0), "correct_answers": F.least("correct_answers", "total_questions")})


def clean_ratings(df: DataFrame, ordinal: str = "rating_id") -> DataFrame:
    out = first_by(df, ["rating_id"], [ordinal])
    return out.withColumns({c: clip(F.col(c), 1.0, 5.0) for c in ("rating", "difficulty_rating", "content_quality", "instructor_rating")})


def surrogate_key(df: DataFrame, name: str, order: list[Column | str]) -> DataFrame:
    """Numbers from 1 in a stated order, as int."""
    return numbered(df, name, order).withColumn(name, F.col(name).cast("int"))


def dim_time(activity: DataFrame, quiz: DataFrame, rating: DataFrame) -> DataFrame:
    """Every date that occurs; keys in calendar order. Monday is day 0."""
    dates = activity.select(F.col("activity_date").alias("date")).union(quiz.select("quiz_date")).union(rating.select("rating_date")).filter("date IS NOT NULL").distinct()
    d = F.col("date")
    out = dates.select("date", F.dayofmonth(d).alias("day"), F.month(d).alias("month"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.weekday(d).alias("day_of_week"), F.weekofyear(d).alias("week_of_year"), (F.weekday(d) >= 5).alias("is_weekend"))
    return surrogate_key(out, "time_key", ["date"])


def dim_user(students: DataFrame) -> DataFrame:
    out = students.withColumns({"experience_level": experience_level(F.col("total_courses_completed")), "performance_tier": performance_tier(F.col("avg_quiz_score"))})
    return surrogate_key(out, "user_key", ["student_id"])


def dim_course(courses: DataFrame) -> DataFrame:
    """With popularity terciles by exact quantiles; equal edges are allowed."""
    low, high = (F.lit(x) for x in quantiles(courses, "total_enrollments", [1.0 / 3, 2.0 / 3]))
    out = courses.withColumns({"difficulty_level": difficulty_level(F.col("difficulty")), "popularity_tier": tercile(F.col("total_enrollments"), low, high)})
    return surrogate_key(out, "course_key", ["course_id"])


def _count_true(c: str) -> Column:
    return F.sum(F.col(c).cast("int"))


def fact_learning(activity: DataFrame) -> DataFrame:
    return activity.groupBy("student_id", "course_id").agg(
        F.sum("time_spent_minutes").alias("total_time_minutes"), F.max("progress_percentage").alias("max_progress"), F.max("module_completed").alias("modules_completed"),
        _count_true("video_watched").alias("videos_watched"), _count_true("notes_taken").alias("notes_count"), _count_true("resources_downloaded").alias("resources_count"),
    )


def fact_quiz(quiz: DataFrame) -> DataFrame:
    return quiz.groupBy("student_id", "course_id").agg(
        F.avg("score_percentage").alias("avg_score"), F.sum("time_taken_minutes").alias("total_time"), F.sum("attempts").alias("total_attempts"),
        _count_true("passed").alias("quizzes_passed"), F.count("quiz_id").alias("total_quizzes"),
    )


def fact_rating(rating: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("rating", "difficulty_rating", "content_quality", "instructor_rating")]
    return rating.groupBy("student_id", "course_id").agg(*means, F.max("would_recommend").alias("would_recommend"))


@dataclass
class Warehouse:
    """The star schema; all frames are lazy."""

    dim_time: DataFrame
    dim_user: DataFrame
    dim_course: DataFrame
    fact_learning: DataFrame
    fact_quiz: DataFrame
    fact_rating: DataFrame


def build_warehouse(students: DataFrame, courses: DataFrame, activity: DataFrame, quiz: DataFrame, rating: DataFrame) -> Warehouse:
    """Clean and transform all tables."""
    s, c, a, q, r = clean_students(students), clean_courses(courses), clean_activity(activity), clean_quiz(quiz), clean_ratings(rating)
    return Warehouse(dim_time(a, q, r), dim_user(s), dim_course(c), fact_learning(a), fact_quiz(q), fact_rating(r))
