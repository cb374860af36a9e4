"""Learner features in five families, and the student feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions.expressions import clip, difficulty_level

TOPIC_WEIGHTS = {"time_spent_minutes": 0.4, "activity_count": 0.3, "rating": 0.3}
COMPLETION_WEIGHTS = {"progress": 0.5, "modules": 0.3, "quizzes": 0.2}
LEVELS = ["Beginner", "Intermediate", "Advanced"]


def with_course(fact: DataFrame, courses: DataFrame, *columns: str) -> DataFrame:
    """A fact's rows of known courses, with some of the course's columns."""
    return fact.join(courses.select("course_id", *columns), "course_id")


def topic_interest(activity: DataFrame, rating: DataFrame, courses: DataFrame) -> DataFrame:
    """Interest of (student, category): time, number of activities and mean rating, each over its largest value, blended 0.4, 0.3, 0.3."""
    keys = ["student_id", "category"]
    seen = with_course(activity, courses, "category").groupBy(*keys).agg(F.sum("time_spent_minutes").alias("time_spent_minutes"), F.count("*").alias("activity_count"))
    rated = with_course(rating, courses, "category").groupBy(*keys).agg(F.avg("rating").alias("rating"))
    both = seen.join(rated, keys, "full_outer").na.fill(0)
    most = both.agg(*[F.max(c).alias(f"_{c}") for c in TOPIC_WEIGHTS])
    share = {c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0) for c in TOPIC_WEIGHTS}
    score = sum((share[c] * w for c, w in TOPIC_WEIGHTS.items()), F.lit(0.0))
    return both.crossJoin(F.broadcast(most)).select(*keys, *TOPIC_WEIGHTS, score.alias("interest_score"))  # one row


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list[str]) -> DataFrame:
    """One row for each ``row``, a column of means for each of the given values, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value)).na.fill(0.0)


def completion_rates(activity: DataFrame, quiz: DataFrame, courses: DataFrame) -> DataFrame:
    keys = ["student_id", "course_id"]
    done = activity.groupBy(*keys).agg(F.max("progress_percentage").alias("progress_percentage"), F.max("module_completed").alias("module_completed"))
    passed = quiz.groupBy(*keys).agg((F.sum(F.col("passed").cast("int")) / F.count("quiz_id")).alias("quiz_pass_rate"))
    modules = F.greatest((F.col("duration_hours") / 5).cast("int"), F.lit(1))
    out = with_course(done, courses, "duration_hours").withColumn("module_completion_rate", clip(F.col("module_completed") / modules, 0.0, 1.0))
    out = out.join(passed, keys, "left").na.fill(0)
    w = COMPLETION_WEIGHTS
    total = w["progress"] * (F.col("progress_percentage") / 100) + w["modules"] * F.col("module_completion_rate") + w["quizzes"] * F.col("quiz_pass_rate")
    return out.select(*keys, "progress_percentage", "module_completion_rate", "quiz_pass_rate", total.alias("weighted_completion"))


def category_scores(quiz: DataFrame, courses: DataFrame) -> DataFrame:
    """Scores of (student, category), and the mean adjusted by 10 % for each step of mean difficulty over the first. A single quiz has deviation 0."""
    out = with_course(quiz, courses, "category", "difficulty").withColumn("level", difficulty_level(F.col("difficulty")))
    out = out.groupBy("student_id", "category").agg(F.avg("score_percentage").alias("avg_score"), F.coalesce(F.stddev_samp("score_percentage"), F.lit(0.0)).alias("score_std"), F.count("score_percentage").alias("quiz_count"), F.avg("level").alias("avg_difficulty"))
    return out.withColumn("adjusted_score", clip(F.col("avg_score") * (1 + 0.1 * (F.col("avg_difficulty") - 1)), 0.0, 100.0))


def student_performance(quiz: DataFrame) -> DataFrame:
    s = "score_percentage"
    return quiz.groupBy("student_id").agg(
        F.avg(s).alias("overall_avg_score"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("score_volatility"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
        F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.avg("attempts").alias("avg_attempts"),
    )


def time_features(activity: DataFrame, courses: DataFrame) -> DataFrame:
    """Time of (student, course), and its share of the expected time, at most 2; a course without hours has none."""
    t = "time_spent_minutes"
    out = activity.groupBy("student_id", "course_id").agg(F.sum(t).alias("total_time"), F.avg(t).alias("avg_session_time"), F.count(t).alias("session_count"))
    out = with_course(out, courses, "duration_hours").withColumn("expected_time_minutes", F.col("duration_hours") * 60)
    return out.withColumn("time_efficiency", clip(F.try_divide("total_time", "expected_time_minutes"), 0.0, 2.0))


def learning_consistency(activity: DataFrame) -> DataFrame:
    """Time by day, its mean and deviation by student; consistency is 1 less the deviation's share of the largest."""
    daily = activity.groupBy("student_id", "activity_date").agg(F.sum("time_spent_minutes").alias("minutes"))
    out = daily.groupBy("student_id").agg(F.avg("minutes").alias("avg_daily_time"), F.coalesce(F.stddev_samp("minutes"), F.lit(0.0)).alias("daily_time_std"), F.count("minutes").alias("active_days"))
    most = out.agg(F.max("daily_time_std").alias("_most"))
    return out.crossJoin(F.broadcast(most)).withColumn("consistency_score", F.when(F.col("_most") > 0, 1 - F.col("daily_time_std") / F.col("_most")).otherwise(1.0)).drop("_most")  # one row


def difficulty_performance(quiz: DataFrame, courses: DataFrame) -> DataFrame:
    return with_course(quiz, courses, "difficulty").groupBy("student_id", "difficulty").agg(F.avg("score_percentage").alias("avg_score"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.count("quiz_id").alias("quiz_count"))


def recommended_difficulty(performance: DataFrame) -> DataFrame:
    """Mean scores by level (0 where there are none) and the level to go for next."""
    out = pivot_mean(performance, "student_id", "difficulty", "avg_score", LEVELS)
    b, i, a = (F.col(c) for c in LEVELS)
    rule = F.when((a >= 80) | (i >= 75) | (a >= 65), "Advanced").when((b >= 75) | (i >= 65), "Intermediate").otherwise("Beginner")
    return out.withColumn("recommended_difficulty", rule)


def student_features(students: DataFrame, quiz: DataFrame, activity: DataFrame, courses: DataFrame) -> DataFrame:
    """All students with performance, consistency and recommended level. What is missing becomes 0, in the text column '0'."""
    advice = recommended_difficulty(difficulty_performance(quiz, courses)).select("student_id", "recommended_difficulty")
    out = students.select("student_id", "learning_style", "preferred_difficulty", "avg_quiz_score")
    out = out.join(student_performance(quiz), "student_id", "left").join(learning_consistency(activity), "student_id", "left").join(advice, "student_id", "left")
    return out.na.fill(0).withColumn("recommended_difficulty", F.coalesce("recommended_difficulty", F.lit("0")))
