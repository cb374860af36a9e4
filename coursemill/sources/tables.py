"""CSV sources with declared schemas, and sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "students": "student_id string, name string, email string, age int, education_level string, major string, enrollment_date date, learning_style string, preferred_difficulty string, total_courses_completed int, avg_quiz_score double, total_time_spent_hours double",
    "courses": "course_id string, title string, category string, subcategory string, difficulty string, duration_hours int, instructor string, description string, prerequisites string, tags string, rating double, total_enrollments int, completion_rate double",
    "course_modules": "module_id string, course_id string, module_number int, module_title string, module_type string, duration_minutes int, content_url string, description string, `order` int",
    "quiz_questions": "question_id string, course_id string, quiz_title string, question_number int, question_text string, option_a string, option_b string, option_c string, option_d string, correct_answer string, difficulty string, points int",
    "module_progress": "progress_id string, student_id string, module_id string, completed boolean, completion_date date, time_spent_minutes int, score double",
    "ratings": "rating_id string, student_id string, course_id string, rating_date date, rating double, review_text string, difficulty_rating double, content_quality double, instructor_rating double, would_recommend boolean",
    "enrollments": "enrollment_id string, student_id string, course_id string, enrollment_date date, status string, progress_percentage double, last_accessed date",
    "quiz_results": "quiz_id string, student_id string, course_id string, quiz_date date, quiz_title string, total_questions int, correct_answers int, score_percentage double, time_taken_minutes int, attempts int, passed boolean",
    "activity_logs": "log_id string, student_id string, course_id string, activity_type string, activity_date date, time_spent_minutes int, progress_percentage int, module_completed int, video_watched boolean, notes_taken boolean, resources_downloaded boolean",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header. Quotes are doubled within quotes; the text None stays a text; what does not parse becomes null."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, dateFormat="yyyy-MM-dd", mode="PERMISSIVE")


def parsed_date(text: str, strict: bool = False) -> Column:
    """A text column as a date. What isn't one becomes null, or with ``strict`` ends the query with an error."""
    return F.col(text).cast("date") if strict else F.col(text).try_cast("date")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', dateFormat="yyyy-MM-dd")


def append_rows(df: DataFrame, rows: DataFrame, path: str) -> None:
    """Append by name: the columns of ``rows`` are put in the order of ``df``."""
    write_csv(rows.select(*df.columns), path, "append")


def write_split(df: DataFrame, path: str) -> None:
    """A table by split_role, for reads that prune partitions."""
    df.write.mode("overwrite").partitionBy("split_role").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; of a summary, one."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def as_summary(row: DataFrame) -> DataFrame:
    """A one-row summary whose tier_* and split_* counters become maps."""
    pick = lambda p: [c for c in row.columns if c.startswith(p)]
    rest = [c for c in row.columns if not c.startswith(("tier_", "split_"))]
    as_map = lambda p: F.create_map(*[x for c in pick(p) for x in (F.lit(c[len(p) :]), F.col(c))])
    return row.select(*rest, as_map("tier_").alias("signal_tiers"), as_map("split_").alias("split_roles"))


#: Names of the cleaned tables in a folder, by their names in what curation.curate() gives.
CLEANED = {"students": "students_clean", "enrollments": "enrollments_clean", "quizzes": "quiz_results_clean", "activities": "activity_logs_clean", "ratings": "ratings_clean", "interactions": "interaction_quality"}


def write_cleaned(cleaned: dict[str, DataFrame], folder: str, summary: DataFrame | None = None) -> None:
    """The cleaned tables as Parquet under a new folder, interactions by split_role, which makes train and test partitions of one table; and the summary as JSON."""
    for name, file in CLEANED.items():
        if name == "interactions":
            write_split(cleaned[name], f"{folder}/{file}")
        else:
            cleaned[name].write.parquet(f"{folder}/{file}")
    if summary is not None:
        write_json(as_summary(summary), f"{folder}/curation_summary")


def read_cleaned(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What write_cleaned() has written, and the train and test rows, which read their own partition only."""
    out = {name: spark.read.parquet(f"{folder}/{file}") for name, file in CLEANED.items()}
    return out | {role: out["interactions"].filter(F.col("split_role") == role) for role in ("train", "test")}


@dataclass
class Store:
    """The tables of a folder, read when first asked for; reload() forgets them and what was fitted on them."""

    spark: SparkSession
    folder: str
    suffix: str = ".csv"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fitted: dict[str, object] = field(default_factory=dict)
    versions: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = read_csv(self.spark, self.versions.get(name, f"{self.folder}/{name}{self.suffix}"), SCHEMAS[name])
            self.tables[name].createOrReplaceTempView(name)
        return self.tables[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        """A new version of a table; fitted models are out of date with it."""
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        self.fitted.clear()

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table's file, by column names; it is read anew afterwards."""
        append_rows(self[name], rows, f"{self.folder}/{name}{self.suffix}")
        self._forget(name)

    def save(self, name: str, df: DataFrame) -> str:
        """Write a new version of a table beside the old one, which it may be made from, and read it from now on."""
        version = f"{self.folder}/{name}-{uuid.uuid4().hex}{self.suffix}"
        write_csv(df, version)
        self._forget(name)
        self.versions[name] = version
        return version

    def _forget(self, name: str) -> None:
        self.tables.pop(name, None)
        self.fitted.clear()
        self.spark.catalog.dropTempView(name)

    def counts(self) -> dict[str, int]:
        """Rows of every table that was read."""
        return {name: df.count() for name, df in self.tables.items()}

    def fit(self, name: str, build) -> object:
        """A fitted object, built once."""
        if name not in self.fitted:
            self.fitted[name] = build(self)
        return self.fitted[name]

    def reload(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        self.tables.clear()
        self.fitted.clear()
