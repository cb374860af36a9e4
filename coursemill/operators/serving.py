"""Serving queries and mutations. A mutation returns the new version of a table; nothing is changed in place."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.expressions import true_or_false
from coursemill.operators.numbering import numbered

PASS_MARK = 60
PAIR = ["student_id", "course_id"]


# --- lookups and filters ---


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first row with a key, or none."""
    return df.filter(F.col(key) == value).limit(1)


def login(students: DataFrame, typed: str) -> DataFrame:
    """The student whose id was typed, blanks and case aside."""
    return students.filter(F.col("student_id") == F.upper(F.trim(F.lit(typed)))).limit(1)


def is_enrolled(enrollments: DataFrame) -> DataFrame:
    """Pairs with an active or completed enrollment."""
    return enrollments.filter(F.col("status").isin("active", "completed")).select(*PAIR).distinct()


def catalog(courses: DataFrame, enrolled: DataFrame | None = None, category: str | None = None, difficulty: str | None = None, search: str | None = None) -> DataFrame:
    """Courses by optional filters; search is a regular expression on title or description, case aside. With a student's enrolled pairs, the flag enrolled."""
    out = courses
    if category:
        out = out.filter(F.col("category") == category)
    if difficulty:
        out = out.filter(F.col("difficulty") == difficulty)
    if search:
        pattern = "(?i)" + search
        out = out.filter(true_or_false(F.col("title").rlike(pattern)) | true_or_false(F.col("description").rlike(pattern)))
    if enrolled is not None:
        out = out.join(enrolled.select("course_id", F.lit(True).alias("enrolled")).distinct(), "course_id", "left").withColumn("enrolled", true_or_false(F.col("enrolled")))
    return out


def first_seen_values(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    return df.groupBy(column).agg(F.min(ordinal).alias("first")).orderBy("first").select(column)


def student_courses(courses: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Courses of a student's active and completed enrollments, with all enrollments of them (dropped rows fan out)."""
    current = enrollments.filter(F.col("status").isin("active", "completed")).select(*PAIR).distinct()
    mine = current.join(courses, "course_id")
    return mine.join(enrollments.select(*PAIR, "enrollment_id", "status", F.col("progress_percentage").alias("progress"), "last_accessed"), PAIR, "left")


def category_performance(quizzes: DataFrame, courses: DataFrame) -> DataFrame:
    """Mean score by (student, category), with strength (75 and more) and weakness (below 60)."""
    out = quizzes.join(courses.select("course_id", "category"), "course_id").groupBy("student_id", "category").agg(F.avg("score_percentage").alias("avg_score"))
    return out.withColumns({"strength": F.col("avg_score") >= 75, "weakness": F.col("avg_score") < 60})


def quiz_history(quizzes: DataFrame) -> DataFrame:
    """Quizzes by student, newest first."""
    order = Window.partitionBy("student_id").orderBy(F.col("quiz_date").desc_nulls_last(), "quiz_id")
    return quizzes.select("student_id", "quiz_id", "course_id", "quiz_title", "quiz_date", "score_percentage", "passed", F.row_number().over(order).alias("position"))


# --- modules and quizzes ---


def modules_with_progress(modules: DataFrame, progress: DataFrame, enrolled: DataFrame) -> DataFrame:
    """The modules of enrolled courses in order, completed or not."""
    done = progress.select("student_id", "module_id", "completed")
    return enrolled.select(*PAIR).join(modules, "course_id").join(done, ["student_id", "module_id"], "left").withColumn("completed", true_or_false(F.col("completed")))


def current_module(listed: DataFrame) -> DataFrame:
    """The first module that is not completed; if all are, the first."""
    order = Window.partitionBy(*PAIR).orderBy("completed", "order_no", "module_id")
    return listed.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def course_progress(listed: DataFrame) -> DataFrame:
    """Completed over all modules in percent, to one place; 100 completes the course."""
    out = listed.groupBy(*PAIR).agg(F.count("*").alias("total_modules"), F.sum(F.col("completed").cast("int")).alias("completed_modules"))
    out = out.withColumn("progress_percentage", F.round(F.col("completed_modules") * 100 / F.col("total_modules"), 1))
    return out.withColumn("status", F.when(F.col("progress_percentage") >= 100, "completed").otherwise("active"))


def quiz_review(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question of each sitting with the given answer ('' if none), whether it is right, and the texts of the right and of the chosen option."""
    sittings = answers.select("sitting", "course_id", "quiz_title").distinct()
    given = answers.select("sitting", "question_id", "answer")
    return reviewed(sittings.join(questions, ["course_id", "quiz_title"]).join(given, ["sitting", "question_id"], "left"))


def sittings_review(questions: DataFrame, sittings: DataFrame) -> DataFrame:
    """quiz_review() of sittings with their answers in one row, as a form sends them: given, an array of (question_id, answer). Answers stay with their sitting, so none is shuffled; a sitting of several rows is reviewed by each."""
    answers = F.filter("given", lambda g: g["question_id"] == F.col("question_id"))
    asked = sittings.join(questions, ["course_id", "quiz_title"])
    return reviewed(asked.withColumn("answer", F.explode_outer(F.transform(answers, lambda g: g["answer"]))).drop("given"))


def reviewed(asked: DataFrame) -> DataFrame:
    """Questions of sittings with the answer, null if none: whether it is right, and the texts of the options."""
    out = asked.withColumn("answer", F.coalesce("answer", F.lit("")))
    option = lambda letter: F.when(letter == "A", F.col("option_a")).when(letter == "B", F.col("option_b")).when(letter == "C", F.col("option_c"))
    given_text: Column = F.when(F.col("answer") == "D", F.col("option_d")).otherwise(option(F.col("answer")))  # null where nothing was chosen
    return out.withColumns({"correct": F.col("answer") == F.col("correct_answer"), "correct_text": option(F.col("correct_answer")).otherwise(F.col("option_d")), "given_text": given_text})


def quiz_scores(review: DataFrame) -> DataFrame:
    """Right answers, questions, points and percentage (one place) of each sitting."""
    right = F.col("correct").cast("int")
    out = review.groupBy("sitting", "course_id", "quiz_title").agg(F.sum(right).alias("correct_answers"), F.count("*").alias("total_questions"), F.sum(right * F.col("points")).alias("earned_points"), F.sum("points").alias("total_points"))
    return out.withColumn("percentage", F.round(F.col("correct_answers") * 100 / F.col("total_questions"), 1)).withColumn("passed", F.col("percentage") >= PASS_MARK)


def attempt_numbers(quizzes: DataFrame) -> DataFrame:
    """Which attempt each quiz row is of its student, course and title."""
    order = Window.partitionBy("student_id", "course_id", "quiz_title").orderBy("quiz_date", "quiz_id")
    return quizzes.select("quiz_id", *PAIR, F.row_number().over(order).alias("attempt"))


# --- analytics ---


def analytics_totals(activity: DataFrame) -> DataFrame:
    """Hours and videos over all activity; 0 where there is none."""
    return activity.agg(F.coalesce(F.round(F.sum("time_spent_minutes") / 60, 1), F.lit(0.0)).alias("total_hours"), F.coalesce(F.sum(F.col("video_watched").cast("int")), F.lit(0)).alias("videos"), F.count("*").alias("activities"))


def score_histogram(quizzes: DataFrame) -> DataFrame:
    """Five bins by score, upper edges included."""
    s = F.col("score_percentage")
    bin_ = F.when(s <= 20, "0-20").when(s <= 40, "21-40").when(s <= 60, "41-60").when(s <= 80, "61-80").otherwise("81-100")
    return quizzes.groupBy(bin_.alias("bin")).agg(F.count("*").alias("quizzes"))


def bands(quizzes: DataFrame) -> DataFrame:
    """How scores and marks are shown: colour bands and shortened ids."""
    s = F.col("score_percentage")
    label = F.initcap(F.replace("quiz_title", F.lit("_"), F.lit(" ")))
    return quizzes.select("quiz_id", F.when(s >= 80, "success").when(s >= 60, "warning").otherwise("danger").alias("band"), F.format_string("%.1f", s).alias("shown"), F.concat(F.substring("course_id", 1, 5), F.lit("...")).alias("short_id"), label.alias("label"))


def course_details(courses: DataFrame, modules: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every course with its modules' titles in order (a short list), and number and mean of its ratings; 0 and null without."""
    listed = modules.groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_no", "module_id", "module_title"))), lambda x: x["module_title"]).alias("modules"))
    rated = ratings.groupBy("course_id").agg(F.count("*").alias("ratings"), F.avg("rating").alias("mean_rating"))
    out = courses.join(listed, "course_id", "left").join(rated, "course_id", "left")
    return out.withColumns({"modules": F.coalesce("modules", F.array().cast("array<string>")), "ratings": F.coalesce("ratings", F.lit(0))})


def previews(tables: dict[str, tuple[DataFrame, str, int | None]]) -> DataFrame:
    """(table, position, id) of the first rows of each table in the order of its id; None: all of them. Spark keeps the first n of each task only."""
    out = None
    for name, (df, key, n) in tables.items():
        own = df.select(F.col(key).alias("id"))
        own = own.orderBy("id").limit(n) if n is not None else own
        own = numbered(own, "position", ["id"]).select(F.lit(name).alias("table"), "position", "id")
        out = own if out is None else out.unionByName(own)
    return out


# --- mutations ---


def next_id(df: DataFrame, column: str, prefix: str, width: int = 3) -> DataFrame:
    """One more than the largest number behind a prefix; 1 for an empty table."""
    digits = F.regexp_extract(F.col(column), f"^{prefix}(\\d+)$", 1)
    n = F.max(F.when(digits != "", digits.cast("long")))
    return df.agg(F.format_string(f"{prefix}%0{width}d", F.coalesce(n, F.lit(0)) + 1).alias("next_id"))


def _append(df: DataFrame, key: str, prefix: str, width: int, row: dict) -> DataFrame:
    """The table with one more row, by column names."""
    fresh = next_id(df, key, prefix, width).select(F.col("next_id").alias(key), *[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in row.items()])
    return df.unionByName(fresh, allowMissingColumns=True)


def register(students: DataFrame, today: date, **values) -> DataFrame:
    """A new student, with zeros for what is not known yet."""
    return _append(students, "student_id", "S", 3, {"enrollment_date": today, "total_courses_completed": 0, "avg_quiz_score": 0.0, "total_time_spent_hours": 0.0} | values)


def enroll(enrollments: DataFrame, student_id: str, course_id: str, today: date) -> DataFrame:
    """Enroll, unless that is so already. A dropped enrollment becomes active again."""
    mine = (F.col("student_id") == student_id) & (F.col("course_id") == course_id)
    if enrollments.filter(mine & F.col("status").isin("active", "completed")).limit(1).count():
        return enrollments
    if enrollments.filter(mine).limit(1).count():
        return enrollments.withColumns({"status": F.when(mine, "active").otherwise(F.col("status")), "last_accessed": F.when(mine, F.lit(today)).otherwise(F.col("last_accessed"))})
    return _append(enrollments, "enrollment_id", "E", 3, {"student_id": student_id, "course_id": course_id, "enrollment_date": today, "status": "active", "progress_percentage": 0.0, "last_accessed": today})


def unenroll(enrollments: DataFrame, student_id: str, course_id: str) -> DataFrame:
    mine = (F.col("student_id") == student_id) & (F.col("course_id") == course_id)
    return enrollments.withColumn("status", F.when(mine, "dropped").otherwise(F.col("status")))


def save_quiz(quizzes: DataFrame, student_id: str, course_id: str, title: str, correct: int, total: int, minutes: int, today: date) -> DataFrame:
    """A quiz result, with its attempt number counted from earlier rows."""
    score = round(100 * correct / total, 1) if total else 0.0
    n = quizzes.filter((F.col("student_id") == student_id) & (F.col("course_id") == course_id) & (F.col("quiz_title") == title)).count()
    return _append(quizzes, "quiz_id", "Q", 3, {"student_id": student_id, "course_id": course_id, "quiz_date": today, "quiz_title": title, "total_questions": total, "correct_answers": correct, "score_percentage": score, "time_taken_minutes": minutes, "attempts": n + 1, "passed": score >= PASS_MARK})


def complete_module(progress: DataFrame, modules: DataFrame, enrollments: DataFrame, student_id: str, module_id: str, today: date) -> tuple[DataFrame, DataFrame]:
    """The new module progress, and the enrollments with progress counted from it: the module just completed counts."""
    if not progress.filter((F.col("student_id") == student_id) & (F.col("module_id") == module_id)).limit(1).count():
        progress = _append(progress, "progress_id", "P", 3, {"student_id": student_id, "module_id": module_id, "completed": True, "completion_date": today})
    course = modules.filter(F.col("module_id") == module_id).select("course_id")
    done = progress.filter((F.col("student_id") == student_id) & F.col("completed")).select("module_id").distinct()
    share = modules.join(course, "course_id", "left_semi").join(done.withColumn("done", F.lit(1)), "module_id", "left").groupBy("course_id").agg(F.round(F.count("done") * 100 / F.count("*"), 1).alias("_share"))
    mine = (F.col("student_id") == student_id) & F.col("_share").isNotNull()
    out = enrollments.join(F.broadcast(share), "course_id", "left")  # one row
    return progress, out.withColumns({
        "progress_percentage": F.when(mine, F.col("_share")).otherwise(F.col("progress_percentage")), "last_accessed": F.when(mine, F.lit(today)).otherwise(F.col("last_accessed")),
        "status": F.when(mine & (F.col("_share") >= 100), "completed").otherwise(F.col("status")),
    }).select(*enrollments.columns)


def minutes_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("int")


def course_badges(courses: DataFrame) -> DataFrame:
    """How courses are shown: the badge of the difficulty, tags as a list, a title of 30 characters at most, enrollments with thousands marked."""
    badge = F.when(F.col("difficulty") == "Beginner", "success").when(F.col("difficulty") == "Intermediate", "warning").otherwise("danger")
    short = F.when(F.char_length("title") > 30, F.concat(F.substring("title", 1, 30), F.lit("..."))).otherwise(F.col("title"))
    return courses.select("course_id", badge.alias("badge"), F.split(F.trim("tags"), r"\s+").alias("tags"), short.alias("short_title"), F.format_number("total_enrollments", 0).alias("enrollments"))


def progress_bands(enrollments: DataFrame) -> DataFrame:
    """Progress of 70 and more, of 40 and more, and below."""
    p = F.col("progress_percentage")
    return enrollments.select("enrollment_id", *PAIR, F.when(p >= 70, "high").when(p >= 40, "middle").otherwise("low").alias("progress_band"))


def prediction_bands(predictions: DataFrame) -> DataFrame:
    """Predicted scores of 80 and more, of 60 and more, and below, beside what the prediction has."""
    p = F.col("predicted_score")
    return predictions.withColumn("band", F.when(p >= 80, "success").when(p >= 60, "warning").otherwise("danger"))


def student_counters(quizzes: DataFrame, enrollments: DataFrame) -> DataFrame:
    """How many quizzes and current courses each student has."""
    q = quizzes.groupBy("student_id").agg(F.count("*").alias("quizzes"))
    e = is_enrolled(enrollments).groupBy("student_id").agg(F.count("*").alias("courses"))
    return q.join(e, "student_id", "full_outer").na.fill(0)


def history_lists(events: DataFrame, order: list[str], distinct: bool = True) -> DataFrame:
    """(student_id, courses): each student's courses in the order of their events, once each at their first or as often as they come."""
    place = F.struct(*order, "course_id")
    if distinct:
        events = events.groupBy(*PAIR).agg(F.min(place).alias("place"))
    else:
        events = events.select(*PAIR, place.alias("place"))
    return events.groupBy("student_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place"))), lambda x: x["place"]["course_id"]).alias("courses"))


def json_lists(rows: DataFrame, key: str, name: str, order: str, columns: list[str]) -> DataFrame:
    """One JSON document for each key: the key, and under ``name`` the rows' columns as objects in order. For short lists."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("item")))), lambda x: x["item"])
    return rows.groupBy(key).agg(items.alias(name)).select(key, F.to_json(F.struct(key, name), {"ignoreNullFields": "false"}).alias("json"))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


