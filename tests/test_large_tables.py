"""Steps whose cost may not grow faster than the tables."""

import re

import pytest

from coursemill.sources.adapter import BODIES, Platform

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    """As with tables that are too large to be broadcast by their size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_activity_finds_its_course_by_a_key(spark, no_broadcasts):
    """Events met every course in a product of both before."""
    found = Platform(spark, SMALL).activity
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    for t in ("events", "part"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(BODIES["activity"][1])
    assert found.count() == want.count() > 0 and not found.exceptAll(want).head(1)


@pytest.mark.parametrize("name", ["rating", "enrollment", "quiz", "module_progress"])
def test_line_items_are_joined_once(spark, no_broadcasts, name):
    """Each table joined all line items with orders and parts anew."""
    found = Platform(spark, SMALL)._frame(name)
    assert "SortMergeJoin" not in plan(found)
    for t in ("lineitem", "orders", "part"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(BODIES[name][1])
    assert found.count() == want.count() > 0 and not found.exceptAll(want).head(1)


def test_what_grows_with_students_is_not_broadcast(spark):
    """hybrid_features broadcast the scores of all students, which Spark took for as small as the packed files of their rows."""
    from coursemill.plans import queries

    found = queries.hybrid_features(Platform(spark, SMALL))
    joined = [x for x in plan(found).splitlines() if "BroadcastHashJoin" in x and "student_id" in x]
    assert not joined and "SortMergeJoin" in plan(found)


def test_features_are_not_joined_by_pairs(spark):
    """Scores of all students' courses were shuffled and written to meet the pairs that were asked for."""
    from coursemill.plans import queries

    found = plan(queries.hybrid_features(Platform(spark, SMALL)))
    assert "MapInArrow" in found and not re.search(r"Exchange hashpartitioning\((student_id#\d+L?, course_id|course_id#\d+L?, student_id)", found)


def test_a_holdout_deals_ratings_once(spark):
    """A copy of the ratings was shuffled for each fold."""
    from pyspark.sql import functions as F

    from coursemill.operators import evaluation

    ratings = spark.range(400).select(F.col("id").cast("string").alias("rating_id"), (F.col("id") % 9).cast("string").alias("student_id"), (F.col("id") % 7).cast("string").alias("course_id"), F.lit(3.0).alias("rating"))
    split = evaluation.holdout(ratings, 5)
    assert plan(split).index("Exchange") > max(plan(split).rindex("Generate"), 0) and plan(split).count("Exchange") == 1  # below all folds
    rows = evaluation.unfolded(evaluation.holdout_rows(ratings, 5))
    key = ["fold", "student_id", "course_id", "is_test"]
    assert rows.count() == split.count() == 2000 and not rows.select(key).exceptAll(split.select(key)).head(1)
    assert "Exchange hashpartitioning(fold" not in plan(rows.groupBy("fold", "student_id").count())


def test_negatives_rank_all_unseen_courses(spark):
    """Courses were drawn by a walk, in which one follows from another."""
    import hashlib

    from coursemill.operators import ml

    courses = spark.createDataFrame([(f"c{k:02d}",) for k in range(20)], "course_id string")
    train = spark.createDataFrame([("s", "c03", 0.9, True), ("s", "c05", 0.8, True), ("s", "c06", 0.0, False), ("t", "c01", 0.2, False)], "student_id string, course_id string, preference_score double, positive_label boolean")
    want = set()
    for s, seen, n in (("s", {"c03", "c05"}, 4), ("t", {"c01"}, 2)):
        left = [f"c{k:02d}" for k in range(20) if f"c{k:02d}" not in seen]
        want |= {(s, c) for c in sorted(left, key=lambda c: hashlib.md5(f"{s}|{c}|42".encode()).hexdigest())[:n]}
    assert {tuple(r) for r in ml.drawn_negatives(train, courses).collect()} == want


def test_answers_are_not_shuffled(spark):
    """Answers were dealt three times: for distinct sittings, to meet the questions, and to be summed up. A sitting of two rows was mixed."""
    from coursemill.operators import serving
    from coursemill.plans import queries

    found = plan(queries.quiz_score(Platform(spark, SMALL)))
    assert found.count("Exchange hashpartitioning(sitting") + found.count("Exchange hashpartitioning(quiz_id") == 1 and found.index("Generate") < found.index("Exchange hashpartitioning(")
    assert "Exchange hashpartitioning" not in plan(queries.quiz_review(Platform(spark, SMALL)))
    q = spark.createDataFrame([(f"q{k}", "c", "t", "A", "one", "two", "three", "four", k) for k in (1, 2)], "question_id string, course_id string, quiz_title string, correct_answer string, option_a string, option_b string, option_c string, option_d string, points int")
    a = spark.createDataFrame([("x", "c", "t", [("q1", "A")]), ("x", "c", "t", [("q1", "B"), ("q2", "A")]), ("y", "c", "t", []), ("z", "d", "t", [("q1", "A")])], "sitting string, course_id string, quiz_title string, given array<struct<question_id: string, answer: string>>")
    review = serving.sittings_review(q, a)
    assert sorted((r["sitting"], r["question_id"], r["answer"], r["given_text"]) for r in review.collect()) == sorted([("x", "q1", "A", "one"), ("x", "q2", "", None), ("x", "q1", "B", "two"), ("x", "q2", "A", "one"), ("y", "q1", "", None), ("y", "q2", "", None)], key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    got = {r["sitting"]: (r["correct_answers"], r["total_questions"], r["earned_points"]) for r in serving.quiz_scores(review).collect()}
    assert got == {"x": (2, 4, 3), "y": (0, 2, 0)}
