"""Results kept under the state of their files, the pair table of curation, and exact quantiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.operators import curation, selection
from coursemill.session import Bucketed, own_writes, release_paths, stash
from coursemill.sources.kept import kept


def test_kept_results_are_read_until_a_file_changes(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    built = []

    def build(more=0):
        built.append(1)
        return spark.read.parquet(source).withColumn("x", F.col("id") + more)

    first = kept(spark, "t", [source], build)
    again = kept(spark, "t", [source], build)
    assert len(built) == 1 and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    other = kept(spark, "t", [source], lambda: build(5), more=5)
    assert len(built) == 2 and other.agg(F.min("x")).first()[0] == 5
    spark.range(10, 12).write.mode("append").parquet(source)
    assert kept(spark, "t", [source], build).count() == 12 and len(built) == 3
    spark.range(3).write.mode("overwrite").parquet(source)
    assert kept(spark, "t", [source], build).count() == 3 and len(built) == 4
    # what comes from elsewhere is never kept
    assert kept(spark, "t", [f"{source}-none"], build).count() == 3 == kept(spark, "t", [f"{source}-none"], build).count() and len(built) == 6


def test_a_failed_build_leaves_no_result(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    with pytest.raises(Exception, match="no luck"):
        kept(spark, "failing", [source], lambda: spark.range(4).select(F.raise_error(F.lit("no luck"))))
    assert kept(spark, "failing", [source], lambda: spark.range(4)).count() == 4


def test_runs_remove_their_own_tables(spark):
    outside = stash(spark.range(3), "outside")
    with own_writes() as outer:
        early = stash(spark.range(4), "early")
        with own_writes() as inner:
            late, last = stash(spark.range(5), "late"), stash(spark.range(6), "last")
        release_paths(spark, inner, last)
    assert inner == [late.stash_path, last.stash_path] and outer == [early.stash_path, *inner]
    assert [df.count() for df in (outside, early, last)] == [3, 4, 6]
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(late.stash_path).count()


def test_bucketed_tables_are_grouped_where_they_are(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), (F.col("id") % 2).alias("kind"), "id")
    table = Bucketed(rows, "buckets", "k", 4, "kind")
    grouped = table.read().filter("kind = 0").groupBy("k").agg(F.sum("id").alias("s"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["s"] for r in grouped.collect()} == {k: sum(i for i in range(100) if i % 7 == k and i % 2 == 0) for k in range(7)}
    table.remove(1)
    assert table.read().filter("kind = 0").count() == 50
    table.drop()


def test_the_pair_table_takes_one_shuffle_by_the_pair(spark):
    """Rows of all sources meet in one exchange on (student, course); a student's start is joined to what is left."""
    pair = "student_id string, course_id string"
    ratings = spark.createDataFrame([("s", "a", "r1", 5.0, None, True), ("s", "b", "r2", 2.0, None, False), ("t", "a", "r3", 4.0, None, None)], f"{pair}, rating_id string, rating double, rating_date date, would_recommend boolean")
    enrollments = spark.createDataFrame([("s", "a", "e1", None, None, "dropped", 10.0)], f"{pair}, enrollment_id string, enrollment_date date, last_accessed date, status string, progress_percentage double")
    quizzes = spark.createDataFrame([], f"{pair}, quiz_id string, quiz_date date, quiz_title string, total_questions int, correct_answers int, score_percentage double, time_taken_minutes int, attempts int, passed boolean")
    logs = spark.createDataFrame([("s", "c", "l1", 10, 20, None), ("s", "c", "l2", 15, 5, None)], f"{pair}, log_id string, time_spent_minutes int, progress_percentage int, activity_date date")
    students = spark.createDataFrame([("s", None), ("t", None)], "student_id string, enrollment_date date")
    pairs = curation.pair_rows(ratings, enrollments, quizzes, logs)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(student_id") == 1
    got = {(r["student_id"], r["course_id"]): r for r in pairs.collect()}
    assert got.keys() == {("s", "a"), ("s", "b"), ("t", "a"), ("s", "c")}
    assert got["s", "c"]["activity_count"] == 2 and got["s", "c"]["total_time_spent"] == 25 and got["s", "c"]["activity_progress"] == 20 and got["s", "c"]["r"] == []
    job = curation.curate(students, ratings, enrollments, quizzes, logs)
    out = {(r["student_id"], r["course_id"]): r for r in job["interactions"].collect()}
    assert out["s", "a"]["enrollment_status"] == "active" and out["s", "a"]["enrollment_progress"] >= 35 and out["s", "a"]["positive_label"]
    assert out["s", "c"]["activity_count"] == 2 and out["s", "b"]["rating_max"] == 2.0 and out["s", "b"]["quiz_attempts"] == 0
    assert set(job) == {"students", "ratings", "enrollments", "quizzes", "activities", "interactions"} and len(job) == 6
    made = job["interactions"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(student_id" in made and "course_id" not in "".join(x for x in made.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("parts, few", [(4096, 50_000), (4, 3), (2, 1)])
def test_order_statistics(spark, parts, few):
    rng = random.Random(6)
    values = [float(rng.choice([rng.gauss(0, 1), 7.0, 7.0, rng.randrange(5), 1e12 * rng.random(), -0.0])) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ranks = [0, 1, 250, 251, 498, 499]
    assert selection.order_statistics(df, "x", [*ranks, 500], parts, few) == {r: sorted(values)[r] for r in ranks}
    shares = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
    assert np.allclose(selection.quantiles(df, "x", shares, parts=parts, few=few), np.quantile(values, shares), rtol=1e-12)


def test_quantiles_of_little(spark):
    assert selection.quantiles(spark.createDataFrame([], "x int"), "x", [0.5]) == [None]
    assert selection.quantiles(spark.createDataFrame([(None,)], "x int"), "x", [0.5]) == [None]
    assert selection.quantiles(spark.createDataFrame([(3,)], "x int"), "x", [0.0, 0.5, 1.0]) == [3.0, 3.0, 3.0]
    assert selection.quantiles(spark.createDataFrame([(3,)] * 9, "x int"), "x", [0.1], few=1) == [3.0]


def test_kept_models_are_loaded(spark, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    from coursemill.operators import ml
    from coursemill.sources.kept import kept_model

    rng = random.Random(1)
    rows = spark.createDataFrame([(*[rng.random() for _ in ml.GRADE_FEATURES], 100 * rng.random()) for _ in range(40)], ", ".join(f"{c} double" for c in [*ml.GRADE_FEATURES, "score_percentage"]))
    source, fitted = str(tmp_path / "source"), []
    rows.write.parquet(source)

    def fit():
        fitted.append(1)
        return ml.fit_grades(spark.read.parquet(source), trees=3)

    first, again = (kept_model(spark, "grades", [source], fit, RandomForestRegressionModel) for _ in range(2))
    assert len(fitted) == 1
    shown = lambda m: [r["prediction"] for r in m.transform(ml._assembled(rows, ml.GRADE_FEATURES)).collect()]
    assert shown(first) == shown(again)
    assert kept_model(spark, "grades", [source], lambda: None, RandomForestRegressionModel, trees=9) is None


HISTORY = "student_id string, course_id string, preference_score double, enrollment_progress double, avg_quiz_score double, positive_label boolean"


def test_learned_features_are_the_same_either_way(spark):
    """By the student's row and by joins: features of pairs and of all that is unseen, and the lists that a forest makes of them."""
    from coursemill.operators import hybrid, ml
    from coursemill.operators import recommend as rec

    rng = random.Random(4)
    levels = ["Beginner", "Intermediate", "Advanced", None]
    courses = spark.createDataFrame([(f"c{k:02d}", f"{rng.choice(['spark', 'flink', 'art'])} part{k % 5} word{k % 3}", rng.choice("XYZ"), levels[k % 4]) for k in range(16)], "course_id string, title string, category string, difficulty string")
    rows = [(f"s{i:02d}", f"c{j:02d}", rng.choice([0.0, 0.25, 0.75, 1.0]), 100 * rng.random(), 100 * rng.random(), rng.random() < 0.5) for i in range(30) for j in rng.sample(range(16), 6)]
    rows += [("s01", "gone", 0.5, 10.0, 20.0, True), ("s02", "gone", 1.0, 10.0, 20.0, False)]
    train = stash(spark.createDataFrame(rows, HISTORY), "train")
    sims = stash(rec.content_similarity(rec.tfidf(rec.course_content(courses, ["title"]), [])), "sims")
    matrix = stash(rec.rating_matrix(ml.train_inputs(train)), "matrix")
    pairs = stash(ml.sampled_negatives(train, courses).unionByName(train.filter("course_id <> 'gone'").select("student_id", "course_id")), "pairs")
    joined = ml.hybrid_features(pairs, train, courses, sims, rec.predicted_ratings(matrix), rec.predicted_item_ratings(pairs, matrix))
    tables = hybrid.tables_for(train, matrix, courses, sims)
    made = hybrid.feature_rows(tables, train, matrix, pairs.groupBy("student_id").agg(F.collect_set("course_id").alias("wanted")))
    want = {(r["student_id"], r["course_id"]): [r[c] for c in ml.HYBRID_FEATURES] for r in joined.collect()}
    got = {(r["student_id"], r["course_id"]): r["features"] for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in want)
    asked = spark.createDataFrame([(f"s{i:02d}",) for i in range(30)] + [("new",)], "student_id string")
    either = [ml.hybrid_tables(train, matrix, asked, courses, sims, most) for most in (1000, 3)]
    forest = ml.fit_hybrid(either[0][0], trees=5)
    lists = [{(r["student_id"], r["course_id"], r["rank"], r["score"]) for r in hybrid.first_ranked(forest, rows, 4).collect()} for _, rows in either]
    assert lists[0] == lists[1] and len(lists[0]) == 31 * 4
    assert either[0][0].count() == either[1][0].count()
    again = ml.fit_hybrid(either[0][0].repartition(3), trees=5)
    assert {(r["student_id"], r["course_id"], r["rank"], r["score"]) for r in hybrid.first_ranked(again, either[0][1], 4).collect()} == lists[0]
    assert hybrid.tables_for(train, matrix, courses, sims, 3) is None


def test_candidates_are_not_shuffled(spark):
    """Each student's first n are cut in the task that scores them, before the only exchange."""
    from coursemill.operators import hybrid, ml

    rng = random.Random(2)
    labelled = spark.createDataFrame([("s", f"c{k}", k % 2, *[rng.random() for _ in ml.HYBRID_FEATURES]) for k in range(20)], "student_id string, course_id string, label int, " + ", ".join(f"{c} double" for c in ml.HYBRID_FEATURES))
    rows = labelled.select("student_id", "course_id", F.array(*ml.HYBRID_FEATURES).alias("features"))
    plan = hybrid.first_ranked(ml.fit_hybrid(labelled, trees=2), rows, 3)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchange = [k for k, x in enumerate(plan) if "Exchange" in x]
    partial = [k for k, x in enumerate(plan) if "WindowGroupLimit" in x and "Partial" in x]
    assert len(exchange) == 1 and len(partial) == 1 and partial[0] > exchange[0]  # plans are read from below


def test_the_report_of_an_evaluation(spark, tmp_path):
    from coursemill.operators import evaluation

    metrics = spark.createDataFrame([("b", 1, 0.25, None), ("b", 0, 0.75, None), ("a", 0, 0.5, 1.0)], "model string, fold int, precision_5 double, rmse double")
    lines = evaluation.report(metrics, ["precision_5", "rmse"])
    shown = [r["line"] for r in lines.orderBy("position").collect()]
    assert shown == ["a:", "-" * 70, "  precision_5:", "    Mean: 0.5000", "    Std:  0.0000", "    Values: [0.5000]", "  rmse:", "    Mean: 1.0000", "    Std:  0.0000", "    Values: [1.0000]", "", "b:", "-" * 70, "  precision_5:", "    Mean: 0.5000", "    Std:  0.2500", "    Values: [0.7500, 0.2500]", "  rmse: none", ""]
    evaluation.write_report(lines, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == shown
