"""Operators on small tables with known answers, and their traps."""

import hashlib
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from coursemill.functions import expressions as ex
from coursemill.operators import curation, etl, evaluation, features, ml, neighbours, publishing, serving
from coursemill.operators import recommend as rec
from coursemill.operators.numbering import numbered
from coursemill.session import stash
from coursemill.sources import tables

D = date.fromisoformat


def one(df, column):
    (row,) = df.collect()
    return row[column]


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_stable_fraction_is_the_md5(spark):
    df = spark.createDataFrame([("S001", "C001"), ("Sé", "x|y")], "a string, b string")
    got = column(df.select("a", ex.stable_fraction(F.col("a"), F.col("b"), "progress").alias("f")), "f", "a")
    assert got == [int(hashlib.md5(f"{a}|{b}|progress".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for a, b in (("S001", "C001"), ("Sé", "x|y"))]
    assert got[0] == 0.5826316430658641


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5,), (50,), (500,)], "x int")
    assert sorted((r["y"] for r in df.select(ex.clip(F.col("x"), 0, 100).alias("y")).collect()), key=str) == [0, 100, 50, None]


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert column(df.select("x", ex.half_even(F.col("x")).alias("y")), "y", "x") == [0, 2, 2]


def test_spread_date_stays_inside(spark):
    df = spark.createDataFrame([(k, D("2024-01-10"), D("2024-01-20")) for k in range(50)] + [(60, None, None), (61, D("2024-05-01"), D("2024-06-01"))], "k int, a date, b date")
    got = {r["k"]: r["d"] for r in df.select("k", ex.spread_date(F.col("a"), F.col("b"), F.col("k")).alias("d")).collect()}
    assert all(D("2024-01-10") <= got[k] <= D("2024-01-20") for k in range(50)) and len(set(got.values())) > 5
    assert D("2024-01-01") <= got[60] <= D("2024-03-31") and got[61] == D("2024-05-01")


def test_tercile_edges(spark):
    courses = spark.createDataFrame([(f"C{k}", k, "Beginner") for k in range(1, 8)], "course_id string, total_enrollments int, difficulty string")
    out = {r["total_enrollments"]: r["popularity_tier"] for r in etl.dim_course(courses).collect()}
    assert out == {1: "Low", 2: "Low", 3: "Low", 4: "Medium", 5: "Medium", 6: "High", 7: "High"}


def test_first_row_of_a_key_stays(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert column(etl.first_by(df, ["k"], ["n"]), "n", "k") == [1, 3]


def test_missing_rating_is_imputed(spark):
    df = spark.createDataFrame([("a", None, 120.0, None), ("b", 4.0, -1.0, "a"), ("c", 3.0, 50.0, "b")], "course_id string, rating double, completion_rate double, prerequisites string")
    out = etl.clean_courses(df).orderBy("course_id").collect()
    assert [r["rating"] for r in out] == [3.5, 4.0, 3.0] and [r["completion_rate"] for r in out] == [100, 0, 50] and out[0]["prerequisites"] == "None"


def test_calendar(spark):
    a = spark.createDataFrame([(D("2024-01-06"),), (D("2024-01-08"),), (None,)], "activity_date date")
    none = spark.createDataFrame([], "quiz_date date, rating_date date")
    out = etl.dim_time(a, none, none).orderBy("time_key").collect()
    assert [(r["day_of_week"], r["is_weekend"], r["week_of_year"]) for r in out] == [(5, True, 1), (0, False, 2)]


QUIZ = "quiz_id string, student_id string, course_id string, score_percentage double, attempts int, passed boolean"


def test_single_quiz_has_no_deviation(spark):
    quiz = spark.createDataFrame([("q", "s", "c", 80.0, 1, True)], QUIZ)
    courses = spark.createDataFrame([("c", "X", "Advanced")], "course_id string, category string, difficulty string")
    assert one(features.student_performance(quiz), "score_volatility") == 0
    r = features.category_scores(quiz, courses).collect()[0]
    assert r["score_std"] == 0 and r["adjusted_score"] == 96
    assert one(features.recommended_difficulty(features.difficulty_performance(quiz, courses)), "recommended_difficulty") == "Advanced"


def test_student_without_quizzes(spark):
    students = spark.createDataFrame([("s", "Visual", "Beginner", 50.0)], "student_id string, learning_style string, preferred_difficulty string, avg_quiz_score double")
    quiz, act = spark.createDataFrame([], QUIZ), spark.createDataFrame([], "student_id string, activity_date date, time_spent_minutes int")
    courses = spark.createDataFrame([("c", "X", "Beginner")], "course_id string, category string, difficulty string")
    r = features.student_features(students, quiz, act, courses).collect()[0]
    assert r["recommended_difficulty"] == "0" and r["overall_avg_score"] == 0 and r["active_days"] == 0


def test_course_without_hours(spark):
    act = spark.createDataFrame([("s", "a", 60, 50, 2), ("s", "b", 6000, 50, 9)], "student_id string, course_id string, time_spent_minutes int, progress_percentage int, module_completed int")
    courses = spark.createDataFrame([("a", 0), ("b", 4)], "course_id string, duration_hours int")
    assert column(features.time_features(act, courses), "time_efficiency", "course_id") == [None, 2.0]
    out = features.completion_rates(act, spark.createDataFrame([], QUIZ), courses)
    assert column(out, "module_completion_rate", "course_id") == [1.0, 1.0]


INTER = "student_id string, course_id string, positive_label boolean, recommend_event_date date, interaction_score double"


def test_split_by_time(spark):
    rows = [("u", "a", True, D("2024-01-01"), 0.5), ("u", "b", True, D("2024-02-01"), 0.4), ("u", "c", True, D("2024-02-01"), 0.9), ("u", "d", False, D("2024-03-01"), 0.1), ("u", "e", False, None, 0.1), ("v", "a", True, D("2024-01-01"), 0.5)]
    out = {(r["student_id"], r["course_id"]): r for r in curation.time_aware_split(spark.createDataFrame(rows, INTER)).collect()}
    assert {k: r["split_role"] for k, r in out.items()} == {("u", "a"): "train", ("u", "b"): "post_cutoff", ("u", "c"): "test", ("u", "d"): "post_cutoff", ("u", "e"): "train", ("v", "a"): "train"}
    assert out["v", "a"]["recommendation_cutoff"] is None and out["u", "a"]["recommendation_cutoff"] == D("2024-02-01")


def test_weak_enrollments_are_strengthened(spark):
    rows = [("s", c, p, "dropped") for c, p in (("a", 1.0), ("b", 30.0), ("c", 31.0), ("d", 0.0))] + [("s", "a", 90.0, "active")]
    e = spark.createDataFrame(rows, "student_id string, course_id string, progress_percentage double, status string")
    r = spark.createDataFrame([("s", c, 4.0) for c in "abcd"], "student_id string, course_id string, rating double")
    out = curation.strengthen_enrollments(e, spark.createDataFrame([], QUIZ), r).collect()
    got = sorted((x["course_id"], x["progress_percentage"] >= 35, x["status"]) for x in out)
    assert got == [("a", True, "active"), ("a", True, "active"), ("b", True, "active"), ("c", False, "dropped"), ("d", False, "dropped")]


def test_support_signals_by_fraction(spark):
    ratings = spark.createDataFrame([(f"S{k}", "C", 5.0, D("2024-02-15")) for k in range(200)], "student_id string, course_id string, rating double, rating_date date")
    students = spark.createDataFrame([(f"S{k}", D("2024-01-05")) for k in range(200)], "student_id string, enrollment_date date")
    none = spark.createDataFrame([], "student_id string, course_id string")
    c = curation.support_candidates(students, ratings, none, none)
    f = {r["student_id"]: r["fraction"] for r in c.collect()}
    e, q = curation.synthetic_enrollments(c, none).collect(), curation.synthetic_quizzes(c, none).collect()
    assert {r["student_id"] for r in e} == {s for s, x in f.items() if x < 0.55} and {r["student_id"] for r in q} == {s for s, x in f.items() if x >= 0.25}
    assert all(35 <= r["progress_percentage"] <= 80 and D("2024-01-05") <= r["enrollment_date"] <= r["last_accessed"] <= D("2024-02-15") for r in e)
    assert sorted(r["enrollment_id"] for r in e)[0] == "SE0001" and all(72 <= r["score_percentage"] <= 95 and r["correct_answers"] <= r["total_questions"] for r in q)


def test_dense_logs(spark):
    schema = "student_id string, course_id string, first_event_date date, last_event_date date, recommend_event_date date, enrollment_progress double, activity_progress int, signal_tier string, positive_label boolean, has_enrollment boolean, has_quiz boolean, has_activity boolean, total_time_spent long"
    a, b = D("2024-01-01"), D("2024-03-01")
    rows = [("s", "a", a, b, b, 10.0, 0, "strong", True, True, True, False, 100), ("s", "b", a, a, a, 0.0, 0, "weak", False, False, False, False, 0), ("t", "c", None, None, None, 0.0, 0, "weak", False, True, False, False, 0)]
    out = publishing.dense_activity_logs(spark.createDataFrame(rows, schema)).orderBy("log_id").collect()
    assert [r["log_id"] for r in out] == ["L0001", "L0002", "L0003", "L0004", "L0005"] and [r["course_id"] for r in out] == ["b", "a", "a", "a", "a"]
    assert [r["progress_percentage"] for r in out[1:]] == [12, 23, 34, 45] and [r["activity_type"] for r in out[1:]] == ["video_watch", "video_watch", "assignment", "quiz_attempt"]
    assert sum(r["time_spent_minutes"] for r in out[1:]) in range(98, 103)


RATE = "student_id string, course_id string, rating double"


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame([("u", "a", 3.0), ("u", "a", 5.0), ("u", "b", 2.0), ("v", "a", 4.0), ("v", "c", 5.0), ("w", "c", 1.0)], RATE)


def test_neighbours(spark, ratings):
    m = rec.rating_matrix(ratings)
    assert {(r[0], r[1]): r[2] for r in m.collect()}["u", "a"] == 4.0
    cohort = spark.createDataFrame([("u",), ("unknown",)], "student_id string")
    (r,) = rec.recommendations(rec.user_cf_scores(m)).filter("student_id = 'u'").collect()
    assert (r["student_id"], r["course_id"], r["score"], r["rank"]) == ("u", "c", 5.0, 1)
    assert {x["course_id"] for x in rec.item_cf_scores(m, cohort).collect()} == {"c"}
    assert one(rec.sparsity(ratings), "sparsity") == round(1 - 5 / 9, 6)


def cosines(cells, who):
    """By plain loops: the cosines of the rows of {(student, course): rating}, or with who=1 of its columns."""
    rows = {}
    for key, r in cells.items():
        rows.setdefault(key[who], {})[key[1 - who]] = r
    norm = {x: sum(r * r for r in row.values()) ** 0.5 for x, row in rows.items()}
    return {(x, y): d / (norm[x] * norm[y]) for x in rows for y in rows if (d := sum(r * rows[y].get(c, 0) for c, r in rows[x].items())) > 0}


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    return {(f"s{i:02d}", f"c{j:02d}"): float(rng.randrange(1, 6)) for i in range(30) for j in range(14) if rng.random() < 0.3}


@pytest.mark.parametrize("most_cells", [2_000_000, 3])
def test_predictions_equal_plain_loops(spark, cells, most_cells):
    """By tables in the tasks and, for large catalogues, by joins."""
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], "student_id string, course_id string, r double")
    sims = cosines(cells, 0)
    want = {}
    for i in {s for s, _ in cells}:
        for j in {c for _, c in cells}:
            raters = [(sims[i, x], r) for (x, c), r in cells.items() if c == j and (i, x) in sims]
            if raters:
                want[i, j] = sum(s * r for s, r in raters) / sum(s for s, _ in raters)
    found = {(r["student_id"], r["course_id"]): r["score"] for r in rec.predicted_ratings(m, most_cells=most_cells).collect()}
    folds = m.withColumn("fold", F.lit(0)).unionByName(m.filter("course_id < 'c07'").withColumn("fold", F.lit(1)))
    by_fold = rec.predicted_ratings(folds, ("fold",), most_cells=most_cells)
    assert {(r["student_id"], r["course_id"]): r["score"] for r in by_fold.filter("fold = 0").collect()} == found
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in want)
    assert not {(r["student_id"], r["course_id"]) for r in rec.user_cf_scores(m).collect()} & cells.keys()


@pytest.mark.parametrize("block", [2048, 4])
def test_similar_users_equal_plain_loops(spark, cells, block):
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], "student_id string, course_id string, r double")
    sims = cosines(cells, 0)
    want = set()
    for i in {s for s, _ in cells}:
        ranked = sorted((-round(s, 6), y) for (x, y), s in sims.items() if x == i)[1:6]
        want |= {(i, y, k + 1) for k, (_, y) in enumerate(ranked)}
    assert {(r["student_id"], r["similar_id"], r["rank"]) for r in neighbours.similar_users(m, block=block).collect()} == want


@pytest.mark.parametrize("most_courses", [1000, 3])
def test_item_neighbours_equal_plain_loops(spark, cells, most_courses):
    """By the matrix of similarities and, for large catalogues, by joins."""
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], "student_id string, course_id string, r double")
    sims = cosines(cells, 1)
    want = {}
    for i in {s for s, _ in cells}:
        for j in {c for _, c in cells}:
            near = sorted((-round(sims[j, c], 9), c, r) for (s, c), r in cells.items() if s == i and c != j and (j, c) in sims)[:3]
            own = [r for (_, c), r in cells.items() if c == j]
            want[i, j] = sum(-s * r for s, _, r in near) / sum(-s for s, _, _ in near) if near else sum(own) / len(own)
    found = {(r["student_id"], r["course_id"]): r["score"] for r in rec.item_cf_scores(m, neighbours=3, most_courses=most_courses).collect()}
    assert found.keys() == want.keys() - cells.keys() and all(abs(found[k] - want[k]) < 2e-6 for k in found)
    pairs = spark.createDataFrame([("nobody", "c01"), ("s01", "no course"), ("s01", "c01")], "student_id string, course_id string")
    got = {(r["student_id"], r["course_id"]): r["score"] for r in rec.predicted_item_ratings(pairs, m).collect()}
    ratings = [r for (_, c), r in cells.items() if c == "c01"]
    assert abs(got["nobody", "c01"] - sum(ratings) / len(ratings)) < 2e-6 and got["s01", "no course"] == 0 and got["s01", "c01"] > 0


def test_ranges_are_numbered_in_order(spark):
    df = spark.createDataFrame([((k * 37) % 501, k) for k in range(501)], "a int, b int").repartition(7)
    assert [r["n"] for r in numbered(df, "n", ["a"]).orderBy("a").collect()] == list(range(1, 502))
    assert numbered(df.limit(0), "n", ["a"]).count() == 0


def test_learned_ranking_serves_all_students(spark, tmp_path):
    """Fifty customers were served before, and learned from."""
    from coursemill.plans import queries
    from coursemill.sources.adapter import Platform

    class Small(Platform):
        student = spark.createDataFrame([(f"S{k:07d}",) for k in range(60, 72)], "student_id string")
        course = spark.createDataFrame([(c, f"{c} spark", "X", "Beginner") for c in "abcdef"], "course_id string, title string, category string, difficulty string").withColumns({c: F.lit("t") for c in ("subcategory", "description", "tags")})
        rating = spark.createDataFrame([(f"S{k:07d}", "abcdef"[(k + i) % 6], float(1 + (k * i) % 5)) for k in range(60, 70) for i in range(3)], RATE)
        quiz = spark.createDataFrame([], "student_id string, course_id string, score_percentage double")
        enrollment = spark.createDataFrame([], "student_id string, course_id string, progress_percentage double")

    out = queries.learned_hybrid_topn(Small(spark, str(tmp_path)))
    assert {r["student_id"]: r["count"] for r in out.groupBy("student_id").count().collect()} == {f"S{k:07d}": 6 - sum((k * i) % 5 > 0 for i in range(3)) if k < 70 else 6 for k in range(60, 72)}  # a rating of 1 is a preference of 0: offered again


def test_content_path_and_rules(spark):
    courses = spark.createDataFrame([("a", "intro spark", "X", "Beginner", 4.0), ("b", "spark streaming", "X", "Advanced", 5.0), ("c", "cooking", "Y", "Beginner", 3.0), ("d", None, "X", "Beginner", 4.5)], "course_id string, title string, category string, difficulty string, rating double").withColumns({"duration_hours": F.lit(1), "prerequisites": F.lit("None")})
    sims = rec.content_similarity(rec.tfidf(rec.course_content(courses, ["title"]), []))
    assert abs({(r["a"], r["b"]): r["sim"] for r in sims.collect()}["a", "a"] - 1) < 1e-9
    seen = spark.createDataFrame([("u", "a")], "student_id string, course_id string")
    content = rec.content_scores(seen, sims, courses)
    assert [r["course_id"] for r in rec.recommendations(content).orderBy("rank").collect()] == ["b", "c", "d"]
    none = content.filter("false")
    hybrid = rec.hybrid_scores(content, none, seen)
    assert max(r["score"] for r in hybrid.collect()) == 0.4
    with pytest.raises(ValueError):
        rec.hybrid_scores(content, none, seen, weights=(0.0, 0.0))
    path = rec.learning_path(spark.createDataFrame([("u",), ("n",)], "student_id string"), seen, courses, "X", 2)
    assert [(r["student_id"], r["course_id"]) for r in path.orderBy("student_id", "path_order").collect()] == [("n", "d"), ("n", "a"), ("u", "d"), ("u", "b")]
    everything = courses.select(F.lit("u").alias("student_id"), "course_id")
    assert rec.content_scores(everything, sims, courses).count() == 0
    rows = lambda df: sorted((r["student_id"], r["course_id"], r["score"]) for r in df.collect())
    more = spark.createDataFrame([("u", "a"), ("v", "b"), ("v", "c"), ("w", "gone")], "student_id string, course_id string")
    assert rows(rec.content_scores(more, stash(sims, "sims"), courses)) == rows(rec.content_scores(more, stash(sims, "sims"), courses, most_courses=2))


def test_metrics(spark):
    courses = spark.createDataFrame([(c,) for c in "abcdef"], "course_id string")
    recs = spark.createDataFrame([("m", "u", c, k + 1) for k, c in enumerate("abc")], "model string, student_id string, course_id string, rank int")
    relevant = spark.createDataFrame([("u", "a"), ("u", "f"), ("w", "a")], "student_id string, course_id string")
    a, b = (evaluation.ranking_metrics(recs, relevant, courses, skip_empty=s).collect()[0] for s in (True, False))
    assert (a["evaluated_users"], a["precision_5"], a["recall_5"], a["coverage"]) == (1, 0.2, 0.5, 0.5)
    assert (b["evaluated_users"], b["precision_5"], b["recall_5"]) == (2, 0.1, 0.25)


def test_next_course_leaderboard(spark):
    """Students u0 to u3 like a and b and go on to c; n has nothing to learn from."""
    courses = spark.createDataFrame([(c, w, "X", "Beginner") for c, w in zip("abcdef", ("spark one", "spark two", "spark three", "cooking", "painting", "dancing"))], "course_id string, title string, category string, difficulty string")
    sims = rec.content_similarity(rec.tfidf(rec.course_content(courses, ["title"]), []))
    train = [(f"u{k}", c, "train", True, 50.0, 80.0, 0.9) for k in range(4) for c in "ab"] + [(f"v{k}", c, "train", True, 50.0, 80.0, 0.8) for k in range(4) for c in "abc"] + [("w", c, "train", False, 5.0, 10.0, 0.1) for c in "de"] + [("u0", "f", "post_cutoff", True, 0.0, 0.0, 0.9)]
    test = [(f"u{k}", "c", "test", True, 50.0, 80.0, 0.9) for k in range(4)] + [("n", "c", "test", True, 50.0, 80.0, 0.9), ("w", "f", "test", False, 1.0, 1.0, 0.1)]
    rows = spark.createDataFrame(train + test, "student_id string, course_id string, split_role string, positive_label boolean, enrollment_progress double, avg_quiz_score double, interaction_score double")
    out = evaluation.next_course_leaderboard(rows, courses, sims, trees=5).collect()
    board = {r["model"]: r for r in out}
    assert set(board) == {"content", "user_cf", "item_cf", "learned_hybrid"} and [r["f1_10"] for r in out] == sorted((r["f1_10"] for r in out), reverse=True)
    assert all(r["evaluated_users"] == 5 for r in out) and {m: board[m]["recall_10"] for m in board} == {"content": 0.8, "user_cf": 0.8, "item_cf": 0.8, "learned_hybrid": 1.0}
    assert board["user_cf"]["precision_5"] == 0.16 and board["user_cf"]["coverage"] == round(1 / 6, 6)


def test_holdout_counts(spark):
    rows = [(f"r{k}", s, f"c{k}", 4.0) for s, n in (("one", 1), ("two", 2), ("ten", 10)) for k in range(n)]
    out = evaluation.holdout(spark.createDataFrame(rows, "rating_id string, student_id string, course_id string, rating double"), 2).filter("is_test")
    assert {(r["fold"], r["student_id"]): r["count"] for r in out.groupBy("fold", "student_id").count().collect()} == {(f, s): n for f in (0, 1) for s, n in (("two", 1), ("ten", 2))}


def test_grades_and_clusters_need_rows(spark):
    rows = spark.createDataFrame([("q", *[1.0] * 10, 50.0)], "quiz_id string, " + ", ".join(f"{c} double" for c in ml.GRADE_FEATURES) + ", score_percentage double")
    assert ml.fit_grades(rows) is None
    assert one(ml.predict_grades(None, rows), "predicted_score") == 70.0
    few = spark.createDataFrame([("s", *[1.0] * 9)], "student_id string, " + ", ".join(f"{c} double" for c in ml.CLUSTER_FEATURES))
    assert one(ml.cluster_students(few), "profile") == "Visual Learner"
    assert [r["students"] for r in ml.cluster_distribution(ml.cluster_students(few)).orderBy("cluster").collect()] == [1, 0, 0, 0]


def test_fitted_grades(spark):
    rng = random.Random(2)
    data = [(f"q{k}", *[float(rng.randrange(100)) for _ in ml.GRADE_FEATURES]) for k in range(300)]
    rows = spark.createDataFrame([(*r, 0.8 * r[1] + 10) for r in data], "quiz_id string, " + ", ".join(f"{c} double" for c in ml.GRADE_FEATURES) + ", score_percentage double")
    out = ml.predict_grades(ml.fit_grades(rows, trees=20), rows).collect()
    mean = sum(r["score_percentage"] for r in out) / len(out)
    spread = sum((r["score_percentage"] - mean) ** 2 for r in out)
    assert sum((r["score_percentage"] - r["predicted_score"]) ** 2 for r in out) < 0.3 * spread and out[0]["factors"][0] == "avg_quiz_score"
    assert {r["confidence"] for r in out} == {"High", "Medium"} | ({"Low"} if any(r["time_spent_on_course"] == 0 and r["progress_percentage"] <= 50 for r in out) else set())
    assert set(r["band"] for r in serving.prediction_bands(ml.predict_grades(None, rows)).collect()) == {"warning"}


def test_fitted_clusters(spark):
    """Four kinds of students, far apart: one cluster each."""
    rng = random.Random(3)
    data = [(f"s{k:03d}", *[(100.0 * (k % 4 >> i % 2 & 1)) + rng.random() for i in range(len(ml.CLUSTER_FEATURES))]) for k in range(80)]
    rows = spark.createDataFrame(data, "student_id string, " + ", ".join(f"{c} double" for c in ml.CLUSTER_FEATURES))
    found = ml.cluster_students(rows, starts=3)
    by = {r["student_id"]: r["cluster"] for r in found.collect()}
    assert all(by[f"s{k:03d}"] == by[f"s{k % 4:03d}"] for k in range(80)) and len(set(by.values())) == 4
    shares = ml.cluster_distribution(found).collect()
    assert len(shares) == 4 and sum(r["students"] for r in shares) == 80 and all(r["percentage"] == 25.0 for r in shares)
    more = rows.select("student_id").union(spark.createDataFrame([("new",)], "student_id string"))
    profiles = {r["student_id"]: (r["cluster"], r["profile"]) for r in ml.student_profiles(more, found).collect()}
    assert profiles["new"] == (0, ml.PROFILES[0]) and profiles["s000"] == (by["s000"], ml.PROFILES[by["s000"]])


def test_preferences_of_zero_are_no_ratings(spark):
    train = spark.createDataFrame([("u", "a", 0.0, D("2024-01-01"), 5), ("u", "b", 0.5, D("2024-01-02"), 6), ("u", "b", 0.5, D("2024-01-02"), 6)], "student_id string, course_id string, preference_score double, recommend_event_date date, activity_progress int")
    assert [(r["course_id"], r["rating"]) for r in ml.train_inputs(train).collect()] == [("b", 3.0)] * 2
    (r,) = ml.train_activities(train).collect()
    assert (r["course_id"], r["activity_date"], r["progress_percentage"], r["activity_type"]) == ("b", D("2024-01-02"), 6, "clean_interaction")


def test_rating_errors_of_evaluated_students(spark):
    test = spark.createDataFrame([("u", "a", 4.0), ("w", "a", 1.0), ("w", "b", 1.0)], RATE)
    predicted = spark.createDataFrame([("u", "a", 3.0), ("w", "a", 4.0), ("w", "b", 0.0)], "student_id string, course_id string, score double")
    (r,) = evaluation.rating_errors(predicted, test, test.filter("rating >= 4")).collect()
    assert (r["predictions"], r["rmse"], r["mae"]) == (1, 1.0, 1.0)
    assert one(evaluation.rating_errors(predicted, test), "predictions") == 2


def test_summary_file(spark, tmp_path):
    evaluation.write_summary(spark.createDataFrame([("b", 1.0), ("a", 2.0)], "model string, f1 double"), str(tmp_path / "summary"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "summary")).collect()] == ["model,f1", "b,1.0", "a,2.0"]  # the order of the leaderboard


def test_store_and_mutations(spark, tmp_path):
    e = spark.createDataFrame([("E001", "s", "c", D("2024-01-01"), "dropped", 10.0, D("2024-01-02"))], tables.SCHEMAS["enrollments"])
    tables.write_csv(e.coalesce(1), str(tmp_path / "enrollments.csv"))
    store = tables.Store(spark, str(tmp_path))
    today = D("2024-02-02")
    again = serving.enroll(store["enrollments"], "s", "c", today)
    assert [(r["status"], r["last_accessed"]) for r in again.collect()] == [("active", today)]
    assert serving.enroll(again, "s", "c", today).count() == 1
    more = serving.enroll(again, "s", "d", today)
    assert sorted(r["enrollment_id"] for r in more.collect()) == ["E001", "E002"]
    assert {r["status"] for r in serving.unenroll(more, "s", "c").collect()} == {"dropped", "active"}
    modules = spark.createDataFrame([("M001", "d")], "module_id string, course_id string")
    progress = spark.createDataFrame([], tables.SCHEMAS["module_progress"])
    progress, more = serving.complete_module(progress, modules, more, "s", "M001", today)
    assert {r["course_id"]: (r["progress_percentage"], r["status"]) for r in more.collect()}["d"] == (100.0, "completed")
    assert one(progress, "progress_id") == "P001"
    students = serving.register(spark.createDataFrame([], tables.SCHEMAS["students"]), today, name="Ä", preferred_difficulty="Beginner")
    assert one(students, "student_id") == "S001" and one(students, "preferred_difficulty") == "Beginner"
    quizzes = serving.save_quiz(spark.createDataFrame([], tables.SCHEMAS["quiz_results"]), "s", "c", "t", 2, 3, 5, today)
    quizzes = serving.save_quiz(quizzes, "s", "c", "t", 3, 3, 5, today)
    assert sorted((r["attempts"], r["score_percentage"], r["passed"]) for r in quizzes.collect()) == [(1, 66.7, True), (2, 100.0, True)]
    assert store.fit("n", lambda s: s["enrollments"].count()) == 1
    store.reload()
    assert not store.tables and not store.fitted


def test_versions_and_appends(spark, tmp_path):
    e = spark.createDataFrame([("E001", "s", "c", D("2024-01-01"), "dropped", 10.0, D("2024-01-02"))], tables.SCHEMAS["enrollments"])
    tables.write_csv(e, str(tmp_path / "enrollments.csv"))
    store = tables.Store(spark, str(tmp_path))
    store.append("enrollments", e.select(*reversed(e.columns)).withColumn("enrollment_id", F.lit("E002")))
    assert store["enrollments"].count() == 2 and store.counts() == {"enrollments": 2}
    path = store.save("enrollments", serving.enroll(store["enrollments"], "s", "d", D("2024-02-02")))
    assert path != str(tmp_path / "enrollments.csv") and store["enrollments"].count() == 3 and spark.table("enrollments").count() == 3
    assert sorted(r["course_id"] for r in store["enrollments"].collect()) == ["c", "c", "d"]


def test_dates_strict_or_not(spark):
    df = spark.createDataFrame([("2024-01-05",), ("soon",), (None,)], "d string")
    assert [r["x"] for r in df.select(tables.parsed_date("d").alias("x")).collect()] == [D("2024-01-05"), None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(tables.parsed_date("d", strict=True).alias("x")).collect()


def test_minutes_between(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, 0), datetime(2024, 1, 1, 10, 7, 59))], "a timestamp, b timestamp")
    assert one(df.select(serving.minutes_between(F.col("a"), F.col("b")).alias("m")), "m") == 7


def test_cleaned_and_published_tables(spark, tmp_path):
    """The whole job on a small platform, written, read and published."""
    students = spark.createDataFrame([(f"s{k}", "n", "e", 20, "U", "m", D("2024-01-03"), "Visual", "Beginner", 1, 50.0, 2.0) for k in range(6)], tables.SCHEMAS["students"])
    ratings = spark.createDataFrame([(f"r{k}", f"s{k % 6}", f"c{k % 4}", D("2024-02-01"), float(1 + k % 5), "", 1.0, 1.0, 1.0, True) for k in range(24)], tables.SCHEMAS["ratings"])
    enrollments = spark.createDataFrame([(f"e{k}", f"s{k}", "c0", D("2024-01-10"), "active", 10.0 * k, D("2024-04-20")) for k in range(6)], tables.SCHEMAS["enrollments"])
    quizzes = spark.createDataFrame([("q0", "s0", "c0", D("2024-01-20"), "t", 10, 8, 80.0, 9, 1, True)], tables.SCHEMAS["quiz_results"])
    logs = spark.createDataFrame([("l0", "s0", "c0", "video_watch", D("2024-01-15"), 30, 20, 1, True, False, False)], tables.SCHEMAS["activity_logs"])
    job = curation.curate(students, ratings, enrollments, quizzes, logs)
    summary = curation.curation_summary(job["ratings"], job["enrollments"], job["quizzes"], job["interactions"])
    tables.write_cleaned(job, str(tmp_path / "cleaned"), summary)
    back = tables.read_cleaned(spark, str(tmp_path / "cleaned"))
    n = back["interactions"].count()
    assert n == job["interactions"].count() and back["train"].count() + back["test"].count() <= n and back["test"].count() > 0
    assert '"ratings":24' in one(spark.read.text(str(tmp_path / "cleaned" / "curation_summary")), "value")
    publishing.publish(back, str(tmp_path / "data"))
    store = tables.Store(spark, str(tmp_path / "data"))
    assert {t: store[t].columns for t in ("students", "ratings", "enrollments", "quiz_results", "activity_logs")} == {t: [c.split()[0] for c in tables.SCHEMAS[t].split(", ")] for t in ("students", "ratings", "enrollments", "quiz_results", "activity_logs")}
    assert store["students"].count() == 6 and store["activity_logs"].count() >= n and max(r["last_accessed"] for r in store["enrollments"].collect()) == D("2024-03-31")


def test_lists_and_documents(spark):
    events = spark.createDataFrame([("u", "b", D("2024-01-02")), ("u", "a", D("2024-01-03")), ("u", "b", D("2024-01-04")), ("v", "a", None)], "student_id string, course_id string, d date")
    lists = lambda **x: {r["student_id"]: r["courses"] for r in serving.history_lists(events, ["d"], **x).collect()}
    assert lists() == {"u": ["b", "a"], "v": ["a"]} and lists(distinct=False) == {"u": ["b", "a", "b"], "v": ["a"]}
    recs = spark.createDataFrame([("u", "b", 2, 0.5), ("u", "a", 1, 0.75)], "student_id string, course_id string, rank int, score double")
    assert one(serving.json_lists(recs, "student_id", "items", "rank", ["course_id", "score"]), "json") == '{"student_id":"u","items":[{"course_id":"a","score":0.75},{"course_id":"b","score":0.5}]}'
    courses = spark.createDataFrame([("c", "A title that is longer than thirty characters", "Advanced", "x  y", 1234567)], "course_id string, title string, difficulty string, tags string, total_enrollments int")
    r = serving.course_badges(courses).collect()[0]
    assert (r["badge"], r["tags"], r["short_title"], r["enrollments"]) == ("danger", ["x", "y"], "A title that is longer than th...", "1,234,567")


def test_chosen_option(spark):
    q = spark.createDataFrame([("q1", "c", "t", "A", "one", "two", "three", "four", 2), ("q2", "c", "t", "D", "one", "two", "three", "four", 1)], "question_id string, course_id string, quiz_title string, correct_answer string, option_a string, option_b string, option_c string, option_d string, points int")
    a = spark.createDataFrame([("x", "c", "t", "q1", "D")], "sitting string, course_id string, quiz_title string, question_id string, answer string")
    out = {r["question_id"]: (r["answer"], r["given_text"], r["correct_text"]) for r in serving.quiz_review(q, a).collect()}
    assert out == {"q1": ("D", "four", "one"), "q2": ("", None, "four")}


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question_id,course_id,quiz_title,question_number,question_text,option_a,option_b,option_c,option_d,correct_answer,difficulty,points\nQ1,C1,"a, b",1,"say ""hi""",w,x,y,z,A,None,x\n')
    (r,) = tables.read_csv(spark, str(tmp_path / "q.csv"), tables.SCHEMAS["quiz_questions"]).collect()
    assert (r["quiz_title"], r["question_text"], r["difficulty"], r["points"]) == ("a, b", 'say "hi"', "None", None)


def test_sinks(spark, tmp_path):
    row = spark.createDataFrame([(1, 2, 3, None)], "ratings int, tier_strong int, split_train int, note string")
    tables.write_json(tables.as_summary(row), str(tmp_path / "s"))
    assert one(spark.read.text(str(tmp_path / "s")), "value") == '{"ratings":1,"note":null,"signal_tiers":{"strong":2},"split_roles":{"train":3}}'
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "k string, split_role string")
    tables.write_split(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("split_role = 'test'").count() == 1


def test_search_by_pattern(spark):
    courses = spark.createDataFrame([("a", "Learn C++", None), ("b", "Cooking", "with spark"), ("c", None, None)], "course_id string, title string, description string")
    assert {r["course_id"] for r in serving.catalog(courses, search=r"c\+\+|SPARK").collect()} == {"a", "b"}
    assert serving.catalog(courses).count() == 3


def test_queries_run_the_whole_models(monkeypatch):
    """Forests and k-means as large as the reference's, so with the operators' own defaults."""
    import inspect
    from unittest.mock import MagicMock

    from coursemill.plans import queries

    for query, operator, parameter, whole in ((queries.learned_hybrid_topn, "learned_rankings", "trees", 300), (queries.grade_predictions, "fit_grades", "trees", 100), (queries.clusters, "cluster_students", "starts", 10)):
        signature, seen = inspect.signature(getattr(ml, operator)), []

        class Stop(Exception):
            pass

        def spy(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append(bound.arguments[parameter])
            raise Stop

        monkeypatch.setattr(ml, operator, spy)
        for module, name in ((queries, "stash"), (queries, "_train"), (queries, "_sims"), (queries, "grade_features"), (queries.rec, "rating_matrix"), (ml, "train_inputs"), (ml, "cluster_features")):
            monkeypatch.setattr(module, name, MagicMock())
        platform = MagicMock()
        platform.kept.side_effect = platform.kept_model.side_effect = lambda label, tables, build, *rest: build()
        with pytest.raises(Stop):
            query(platform)
        assert seen == [whole]


def test_entry_has_a_query_for_every_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
