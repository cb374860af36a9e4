"""SQL for DuckDB, under the names of queries.py. Written apart from the operators, from what they are to compute."""

from __future__ import annotations

from coursemill.plans.queries import ACTOR, CATEGORY, CHOSEN_COURSE, CHOSEN_MODULE, FOLDS, STOP_WORDS, TODAY
from coursemill.sources.adapter import with_tables

_CLIP = "CASE WHEN {0} IS NULL THEN NULL ELSE greatest({1}, least({2}, {0})) END"


def clip(x: str, low: object, high: object) -> str:
    return _CLIP.format(x, low, high)


def fraction(*parts: str) -> str:
    """stable_fraction of columns and quoted texts."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"


def even(x: str) -> str:
    return f"round_even({x}, 0)::INTEGER"


def spread(lower: str, upper: str, *parts: str) -> str:
    low = f"greatest(coalesce({lower}, DATE '2024-01-01'), DATE '2024-01-01')"
    high = f"greatest(least(coalesce({upper}, DATE '2024-03-31'), DATE '2024-03-31'), {low})"
    return f"({low} + {even(f'{fraction(*parts)} * (({high}) - ({low}))')})"


LEVEL = "CASE c.difficulty WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 WHEN 'Advanced' THEN 3 END"

# --- cleaned tables, shared by several queries ---
CLEAN = {
    "student": f"SELECT * REPLACE ({clip('age', 16, 60)} AS age) FROM student",
    "course": f"SELECT * REPLACE ({clip('rating', 0, 5)} AS rating, {clip('completion_rate', 0, 100)} AS completion_rate) FROM course",
    "activity": f"SELECT * REPLACE (greatest(time_spent_minutes, 0) AS time_spent_minutes, {clip('progress_percentage', 0, 100)} AS progress_percentage) FROM activity",
    "quiz": f"SELECT * REPLACE ({clip('score_percentage', 0, 100)} AS score_percentage, least(correct_answers, total_questions) AS correct_answers) FROM quiz",
    "rating": "SELECT * REPLACE (" + ", ".join(f"{clip(c, 1, 5)} AS {c}" for c in ("rating", "difficulty_rating", "content_quality", "instructor_rating")) + ") FROM rating",
}


def _star() -> dict[str, str]:
    out = {}
    for table, name in (("student", "clean_students"), ("course", "clean_courses"), ("activity", "clean_activity"), ("quiz", "clean_quiz"), ("rating", "clean_ratings")):
        out[name] = with_tables(CLEAN[table], table)
    out["dim_time"] = with_tables(
        """SELECT row_number() OVER (ORDER BY date)::INTEGER AS time_key, date, day(date)::INTEGER AS day, month(date)::INTEGER AS month, year(date)::INTEGER AS year, quarter(date)::INTEGER AS quarter,
  (isodow(date) - 1)::INTEGER AS day_of_week, weekofyear(date)::INTEGER AS week_of_year, isodow(date) >= 6 AS is_weekend
FROM (SELECT activity_date AS date FROM activity UNION SELECT quiz_date FROM quiz UNION SELECT rating_date FROM rating) WHERE date IS NOT NULL""",
        "activity", "quiz", "rating",
    )
    out["dim_user"] = with_tables(
        f"""SELECT s.*, CASE WHEN total_courses_completed < 5 THEN 'Beginner' WHEN total_courses_completed < 15 THEN 'Intermediate' ELSE 'Advanced' END AS experience_level,
  CASE WHEN avg_quiz_score < 60 THEN 'Low' WHEN avg_quiz_score < 80 THEN 'Medium' ELSE 'High' END AS performance_tier, row_number() OVER (ORDER BY student_id)::INTEGER AS user_key FROM ({CLEAN["student"]}) s""",
        "student",
    )
    out["dim_course"] = with_tables(
        f"""SELECT c.*, {LEVEL} AS difficulty_level, CASE WHEN total_enrollments <= q1 THEN 'Low' WHEN total_enrollments <= q2 THEN 'Medium' ELSE 'High' END AS popularity_tier, row_number() OVER (ORDER BY course_id)::INTEGER AS course_key
FROM ({CLEAN["course"]}) c, (SELECT quantile_cont(total_enrollments::DOUBLE, 1.0 / 3) AS q1, quantile_cont(total_enrollments::DOUBLE, 2.0 / 3) AS q2 FROM course)""",
        "course",
    )
    n = lambda c: f"sum({c}::INTEGER)::BIGINT"
    out["fact_learning"] = with_tables(f"SELECT student_id, course_id, sum(time_spent_minutes)::BIGINT AS total_time_minutes, max(progress_percentage) AS max_progress, max(module_completed) AS modules_completed, {n('video_watched')} AS videos_watched, {n('notes_taken')} AS notes_count, {n('resources_downloaded')} AS resources_count FROM ({CLEAN['activity']}) GROUP BY ALL", "activity")
    out["fact_quiz"] = with_tables(f"SELECT student_id, course_id, round(avg(score_percentage), 6) AS avg_score, sum(time_taken_minutes)::BIGINT AS total_time, sum(attempts)::BIGINT AS total_attempts, {n('passed')} AS quizzes_passed, count(quiz_id) AS total_quizzes FROM ({CLEAN['quiz']}) GROUP BY ALL", "quiz")
    out["fact_rating"] = with_tables("SELECT student_id, course_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("rating", "difficulty_rating", "content_quality", "instructor_rating")) + f", bool_or(would_recommend) AS would_recommend FROM ({CLEAN['rating']}) GROUP BY ALL", "rating")
    star = ("fact_learning", "fact_quiz", "fact_rating", "dim_user", "dim_course")
    sources = {"fact_learning": "activity", "fact_quiz": "quiz", "fact_rating": "rating", "dim_user": "student", "dim_course": "course"}
    pairs = {t: "(SELECT DISTINCT student_id, course_id FROM " + sources[t] + ")" if t.startswith("fact") else sources[t] for t in star}
    dates = "(SELECT activity_date AS d FROM activity UNION SELECT quiz_date FROM quiz UNION SELECT rating_date FROM rating) WHERE d IS NOT NULL"
    out["warehouse_counts"] = with_tables(" UNION ALL ".join([f"SELECT 'dim_time' AS \"table\", count(*) AS rows FROM {dates}", *[f"SELECT '{t}', count(*) FROM {pairs[t]}" for t in star]]), "student", "course", "activity", "quiz", "rating")
    return out


TOPIC = """seen AS (SELECT student_id, category, sum(time_spent_minutes)::BIGINT AS time_spent_minutes, count(*) AS activity_count FROM activity JOIN course USING (course_id) GROUP BY ALL),
rated AS (SELECT student_id, category, avg(r.rating) AS rating FROM rating r JOIN course USING (course_id) GROUP BY ALL),
both_ AS (SELECT student_id, category, coalesce(time_spent_minutes, 0)::BIGINT AS time_spent_minutes, coalesce(activity_count, 0)::BIGINT AS activity_count, coalesce(rating, 0) AS rating FROM seen FULL JOIN rated USING (student_id, category)),
topic AS (SELECT student_id, category, time_spent_minutes, activity_count, round(rating, 6) AS rating,
  round(0.4 * (CASE WHEN mt > 0 THEN time_spent_minutes / mt ELSE 0 END) + 0.3 * (CASE WHEN ma > 0 THEN activity_count / ma ELSE 0 END) + 0.3 * (CASE WHEN mr > 0 THEN rating / mr ELSE 0 END), 6) AS interest_score
  FROM both_, (SELECT max(time_spent_minutes)::DOUBLE AS mt, max(activity_count)::DOUBLE AS ma, max(rating) AS mr FROM both_))"""
CONSISTENCY = """daily AS (SELECT student_id, activity_date, sum(time_spent_minutes)::BIGINT AS minutes FROM activity GROUP BY ALL),
spread_ AS (SELECT student_id, avg(minutes) AS m, coalesce(stddev_samp(minutes), 0) AS s, count(minutes) AS active_days FROM daily GROUP BY ALL),
consistency AS (SELECT student_id, round(m, 6) AS avg_daily_time, round(s, 6) AS daily_time_std, active_days, round(CASE WHEN top > 0 THEN 1 - s / top ELSE 1 END, 6) AS consistency_score FROM spread_, (SELECT max(s) AS top FROM spread_))"""
PERFORMANCE = """performance AS (SELECT student_id, round(avg(score_percentage), 6) AS overall_avg_score, round(coalesce(stddev_samp(score_percentage), 0), 6) AS score_volatility, min(score_percentage) AS min_score, max(score_percentage) AS max_score,
  round(avg(passed::INTEGER), 6) AS pass_rate, round(avg(attempts), 6) AS avg_attempts FROM quiz GROUP BY ALL)"""
ADVICE = """levels AS (SELECT student_id, round(coalesce(avg(score_percentage) FILTER (difficulty = 'Beginner'), 0), 6) AS beginner, round(coalesce(avg(score_percentage) FILTER (difficulty = 'Intermediate'), 0), 6) AS intermediate,
  round(coalesce(avg(score_percentage) FILTER (difficulty = 'Advanced'), 0), 6) AS advanced FROM quiz JOIN course USING (course_id) GROUP BY ALL),
advice AS (SELECT *, CASE WHEN advanced >= 80 THEN 'Advanced' WHEN intermediate >= 75 OR advanced >= 65 THEN 'Advanced' WHEN beginner >= 75 OR intermediate >= 65 THEN 'Intermediate' ELSE 'Beginner' END AS recommended_difficulty FROM levels)"""
# The categories of part.p_type.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _features() -> dict[str, str]:
    acr, qc = ("activity", "course", "rating"), ("quiz", "course")
    return {
        "topic_interest": with_tables("SELECT * FROM topic", *acr, more=TOPIC),
        "topic_interest_pivot": with_tables("SELECT student_id, " + ", ".join(f"round(coalesce(avg(interest_score) FILTER (category = '{c}'), 0), 6) AS {c.lower()}" for c in CATEGORIES) + " FROM topic GROUP BY student_id", *acr, more=TOPIC),
        "completion_rate": with_tables(
            """SELECT student_id, course_id, progress_percentage, round(m, 6) AS module_completion_rate, round(coalesce(p, 0), 6) AS quiz_pass_rate, round(0.5 * (progress_percentage / 100) + 0.3 * m + 0.2 * coalesce(p, 0), 6) AS weighted_completion
FROM (SELECT student_id, course_id, max(progress_percentage) AS progress_percentage, least(greatest(max(module_completed) / greatest(floor(any_value(duration_hours) / 5), 1), 0), 1) AS m FROM activity JOIN course USING (course_id) GROUP BY ALL)
LEFT JOIN (SELECT student_id, course_id, sum(passed::INTEGER)::DOUBLE / count(quiz_id) AS p FROM quiz GROUP BY ALL) USING (student_id, course_id)""",
            "activity", "quiz", "course",
        ),
        "quiz_perf_category": with_tables(
            f"""SELECT student_id, category, round(a, 6) AS avg_score, round(s, 6) AS score_std, n AS quiz_count, round(l, 6) AS avg_difficulty, round(least(greatest(a * (1 + 0.1 * (l - 1)), 0), 100), 6) AS adjusted_score
FROM (SELECT student_id, category, avg(score_percentage) AS a, coalesce(stddev_samp(score_percentage), 0) AS s, count(*) AS n, avg({LEVEL}) AS l FROM quiz JOIN course c USING (course_id) GROUP BY ALL)""",
            *qc,
        ),
        "quiz_perf_student": with_tables("SELECT * FROM performance", "quiz", more=PERFORMANCE),
        "time_per_course": with_tables(
            """SELECT student_id, course_id, t AS total_time, round(a, 6) AS avg_session_time, n AS session_count, duration_hours, duration_hours * 60 AS expected_time_minutes,
  round(CASE WHEN duration_hours = 0 THEN NULL ELSE least(greatest(t / (duration_hours * 60), 0), 2) END, 6) AS time_efficiency
FROM (SELECT student_id, course_id, sum(time_spent_minutes)::BIGINT AS t, avg(time_spent_minutes) AS a, count(*) AS n FROM activity GROUP BY ALL) JOIN course USING (course_id)""",
            "activity", "course",
        ),
        "learning_consistency": with_tables("SELECT * FROM consistency", "activity", more=CONSISTENCY),
        "difficulty_performance": with_tables("SELECT student_id, difficulty, round(avg(score_percentage), 6) AS avg_score, round(avg(passed::INTEGER), 6) AS pass_rate, count(quiz_id) AS quiz_count FROM quiz JOIN course USING (course_id) GROUP BY ALL", *qc),
        "difficulty_pref": with_tables("SELECT * FROM advice", *qc, more=ADVICE),
        "student_features": with_tables(
            "SELECT student_id, learning_style, preferred_difficulty, avg_quiz_score, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("overall_avg_score", "score_volatility", "min_score", "max_score", "pass_rate", "avg_attempts", "avg_daily_time", "daily_time_std", "active_days", "consistency_score"))
            + ", coalesce(recommended_difficulty, '0') AS recommended_difficulty FROM student LEFT JOIN performance USING (student_id) LEFT JOIN consistency USING (student_id) LEFT JOIN (SELECT student_id, recommended_difficulty FROM advice) USING (student_id)",
            "student", "quiz", "activity", "course", more=f"{PERFORMANCE}, {CONSISTENCY}, {ADVICE}",
        ),
    }


_P = ("student_id", "course_id")
CANDIDATES = f"""cand AS (SELECT r.student_id, r.course_id, e.student_id IS NOT NULL AS has_enroll, q.student_id IS NOT NULL AS has_quiz, s.enrollment_date AS student_start,
  CASE WHEN least(r.d, DATE '2024-03-31') < DATE '2024-01-01' THEN DATE '2024-03-31' ELSE least(r.d, DATE '2024-03-31') END AS upper, {fraction("r.student_id", "r.course_id", "'support_signal'")} AS f
  FROM (SELECT student_id, course_id, max(rating_date) AS d FROM rating GROUP BY ALL HAVING max(rating) >= 4) r
  LEFT JOIN (SELECT DISTINCT student_id, course_id FROM enrollment) e ON r.student_id = e.student_id AND r.course_id = e.course_id LEFT JOIN (SELECT DISTINCT student_id, course_id FROM quiz) q ON r.student_id = q.student_id AND r.course_id = q.course_id
  LEFT JOIN student s ON r.student_id = s.student_id WHERE e.student_id IS NULL OR q.student_id IS NULL)"""
SYNTH = f"""synth_e0 AS (SELECT student_id, course_id, upper, (35 + {even(fraction(*_P, "'progress'") + " * 45")})::DOUBLE AS progress_percentage, {spread("student_start", "upper - 7", *_P, "'enroll_date'")} AS enrollment_date FROM cand WHERE NOT has_enroll AND f < 0.55),
synth_e AS (SELECT student_id, course_id, enrollment_date, greatest(least(enrollment_date + 7 + floor(progress_percentage / 10)::INTEGER, DATE '2024-03-31', upper), enrollment_date) AS last_accessed,
  CASE WHEN progress_percentage >= 80 THEN 'completed' ELSE 'active' END AS status, progress_percentage, TRUE AS synthetic_generated,
  'SE' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS enrollment_id FROM (SELECT *, (SELECT count(*) FROM enrollment) + row_number() OVER (ORDER BY student_id, course_id) AS k FROM synth_e0)),
synth_q0 AS (SELECT student_id, course_id, {spread("student_start", "upper - 1", *_P, "'quiz_date'")} AS quiz_date, 20 + {even(fraction(*_P, "'quiz_total'") + " * 10")} AS total_questions, (72 + {even(fraction(*_P, "'quiz_score'") + " * 23")})::DOUBLE AS score_percentage,
  18 + {even(fraction(*_P, "'quiz_time'") + " * 17")} AS time_taken_minutes, CASE WHEN {fraction(*_P, "'quiz_attempts'")} > 0.35 THEN 1 ELSE 2 END AS attempts FROM cand WHERE NOT has_quiz AND f >= 0.25),
synth_q AS (SELECT student_id, course_id, quiz_date, 'Synthetic Mastery Check' AS quiz_title, total_questions, score_percentage, time_taken_minutes, attempts, TRUE AS passed, TRUE AS synthetic_generated, {even("total_questions * score_percentage / 100")} AS correct_answers,
  'SQ' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS quiz_id FROM (SELECT *, (SELECT count(*) FROM quiz) + row_number() OVER (ORDER BY student_id, course_id) AS k FROM synth_q0))"""


def strengthened(enrollments: str, quizzes: str) -> str:
    return f"""SELECT e.* REPLACE (CASE WHEN g.student_id IS NULL THEN e.progress_percentage ELSE greatest(e.progress_percentage, (35 + {even(fraction("e.student_id", "e.course_id", "'progress_bump'") + " * 30")})::DOUBLE) END AS progress_percentage,
    CASE WHEN g.student_id IS NOT NULL AND e.status = 'dropped' THEN 'active' ELSE e.status END AS status)
  FROM {enrollments} e LEFT JOIN (SELECT DISTINCT w.student_id, w.course_id FROM {enrollments} w
    LEFT JOIN (SELECT student_id, course_id, avg(score_percentage) AS score FROM {quizzes} GROUP BY ALL) q ON w.student_id = q.student_id AND w.course_id = q.course_id
    LEFT JOIN (SELECT student_id, course_id, max(rating) AS top FROM rating GROUP BY ALL) r ON w.student_id = r.student_id AND w.course_id = r.course_id
    WHERE w.progress_percentage BETWEEN 1 AND 30 AND (coalesce(top, 0) >= 4 OR coalesce(score, 0) > 70)) g ON e.student_id = g.student_id AND e.course_id = g.course_id"""


_END = "DATE '2024-03-31'"
CURATED = f"""{CANDIDATES.replace("s.enrollment_date AS student_start", f"least(s.enrollment_date, {_END}) AS student_start")}, {SYNTH},
all_q AS (SELECT *, FALSE AS synthetic_generated FROM quiz UNION ALL BY NAME SELECT * FROM synth_q),
all_e AS (SELECT *, FALSE AS synthetic_generated FROM enrollment UNION ALL BY NAME SELECT * FROM synth_e),
cur_e AS (SELECT x.*, least(enrollment_date, {_END}) AS enrollment_date_clean, least(last_accessed, {_END}) AS last_accessed_clean FROM ({strengthened("all_e", "all_q")}) x),
cur_q AS (SELECT *, least(quiz_date, {_END}) AS quiz_date_clean FROM all_q),
cur_a AS (SELECT *, least(activity_date, {_END}) AS activity_date_clean FROM activity),
bounds AS (SELECT r.*, greatest(coalesce(least(s.enrollment_date, {_END}), DATE '2024-01-01'), coalesce(e.lo, DATE '1900-01-01'), coalesce(q.d, DATE '1900-01-01'), coalesce(a.d, DATE '1900-01-01')) AS lb, least(coalesce(e.hi, {_END}), {_END}) AS ub0
  FROM rating r LEFT JOIN student s ON r.student_id = s.student_id
  LEFT JOIN (SELECT student_id, course_id, min(enrollment_date_clean) AS lo, max(last_accessed_clean) AS hi FROM cur_e GROUP BY ALL) e ON r.student_id = e.student_id AND r.course_id = e.course_id
  LEFT JOIN (SELECT student_id, course_id, max(quiz_date_clean) AS d FROM cur_q GROUP BY ALL) q ON r.student_id = q.student_id AND r.course_id = q.course_id
  LEFT JOIN (SELECT student_id, course_id, max(activity_date_clean) AS d FROM cur_a GROUP BY ALL) a ON r.student_id = a.student_id AND r.course_id = a.course_id),
limits AS (SELECT *, greatest(lb, DATE '2024-01-01') AS low, greatest(least(greatest(ub0, lb), {_END}), greatest(lb, DATE '2024-01-01')) AS high FROM bounds),
cur_r AS (SELECT * EXCLUDE (lb, ub0, low, high), CASE WHEN rating_date < low OR rating_date > high OR rating_date > {_END} THEN {spread("low", "high", "student_id", "course_id", "rating_id", "'rating_clean'")} ELSE rating_date END AS rating_date_clean,
  CASE WHEN rating >= 4 THEN 0.70::DOUBLE WHEN rating = 3 THEN 0.30::DOUBLE ELSE 0.10::DOUBLE END AS rating_signal_weight FROM limits)"""
INTERACTIONS = """ra AS (SELECT student_id, course_id, avg(rating) AS rating_mean, max(rating) AS rating_max, count(rating) AS rating_count, max(rating_date_clean) AS rating_date_clean, avg(would_recommend::INTEGER) AS would_recommend_rate FROM cur_r GROUP BY ALL),
ea AS (SELECT student_id, course_id, min(enrollment_date_clean) AS enrollment_date_clean, max(last_accessed_clean) AS last_accessed_clean, max(progress_percentage) AS enrollment_progress, arg_max(status, enrollment_id) AS enrollment_status FROM cur_e GROUP BY ALL),
qa AS (SELECT student_id, course_id, avg(score_percentage) AS avg_quiz_score, max(score_percentage) AS max_quiz_score, sum(attempts)::BIGINT AS quiz_attempts, avg(passed::INTEGER) AS quiz_pass_rate, max(quiz_date_clean) AS quiz_date_clean FROM cur_q GROUP BY ALL),
aa AS (SELECT student_id, course_id, count(log_id) AS activity_count, sum(time_spent_minutes)::BIGINT AS total_time_spent, max(progress_percentage)::BIGINT AS activity_progress, max(activity_date_clean) AS activity_date_clean FROM cur_a GROUP BY ALL),
pairs AS (SELECT student_id, course_id FROM ra UNION SELECT student_id, course_id FROM ea UNION SELECT student_id, course_id FROM qa UNION SELECT student_id, course_id FROM aa),
i0 AS (SELECT student_id, course_id, coalesce(rating_mean, 0) AS rating_mean, coalesce(rating_max, 0) AS rating_max, coalesce(rating_count, 0) AS rating_count, rating_date_clean, coalesce(would_recommend_rate, 0) AS would_recommend_rate,
  enrollment_date_clean, last_accessed_clean, coalesce(enrollment_progress, 0) AS enrollment_progress, enrollment_status, coalesce(avg_quiz_score, 0) AS avg_quiz_score, coalesce(max_quiz_score, 0) AS max_quiz_score, coalesce(quiz_attempts, 0) AS quiz_attempts,
  coalesce(quiz_pass_rate, 0) AS quiz_pass_rate, quiz_date_clean, coalesce(activity_count, 0) AS activity_count, coalesce(total_time_spent, 0) AS total_time_spent, coalesce(activity_progress, 0) AS activity_progress, activity_date_clean,
  least(s.enrollment_date, DATE '2024-03-31') AS student_enrollment_date_clean, enrollment_date_clean IS NOT NULL AS has_enrollment, rating_date_clean IS NOT NULL AS has_rating, quiz_date_clean IS NOT NULL AS has_quiz, activity_date_clean IS NOT NULL AS has_activity
  FROM pairs LEFT JOIN ra USING (student_id, course_id) LEFT JOIN ea USING (student_id, course_id) LEFT JOIN qa USING (student_id, course_id) LEFT JOIN aa USING (student_id, course_id) LEFT JOIN (SELECT student_id, enrollment_date FROM student) s USING (student_id)),
i1 AS (SELECT *, has_enrollment AND enrollment_progress > 30 AS strong_enroll_progress, rating_max >= 4 AS high_rating, avg_quiz_score > 70 AS high_quiz, has_enrollment AND NOT (enrollment_progress > 30) AS weak_enroll, has_activity AS weak_activity FROM i0),
i2 AS (SELECT *, strong_enroll_progress::INTEGER::DOUBLE + 0.70 * high_rating::INTEGER + 0.45 * high_quiz::INTEGER + (CASE WHEN weak_enroll THEN 0.10 + 0.15 * (least(greatest(enrollment_progress, 0), 30) / 30) ELSE 0 END)
  + (CASE WHEN weak_activity THEN 0.03 + 0.04 * least(activity_count, 5) / 5 + 0.03 * least(greatest(activity_progress, 0), 30) / 30 ELSE 0 END) + 0.05 * (would_recommend_rate >= 0.5)::INTEGER AS raw_interaction_score,
  CASE WHEN strong_enroll_progress THEN 'strong' WHEN high_rating THEN 'medium' WHEN high_quiz THEN 'supportive' ELSE 'weak' END AS signal_tier, strong_enroll_progress OR high_rating OR high_quiz AS positive_label,
  concat_ws('|', CASE WHEN has_enrollment THEN 'enrollment' END, CASE WHEN has_rating THEN 'rating' END, CASE WHEN has_quiz THEN 'quiz' END, CASE WHEN has_activity THEN 'activity' END) AS evidence_sources,
  least(rating_date_clean, enrollment_date_clean, last_accessed_clean, quiz_date_clean, activity_date_clean) AS first_event_date, greatest(rating_date_clean, enrollment_date_clean, last_accessed_clean, quiz_date_clean, activity_date_clean) AS last_event_date FROM i1),
inter AS (SELECT *, least(greatest(raw_interaction_score / 2.55, 0), 1) AS interaction_score FROM i2),
last_ AS (SELECT student_id, course_id AS test_course, last_event_date AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY last_event_date DESC, round(interaction_score, 9) DESC, course_id DESC) AS k, count(*) OVER (PARTITION BY student_id) AS n FROM inter WHERE positive_label AND last_event_date IS NOT NULL) WHERE k = 1 AND n >= 2),
split_ AS (SELECT i.*, cutoff AS recommendation_cutoff, CASE WHEN course_id = test_course AND last_event_date = cutoff THEN 'test' WHEN last_event_date >= cutoff THEN 'post_cutoff' ELSE 'train' END AS split_role FROM inter i LEFT JOIN last_ USING (student_id))"""
DENSE = f"""d0 AS (SELECT *, last_event_date - first_event_date AS span, greatest(enrollment_progress, activity_progress)::DOUBLE AS reached, CASE WHEN total_time_spent > 0 THEN total_time_spent::DOUBLE ELSE 20 + 80 * {fraction(*_P, "'time'")} END AS minutes,
  CASE signal_tier WHEN 'strong' THEN 4 WHEN 'medium' THEN 3 ELSE CASE WHEN has_enrollment OR has_quiz OR has_activity THEN 2 ELSE 1 END END AS n0 FROM inter WHERE first_event_date IS NOT NULL),
d1 AS (SELECT *, CASE WHEN signal_tier = 'strong' AND reached < 45 THEN 45 WHEN signal_tier = 'medium' AND reached < 25 THEN 25 WHEN reached = 0 AND positive_label THEN 20 ELSE reached END AS target, CASE WHEN has_quiz AND n0 < 3 THEN 3 ELSE n0 END AS n FROM d0),
d2 AS (SELECT d1.*, i, CASE WHEN n > 1 THEN {even(f"span * least(greatest(i / (n - 1) + ({fraction('student_id', 'course_id', 'signal_tier', 'i')} - 0.5) * 0.15, 0), 1)")} ELSE 0 END AS shift_ FROM d1, (VALUES (0), (1), (2), (3)) AS v(i) WHERE i < n),
d3 AS (SELECT *, row_number() OVER (PARTITION BY student_id, course_id ORDER BY shift_, i) - 1 AS j FROM d2),
d4 AS (SELECT *, CASE WHEN n > 1 THEN j / (n - 1) ELSE 0 END AS part, CASE WHEN target > 0 THEN greatest(5, least(target, 12)) ELSE 5 END AS low FROM d3),
d5 AS (SELECT *, {even("low + (greatest(target, 5) - low) * part")} AS progress, CASE WHEN j = n - 1 AND has_quiz THEN 'quiz_attempt' WHEN j = n - 2 AND signal_tier IN ('strong', 'medium') THEN 'assignment' ELSE 'video_watch' END AS activity_type,
  row_number() OVER (ORDER BY student_id, last_event_date, course_id, j) AS k FROM d4)"""


def _curation() -> dict[str, str]:
    base = ("student", "rating", "enrollment", "quiz")
    every = (*base, "activity")
    full = f"{CURATED}, {INTERACTIONS}"
    return {
        "synth_enrollments": with_tables("SELECT * FROM synth_e", *base, more=f"{CANDIDATES}, {SYNTH}"),
        "synth_quizzes": with_tables("SELECT * FROM synth_q", *base, more=f"{CANDIDATES}, {SYNTH}"),
        "strengthen_enrollments": with_tables(strengthened("enrollment", "quiz"), *base),
        "curate_rating_dates": with_tables("SELECT rating_id, student_id, course_id, rating_date, rating_date_clean, rating_signal_weight, rating_date_clean <> rating_date AS temporal_issue_fixed FROM cur_r", *every, more=CURATED),
        "interaction_quality": with_tables("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ("rating_mean", "would_recommend_rate", "avg_quiz_score", "quiz_pass_rate", "raw_interaction_score", "interaction_score")) + ") FROM inter", *every, more=full),
        "time_split": with_tables("SELECT student_id, course_id, last_event_date AS recommend_event_date, positive_label, split_role, recommendation_cutoff FROM split_", *every, more=full),
        "curation_summary": with_tables(
            "SELECT (SELECT count(*) FROM cur_r) AS ratings, (SELECT count(*) FROM cur_r WHERE rating_date <> rating_date_clean) AS dates_fixed, (SELECT count(*) FROM cur_e) AS enrollments, (SELECT count(*) FROM synth_e) AS synthetic_enrollments, (SELECT count(*) FROM cur_e WHERE enrollment_date > DATE '2024-03-31') AS enrollments_clipped, (SELECT count(*) FROM cur_q) AS quizzes, (SELECT count(*) FROM synth_q) AS synthetic_quizzes, "
            "count(*) AS interactions, count(*) FILTER (positive_label) AS positives, " + ", ".join(f"count(*) FILTER (signal_tier = '{t}') AS tier_{t}" for t in ("strong", "medium", "supportive", "weak")) + ", " + ", ".join(f"count(*) FILTER (split_role = '{r}') AS split_{r}" for r in ("train", "post_cutoff", "test")) + " FROM split_",
            *every, more=full,
        ),
        "dense_activity_logs": with_tables(
            f"""SELECT 'L' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS log_id, student_id, course_id, activity_type, strftime(first_event_date + shift_, '%Y-%m-%d') AS activity_date,
  greatest(10, {even("minutes * ((1.0::DOUBLE - 0.3 * part) / CASE WHEN n > 1 THEN 0.85::DOUBLE * n ELSE 1 END)")}) AS time_spent_minutes, least(progress, 100) AS progress_percentage, CASE WHEN progress > 0 THEN greatest(1, ceil(progress / 25)::INTEGER) ELSE 1 END AS module_completed,
  activity_type = 'video_watch' AS video_watched, activity_type = 'assignment' AS notes_taken, activity_type IN ('assignment', 'quiz_attempt') AS resources_downloaded FROM d5""",
            *every, more=f"{full}, {DENSE}",
        ),
        "published_enrollments": with_tables("SELECT enrollment_id, student_id, course_id, strftime(enrollment_date_clean, '%Y-%m-%d') AS enrollment_date, status, progress_percentage, strftime(last_accessed_clean, '%Y-%m-%d') AS last_accessed FROM cur_e", *every, more=CURATED),
        "published_quizzes": with_tables("SELECT quiz_id, student_id, course_id, strftime(quiz_date_clean, '%Y-%m-%d') AS quiz_date, quiz_title, total_questions, correct_answers, score_percentage, time_taken_minutes, attempts, passed FROM cur_q", *every, more=CURATED),
    }


# --- recommenders ---
MATRIX = "matrix AS (SELECT student_id, course_id, avg(rating) AS r FROM rating GROUP BY ALL HAVING avg(rating) <> 0)"
CF = """un AS (SELECT student_id, sqrt(sum(r * r)) AS norm FROM matrix GROUP BY ALL),
usim AS (SELECT a, b, d / (x.norm * y.norm) AS sim FROM (SELECT m.student_id AS a, o.student_id AS b, sum(m.r * o.r) AS d FROM matrix m JOIN matrix o ON m.course_id = o.course_id GROUP BY ALL) JOIN un x ON a = x.student_id JOIN un y ON b = y.student_id),
pred AS (SELECT a AS student_id, course_id, round(sum(sim * r) / sum(abs(sim)), 6) AS score FROM usim JOIN matrix ON b = student_id GROUP BY ALL),
cf AS (SELECT * FROM pred WHERE score > 0 AND (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM matrix))"""
ITEM = """inorm AS (SELECT course_id, sqrt(sum(r * r)) AS norm, avg(r) AS mean FROM matrix GROUP BY ALL),
isim AS (SELECT a, b, round(d / (x.norm * y.norm), 9) AS sim FROM (SELECT m.course_id AS a, o.course_id AS b, sum(m.r * o.r) AS d FROM matrix m JOIN matrix o ON m.student_id = o.student_id AND m.course_id <> o.course_id GROUP BY ALL) JOIN inorm x ON a = x.course_id JOIN inorm y ON b = y.course_id WHERE d > 0),
own AS (SELECT * FROM matrix),
near_ AS (SELECT o.student_id, a AS course_id, sim, r, row_number() OVER (PARTITION BY o.student_id, a ORDER BY sim DESC, o.course_id) AS k FROM own o JOIN isim ON o.course_id = b),
iscore AS (SELECT student_id, course_id, sum(sim * r) / sum(sim) AS score FROM near_ WHERE k <= 20 GROUP BY ALL),
icf AS (SELECT u.student_id, i.course_id, round(coalesce(s.score, i.mean), 6) AS score FROM (SELECT DISTINCT student_id FROM own) u CROSS JOIN inorm i LEFT JOIN iscore s ON u.student_id = s.student_id AND i.course_id = s.course_id WHERE (u.student_id, i.course_id) NOT IN (SELECT (student_id, course_id) FROM matrix))"""
SEEN = "seen AS (SELECT student_id, course_id FROM activity UNION SELECT student_id, course_id FROM enrollment WHERE status IN ('active', 'completed') UNION SELECT student_id, course_id FROM quiz)"


def vectors(fields: list[str], bigrams: bool = True, features: int = 5000) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    pairs = "UNION ALL SELECT x.id, x.tok || ' ' || y.tok FROM toks x JOIN toks y ON x.id = y.id AND y.pos = x.pos + 1" if bigrams else ""
    return f"""words AS (SELECT course_id AS id, list_filter(regexp_extract_all(lower({" || ' ' || ".join(fields)}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({stop})) AS w FROM course),
toks AS (SELECT id, w[pos] AS tok, pos FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS pos FROM words)),
grams AS (SELECT id, tok AS term FROM toks {pairs}),
tf AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL ORDER BY total DESC, term LIMIT {features}),
raw_ AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM course)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw_)"""


SIMS = vectors(["title", "category", "subcategory", "description", "tags", "difficulty"]) + """,
sims AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS sim FROM vec x JOIN vec y USING (term) GROUP BY ALL)"""
CONTENT = """hist AS (SELECT * FROM seen),
content AS (SELECT u.student_id, c.course_id, round(coalesce(t.score, 0), 6) AS score FROM (SELECT DISTINCT student_id FROM hist) u CROSS JOIN course c
  LEFT JOIN (SELECT student_id, b AS course_id, sum(sim) AS score FROM hist JOIN sims ON course_id = a GROUP BY ALL) t ON u.student_id = t.student_id AND c.course_id = t.course_id WHERE (u.student_id, c.course_id) NOT IN (SELECT (student_id, course_id) FROM hist))"""


def top(table: str, n: int, keys: str = "student_id", tie: str = "course_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {tie}) AS rank FROM {table} QUALIFY rank <= {n}"


def hybrid(seen: str, wc: str = "0.4::DOUBLE", wu: str = "0.6::DOUBLE", keys: str = "student_id", more: str = "", grid: str = "") -> str:
    share = "CASE WHEN max(score) OVER (PARTITION BY {k}) > 0 THEN score / max(score) OVER (PARTITION BY {k}) ELSE 0 END".format(k=keys)
    return f"""hc AS (SELECT *, {share} AS share FROM ({top("content", 20, keys)})), hu AS (SELECT *, {share} AS share FROM ({top("cf", 20, keys)})),
hsum AS (SELECT {keys}, course_id, sum(c) AS c, sum(u) AS u FROM (SELECT {keys}, course_id, share AS c, 0 AS u FROM hc UNION ALL SELECT {keys}, course_id, 0, share FROM hu) GROUP BY ALL),
hyb AS (SELECT {more} {keys}, course_id, round({wc} * c + {wu} * u, 6) AS score FROM hsum {grid} WHERE ({keys}, course_id) NOT IN (SELECT ({keys}, course_id) FROM {seen}))"""


def _recommend() -> dict[str, str]:
    src = ("activity", "enrollment", "quiz", "course", "rating")
    details = "SELECT h.student_id, h.course_id, h.score AS hybrid_score, h.rank::INTEGER AS rank, title, category, difficulty, duration_hours, c.rating FROM"
    every = f"{MATRIX}, {CF}, {SEEN}, {SIMS}, {CONTENT}, {hybrid('hist')}"
    beginners = "(SELECT y.* FROM hyb y JOIN course USING (course_id) WHERE difficulty = 'Beginner')"
    pick = "SELECT student_id, course_id, score, rank::INTEGER AS rank FROM ({})"
    return {
        "cf_user_topn": with_tables(pick.format(top("cf", 10)), "rating", more=f"{MATRIX}, {CF}"),
        "cf_user_topn_joined": with_tables(pick.format(top("cf", 10)), "rating", more=f"{MATRIX}, {CF}"),
        "cf_item_topn_joined": with_tables(pick.format(top("(SELECT * FROM icf WHERE score > 0)", 10)), "rating", more=f"{MATRIX}, {ITEM}"),
        "content_user_topn_joined": with_tables(pick.format(top("content", 10)), *src, more=f"{SEEN}, {SIMS}, {CONTENT}"),
        "cf_item_topn": with_tables(pick.format(top("(SELECT * FROM icf WHERE score > 0)", 10)), "rating", more=f"{MATRIX}, {ITEM}"),
        "similar_users": with_tables("SELECT a AS student_id, b AS similar_id, score, (k - 1)::INTEGER AS rank FROM (SELECT a, b, round(sim, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS k FROM usim) WHERE k BETWEEN 2 AND 6", "rating", more=f"{MATRIX}, {CF}"),
        "item_ratings": with_tables(
            f"""SELECT a.student_id, a.course_id, round(coalesce(s.score, i.mean, 0), 6) AS score FROM (SELECT DISTINCT student_id, course_id FROM activity) a LEFT JOIN iscore s ON a.student_id = s.student_id AND a.course_id = s.course_id LEFT JOIN inorm i ON a.course_id = i.course_id""",
            "activity", "rating", more=f"{MATRIX}, {ITEM}",
        ),
        "matrix_sparsity": with_tables("SELECT *, round(1 - filled / (students * courses), 6) AS sparsity FROM (SELECT count(DISTINCT student_id) AS students, count(DISTINCT course_id) AS courses, count(*) AS filled FROM matrix)", "rating", more=MATRIX),
        "content_similar": with_tables("SELECT a AS course_id, b AS similar_id, score, (k - 1)::INTEGER AS rank FROM (SELECT a, b, round(sim, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS k FROM sims) WHERE k BETWEEN 2 AND 11", "course", more=SIMS),
        "content_user_topn": with_tables(pick.format(top("content", 10)), *src, more=f"{SEEN}, {SIMS}, {CONTENT}"),
        "seen_union": with_tables("SELECT * FROM seen", "activity", "enrollment", "quiz", more=SEEN),
        "hybrid_topn": with_tables(f"{details} ({top('hyb', 10)}) h JOIN course c USING (course_id)", *src, more=every),
        "hybrid_beginner": with_tables(f"{details} ({top(beginners, 10)}) h JOIN course c USING (course_id)", *src, more=every),
        "rules_after_cf": with_tables(f"SELECT student_id, course_id, given::INTEGER AS given, row_number() OVER (PARTITION BY student_id ORDER BY given)::INTEGER AS rank FROM (SELECT student_id, course_id, rank AS given FROM ({top('cf', 20)}) WHERE (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM seen)) QUALIFY rank <= 5", *src, more=f"{MATRIX}, {CF}, {SEEN}"),
        "learning_path": with_tables(
            f"SELECT student_id, row_number() OVER (PARTITION BY student_id ORDER BY {LEVEL}, c.rating DESC, course_id)::INTEGER AS path_order, course_id, title, difficulty, duration_hours, c.rating, prerequisites FROM student CROSS JOIN course c WHERE category = '{CATEGORY}' AND (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM seen) QUALIFY path_order <= 6",
            "student", "activity", "enrollment", "quiz", "course", more=SEEN,
        ),
    }


def folded(folds: int, grid: str = "") -> str:
    """The split and the three models' scores by fold."""
    by = lambda s: s.replace("student_id", "fold, student_id")
    # as CF above, but sums over raters are taken for pairs of courses first: pairs of students are too many for ten folds
    cf = """unit AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY fold, student_id)) AS u FROM matrix),
pairs AS (SELECT x.fold, x.course_id AS common, y.course_id, sum(x.u * y.r) AS rated, sum(x.u) AS weight FROM unit x JOIN matrix y ON x.fold = y.fold AND x.student_id = y.student_id GROUP BY ALL),
pred AS (SELECT x.fold, x.student_id, y.course_id, round(sum(u * rated) / sum(u * weight), 6) AS score FROM unit x JOIN pairs y ON x.fold = y.fold AND x.course_id = y.common GROUP BY ALL),
cf AS (SELECT * FROM pred WHERE score > 0 AND (fold, student_id, course_id) NOT IN (SELECT (fold, student_id, course_id) FROM matrix))"""
    content = """hist AS (SELECT DISTINCT fold, student_id, course_id FROM train),
content AS (SELECT u.fold, u.student_id, c.course_id, round(coalesce(t.score, 0), 6) AS score FROM (SELECT DISTINCT fold, student_id FROM hist) u CROSS JOIN course c
  LEFT JOIN (SELECT fold, student_id, b AS course_id, sum(sim) AS score FROM hist JOIN sims ON course_id = a GROUP BY ALL) t ON u.fold = t.fold AND u.student_id = t.student_id AND c.course_id = t.course_id WHERE (u.fold, u.student_id, c.course_id) NOT IN (SELECT (fold, student_id, course_id) FROM hist))"""
    wc, wu, more = ("content_weight / (content_weight + collaborative_weight)", "collaborative_weight / (content_weight + collaborative_weight)", "content_weight, collaborative_weight,") if grid else ("0.4::DOUBLE", "0.6::DOUBLE", "")
    return f"""split_ AS (SELECT fold, rating_id, student_id, course_id, rating,
  row_number() OVER (PARTITION BY fold, student_id ORDER BY md5(student_id || '|' || rating_id || '|' || fold), rating_id) <= CASE WHEN count(*) OVER (PARTITION BY fold, student_id) <= 1 THEN 0 ELSE
    least(greatest(1, round_even(count(*) OVER (PARTITION BY fold, student_id) * 0.2::DOUBLE, 0)), count(*) OVER (PARTITION BY fold, student_id) - 1) END AS is_test
  FROM rating, (SELECT unnest(range(0, {folds}))::INTEGER AS fold)),
train AS (SELECT * FROM split_ WHERE NOT is_test), matrix AS (SELECT fold, student_id, course_id, avg(rating) AS r FROM train GROUP BY ALL HAVING avg(rating) <> 0), {cf}, {SIMS}, {content}, {hybrid("hist", wc, wu, "fold, student_id", more, grid)}"""


def metrics(recs: str, keys: str, skip: bool = True, fold: bool = True) -> str:
    """Metrics of a table of recommendations (keys, student_id, course_id, rank)."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"g.{x} = o.{x}" for x in k)
    f = "fold," if fold else ""
    shown = ", ".join(f"round(p{n}, 6) AS precision_{n}, round(r{n}, 6) AS recall_{n}, round(CASE WHEN p{n} + r{n} > 0 THEN 2 * p{n} * r{n} / (p{n} + r{n}) ELSE 0 END, 6) AS f1_{n}" for n in (5, 10))
    return f"""rel AS (SELECT DISTINCT {f} student_id, course_id FROM split_ WHERE is_test AND rating >= 4), relc AS (SELECT {f} student_id, count(*) AS relevant FROM rel GROUP BY ALL),
own_ AS (SELECT {keys}, student_id, count(*) AS n, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (hit AND rank <= 10) AS h10 FROM (SELECT *, ({f} student_id, course_id) IN (SELECT ({f} student_id, course_id) FROM rel) AS hit FROM {recs}) GROUP BY ALL),
users AS (SELECT g.*, coalesce(h5, 0) / 5 AS p5, coalesce(h5, 0) / relevant AS r5, coalesce(h10, 0) / 10 AS p10, coalesce(h10, 0) / relevant AS r10 FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM {recs}) {"JOIN relc USING (fold)" if fold else "CROSS JOIN relc"}) g LEFT JOIN own_ o ON {on} AND g.student_id = o.student_id {"WHERE n IS NOT NULL" if skip else ""}),
means AS (SELECT {keys}, count(*) AS evaluated_users, avg(p5) AS p5, avg(r5) AS r5, avg(p10) AS p10, avg(r10) AS r10 FROM users GROUP BY ALL),
cov AS (SELECT {keys}, count(DISTINCT course_id) AS covered FROM {recs} SEMI JOIN users USING ({keys}, student_id) GROUP BY ALL),
result AS (SELECT {keys}, evaluated_users, {shown}, round(coalesce(covered, 0) / (SELECT count(*) FROM course), 6) AS coverage FROM means LEFT JOIN cov USING ({keys}))"""


def _evaluation() -> dict[str, str]:
    src = ("rating", "course")
    three = "recs AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, fold, student_id, course_id, rank FROM ({top(t, 10, 'fold, student_id')})" for m, t in (("content", "content"), ("collaborative", "cf"), ("hybrid", "hyb"))) + ")"
    names = ["evaluated_users", "precision_5", "recall_5", "f1_5", "precision_10", "recall_10", "f1_10", "coverage"]
    grid = ", (VALUES (0.2::DOUBLE, 0.8::DOUBLE), (0.4, 0.6), (0.5, 0.5), (0.8, 0.2)) AS w(content_weight, collaborative_weight)"
    wkeys = "content_weight, collaborative_weight"
    wrecs = f"recs AS (SELECT * FROM ({top('hyb', 10, wkeys + ', student_id')}))"
    return {
        "holdout_split": with_tables("SELECT fold, rating_id, student_id, is_test FROM split_", *src, more=folded(FOLDS)),
        "metrics_at_k_skipping": with_tables("SELECT * FROM result", *src, more=f"{folded(1)}, {three}, {metrics('recs', 'model, fold')}"),
        "metrics_at_k_with_zeros": with_tables("SELECT * FROM result", *src, more=f"{folded(1)}, {three}, {metrics('recs', 'model, fold', skip=False)}"),
        "repeated_holdout_summary": with_tables("SELECT model, count(*) AS folds, " + ", ".join(f"floor(sum(round({n} * 1000000)::BIGINT)::DOUBLE / count({n}) + 0.5) / 1000000.0::DOUBLE AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std" for n in names) + " FROM result GROUP BY model", *src, more=f"{folded(FOLDS)}, {three}, {metrics('recs', 'model, fold')}"),
        "holdout_report": with_tables(
            f"SELECT row_number() OVER (ORDER BY model, m, k) AS position, line FROM (SELECT model, 0 AS m, unnest([0, 1]) AS k, unnest([model || ':', repeat('-', 70)]) AS line FROM result UNION ALL "
            + " UNION ALL ".join(f"SELECT model, {i}, unnest([0, 1, 2, 3]), unnest(['  {n}:', '    Mean: ' || printf('%.4f', {n}), '    Std:  0.0000', '    Values: [' || printf('%.4f', {n}) || ']']) FROM result" for i, n in enumerate(names[1:], 1))
            + " UNION ALL SELECT model, 99, 0, '' FROM result)",
            *src, more=f"{folded(1)}, {three}, {metrics('recs', 'model, fold')}",
        ),
        "rmse_mae": with_tables("SELECT t.fold, count(*) AS predictions, round(sqrt(avg((score - rating) * (score - rating))), 6) AS rmse, round(avg(abs(score - rating)), 6) AS mae FROM split_ t JOIN pred p ON t.fold = p.fold AND t.student_id = p.student_id AND t.course_id = p.course_id WHERE is_test AND score > 0 AND (t.fold, t.student_id) IN (SELECT (fold, student_id) FROM split_ WHERE is_test AND rating >= 4) AND (t.fold, t.student_id) IN (SELECT (fold, student_id) FROM cf) GROUP BY ALL", *src, more=folded(FOLDS)),
        "history_lists": with_tables("SELECT student_id, string_agg(course_id, ',' ORDER BY d, course_id) AS courses FROM (SELECT student_id, course_id, min(quiz_date) AS d FROM quiz GROUP BY ALL) GROUP BY ALL", "quiz"),
        "full_history_lists": with_tables("SELECT student_id, string_agg(course_id, ',' ORDER BY quiz_date, quiz_id) AS courses FROM quiz GROUP BY ALL", "quiz"),
        "weight_search": with_tables("SELECT * FROM result", *src, more=f"{folded(1, grid)}, {wrecs}, {metrics('recs', wkeys, fold=False)}"),
    }


TRAIN = """train0 AS (SELECT student_id, course_id, avg(rating) AS m FROM rating GROUP BY ALL),
train AS (SELECT student_id, course_id, (m - 1) / 4 AS preference_score, coalesce(enrollment_progress, 0) AS enrollment_progress, coalesce(avg_quiz_score, 0) AS avg_quiz_score, m >= 4 AS positive_label FROM train0
  LEFT JOIN (SELECT student_id, course_id, avg(score_percentage) AS avg_quiz_score FROM quiz GROUP BY ALL) USING (student_id, course_id) LEFT JOIN (SELECT student_id, course_id, max(progress_percentage) AS enrollment_progress FROM enrollment GROUP BY ALL) USING (student_id, course_id))"""
NEGATIVES = """liked AS (SELECT * FROM train WHERE preference_score > 0), quota AS (SELECT student_id, 2 * greatest(1, count(*) FILTER (positive_label)) AS q FROM liked GROUP BY ALL),
catalogue AS (SELECT course_id, row_number() OVER (ORDER BY course_id) - 1 AS pos FROM course),
prime AS (SELECT min(x) AS p FROM (SELECT unnest(range(greatest(n, 2), 2 * n + 3)) AS x FROM (SELECT count(*) AS n FROM course)) WHERE len(list_filter(range(2, floor(sqrt(x))::BIGINT + 1), lambda d: x % d = 0)) = 0),
walks AS (SELECT student_id, q, p, ('0x' || substr(md5(student_id || '|42|start'), 1, 12))::BIGINT % p AS s, 1 + ('0x' || substr(md5(student_id || '|42|step'), 1, 12))::BIGINT % (p - 1) AS t FROM quota, prime),
places AS (SELECT student_id, q, j, (s + j * t) % p AS pos FROM (SELECT *, unnest(range(0, p)) AS j FROM walks)),
neg AS (SELECT student_id, course_id FROM (SELECT student_id, course_id, q, row_number() OVER (PARTITION BY student_id ORDER BY j) AS k FROM places JOIN catalogue USING (pos) WHERE (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM liked)) WHERE k <= q)"""
#: All unseen courses ranked, as negatives draws them.
DRAWN = """liked AS (SELECT * FROM train WHERE preference_score > 0), quota AS (SELECT student_id, 2 * greatest(1, count(*) FILTER (positive_label)) AS q FROM liked GROUP BY ALL),
neg AS (SELECT student_id, course_id FROM (SELECT student_id, course_id, q, row_number() OVER (PARTITION BY student_id ORDER BY md5(student_id || '|' || course_id || '|42')) AS k FROM quota CROSS JOIN course WHERE (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM liked)) WHERE k <= q)"""
HYBRID_X = f"""matrix AS (SELECT student_id, course_id, least(greatest(1 + 4 * preference_score, 1), 5) AS r FROM liked), {CF}, {ITEM}, {SIMS},
obs AS (SELECT l.*, c.category, {LEVEL} AS level FROM liked l JOIN course c USING (course_id)),
pop AS (SELECT course_id, avg(positive_label::INTEGER) AS rate FROM obs GROUP BY ALL)"""


def _learned() -> dict[str, str]:
    src = ("rating", "quiz", "enrollment", "course")
    act = "SELECT student_id, course_id, sum(time_spent_minutes)::BIGINT AS t, max(progress_percentage) AS p, sum(video_watched::INTEGER)::BIGINT AS v, sum(notes_taken::INTEGER)::BIGINT AS n FROM activity GROUP BY ALL"
    words = f"{vectors(['title', 'description', 'tags'], False, 100)}, ranked AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(w, 6) DESC, term) AS k FROM vec WHERE round(w, 6) > 0), kw AS (SELECT id AS course_id, string_agg(term, ', ' ORDER BY k) FILTER (k <= 5) AS keywords, string_agg(term, ', ' ORDER BY k) FILTER (k <= 3) AS first3 FROM ranked GROUP BY ALL)"
    return {
        "train_inputs": with_tables("SELECT student_id, course_id, round(preference_score, 6) AS preference_score, enrollment_progress, round(avg_quiz_score, 6) AS avg_quiz_score, positive_label, round(least(greatest(1 + 4 * preference_score, 1), 5), 6) AS rating FROM train WHERE preference_score > 0", *src, more=TRAIN),
        "negatives": with_tables("SELECT * FROM neg", *src, more=f"{TRAIN}, {DRAWN}"),
        "hybrid_features": with_tables(
            f"""SELECT n.student_id, n.course_id, round(coalesce(content_score, 0), 6) AS content_score, round(coalesce(p.score, 0) / 5, 6) AS user_cf_score, round(coalesce(i.score, 0) / 5, 6) AS item_cf_score, round(coalesce(g.a, 0), 6) AS category_affinity, round(coalesce(g.b, 0), 6) AS category_progress,
  round(coalesce(g.q, 0), 6) AS category_quiz, round({LEVEL} / 3, 6) AS difficulty_level, round(greatest(0, 1 - abs(coalesce(u.pref, 2) - {LEVEL}) / 2), 6) AS difficulty_match, round(coalesce(pop.rate, 0) / (SELECT greatest(max(rate), 1e-8) FROM pop), 6) AS course_popularity,
  round(least(coalesce(u.h, 0) / 20, 1), 6) AS history_size, round(least(coalesce(u.pos, 0) / 10, 1), 6) AS positive_history_size
FROM neg n JOIN course c USING (course_id) LEFT JOIN (SELECT student_id, sum(level * preference_score) / greatest(sum(preference_score), 1e-8) AS pref, count(*) AS h, count(*) FILTER (positive_label) AS pos FROM obs GROUP BY ALL) u ON n.student_id = u.student_id
LEFT JOIN (SELECT student_id, category, avg(preference_score) AS a, avg(enrollment_progress) / 100 AS b, avg(avg_quiz_score) / 100 AS q FROM obs GROUP BY ALL) g ON n.student_id = g.student_id AND c.category = g.category LEFT JOIN pop ON n.course_id = pop.course_id
LEFT JOIN (SELECT student_id, b AS course_id, max(sim) AS content_score FROM obs JOIN sims ON course_id = a WHERE positive_label GROUP BY ALL) s ON n.student_id = s.student_id AND n.course_id = s.course_id
LEFT JOIN pred p ON n.student_id = p.student_id AND n.course_id = p.course_id LEFT JOIN icf i ON n.student_id = i.student_id AND n.course_id = i.course_id""",
            *src, more=f"{TRAIN}, {NEGATIVES}, {HYBRID_X}",
        ),
        "grade_features": with_tables(
            f"SELECT quiz_id, q.student_id, q.course_id, s.avg_quiz_score, s.total_courses_completed, s.total_time_spent_hours, {LEVEL} AS course_difficulty, c.duration_hours AS course_duration, c.rating AS course_rating, coalesce(t, 0) AS time_spent_on_course, coalesce(p, 0) AS progress_percentage, coalesce(v, 0) AS videos_watched, coalesce(n, 0) AS notes_taken, score_percentage "
            f"FROM quiz q JOIN student s ON q.student_id = s.student_id JOIN course c ON q.course_id = c.course_id LEFT JOIN ({act}) a ON q.student_id = a.student_id AND q.course_id = a.course_id",
            "quiz", "student", "course", "activity",
        ),
        "cluster_features": with_tables(
            """SELECT student_id, avg_quiz_score, total_courses_completed AS total_courses, total_time_spent_hours AS total_time, round(total_time_spent_hours / greatest(1, total_courses_completed), 6) AS avg_time_per_course, coalesce(v, 0) AS videos_watched, coalesce(n, 0) AS notes_taken, round(coalesce(p, 0), 6) AS avg_progress, coalesce(k, 0) AS quiz_attempts, round(coalesce(r, 0), 6) AS pass_rate
FROM student LEFT JOIN (SELECT student_id, sum(video_watched::INTEGER)::BIGINT AS v, sum(notes_taken::INTEGER)::BIGINT AS n, avg(progress_percentage) AS p FROM activity GROUP BY ALL) USING (student_id) LEFT JOIN (SELECT student_id, count(*) AS k, avg(passed::INTEGER) * 100 AS r FROM quiz GROUP BY ALL) USING (student_id)""",
            "student", "activity", "quiz",
        ),
        "course_keywords": with_tables("SELECT course_id, keywords FROM kw", "course", more=words),
        "explanations": with_tables(
            f"""SELECT student_id, course_id, array_to_string(list_filter([
  CASE WHEN (student_id, category) IN (SELECT (student_id, category) FROM activity JOIN course USING (course_id)) THEN 'category bi-bookmark-check: Matches your interest in ' || category END,
  CASE WHEN difficulty = preferred_difficulty THEN 'difficulty bi-bullseye: Matches your preferred difficulty level (' || preferred_difficulty || ')' WHEN difficulty = 'Beginner' AND avg_quiz_score < 60 THEN 'difficulty bi-arrow-down-circle: Easier course to build foundational skills' END,
  CASE WHEN c.rating >= 4.5 THEN 'rating bi-star-fill: Highly rated course (' || printf('%.1f', c.rating) || '/5.0)' END, CASE WHEN rn > 5 AND rm >= 4 THEN 'collaborative bi-people: Popular among similar students (avg ' || printf('%.1f', rm) || '/5)' END,
  CASE WHEN first3 IS NOT NULL THEN 'content bi-tags: Covers: ' || first3 END, CASE WHEN difficulty = 'Beginner' AND adv > 0 THEN 'path bi-signpost-split: Foundation for ' || adv || ' advanced courses' END], lambda x: x IS NOT NULL)[:4], '; ') AS reasons
FROM ({top("cf", 10)}) JOIN student s USING (student_id) JOIN course c USING (course_id) LEFT JOIN (SELECT course_id, count(*) AS rn, avg(rating) AS rm FROM rating GROUP BY ALL) USING (course_id) LEFT JOIN (SELECT category, count(*) AS adv FROM course WHERE difficulty = 'Advanced' GROUP BY ALL) USING (category) LEFT JOIN kw USING (course_id)""",
            "rating", "activity", "course", "student", more=f"{MATRIX}, {CF}, {words}",
        ),
    }


MODULES = """listed AS (SELECT e.student_id, e.course_id, m.module_id, m.order_no, coalesce(completed, FALSE) AS completed FROM (SELECT DISTINCT student_id, course_id FROM enrollment WHERE status IN ('active', 'completed')) e
  JOIN module m USING (course_id) LEFT JOIN module_progress p ON e.student_id = p.student_id AND m.module_id = p.module_id)"""
REVIEW = """review AS (SELECT z.quiz_id AS sitting, z.course_id, z.quiz_title, question_id, points, CASE WHEN question_number % 5 = 0 THEN '' ELSE substr('ABCD', (correct_answers + question_number) % 4 + 1, 1) END AS answer, correct_answer, CASE answer WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c WHEN 'D' THEN option_d END AS given_text,
  CASE correct_answer WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE option_d END AS correct_text FROM quiz z JOIN question USING (course_id))"""


_MINE = f"student_id = '{ACTOR}' AND course_id = '{CHOSEN_COURSE}'"
_DAY = f"DATE '{TODAY}'"


def following(table: str, column: str, prefix: str) -> str:
    """next_id of a table: one more than the largest number that stands behind the prefix alone."""
    n = f"coalesce(max(CASE WHEN regexp_matches({column}, '^{prefix}[0-9]+$') THEN substr({column}, {len(prefix) + 1})::BIGINT END), 0) + 1"
    return f"(SELECT '{prefix}' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END FROM (SELECT {n} AS n FROM {table}))"


def _mutations() -> dict[str, str]:
    share = f"(SELECT round(count(*) FILTER (module_id IN (SELECT module_id FROM done)) * 100 / count(*), 1) FROM module WHERE course_id = '{CHOSEN_COURSE}')"
    progress = f"""after AS (SELECT student_id, module_id, completed, 'P7' AS progress_id, NULL::DATE AS completion_date FROM module_progress
  UNION ALL SELECT '{ACTOR}', '{CHOSEN_MODULE}', TRUE, 'P008', {_DAY} WHERE NOT EXISTS (SELECT 1 FROM module_progress WHERE student_id = '{ACTOR}' AND module_id = '{CHOSEN_MODULE}'))"""
    done = f"done AS (SELECT DISTINCT module_id FROM after WHERE student_id = '{ACTOR}' AND completed)"
    return {
        "after_register": with_tables(f"SELECT student_id, name, email, age, enrollment_date, total_courses_completed, avg_quiz_score FROM student UNION ALL SELECT {following('student', 'student_id', 'S')}, 'New Student', 'new@example.org', 20, {_DAY}, 0, 0", "student"),
        "after_enroll": with_tables(
            f"""SELECT enrollment_id, student_id, course_id, enrollment_date, CASE WHEN {_MINE} AND NOT now THEN 'active' ELSE status END AS status, progress_percentage, CASE WHEN {_MINE} AND NOT now THEN {_DAY} ELSE last_accessed END AS last_accessed
FROM enrollment, (SELECT coalesce(bool_or({_MINE} AND status IN ('active', 'completed')), FALSE) AS now FROM enrollment)
UNION ALL SELECT {following('enrollment', 'enrollment_id', 'E')}, '{ACTOR}', '{CHOSEN_COURSE}', {_DAY}, 'active', 0, {_DAY} WHERE NOT EXISTS (SELECT 1 FROM enrollment WHERE {_MINE})""",
            "enrollment",
        ),
        "after_unenroll": with_tables(f"SELECT * REPLACE (CASE WHEN {_MINE} THEN 'dropped' ELSE status END AS status) FROM enrollment", "enrollment"),
        "after_quiz": with_tables(f"SELECT * FROM quiz UNION ALL BY NAME SELECT {following('quiz', 'quiz_id', 'Q')} AS quiz_id, '{ACTOR}' AS student_id, '{CHOSEN_COURSE}' AS course_id, {_DAY} AS quiz_date, 'Final' AS quiz_title, 9 AS total_questions, 7 AS correct_answers, 77.8::DOUBLE AS score_percentage, 12 AS time_taken_minutes, (1 + (SELECT count(*) FROM quiz WHERE {_MINE} AND quiz_title = 'Final'))::INTEGER AS attempts, TRUE AS passed", "quiz"),
        "after_module": with_tables("SELECT * FROM after", "module_progress", more=progress),
        "after_module_enrollments": with_tables(
            f"SELECT * REPLACE (CASE WHEN {_MINE} THEN {share} ELSE progress_percentage END AS progress_percentage, CASE WHEN {_MINE} THEN {_DAY} ELSE last_accessed END AS last_accessed, CASE WHEN {_MINE} AND {share} >= 100 THEN 'completed' ELSE status END AS status) FROM enrollment",
            "module_progress", "module", "enrollment", more=f"{progress}, {done}",
        ),
    }


def _pages() -> dict[str, str]:
    quote = lambda c: f"""'"' || {c} || '"'"""
    number = lambda c: f"printf('%.6f', {c})"
    recs = f"(SELECT student_id, course_id, rank AS given, row_number() OVER (PARTITION BY student_id ORDER BY rank) AS k FROM ({top('hyb', 10)}) WHERE (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM seen))"
    first = lambda t, table, key, n: f"SELECT '{t}' AS \"table\", row_number() OVER (ORDER BY {key}) AS position, {key} AS id FROM {table}" + (f" QUALIFY position <= {n}" if n else "")
    return {
        "api_similar": with_tables(
            f"""SELECT course_id, '{{"course_id":' || {quote("course_id")} || ',"similar_courses":[' || string_agg('{{"similar_id":' || {quote("similar_id")} || ',"score":' || {number("score")} || '}}', ',' ORDER BY k) || ']}}' AS json
FROM (SELECT a AS course_id, b AS similar_id, round(sim, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS k FROM sims) WHERE k BETWEEN 2 AND 11 GROUP BY course_id""",
            "course", more=SIMS,
        ),
        "api_recommend": with_tables(
            f"""SELECT student_id, '{{"student_id":' || {quote("student_id")} || ',"recommendations":[' || string_agg('{{"course_id":' || {quote("course_id")} || ',"given":' || given || '}}', ',' ORDER BY k) || ']}}' AS json FROM {recs} WHERE k <= 10 GROUP BY student_id""",
            "activity", "enrollment", "quiz", "course", "rating", more=f"{MATRIX}, {CF}, {SEEN}, {SIMS}, {CONTENT}, {hybrid('hist')}",
        ),
        "api_student": with_tables(
            f"""SELECT s.student_id, '{{"student_id":' || {quote("s.student_id")} || ',"name":' || {quote("name")} || ',"learning_style":' || {quote("learning_style")} || ',"enrolled_courses":' || coalesce('[' || c.l || ']', 'null') || ',"performance":' || coalesce('[' || q.l || ']', 'null') || '}}' AS json
FROM student s LEFT JOIN (SELECT student_id, string_agg({quote("course_id")}, ',' ORDER BY course_id) AS l FROM (SELECT DISTINCT student_id, course_id FROM enrollment WHERE status IN ('active', 'completed')) GROUP BY ALL) c ON s.student_id = c.student_id
LEFT JOIN (SELECT student_id, string_agg('{{"category":' || {quote("category")} || ',"avg_score":' || {number("a")} || '}}', ',' ORDER BY category) AS l FROM (SELECT student_id, category, round(avg(score_percentage), 6) AS a FROM quiz JOIN course USING (course_id) GROUP BY ALL) GROUP BY ALL) q ON s.student_id = q.student_id""",
            "student", "enrollment", "quiz", "course",
        ),
        "course_detail": with_tables(
            "SELECT course_id, title, difficulty, coalesce(modules, '') AS modules, coalesce(n, 0) AS ratings, round(m, 6) AS mean_rating FROM course LEFT JOIN (SELECT course_id, string_agg(module_title, ', ' ORDER BY order_no, module_id) AS modules FROM module GROUP BY ALL) USING (course_id) LEFT JOIN (SELECT course_id, count(*) AS n, avg(rating) AS m FROM rating GROUP BY ALL) USING (course_id)",
            "course", "module", "rating",
        ),
        "admin_preview": with_tables(" UNION ALL ".join(f"(SELECT * FROM ({first(*x)}))" for x in (("students", "student", "student_id", 20), ("courses", "course", "course_id", None), ("activities", "activity", "log_id", 50), ("quizzes", "quiz", "quiz_id", 50), ("ratings", "rating", "rating_id", 50))), "student", "course", "activity", "quiz", "rating"),
        "minutes_shown": with_tables("SELECT course_id, format('{:,}', sum(time_spent_minutes)::BIGINT) AS minutes FROM activity GROUP BY ALL", "activity"),
    }


def _serving() -> dict[str, str]:
    listed = ("enrollment", "module", "module_progress")
    return {
        "point_lookup": with_tables("SELECT * FROM student WHERE student_id = 'S0000007'", "student"),
        "login_lookup": with_tables("SELECT * FROM student WHERE student_id = 'S0000007'", "student"),
        "catalog_search": with_tables("SELECT course_id, title, category, difficulty, course_id IN (SELECT course_id FROM enrollment WHERE student_id = 'S0000007' AND status IN ('active', 'completed')) AS enrolled FROM course WHERE regexp_matches(title, '(?i)PROMO|brand#1') OR regexp_matches(description, '(?i)PROMO|brand#1')", "course", "enrollment"),
        "student_courses": with_tables("SELECT x.student_id, x.course_id, title, enrollment_id, status, progress_percentage AS progress, last_accessed FROM (SELECT DISTINCT student_id, course_id FROM enrollment WHERE status IN ('active', 'completed')) x JOIN course USING (course_id) JOIN enrollment e ON x.student_id = e.student_id AND x.course_id = e.course_id", "course", "enrollment"),
        "catalog_filtered": with_tables(f"SELECT course_id, title, category, difficulty FROM course WHERE category = '{CATEGORY}' AND difficulty = 'Beginner'", "course"),
        "course_badges": with_tables("SELECT course_id, CASE difficulty WHEN 'Beginner' THEN 'success' WHEN 'Intermediate' THEN 'warning' ELSE 'danger' END AS badge, array_to_string(string_split_regex(trim(tags), '\\s+'), '|') AS tags, CASE WHEN length(title) > 30 THEN substr(title, 1, 30) || '...' ELSE title END AS short_title, format('{:,}', total_enrollments) AS enrollments FROM course", "course"),
        "progress_bands": with_tables("SELECT enrollment_id, student_id, course_id, CASE WHEN progress_percentage >= 70 THEN 'high' WHEN progress_percentage >= 40 THEN 'middle' ELSE 'low' END AS progress_band FROM enrollment", "enrollment"),
        "student_counters": with_tables("SELECT student_id, coalesce(q, 0) AS quizzes, coalesce(e, 0) AS courses FROM (SELECT student_id, count(*) AS q FROM quiz GROUP BY ALL) FULL JOIN (SELECT student_id, count(DISTINCT course_id) AS e FROM enrollment WHERE status IN ('active', 'completed') GROUP BY ALL) USING (student_id)", "quiz", "enrollment"),
        "api_learning_path": with_tables(
            f"""SELECT student_id, '{{"student_id":"' || student_id || '","learning_path":[' || string_agg('{{"course_id":"' || course_id || '","title":"' || title || '","difficulty":"' || difficulty || '"}}', ',' ORDER BY path_order) || ']}}' AS json
FROM (SELECT student_id, row_number() OVER (PARTITION BY student_id ORDER BY {LEVEL}, c.rating DESC, course_id) AS path_order, course_id, title, difficulty FROM student CROSS JOIN course c WHERE category = '{CATEGORY}' AND (student_id, course_id) NOT IN (SELECT (student_id, course_id) FROM seen) QUALIFY path_order <= 6) GROUP BY student_id""",
            "student", "activity", "enrollment", "quiz", "course", more=SEEN,
        ),
        "category_performance": with_tables("SELECT student_id, category, round(a, 6) AS avg_score, a >= 75 AS strength, a < 60 AS weakness FROM (SELECT student_id, category, avg(score_percentage) AS a FROM quiz JOIN course USING (course_id) GROUP BY ALL)", "quiz", "course"),
        "quiz_history": with_tables("SELECT student_id, quiz_id, course_id, quiz_title, quiz_date, score_percentage, passed, row_number() OVER (PARTITION BY student_id ORDER BY quiz_date DESC, quiz_id)::INTEGER AS position FROM quiz", "quiz"),
        "module_progress": with_tables("SELECT * FROM listed", *listed, more=MODULES),
        "current_module": with_tables("SELECT student_id, course_id, module_id, completed FROM listed QUALIFY row_number() OVER (PARTITION BY student_id, course_id ORDER BY completed, order_no, module_id) = 1", *listed, more=MODULES),
        "course_progress": with_tables("SELECT student_id, course_id, n AS total_modules, d AS completed_modules, round(d * 100 / n, 1) AS progress_percentage, CASE WHEN d >= n THEN 'completed' ELSE 'active' END AS status FROM (SELECT student_id, course_id, count(*) AS n, count(*) FILTER (completed) AS d FROM listed GROUP BY ALL)", *listed, more=MODULES),
        "quiz_review": with_tables("SELECT sitting, question_id, answer, answer = correct_answer AS correct, correct_text, given_text FROM review", "quiz", "question", more=REVIEW),
        "quiz_score": with_tables("SELECT *, round(correct_answers * 100 / total_questions, 1) AS percentage, round(correct_answers * 100 / total_questions, 1) >= 60 AS passed FROM (SELECT sitting, course_id, quiz_title, count(*) FILTER (answer = correct_answer) AS correct_answers, count(*) AS total_questions, sum(CASE WHEN answer = correct_answer THEN points ELSE 0 END)::BIGINT AS earned_points, sum(points)::BIGINT AS total_points FROM review GROUP BY ALL)", "quiz", "question", more=REVIEW),
        "attempt_numbers": with_tables("SELECT quiz_id, student_id, course_id, row_number() OVER (PARTITION BY student_id, course_id, quiz_title ORDER BY quiz_date, quiz_id)::INTEGER AS attempt FROM quiz", "quiz"),
        "analytics_totals": with_tables("SELECT round(sum(time_spent_minutes) / 60, 1) AS total_hours, sum(video_watched::INTEGER)::BIGINT AS videos, count(*) AS activities FROM activity", "activity"),
        "score_histogram": with_tables("SELECT CASE WHEN score_percentage <= 20 THEN '0-20' WHEN score_percentage <= 40 THEN '21-40' WHEN score_percentage <= 60 THEN '41-60' WHEN score_percentage <= 80 THEN '61-80' ELSE '81-100' END AS bin, count(*) AS quizzes FROM quiz GROUP BY ALL", "quiz"),
        "presentation_bands": with_tables("SELECT quiz_id, CASE WHEN score_percentage >= 80 THEN 'success' WHEN score_percentage >= 60 THEN 'warning' ELSE 'danger' END AS band, printf('%.1f', score_percentage) AS shown, substr(course_id, 1, 5) || '...' AS short_id, quiz_title AS label FROM quiz", "quiz"),
        "next_id": with_tables("SELECT 'S' || lpad((max(substr(student_id, 2)::BIGINT) + 1)::VARCHAR, greatest(3, length((max(substr(student_id, 2)::BIGINT) + 1)::VARCHAR))::INTEGER, '0') AS next_id FROM student", "student"),
        "first_seen_categories": with_tables("SELECT DISTINCT category FROM course", "course"),
        "json_api": with_tables("""SELECT '{"course_id":"' || course_id || '","category":"' || category || '","duration_hours":' || duration_hours || '}' AS json FROM course""", "course"),
    }


def oracle_sql() -> dict[str, str]:
    out = _star() | _features() | _curation() | _recommend() | _evaluation() | _learned() | _serving() | _mutations() | _pages()
    return out | {"hybrid_features_by_student": out["hybrid_features"]}
