"""The learning-platform tables as views of the driver's TPC-H-like tables.

Each body is SQL that Spark and DuckDB read alike, so queries and their oracles start from the same
rows. Values are whole numbers where sums are taken, so that no order of summation shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coursemill.session import small_side
from coursemill.sources.kept import kept, kept_model

_SID = "concat('S', lpad(cast({0} AS STRING), 7, '0'))"
_LINE = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
#: The courses numbered from 0, each with their number; and the join of activity with them, which holds both of its sides and so has no key that Spark could hash.
_NUMBERED = "SELECT course_id, row_number() OVER (ORDER BY course_id) - 1 AS n, count(*) OVER () AS courses FROM (SELECT DISTINCT concat('C-', p_brand, '-', p_type) AS course_id FROM part) p0"
_NUMBER = "(event_id * 31 + user_id) % courses = n"
_KEYS = f"{_SID.format('o_custkey')} AS student_id, concat('C-', p_brand, '-', p_type) AS course_id"

BODIES: dict[str, tuple[tuple[str, ...], str]] = {
    "student": (
        ("customer",),
        f"""SELECT {_SID.format("c_custkey")} AS student_id, c_name AS name, concat('s', cast(c_custkey AS STRING), '@example.org') AS email,
  cast(12 + c_custkey % 55 AS INT) AS age, CASE WHEN c_custkey % 3 = 0 THEN 'Graduate' ELSE 'Undergraduate' END AS education_level, c_mktsegment AS major,
  date '2023-10-15' + cast(c_custkey % 140 AS INT) AS enrollment_date,
  CASE c_custkey % 4 WHEN 0 THEN 'Visual' WHEN 1 THEN 'Reading' WHEN 2 THEN 'Kinesthetic' ELSE 'Auditory' END AS learning_style,
  CASE c_custkey % 3 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'Intermediate' ELSE 'Advanced' END AS preferred_difficulty,
  cast(c_custkey % 25 AS INT) AS total_courses_completed, cast((c_custkey * 37) % 1000 AS DOUBLE) / 10 AS avg_quiz_score, cast((c_custkey * 13) % 400 AS DOUBLE) AS total_time_spent_hours
FROM customer""",
    ),
    "course": (
        ("part",),
        """SELECT concat('C-', p_brand, '-', p_type) AS course_id, concat(p_brand, ' ', p_type, ' ', min(p_name)) AS title, p_type AS category, p_brand AS subcategory,
  CASE WHEN sum(p_size) < 23 * count(*) THEN 'Beginner' WHEN sum(p_size) < 27 * count(*) THEN 'Intermediate' ELSE 'Advanced' END AS difficulty,
  cast(count(*) * 3 % 40 AS INT) AS duration_hours, concat('Instructor ', p_brand) AS instructor, min(p_name) AS description,
  CASE WHEN sum(p_size) % 3 = 0 THEN 'None' ELSE concat('C-', p_brand, '-', min(p_type)) END AS prerequisites, lower(concat(p_type, ' ', max(p_name))) AS tags,
  cast(30 + sum(p_size) % 20 AS DOUBLE) / 10 AS rating, cast(sum(p_partkey) % 1000 AS INT) AS total_enrollments, cast((sum(p_size) * 7) % 1100 AS DOUBLE) / 10 AS completion_rate
FROM part GROUP BY p_brand, p_type""",
    ),
    "rating": (
        ("lineitem", "orders", "part"),
        f"""SELECT concat('R', cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING), '-', cast(l_partkey AS STRING), '-', cast(l_suppkey AS STRING)) AS rating_id, {_KEYS},
  date '2023-12-01' + cast((l_orderkey * 7 + l_linenumber * 3) % 150 AS INT) AS rating_date, least(cast(5 AS DOUBLE), floor((l_quantity - 1) / 10) + 1) AS rating,
  cast(l_linenumber % 7 AS DOUBLE) AS difficulty_rating, cast(1 + l_suppkey % 5 AS DOUBLE) AS content_quality, cast(1 + l_partkey % 5 AS DOUBLE) AS instructor_rating,
  l_returnflag <> 'R' AS would_recommend {_LINE}""",
    ),
    "enrollment": (
        ("lineitem", "orders", "part"),
        f"""SELECT concat('E', cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING), '-', cast(l_partkey AS STRING), '-', cast(l_suppkey AS STRING)) AS enrollment_id, {_KEYS},
  date '2023-12-10' + cast((l_orderkey * 5) % 100 AS INT) AS enrollment_date, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'dropped' END AS status,
  cast((l_orderkey * 11 + l_linenumber * 17) % 101 AS DOUBLE) AS progress_percentage, date '2023-12-10' + cast((l_orderkey * 5) % 100 + l_linenumber * 5 AS INT) AS last_accessed
{_LINE} WHERE (l_orderkey + l_linenumber) % 3 <> 0""",
    ),
    "quiz": (
        ("lineitem", "orders", "part"),
        f"""SELECT concat('Q', cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING), '-', cast(l_partkey AS STRING), '-', cast(l_suppkey AS STRING)) AS quiz_id, {_KEYS},
  date '2023-12-05' + cast((l_orderkey * 3 + l_linenumber) % 140 AS INT) AS quiz_date, 'Final' AS quiz_title, cast(20 + l_linenumber AS INT) AS total_questions,
  cast((l_orderkey + l_linenumber * 5) % 31 AS INT) AS correct_answers, cast((l_orderkey * 13 + l_linenumber * 29) % 104 AS DOUBLE) AS score_percentage,
  cast(5 + l_linenumber * 3 AS INT) AS time_taken_minutes, cast(1 + l_linenumber % 3 AS INT) AS attempts, (l_orderkey * 13 + l_linenumber * 29) % 104 >= 60 AS passed
{_LINE} WHERE (l_orderkey + l_linenumber) % 2 = 0""",
    ),
    "activity": (
        ("events", "part"),
        f"""SELECT concat('L', lpad(cast(event_id AS STRING), 9, '0')) AS log_id, {_SID.format("user_id")} AS student_id, course_id,
  CASE event_type WHEN 'view' THEN 'video_watch' WHEN 'click' THEN 'assignment' ELSE 'quiz_attempt' END AS activity_type, date '2023-12-15' + cast(event_id % 120 AS INT) AS activity_date,
  cast((event_id * 17) % 95 - 3 AS INT) AS time_spent_minutes, cast((event_id * 7) % 108 AS INT) AS progress_percentage, cast(event_id % 9 AS INT) AS module_completed,
  event_id % 2 = 0 AS video_watched, event_id % 3 = 0 AS notes_taken, event_id % 5 = 0 AS resources_downloaded
FROM events JOIN ({_NUMBERED}) p1
  ON {_NUMBER}""",
    ),
    "module": (
        ("part",),
        """SELECT concat(course_id, '-M', cast(n AS STRING)) AS module_id, course_id, cast(n AS INT) AS module_number, concat('Module ', cast(n AS STRING)) AS module_title,
  CASE n WHEN 3 THEN 'quiz' WHEN 4 THEN 'assignment' ELSE 'video' END AS module_type, cast(10 * n AS INT) AS duration_minutes, cast(5 - n AS INT) AS order_no
FROM (SELECT DISTINCT concat('C-', p_brand, '-', p_type) AS course_id FROM part) c CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(n)""",
    ),
    "module_progress": (
        ("lineitem", "orders", "part"),
        f"""SELECT DISTINCT {_SID.format("o_custkey")} AS student_id, concat('C-', p_brand, '-', p_type, '-M', cast(n AS STRING)) AS module_id, TRUE AS completed
{_LINE} CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(n) WHERE (l_orderkey + l_linenumber) % 5 >= n""",
    ),
    "question": (
        ("part",),
        """SELECT concat(course_id, '-Q', cast(n AS STRING)) AS question_id, course_id, 'Final' AS quiz_title, cast(n AS INT) AS question_number,
  CASE n % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS correct_answer, concat('first of ', cast(n AS STRING)) AS option_a, concat('second of ', cast(n AS STRING)) AS option_b,
  concat('third of ', cast(n AS STRING)) AS option_c, concat('fourth of ', cast(n AS STRING)) AS option_d, cast(3 + n % 3 AS INT) AS points
FROM (SELECT DISTINCT concat('C-', p_brand, '-', p_type) AS course_id FROM part) c CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS t(n)""",
    ),
}
#: Tables of the catalogue: a few rows made of all parts. They are kept, so that their files show how small they are.
_CATALOGUE = ("course", "module", "question")
#: What the tables of line items read of their joined rows.
_LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, o_custkey, o_orderstatus"
#: The kinds of parts, of which line items carry the number.
_KINDS = "SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) AS kind FROM (SELECT DISTINCT p_brand, p_type FROM part) p0"


class Platform:
    """The platform's tables over a folder of driver tables; each is built when first asked for.

    Spark gets the rows of BODIES in cheaper ways: line items are joined with their orders and parts
    once for all tables, the catalogue is made once, and activity finds its course by the number.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._built[name]

    def _line(self) -> DataFrame:
        """Line items with their orders and parts, joined once for the state of the files.

        They carry the number of their part's kind, so the join that gives back its names also keeps Spark from
        taking what is made of them for small because their packed files are.
        """
        if "line" not in self._built:
            kinds = small_side(self._kept_of("kinds", ("part",), lambda: self.spark.sql(_over(_KINDS, ("part",)), part=self.raw("part")), body=_KINDS))
            tables = ("lineitem", "orders", "part")
            numbered = f"SELECT {_LINE_COLUMNS}, k.kind {_LINE} JOIN {{kinds}} k ON part.p_brand <=> k.p_brand AND part.p_type <=> k.p_type"
            for t in tables:
                numbered = numbered.replace(f"FROM {t} ", f"FROM {{{t}}} AS {t} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
            build = lambda: self.spark.sql(numbered, kinds=kinds, **{t: self.raw(t) for t in tables})
            self._built["line"] = self._kept_of("line", tables, build, body=numbered).join(kinds, "kind")
        return self._built["line"]

    def _numbered_courses(self) -> DataFrame:
        if "numbered" not in self._built:
            self._built["numbered"] = self._kept_of("numbered", ("part",), lambda: self.spark.sql(_over(_NUMBERED, ("part",)), part=self.raw("part")), body=_NUMBERED)
        return self._built["numbered"]

    def _kept_of(self, label: str, tables: tuple[str, ...], build: Callable[[], DataFrame], **params: object) -> DataFrame:
        return kept(self.spark, label, [f"{self.sf_dir}/{t}.parquet" for t in tables], build, **params)

    def _frame(self, name: str) -> DataFrame:
        needs, body = BODIES[name]
        if _LINE in body:
            return self.spark.sql(body.replace(_LINE, "FROM {line}"), line=self._line())
        if name == "activity":
            courses = self._numbered_courses()
            first = courses.select("courses").first()  # one number
            body = body.replace(f"({_NUMBERED})", "{numbered}").replace(_NUMBER, _NUMBER.replace("courses", str(first["courses"] if first else 1)))
            return self.spark.sql(_over(body, ("events",)), events=self.raw("events"), numbered=small_side(courses.select("course_id", "n")))
        build = lambda: self.spark.sql(_over(body, needs), **{t: self.raw(t) for t in needs})
        return self._kept_of(name, needs, build, body=body) if name in _CATALOGUE else build()

    def kept(self, label: str, tables: tuple[str, ...], build: Callable[[], DataFrame], **params: object) -> DataFrame:
        """A result made from these tables, kept for the state of the files that they come from."""
        return kept(self.spark, label, self._files(tables), build, bodies=[BODIES[t][1] for t in tables], **params)

    def kept_model(self, label: str, tables: tuple[str, ...], fit: Callable[[], object | None], kind: type, **params: object) -> object | None:
        """A fitted model likewise."""
        return kept_model(self.spark, label, self._files(tables), fit, kind, bodies=[BODIES[t][1] for t in tables], **params)

    def _files(self, tables: tuple[str, ...]) -> list[str]:
        return [f"{self.sf_dir}/{n}.parquet" for n in sorted({n for t in tables for n in BODIES[t][0]})]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BODIES:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._frame(name)
        return self._built[name]


def _over(body: str, tables: tuple[str, ...]) -> str:
    for table in tables:
        body = _in_braces(body, table)
    return body


def _in_braces(body: str, table: str) -> str:
    for word in ("FROM", "JOIN"):
        body = body.replace(f"{word} {table} ", f"{word} {{{table}}} ").replace(f"{word} {table})", f"{word} {{{table}}})")
        if body.endswith(f"{word} {table}"):
            body = body[: -len(table)] + f"{{{table}}}"
    return body


def with_tables(sql: str, *names: str, more: str = "") -> str:
    """DuckDB SQL with the named tables (and further common table expressions) before it."""
    ctes = [f"{n} AS ({BODIES[n][1]})" for n in names] + ([more] if more else [])
    return f"WITH {', '.join(ctes)} {sql}"
