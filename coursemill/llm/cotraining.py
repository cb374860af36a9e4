"""Quality classifier by co-training.

Two logistic regressions see a document from two sides: its text's content (hashed byte trigrams
and how often words repeat), and the page's metadata (language, source and recorded length, alone
and in pairs), which share no bytes. In every round each scores all unlabelled documents and hands those it is most sure of, with
the labels it gives them, to the other. Both are calibrated on labelled documents that neither has
learned from; the sum of their calibrated log odds, less the prior's, scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.llm.jaccard import word_hashes
from coursemill.session import ship, stash

LABELLED = 8_000
ROUNDS = 3
#: How many documents a view hands over in a round, and how sure it must be.
HANDED = 800
SURE = 0.98
HELD_OUT = 0.25
KEEP_ABOVE = 0.5
BUCKETS = 512
#: Hashed values: languages, sources, pairs of both, pairs of source and length; and lengths by powers of two.
LANGS, SOURCES, PAIRS, LENGTHS = 8, 16, 32, 24
SEED = 5


def text_view(raw: bytes) -> np.ndarray:
    """Content: square roots of trigram shares, the share of distinct words, of the commonest one, of words that repeat the one before."""
    out = np.zeros(BUCKETS + 3, np.float32)
    d = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(d) >= 3:
        code = (d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(2654435761)
        out[:BUCKETS] = np.sqrt(np.bincount(code >> np.uint32(23), minlength=BUCKETS) / (len(d) - 2))
    h = word_hashes(raw)
    if len(h):
        counts = np.unique(h, return_counts=True)[1]
        out[BUCKETS:] = len(counts) / len(h), counts.max() / len(h), np.count_nonzero(h[1:] == h[:-1]) / len(h)
    return out


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata: hashed language, source and both, recorded length by powers of two, that with the source, and its logarithm. A null is a value of its own."""
    out = np.zeros(LANGS + SOURCES + 2 * PAIRS + LENGTHS + 1, np.float32)
    place = lambda *values: zlib.crc32(repr(values).encode("utf-8", "surrogatepass"))
    length = 0 if n_chars is None else min(max(n_chars, 0).bit_length() + 1, LENGTHS - 1)
    at = 0
    for hashed, size in ((place(lang), LANGS), (place(source), SOURCES), (place(lang, source), PAIRS), (place(source, length), PAIRS), (length, LENGTHS)):
        out[at + hashed % size] = 1
        at += size
    out[at] = np.log1p(max(n_chars or 0, 0))
    return out


@dataclass
class Logistic:
    """A logistic regression on standardized features, fitted by Newton's method with an L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: slope and shift of the calibration
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 3.0, rounds: int = 8) -> Logistic:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1), x.dtype)), 1).astype(np.float32)
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = sigmoid(z @ w)
            gradient = z.T @ (p - y) + ridge * w
            hessian = (z * np.maximum(p * (1 - p), 1e-4).astype(np.float32)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w -= step * min(1.0, 20.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-3:
                break
        return cls(mean, scale, w[:-1].copy(), float(w[-1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, with smoothed targets."""
        m = self.margin(x)
        up, down = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(60):  # damped, with a pull towards slope 1: where the sample separates, no slope is best
            p = sigmoid(a * m + b)
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * m).sum() + (a - 1), (p - t).sum() + 1e-3 * b])
            h = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(a, 0.05), b

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds, kept within what the calibration sample can tell."""
        return np.clip(self.slope * self.margin(x) + self.shift, -12, 12)


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


@dataclass
class Quality:
    """Two calibrated views and the prior's log odds."""

    text: Logistic
    page: Logistic
    prior: float

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by the text, by the page, by both."""
        a, b = self.text.odds(text), self.page.odds(page)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


#: Gives, for the models of a round and the documents of either label that a view may hand over, each view's choice: text features, page features, labels.
Choice = Callable[[dict[str, Logistic], dict[float, int]], dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def cotrain(text: np.ndarray, page: np.ndarray, y: np.ndarray, choose: Choice, rounds: int = ROUNDS, handed: int = HANDED) -> Quality | None:
    """Fit both views. None where the labels don't have both classes on either side of the split."""
    held = np.random.default_rng(SEED).random(len(y)) < HELD_OUT
    if any(len(set(part.tolist())) < 2 for part in (y[held], y[~held])):
        return None
    views = {"text": text, "page": page}
    learned = {v: (x[~held], y[~held]) for v, x in views.items()}
    # as many of either class as the labels have, in proportion
    quotas = {label: max(1, round(handed * float(np.mean(y == label)))) for label in (0.0, 1.0)}
    models: dict[str, Logistic] = {}
    for k in range(rounds + 1):
        for v, x in views.items():
            models[v] = Logistic.fit(*learned[v])
            models[v].calibrate(x[held], y[held])
        if k == rounds:
            break
        given = choose(models, quotas)
        if not any(len(labels) for _, _, labels in given.values()):
            break
        for v, other, side in (("text", "page", 1), ("page", "text", 0)):
            x = learned[other]
            learned[other] = np.concatenate((x[0], given[v][side])), np.concatenate((x[1], given[v][2]))
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    return Quality(models["text"], models["page"], float(np.log(share / (1 - share))))


#: What the views see of a document, in this order.
SEEN = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def seen_columns(docs: DataFrame) -> list[Column]:
    """The columns of SEEN; one that the table lacks is null."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in SEEN.items()]


def _views(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    texts, langs, sources, lengths = (c.to_pylist() for c in columns)
    return np.stack([text_view((t or "").encode()) for t in texts]), np.stack([page_view(*x) for x in zip(langs, sources, lengths, strict=True)])


def _features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """mark, text and page features of (doc_id, mark, *SEEN), which must be few."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, page = _views(part.columns[2:])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in text]), pa.array([x.tobytes() for x in page])], names=["doc_id", "mark", "text", "page"])

    found = rows.select("doc_id", "mark", *SEEN).mapInArrow(features, "doc_id long, mark long, text binary, page binary").toArrow()
    # rows come in any order: sort, so that reruns agree
    found = found.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("page", "ascending")])
    widths = len(text_view(b"")), len(page_view(None, None, None))
    text, page = (np.stack([np.frombuffer(x, np.float32) for x in found.column(c).to_pylist()]) if len(found) else np.zeros((0, w), np.float32) for c, w in zip(("text", "page"), widths, strict=True))
    return found.column("mark").to_pylist(), text, page


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> Quality | None:
    """Fit on at most ``labelled`` labelled documents, the first in the order of a hash of doc_id, and on what the views hand over of all others.

    A document with several labels takes the largest; one with several rows takes part with each
    different one, within the bound. Null labels and ids don't count. Every round
    scores all unlabelled documents, and ``handed`` of them at most go from one view to the other.
    """
    spark = docs.sparkSession
    ship(spark)
    place = F.xxhash64("doc_id", F.lit(SEED))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("long").alias("mark"))
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *seen_columns(docs))
    chosen = known.orderBy(place, "doc_id").limit(labelled)  # bounded by the parameter, as are the rows of these ids
    own = rows.join(F.broadcast(chosen), "doc_id").withColumn("row_hash", F.xxhash64(*SEEN))
    mark, text, page = _features(own.dropDuplicates(["doc_id", "row_hash"]).orderBy(place, "doc_id", "row_hash").limit(labelled))
    keyed = rows.withColumn("mark", F.xxhash64("doc_id", *SEEN))
    handed_over: list[int] = []

    def choose(models: dict[str, Logistic], quotas: dict[float, int]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(dict(models))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    views = zip(("text", "page"), _views(part.columns[2:]), strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(sigmoid(own[v].odds(x)).round(9)) for v, x in views)], names=["doc_id", "mark", "p_text", "p_page"])

        scored = keyed.select("doc_id", "mark", *SEEN).mapInArrow(score, "doc_id long, mark long, p_text double, p_page double")
        is_sure = " OR ".join(f"p_{v} >= {sure} OR p_{v} <= {1 - sure}" for v in models)
        gone = spark.createDataFrame([(m,) for m in handed_over], "mark long")  # 2 x handed a round at most
        scored = scored.filter(is_sure).join(F.broadcast(gone), "mark", "left_anti").join(known, "doc_id", "left_anti").dropDuplicates(["mark"])
        scored = stash(scored, "sure")  # read four times: two views, two labels
        picked: dict[str, dict[int, float]] = {}
        for v in models:
            picked[v] = {}
            for label, quota in quotas.items():
                p = F.col(f"p_{v}") if label else 1 - F.col(f"p_{v}")
                best = scored.withColumn("p", p).filter(F.col("p") >= sure).orderBy(F.desc("p"), place, "doc_id", "mark").limit(quota)
                picked[v] |= {r["mark"]: label for r in best.select("mark").collect()}
        both = sorted(picked["text"].keys() | picked["page"].keys())
        handed_over.extend(both)
        wanted = spark.createDataFrame([(m,) for m in both], "mark long")
        found = keyed.join(F.broadcast(wanted), "mark").dropDuplicates(["mark"]) if both else keyed.limit(0)
        marks, t, p = _features(found)
        out = {}
        for v in models:
            at = [k for k, m in enumerate(marks) if m in picked[v]]
            out[v] = t[at], p[at], np.array([picked[v][marks[k]] for k in at], np.float64)
        return out

    return cotrain(text, page, np.array(mark, np.float64), choose, rounds, handed)


def classify(docs: DataFrame, model: Quality | None, keep_above: float = KEEP_ABOVE) -> DataFrame:
    """row (a struct of all columns of ``docs``), p_text, p_page, score, keep of every document. Without a model every score is 1.

    A null text counts as empty. Rows are mapped one by one: no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    # a text column goes along once, within the row
    inside = "text" in docs.columns and isinstance(docs.schema["text"].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                if own is None:
                    scores = (np.ones(n),) * 3
                else:
                    text = part.column(0).field("text") if inside else part.column(1)
                    scores = own.scores(*_views([text, *part.columns[2:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s, pa.float64()) for s in scores), pa.array(scores[2] >= keep_above)], names=["row", "p_text", "p_page", "score", "keep"])

    seen = seen_columns(docs)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.lit(None).cast("string").alias("text") if inside else seen[0], *seen[1:])
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_page", "score")), T.StructField("keep", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, p_text, p_page, score and keep of every document.

    Null columns are values like others, a null text is an empty one, and texts of any length are seen
    whole. Repeated rows and ties have equal scores. Other columns are ignored, whatever their names.
    An empty table gives no rows; without usable labels all are kept.
    """
    slim = docs.select("doc_id", *seen_columns(docs))
    return classify(slim, train(slim, labels, **params)).select(F.col("row.doc_id").alias("doc_id"), "p_text", "p_page", "score", "keep")


def good_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` without those that the classifier rejects. Cases as in score_documents(); repeated rows go or stay together, and all columns stay as they are."""
    return classify(docs, train(docs, labels, **params)).filter("keep").select("row.*")
