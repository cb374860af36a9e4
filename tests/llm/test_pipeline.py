"""The pipeline: each stage's output against a brute-force version on the stage's own input, with nulls, repeats and an empty table."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from coursemill.session import stash  # noqa: E402
from test_llm_operators import classes_by_force, copies_by_force, lines_by_force, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(21)
    out = []
    for k in range(150):
        text = words(rng, rng.randrange(20, 80)) if k % 5 else "CLICK HERE!! " * rng.randrange(5, 20)
        out.append((k, text + ("\nThis line stands in many of the documents." if k % 3 == 0 else ""), "en", rng.choice(["a", "b", "c", None]), len(text)))
    base = words(rng, 150)
    out += [(300 + k, f"{base} and the end {k}", "en", "b", 900) for k in range(8)]
    return [*out, out[7], (400, None, None, None, None), (401, "", "en", "a", 0), (None, "no id here at all", "en", "a", 17)]


def folder(spark, tmp_path, data):
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0 if r[1].startswith("CLICK") else 1, 0) for r in data if r[0] is not None and r[0] < 150 and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_every_stage(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, rows())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs, outputs = [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        docs = stash(stage(spark, docs, sf_dir), "stage")
        outputs.append([tuple(r) for r in docs.collect()])
    kept = {r[0] for r in outputs[0]}
    assert sum((r[0] in kept) == (not (r[1] or "").startswith("CLICK")) for r in inputs[0] if r[0] is not None and r[0] < 400) >= 0.97 * 159
    # lines
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((x.split(",")[0].strip("("), x.split("'")[1]) for x in lines_by_force([(r[0], r[1]) for r in inputs[1]]))
    assert sorted((str(r[0]), digest(r[1])) for r in outputs[1]) == want and all(r[4] == len(r[1]) for r in outputs[1])
    # near copies
    label = {i: c for i, _, c in classes_by_force([(r[0], r[1]) for r in inputs[2] if r[0] is not None], 5, 80)}
    assert sorted(map(str, outputs[2])) == sorted(str(r) for r in inputs[2] if r[0] is None or label[r[0]] == r[0])
    # the mix
    copies = copies_by_force([r for r in inputs[3]]) if all(r[0] is not None for r in inputs[3]) else None
    times = {}
    for r in outputs[3]:
        times[r[0]] = times.get(r[0], 0) + 1
    if copies:
        assert all(times.get(i, 0) == sum(c for j, _, c in copies if j == i) for i, _, _ in copies)
    assert set(outputs[3]) <= set(inputs[3])
    # pieces
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in inputs[4]:
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(str, (r[:4] for r in outputs[4]))) == sorted(map(str, want))
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(map(str, outputs[4]))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_codecs_caches_end_with_their_task(spark):
    """Workers live on: what the codec had cached stayed with them, beside what the next steps needed."""
    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql import functions as F

    from coursemill.llm import pieces

    def held(batches):
        for batch in batches:
            n = sum(len(d.marked) + len(d.bare) + len(d.model.fits) for d in pieces._digesters.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    docs = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and "), F.col("id").cast("string")).alias("text"))
    first = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert max(r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()) == 0
    assert first == pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
