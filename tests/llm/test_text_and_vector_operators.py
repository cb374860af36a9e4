"""Fill-in-middle, near-duplicate vectors and collocations against brute force, with their edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coursemill.llm import collocations, fill_middle, neardup

DOCS = "doc_id long, text string, lang string, source string, output string, form string, n long, block long, stream string, vec string"
VECTORS = "vec_id long, embedding array<double>, label int, cid string, vec string, tab int, m int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, "x", "psm", 1, 1, "s", "v") for i, t, lang in rows], DOCS)


# --- fill in middle ---


def plain_fim(doc_id, text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng, n):
    parts = ["a", "é", "\n", " ", "\t", "<P>", "<", "S>", "<M", "𝄞", "\x0b", "\x85", " ", "word ", ">", "\0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_fim_equals_plain_code(spark):
    rng = random.Random(1)
    texts = [*odd_texts(rng, 400), None, "", " ", "<P>", "one", "é" * 50, " ".join(f"w{k}" for k in range(60_000))]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(7, texts[7], "en"), (None, "a text without an id", None), (None, None, None), (-3, "b c d", "en")]
    made = fill_middle.restored(fill_middle.fill_in_middle(documents(spark, rows))).collect()
    want = [(i, *plain_fim(i, t or ""), t or "") for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([tuple(r) for r in made], key=key) == sorted(want, key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_fim_digests_and_no_rows(spark):
    rows = [(5, "alpha beta gamma delta", "en"), (6, None, None)]
    for r in fill_middle.digests(documents(spark, rows)).collect():
        text = dict((i, t or "") for i, t, _ in rows)[r["doc_id"]]
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(plain_fim(r["doc_id"], text)[4].encode()).hexdigest()
    assert fill_middle.digests(documents(spark, [])).count() == 0


def test_fim_kernel_takes_slices_and_small_runs():
    texts = pa.array(["no", *odd_texts(random.Random(2), 60), "no"]).slice(1, 60)
    h = np.random.default_rng(1).integers(0, 2**32, (60, 4))
    whole = fill_middle.transform(texts, h)
    parts = [fill_middle.transform(texts[s], h[s]) for s in fill_middle.runs(texts, 50)]
    for name, column in whole.items():
        assert column.to_pylist() == [x for p in parts for x in p[name].to_pylist()]
    assert fill_middle.restore(whole["output"], whole["form"]).to_pylist() == texts.to_pylist()
    with pytest.raises(ValueError, match="each mark once"):
        fill_middle.restore(pa.array(["<P>a<S>b"]), pa.array(["psm"]))


# --- near-duplicate vectors ---


def plain_links(rows):
    fine = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up = list(range(len(rows)))
    links = Counter()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(fine, 2):
        if len(rows[a][1]) == len(rows[b][1]) and neardup.cosine_of(np.array(rows[a][1]), np.array(rows[b][1])) >= 0.95:
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    named = {}
    for k in fine:
        named[root(k)] = min(named.get(root(k), rows[k][0]), rows[k][0])
    return [(i, links[k], named[root(k)] if k in fine else i, i is not None and i == (named[root(k)] if k in fine else i)) for k, (i, _) in enumerate(rows)]


def vector_rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(1000 - k, (centres[k % 12] + 0.12 * rng.standard_normal(16)).tolist()) for k in range(150)]
    rows += [(2000 + k, rng.standard_normal(16).tolist()) for k in range(40)]
    same = rows[3][1]
    rows += [(5, same), (6, same), (6, same), (7, [2 * x for x in same]), (8, [x * 1e200 for x in same]), (9, [x * 1e-200 for x in same])]
    rows += [(20, None), (21, []), (22, [0.0] * 16), (23, [math.nan] * 16), (24, [math.inf] + [1.0] * 15), (25, [None] + [1.0] * 15), (None, same), (26, [1.0, 2.0]), (27, [1.0, 2.0]), (28, [1.0, 2.1]), (6, centres[0].tolist())]
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_linked_vectors_equal_all_pairs(spark, tile):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x", "y", 0, 3) for i, v in rows], VECTORS)
    got = [tuple(r) for r in neardup.linked_vectors(df, recall=0.999999, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(plain_links(rows), key=key)
    assert neardup.linked_vectors(df.limit(0)).count() == 0


def test_more_vectors_get_more_bits_and_tables_that_keep_the_recall():
    for n in (1, 500, 10**5, 10**9):
        bits, tables = neardup.hashing(n)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.999
        assert n / 2**bits <= 2 * neardup.BUCKET
    vectors = np.random.default_rng(1).standard_normal((50, 8))
    packed, found = neardup.sketches(vectors, 6, 9)
    assert np.array_equal(neardup.buckets(packed, 6, 9), found) and found.max() < 64
    assert np.array_equal(neardup.sketches(3 * vectors, 6, 9)[1], found)


def test_forest_is_the_smallest_reached():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = rng.integers(0, 40, (2, 25))
        label = neardup.forest(40, x, y)
        assert (label[x] == label[y]).all() and (label <= np.arange(40)).all() and (label[label] == label).all()


# --- collocations ---


def plain_phrases(rows, least, longest, percent):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang, tuple(words[at : at + k])] += 1
    made = {}
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, g), a in candidates.items():
        for k in range(2, len(g)):
            for at in range(len(g) - k + 1):
                longer[lang, g[at : at + k]] = max(longer[lang, g[at : at + k]], a)
    for (lang, g), a in candidates.items():
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        made[lang, " ".join(g)] = (a, left, right, n[lang], score, 100 * longer[lang, g] >= percent * a)
    return made


def phrase_rows():
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "gAmma", "été", "É", "x\0y", " ", "d'eau", "(a)", "\x1c"]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "!", "\r\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for k in range(120)]
    return rows + [(200, None, "en"), (201, "", None), (202, " \t ", "en"), (203, ".,;", "en"), (204, "one", "fr"), rows[3], rows[3], (None, None, None), (205, "very long text " * 20_000, "es"), (206, "a b c " * 500 + "\n" + "a b c d\n" * 40, "es")]


@pytest.mark.parametrize("least, longest, percent, block_bytes", [(3, 5, 100, 1 << 22), (12, 4, 80, 500), (1, 2, 100, 2_000)])
def test_phrases_equal_plain_counts(spark, least, longest, percent, block_bytes):
    rows = phrase_rows()
    got = collocations.phrases(documents(spark, rows), least, longest, percent, block_bytes).collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["subsumed"]) for r in got} == plain_phrases(rows, least, longest, percent)
    assert len(got) == len({(r["lang"], r["phrase"]) for r in got})


def test_collocations_are_ranked_by_language(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED_AT_ONCE", 40)
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.collocations(documents(spark, rows), top=30, least=3).collect()]
    want = []
    for lang, own in itertools.groupby(sorted((lang, p, *v) for (lang, p), v in plain_phrases(rows, 3, 5, 100).items() if not v[5]), key=lambda x: x[0]):
        own = sorted(own, key=lambda x: (-x[6], -x[2], x[1].encode()))[:30]
        want += [(lang, k + 1, p, a, left, right, n, score) for k, (_, p, a, left, right, n, score, _) in enumerate(own)]
    assert sorted(got) == sorted(want)
    assert collocations.collocations(documents(spark, [])).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r of counts as large as these do not fit into 64 bits."""
    a, n, left, right = 3 * 10**11 + 7, 10**15 + 3, 4 * 10**11 + 1, 10**12 - 1
    wide = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    shown = spark.sql(f"SELECT div({wide(1000 * a)} * {wide(n)}, {wide(left)} * {wide(right)}) AS x").first()["x"]
    assert shown == 1000 * a * n // (left * right) and 1000 * a * n > 2**64 and left * right > 2**64


def test_streams_come_back_without_repeated_zeros():
    stream = np.array([0, 0, 3, 0, 0, 0, 4, 5, 0], np.int64)
    assert collocations.without_repeated_zeros(stream).tolist() == [0, 3, 0, 4, 5]
    for arrays in ([stream], [stream, np.array([], np.int64), np.array([2**40, -1, 7])], [np.zeros(0, np.int64)]):
        assert [x.tolist() for x in collocations.unpack(collocations.pack(*arrays))] == [x.tolist() for x in arrays]
