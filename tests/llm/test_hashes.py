"""Words, shingle sets and classes whose hashes once collided, or are made to."""

import random

import numpy as np
import pytest

from coursemill.llm import jaccard

SCHEMA = "doc_id long, text string, c1 long, bits string, name string, n int"


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [256, 512, 1024, 2048, 4096])
def test_thue_morse_words_are_different_words(spark, n):
    """Sums of powers modulo 2**64 are the same for a Thue-Morse word of 1,024 letters and its complement, whatever the base."""
    words = [thue_morse(n), thue_morse(n, True)]
    assert len(set(jaccard.word_hashes(" ".join(words).encode()).tolist())) == 2
    rows = [(k + 1, f"x y {w}", 0, "", "", 0) for k, w in enumerate(words)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 1, 2: 2}


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé\0") for _ in range(n)) for n in [*range(1, 40), 511, 512, 513, 600, 2000]]
    text = "  ".join(words + words[::-1])
    h = jaccard.word_hashes(text.encode()).tolist()
    assert len(h) == 2 * len(words) and h[: len(words)] == h[len(words) :][::-1] and len(set(h)) == len(set(words))
    assert [int(jaccard.word_hashes(w.encode())[0]) for w in words] == h[: len(words)]
    assert jaccard.word_hashes(b"a")[0] != jaccard.word_hashes(b"a\0")[0]


@pytest.mark.parametrize("bits", [0, 3])
def test_sets_that_share_half_a_digest_are_not_one(spark, monkeypatch, bits):
    """The first halves of all digests are made one of few numbers: sets are still told apart, and links stay."""
    plain = jaccard.set_digest
    monkeypatch.setattr(jaccard, "set_digest", lambda items: (len(items), plain(items)[1] % (1 << bits) + 1, plain(items)[2]))
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(80)) for _ in range(12)]
    texts = base + [b + " tail" for b in base[:6]] + base[3:5] + [None, ""]
    rows = [(k, t, 0, "", "", 0) for k, t in enumerate(texts)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k: k for k in range(len(texts))} | {12 + k: k for k in range(6)} | {18: 3, 19: 4}
    assert out == want


def test_too_many_clashes_are_an_error(spark, monkeypatch):
    plain = jaccard.set_digest
    monkeypatch.setattr(jaccard, "set_digest", lambda items: (len(items), 5, plain(items)[2]))
    monkeypatch.setattr(jaccard, "MOST_RENAMED", 2)
    rows = [(k, f"text number {k} of four", 0, "", "", 0) for k in range(4)]
    with pytest.raises(RuntimeError, match="first half"):
        jaccard.jaccard_classes(spark.createDataFrame(rows, SCHEMA)).count()


def test_hashes_have_no_visible_pattern():
    """Words that differ in one place, and their shingles, spread over all 64 bits."""
    h = jaccard.word_hashes(" ".join(f"word{k}" for k in range(20_000)).encode())
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).mean(0)
    assert len(np.unique(h)) == 20_000 and abs(ones - 0.5).max() < 0.02
