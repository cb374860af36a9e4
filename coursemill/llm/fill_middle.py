"""Fill-in-middle transformation of whole Arrow batches.

A batch's texts are one UTF-8 buffer. A byte-class lookup and a mask of adjacent bytes mark where
tokens end; a cumulative sum, reset at each document, numbers the ends, and one searchsorted finds
both cuts of all rows. Bytes of a multi-byte character are never blank, so cuts fall between code
points. The pieces are slices of the buffer: three for each row in one Arrow array that shares the
texts' bytes. Outputs are put together by a single take from it; the way back is cut out likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.session import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Hundredths of the documents that are transformed, and of those the ones with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
FORMS = np.array(["plain", "psm", "spm"])
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 23
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, np.int8)
_LETTER[[ord("P"), ord("S"), ord("M")]] = 1, 2, 3
_MARKS = pa.array(["", PREFIX, SUFFIX, MIDDLE], pa.large_string())


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts without nulls; offsets from 0."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(texts: pa.Array, size: int = BYTES_AT_ONCE) -> Iterator[slice]:
    """Slices of rows that have about so many bytes together."""
    offsets = buffer_of(texts)[1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield slice(at, end)
        at = end


def slices(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The texts between ascending edges, sharing the bytes of ``data``."""
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def joined(pieces: pa.Array, order: np.ndarray) -> pa.Array:
    """For each row of ``order`` the texts at its places, joined."""
    flat = pieces.take(pa.array(order.ravel()))
    data, offsets = buffer_of(flat)
    return slices(data, offsets[:: order.shape[1]])


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, kinds 1 to 3) of the strings <P>, <S> and <M> in a buffer."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    kinds = _LETTER[data[1:-1]]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & (kinds > 0))
    return at, kinds[at]


def first_in_rows(at: np.ndarray, width: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places lie, ``width`` bytes long, within one row, and each place's row."""
    row = np.searchsorted(offsets, at, side="right") - 1
    return at + width <= offsets[row + 1], row


def transform(texts: pa.Array, h: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts without nulls. h: four columns of random numbers."""
    data, offsets = buffer_of(texts)
    rows, starts, ends = len(texts), offsets[:-1], offsets[1:]
    blank = BLANK[data]
    filled = ends > starts
    end = np.zeros(len(data), bool)
    end[:-1] = ~blank[:-1] & blank[1:]
    end[ends[filled] - 1] = True
    count = np.concatenate(([0], np.cumsum(end)))
    before = count[starts]
    n = count[ends] - before
    units = np.sort(np.stack((h[:, 0] % (n + 1), h[:, 1] % (n + 1))), axis=0)
    # the cut after unit k is where the count first reaches k more than before the document
    cuts = np.where(units > 0, np.searchsorted(count, before + units), starts)
    place, _ = marks(data)
    inside, row = first_in_rows(place, 3, offsets)
    plain = ~filled | (h[:, 2] % 100 >= rate)
    plain[row[inside]] = True
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < suffix_first, 2, 1))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    pieces = pa.chunked_array([slices(data, np.append(np.stack((starts, cuts[0], cuts[1]), 1).ravel(), len(data))), _MARKS]).combine_chunks()
    p, m, s = (3 * np.arange(rows) + k for k in range(3))
    none, mark = 3 * rows, 3 * rows + np.arange(4)
    full = lambda k: np.full(rows, mark[k])
    order = np.stack([
        np.choose(form, [full(0), full(1), full(2)]), np.choose(form, [p, p, s]), np.choose(form, [full(0), full(2), full(1)]),
        np.choose(form, [m, s, p]), np.choose(form, [full(0), full(3), full(3)]), np.choose(form, [s, m, m]),
    ], 1) if rows else np.zeros((0, 6), np.int64) + none
    return {
        "n": pa.array(n.astype(np.int64)), "form": pa.array(FORMS[form], pa.string()),
        "prefix_chars": pa.array(points[cuts[0]] - points[starts], pa.int64(), mask=plain), "middle_chars": pa.array(points[cuts[1]] - points[cuts[0]], pa.int64(), mask=plain),
        "output": joined(pieces, order),
    }


def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that ``transform`` got, from its outputs and forms: a transformed output holds each mark once."""
    data, offsets = buffer_of(outputs)
    form = np.array(forms.to_pylist(), object)
    moved = form != "plain"
    place, _ = marks(data)
    inside, row = first_in_rows(place, 3, offsets)
    keep = inside & moved[row]
    place, row = place[keep], row[keep]
    if not np.array_equal(np.bincount(row, minlength=len(form)), np.where(moved, 3, 0)):
        raise ValueError("an output does not hold each mark once")
    # seven edges for each row: start, three marks' starts and ends, of which a plain row has all at its start
    edges = np.repeat(offsets[:-1], 7).reshape(-1, 7)
    edges[moved, 1:] = np.stack((place, place + 3), 1).reshape(-1, 6)
    pieces = slices(data, np.append(edges.ravel(), len(data)))
    at = 7 * np.arange(len(form))
    first, second, third = at + 2, at + 4, at + 6
    spm = form == "spm"
    # psm: prefix, suffix, middle; spm: suffix, prefix, middle; a plain row lies in its last piece whole
    order = np.stack((np.where(moved, np.where(spm, second, first), at), np.where(moved, third, at + 1), np.where(moved, np.where(spm, first, second), third)), 1)
    return joined(pieces, order)


def draws(seed: int = SEED) -> list[Column]:
    """Four unsigned numbers of a document, from the hexadecimal SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    n counts the tokens: a word with the blanks before it, or the blanks that end the text. Form is
    ``plain`` (output is the text, both lengths are null) where the text is empty, holds a mark, or
    is not drawn; else ``spm`` or ``psm``. A null text is an empty one. A document without an id draws
    as ``seed:`` alone does. Texts of any length are cut whole, repeated rows alike; an empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch.column(1)):
                own = batch.slice(part.start, part.stop - part.start)
                h = np.stack([own.column(k).to_numpy() for k in range(2, 6)], 1)
                made = transform(own.column(1), h, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([own.column(0), *made.values()], names=["doc_id", *made]).cast(target)

    target = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draws(seed))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle(), or others with form and output, with the text in column ``restored``."""
    ship(made.sparkSession)
    names = made.columns
    at = {c: names.index(c) for c in ("form", "output")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch.column(at["output"])):
                own = batch.slice(part.start, part.stop - part.start)
                text = restore(own.column(at["output"]), own.column(at["form"]))
                yield pa.RecordBatch.from_arrays([*own.columns, text.cast(pa.string())], names=[*names, "restored"])

    schema = made.select("*", F.lit("").alias("restored")).schema
    return made.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tok, sha256('42:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(tok) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT *, array_to_string(tok[1:lo], '') AS pre, array_to_string(tok[lo + 1:hi], '') AS mid, array_to_string(tok[hi + 1:], '') AS suf,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
