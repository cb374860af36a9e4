"""SentencePiece encoding and decoding: exact merge-type BPE by backtracking.

A chunk is encoded from left to right: take the longest piece that starts here (all matches come
from one Aho-Corasick pass over the chunk), and accept it if it is compatible with the piece before
it, that is, if re-merging the two together gives the same two pieces. If it isn't, try the next
shorter piece; if none is left, step back one piece. A bitfield marks the positions from which the
rest can't be reached. The result is the one sequence that the merges give.

A text falls into chunks at white space (no piece of the model has the space mark after another
character) and at line ends (no piece has one); so a chunk's pieces don't depend on its
neighbours, and frequent chunks are encoded once for a task. Runs of space marks are the one
place where pieces share a score; they are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A BPE model file: encodes and decodes as the sentencepiece library does.

    Of the library's options it takes what the file says: identity normalization, a dummy prefix,
    no removal of extra white space, byte fallback. Other models raise ValueError.
    """

    def __init__(self, data: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("this model needs options that are not supported")
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: score for p, score, kind in pieces if kind == NORMAL}
        self.byte_ids = {int(p[1:-1], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.ids):
            raise ValueError("this model has pieces that go over white space")
        bytes_of = {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.bytes_of = [bytes_of.get(k, p.encode() if kind == NORMAL else b" \xe2\x81\x87 " if kind == UNKNOWN else b"").replace(MARK.encode(), b" ") for k, (p, _, kind) in enumerate(pieces)]
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            self.machine.add_word(p, p)
        self.machine.make_automaton()
        #: A piece -> the next shorter piece that it starts with.
        self.shorter = {p: q for p in self.ids for q in [next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None)] if q}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: best score first, then leftmost. Characters without a piece stay alone."""
        parts = list(text)
        if len(parts) <= 32:  # a queue only pays for long texts
            get, none = self.scores.get, float("-inf")
            pairs = [get(x + y, none) for x, y in zip(parts, parts[1:])]
            while pairs and (best := max(pairs)) > none:
                k = pairs.index(best)
                made = parts[k] + parts[k + 1]
                parts[k : k + 2] = [made]
                del pairs[k]
                if k:
                    pairs[k - 1] = get(parts[k - 1] + made, none)
                if k < len(pairs):
                    pairs[k] = get(made + parts[k + 1], none)
            return parts
        before, after = [k - 1 for k in range(len(parts))], [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-score, a, b, parts[a] + parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, made = heapq.heappop(queue)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != made:
                continue
            parts[a], parts[b] = made, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p]

    def _fit(self, a: str, b: str) -> bool:
        got = self.fits.setdefault(a, {})[b] = a + b not in self.scores and self.merged(a + b) == [a, b]
        self.n_fits += 1
        return got

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text without runs of marks. Characters without a piece stay alone, and pieces don't join over them."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.machine.iter(text):
            longest[end - len(piece) + 1] = piece  # longer pieces from a position come later
        out: list[str] = []
        fits, shorter = self.fits, self.shorter
        failed = at = 0
        piece = longest[0] if n else None
        while at < n:
            row = fits.get(out[-1]) if out else None
            while piece is not None:
                if not failed >> at + len(piece) & 1:
                    if not out:
                        break
                    fit = row.get(piece) if row is not None else None
                    if fit or fit is None and self._fit(out[-1], piece):
                        break
                piece = shorter.get(piece)
            if piece is None and longest[at] is None:
                piece = text[at]  # nothing merges with a character that has no piece
                if failed >> at + 1 & 1:
                    piece = None
            if piece is not None:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError("no sequence of pieces")
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                piece = shorter.get(piece)
        return out

    def chunk_ids(self, rest: str, marks: int) -> list[int]:
        """The ids of ``marks`` space marks and a rest without marks."""
        lines = rest.split("\n")
        pieces = self.backtracked(MARK + lines[0] if marks else lines[0])
        if marks > 1:  # the last mark belongs to the word if it joins it, else to the run
            pieces = self.merged(MARK * marks) + pieces[1:] if pieces[0] == MARK else self.merged(MARK * (marks - 1)) + pieces
        for line in lines[1:]:
            pieces += ["\n", *self.backtracked(line)]
        out: list[int] = []
        for p in pieces:
            if (k := self.ids.get(p)) is None:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(k)
        return out

    @staticmethod
    def chunks(text: str) -> list[tuple[str, int]]:
        """(rest, marks) of a text with its dummy prefix."""
        out: list[tuple[str, int]] = []
        marks = 0
        for rest in text.replace(" ", MARK).split(MARK):
            marks += 1
            if rest:
                out.append((rest, marks))
                marks = 0
        return [*out, ("", marks)] if marks else out

    def encode(self, text: str) -> list[int]:
        return [k for rest, marks in self.chunks(text) for k in self.chunk_ids(rest, marks)] if text else []

    def decode(self, ids: list[int]) -> str:
        return self.join_bytes([b"".join([self.bytes_of[k] for k in ids])])

    @staticmethod
    def join_bytes(parts: list[bytes]) -> str:
        """The text of decoded bytes: the dummy prefix goes."""
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Chunks(dict):
    """Rest of a chunk -> its ids joined by commas, or a pair of that and the decoded bytes where these aren't the chunk itself.

    ``marks`` space marks stand before each rest. Emptied when full, so that memory stays bounded.
    """

    MOST = 350_000
    MOST_PAIRS = 300_000

    def __init__(self, model: PieceModel, marks: int):
        super().__init__()
        self.model, self.marks = model, marks

    def __missing__(self, rest: str):
        if len(self) >= self.MOST:
            self.clear()
        if self.model.n_fits >= self.MOST_PAIRS:
            self.model.fits.clear()
            self.model.n_fits = 0
        ids = self.model.chunk_ids(rest, self.marks)
        joined, back = ",".join(map(str, ids)), b"".join([self.model.bytes_of[k] for k in ids])
        found = joined if back == b" " * self.marks + rest.encode() else (joined, back)
        if len(joined) < 400:
            self[rest] = found
        return found


class _Digester:
    """Encodes and decodes whole texts chunk by chunk."""

    def __init__(self, model: PieceModel):
        self.model, self.marked, self.bare = model, _Chunks(model, 1), _Chunks(model, 0)

    def __call__(self, text: str) -> tuple[str, str]:
        """The ids of a text joined by commas, and the text decoded from them."""
        if not text:
            return "", ""
        if text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and MARK not in text:
            marked, bare = self.marked, self.bare
            try:
                first, *lines = text.split("\n")
                parts = [marked[w] for w in first.split(" ")]
                for line in lines:
                    words = line.split(" ")
                    parts.append(bare["\n"])
                    if line:
                        parts.append(bare[words[0]])
                        parts += [marked[w] for w in words[1:]]
                return ",".join(parts), text
            except TypeError:  # a pair among the parts
                pass
        ids, back = [], []
        for rest, marks in self.model.chunks(text):
            first, *lines = rest.split("\n")
            found = [(marks, self.marked[first] if marks == 1 else self.bare[first] if not marks else _Chunks(self.model, marks)[first], first)]
            for line in lines:
                found.append((0, self.bare["\n"], "\n"))
                if line:
                    found.append((0, self.bare[line], line))
            for n, got, chunk in found:
                ids.append(got if type(got) is str else got[0])
                back.append(b" " * n + chunk.encode() if type(got) is str else got[1])
        return ",".join(filter(None, ids)), self.model.join_bytes(back)

    def forget(self) -> None:
        """Empty the caches: workers live on and serve other steps."""
        self.marked.clear()
        self.bare.clear()
        self.model.fits.clear()
        self.model.n_fits = 0


_digesters: dict[str, _Digester] = {}


def _digester(data: bytes) -> _Digester:
    key = hashlib.sha256(data).hexdigest()
    if key not in _digesters:
        _digesters[key] = _Digester(PieceModel(data))
    return _digesters[key]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, where asked for, ids (array of int) and decoded of every document.

    A null text counts as empty; an empty text has no ids; texts of any length are encoded whole.
    Repeated rows are encoded each for itself, other columns are ignored, whatever their names, an
    empty table gives no rows. The model file is read on the
    driver and sent to the executors (half a megabyte). Rows are mapped one by one: no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digester(model.value)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    counts, digests, decoded, ids, texts = [], [], [], [], []
                    for text in rows.column(1).to_pylist():
                        joined, back = digest(text)
                        counts.append(joined.count(",") + 1 if joined else 0)
                        digests.append(hashlib.sha256(joined.encode()).hexdigest())
                        decoded.append(hashlib.sha256(back.encode()).hexdigest())
                        if with_ids:
                            ids.append([int(k) for k in joined.split(",")] if joined else [])
                            texts.append(back)
                    arrays = [rows.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            digest.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
