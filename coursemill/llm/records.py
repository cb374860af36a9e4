"""Token-ID output: length-delimited binary records with a separate offset index.

A record file is a run of frames, the framing known from TFRecord files: the payload's length
(unsigned 64 bits), the masked CRC-32C of these eight bytes, the payload, the masked CRC-32C of the
payload; all little-endian. A payload is one document: doc_id (signed 64 bits), a flag (0: the
document has no id), the width of an id in bytes (2 or 4), then the ids. The index, a Parquet
table, has file, part, offset, length, doc_id and n_tokens of every record, so that a reader can
fetch records in any order.

Files are written once under a name of their own; the index names those of the tasks that
succeeded, so a repeated task leaves an unread file at worst.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coursemill.session import new_path, ship

HEAD = struct.Struct("<QI")
ITEM = struct.Struct("<qBB")
INDEX = "part int, file string, offset long, length long, doc_id long, n_tokens long"


def _crc32c_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1))
    return table


_T = _crc32c_table()
#: _SLICES[k][b]: the effect of byte b with k zero bytes after it.
_SLICES = [_T]
for _ in range(7):
    _SLICES.append(_T[_SLICES[-1] & 0xFF] ^ (_SLICES[-1] >> np.uint32(8)))


def _squared(tables: list[list[int]]) -> list[list[int]]:
    """The tables of doing what these tables do twice."""
    return [[_carried(v, tables) for v in row] for row in tables]


def _carried(state: int, tables: list[list[int]]) -> int:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


#: _ZEROS[k]: what 2**k zero bytes do to a state, one table for each of its bytes.
_ZEROS = [[_T.tolist(), *([b << 8 * k for b in range(256)] for k in range(3))]]
for _ in range(40):
    _ZEROS.append(_squared(_ZEROS[-1]))
_BLOCK_BITS = 9


def crc32c_many(items: list[bytes]) -> list[int]:
    """CRC-32C of each item. All blocks of all items are taken side by side, so that NumPy does the inner loop.

    Zeros before the data leave a state of zero as it is, so items are filled up in front; what the
    checksum's starting state adds depends on the length alone.
    """
    size = 1 << _BLOCK_BITS
    filled = b"".join([part for x in items for part in (bytes(-len(x) % size), x)])
    blocks = np.frombuffer(filled, np.uint8).reshape(-1, size)
    part = np.zeros(len(blocks), np.uint32)
    for k in range(0, size, 8):
        b = blocks[:, k : k + 8]
        part = (
            _SLICES[7][b[:, 0] ^ (part & 0xFF)] ^ _SLICES[6][b[:, 1] ^ (part >> 8 & 0xFF)] ^ _SLICES[5][b[:, 2] ^ (part >> 16 & 0xFF)] ^ _SLICES[4][b[:, 3] ^ (part >> 24)]
            ^ _SLICES[3][b[:, 4]] ^ _SLICES[2][b[:, 5]] ^ _SLICES[1][b[:, 6]] ^ _SLICES[0][b[:, 7]]
        )
    parts, at, out = part.tolist(), 0, []
    for x in items:
        state, start = 0, 0xFFFFFFFF
        for p in parts[at : (at := at + -(-len(x) // size))]:
            state = _carried(state, _ZEROS[_BLOCK_BITS]) ^ p
        for k in range(len(x).bit_length()):
            if len(x) >> k & 1:
                start = _carried(start, _ZEROS[k])
        out.append(state ^ start ^ 0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return crc32c_many([data])[0]


def masked(crc: int) -> int:
    """A CRC as stored: turned by 15 bits and moved, as data that hold their own CRC are weak."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload in its frame."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    crcs = crc32c_many([*heads, *payloads])
    n = len(heads)
    return [b"".join((h, struct.pack("<I", masked(a)), p, struct.pack("<I", masked(b)))) for h, p, a, b in zip(heads, payloads, crcs[:n], crcs[n:], strict=True)]


def checked(found: list[tuple[bytes, bytes, bytes]]) -> list[bytes]:
    """The payloads of (head with checksum, payload, checksum); ValueError if a checksum does not hold."""
    crcs = crc32c_many([*(h[:8] for h, _, _ in found), *(p for _, p, _ in found)])
    n = len(found)
    for (h, p, c), a, b in zip(found, crcs[:n], crcs[n:], strict=True):
        if HEAD.unpack(h) != (len(p), masked(a)) or struct.unpack("<I", c)[0] != masked(b):
            raise ValueError("damaged record")
    return [p for _, p, _ in found]


def unframe(data: bytes) -> bytes:
    """The payload of one frame."""
    return checked([(data[:12], data[12:-4], data[-4:])])[0]


def pack_bytes(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return ITEM.pack(doc_id or 0, doc_id is not None, width) + ids


def next_frame(stream) -> tuple[bytes, bytes, bytes]:
    """The parts of the frame at which the stream stands."""
    head = stream.read(HEAD.size)
    n = HEAD.unpack(head)[0]
    body = stream.read(n + 4)
    return head, body[:n], body[n:]


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = ITEM.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=ITEM.size).astype("<u4")


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there. Tasks write with Arrow's file systems, which know one name for S3."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


#: Where words and lines aren't the only things that one space or line end separates.
_UNEVEN = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z")


#: Fixed value: the pattern of byte-level pre-tokens, as published with the byte-level tokenizers of GPT-2.
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: bytes that print as one letter stand for themselves, the others for letters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def checked_tokenizer(data: str) -> Tokenizer:
    """The tokenizer of a JSON text. ValueError unless it is plain byte-level BPE, for which the ids of a text are those of its chunks."""
    parts = json.loads(data)
    pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding")
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in parts.get("added_tokens", []))
    if not plain:
        raise ValueError("not a plain byte-level BPE tokenizer")
    return Tokenizer.from_str(data)


class _WordCache(dict):
    """Chunk of a text -> its ids as bytes. A chunk is a word with the space before it, a line's first word, or a line end.

    The byte-level pattern has no match over a single space or line end between other characters,
    but for the space that begins a word, so the ids of a text are those of its chunks. Texts with
    other white space are encoded whole. A chunk that is not known yet is put together from its
    pre-tokens, chunks themselves, which the library's model merges; one that holds an added token
    goes through all of the library. Emptied when full, and long chunks aren't kept, so that memory
    stays bounded.
    """

    MOST, MOST_CHARS = 1_200_000, 64

    def __init__(self, tokenizer: Tokenizer, width: int):
        super().__init__()
        self.tokenizer, self.width = tokenizer, width
        self.model = tokenizer.model
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, chunk: str) -> bytes:
        if self.added and self.added.search(chunk):
            return self._whole(chunk)
        # letters, with a space before them or not, are one pre-token
        if chunk[chunk.startswith(" ") :].isalpha() or len(pieces := _PRE_TOKENS.findall(chunk)) == 1:
            ids = self._packed(map(_ID, self.model.tokenize(chunk.encode().decode("latin-1").translate(_LETTERS))))
        else:
            ids = b"".join(map(self.__getitem__, pieces))
        if len(chunk) <= self.MOST_CHARS:
            self[chunk] = ids
        return ids

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of an even text. Its spaces are kept by splitting before them."""
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self) >= self.MOST:
            self.clear()
        if "\0" in text or _UNEVEN.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, self.chunks(text)))

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: Iterable[int]) -> bytes:
        return np.fromiter(ids, f"<u{self.width}").tobytes()


_ID = attrgetter("id")
_word_caches: dict[str, _WordCache] = {}


def _words(data: str, width: int) -> _WordCache:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _word_caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _word_caches[key] = _WordCache(checked_tokenizer(data), width)
    return _word_caches[key]


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> tuple[str, DataFrame]:
    """Tokenize every whole text, append ``end_id``, and write record files and their index.

    Files follow each other in ascending order of doc_id (documents without an id first), and so do
    the records of a file. Rows with the same doc_id are records of their own, in the order of their
    texts' hashes. A null text counts as empty: its record has just the end id. Texts of any length are
    one record. Other columns are ignored, whatever their names. An empty table gives an empty index.
    ValueError for a tokenizer that isn't plain byte-level BPE. Returns the folder and the index. The tokenizer file is read on the driver and
    sent to the executors.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "records")
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    width = 2 if max(checked_tokenizer(data).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(data)
    end = np.asarray([end_id], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary.value, width)
        part = TaskContext.get().partitionId()
        system, base = _open_fs(folder)
        system.create_dir(f"{base}/data")
        name = f"data/part-{part:06d}-{uuid.uuid4().hex}.rec"
        offset, out = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = rows.column(1).to_pylist()
                ids = [words.ids(x) + end for x in texts]
                made = frames([pack_bytes(d, x, width) for d, x in zip(rows.column(0).to_pylist(), ids, strict=True)])
                lengths, tokens = [len(x) for x in made], [len(x) // width for x in ids]
                offsets = [offset, *(offset + x for x in accumulate(lengths))]
                offset = offsets.pop()
                out = out or system.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                out.write(b"".join(made))
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), rows.column(0), pa.array(tokens, pa.int64())], names=["part", "file", "offset", "length", "doc_id", "n_tokens"])
        if out:
            out.close()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(write, INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return folder, read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, read from the files; with their ids where asked for.

    start counts the ids of all records before. A file is read by one task, front to back; before it
    stand the ids of earlier files, summed up from the index.
    """
    spark = index.sparkSession
    ship(spark)
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("length")).alias("bytes"))
    # one row per file: some thousands at most, whatever the size of the files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "file", "bytes", "start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_fs(folder)
        for batch in batches:
            for item in batch.to_pylist():
                start, left = item["start"], item["bytes"]
                with system.open_input_stream(f"{base}/{item['file']}", buffer_size=1 << 20) as f:
                    while left:
                        out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        if with_ids:
                            out["ids"] = []
                        found, size = [], 0
                        while left and len(found) < 512 and size < 1 << 24:
                            found.append(next_frame(f))
                            size += len(found[-1][1])
                            left -= len(found[-1][1]) + 16
                        for payload in checked(found):
                            doc_id, ids = unpack_ids(payload)
                            out["doc_id"].append(doc_id)
                            out["start"].append(start)
                            out["n_tokens"].append(len(ids))
                            out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                            if with_ids:
                                out["ids"].append(ids)
                            start += len(ids)
                        kinds = {"ids": pa.list_(pa.int64())}
                        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return starts.repartition(parts, "part").mapInArrow(read, schema)


def read_chosen(chosen: DataFrame, folder: str) -> DataFrame:
    """doc_id and ids of the records that ``chosen``, rows of the index in any order, names: each is fetched by its offset."""
    ship(chosen.sparkSession)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_fs(folder)
        for batch in batches:
            ids = []
            for item in batch.to_pylist():
                with system.open_input_file(f"{base}/{item['file']}") as f:
                    ids.append(unpack_ids(unframe(f.read_at(item["length"], item["offset"])))[1])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return chosen.select("file", "offset", "length", "doc_id").mapInArrow(fetch, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents and read the files back: doc_id, start, n_tokens, ids_crc32."""
    folder, index = write_records(docs, tokenizer_path, end_id)
    return read_records(index, folder)
