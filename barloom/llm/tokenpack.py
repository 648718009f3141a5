"""Token ids in fixed-width bit-packed files.

Layout of a ``.blpk`` file (all integers little-endian)::

    b"BLPK1\\0" | u8 bits | u8 0
    blocks: each holds BLOCK ids (the last one fewer), every id in ``bits`` bits, padded to a whole byte
    footer: u64 byte offset of each block | u64 tokens of each document | their ids, an Arrow stream of one column
    trailer: u64 blocks | u64 documents | u64 ids | u64 footer offset | b"BLPK1\\0"

The offsets give random access: document ``k`` starts at the sum of the counts before it, which lies in
block ``start // BLOCK`` at bit ``start % BLOCK * bits``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm.common import fresh_path
from barloom.llm.memory import claim, keep

MAGIC = b"BLPK1\0"
BLOCK = 65536
CACHE = 400_000  # entries a generation of the word caches; two generations live at once


def min_bits(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, each in ``bits`` bits, little-endian bit order."""
    if not len(ids):
        return b""
    if int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    flat = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flat[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, "<u4")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class PackWriter:
    """Streams documents into one file; memory is a block of ids plus each document's id and length."""

    def __init__(self, out, bits: int, id_type: pa.DataType | None = None):
        self.out, self.bits, self.at, self.id_type = out, bits, 0, id_type or pa.int64()
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.offsets: list[int] = []
        self.doc_ids: list = []
        self.counts: list[int] = []
        self._put(MAGIC + bytes([bits, 0]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, end, BLOCK):
            self.offsets.append(self.at)
            self._put(pack(ids[k : min(k + BLOCK, end)], self.bits))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= 4 * BLOCK:
            self._flush()

    def close(self) -> None:
        self._flush(last=True)
        footer = self.at
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(np.array(self.counts, "<u8").tobytes())
        sink = pa.BufferOutputStream()
        column = pa.record_batch([pa.array(self.doc_ids, self.id_type)], names=["doc_id"])
        with pa.ipc.new_stream(sink, column.schema) as writer:
            writer.write_batch(column)
        self._put(sink.getvalue().to_pybytes())
        self._put(struct.pack("<4Q", len(self.offsets), len(self.counts), self.n_ids, footer) + MAGIC)


class PackReader:
    """Random access to one file through any seekable handle."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        self.file.seek(size - 38)
        tail = self.file.read(38)
        if tail[32:] != MAGIC:
            raise ValueError("not a packed token file")
        blocks, docs, self.n_ids, self.footer = struct.unpack("<4Q", tail[:32])
        self.file.seek(6)
        self.bits = self.file.read(2)[0]
        self.file.seek(self.footer)
        self.offsets = np.frombuffer(self.file.read(8 * blocks), "<u8")
        self.counts = np.frombuffer(self.file.read(8 * docs), "<u8").astype(np.int64)
        self.doc_ids = pa.ipc.open_stream(self.file.read(size - 38 - self.file.tell())).read_all()["doc_id"].to_pylist()
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self._block, self._ids = -1, np.empty(0, "<u4")

    def block(self, k: int) -> np.ndarray:
        if k != self._block:
            end = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.footer
            self.file.seek(int(self.offsets[k]))
            n = min(BLOCK, self.n_ids - k * BLOCK)
            self._block, self._ids = k, unpack(self.file.read(int(end - self.offsets[k])), self.bits, n)
        return self._ids

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = []
        for k in range(start // BLOCK, -(-end // BLOCK)):
            parts.append(self.block(k)[max(start - k * BLOCK, 0) : end - k * BLOCK])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def crcs(self) -> Iterator[tuple[object, int, int]]:
        """(doc_id, tokens, crc32 of the ids as u32) of every document; one block in memory at a time."""
        for k in range(len(self.counts)):
            crc, at, end = 0, int(self.starts[k]), int(self.starts[k + 1])
            while at < end:
                stop = min(end, (at // BLOCK + 1) * BLOCK)
                crc = zlib.crc32(self.ids(at, stop).tobytes(), crc)
                at = stop
            yield self.doc_ids[k], int(self.counts[k]), crc


class GenerationCache(dict):
    """A dict of bounded size: when it is full it becomes the old generation, and what is used comes back."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, remembering white-space separated words.

    Words may be remembered when the file's normalizer and pre-tokenizer never look across white space; that
    is the case for the pipeline checked in ``__init__``. Any other file is encoded text by text. Within a
    word of Latin-1 characters the pre-tokenizer's pattern is applied here and the library's own model encodes
    each piece; every other word goes through the whole library pipeline.
    """

    # fixed values: the pipeline whose words are independent, as its file states it
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # the same classes for lower-cased Latin-1 text
    LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
    TRAILING = ".,;:!?*#$%&|\""
    ODD_SPACE = re.compile("[\x1c-\x1f\x85​⁠﻿᠎]")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": self.PATTERN}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces = GenerationCache(self._piece)
        self.words = GenerationCache(self._word)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        self.shift = {b: 256 + k for k, b in enumerate(rest)}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.shift)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if word.isascii() or max(word) <= "ÿ":
            if not ("<" in word and any(s in word for s in self.special)):
                pieces, low = self.pieces, word.lower()
                core = low.rstrip(self.TRAILING)
                if core.isalpha():  # the common case without the pattern: letters, then perhaps marks
                    return pieces[core] if len(core) == len(low) else pieces[core] + pieces[low[len(core) :]]
                return b"".join([pieces[p] for p in self.LATIN.findall(low)])
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian u32 bytes."""
        if not self.by_word or (not text.isascii() and self.ODD_SPACE.search(text)) or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        return b"".join([words[w] for w in text.split()])


_ENCODERS: dict[str, WordEncoder] = {}  # one a Python worker: the words it remembers serve all its tasks


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
        keep("tokens", _ENCODERS[path].words)
        keep("tokens", _ENCODERS[path].pieces)
    claim("tokens")
    return _ENCODERS[path]


MANIFEST = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)
SHARD_BYTES = 64 << 20  # of the input as stored; a shard holds so much or less


def _open(uri: str, mode: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    if mode == "w":
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path)
    return fs.open_input_file(path)


def write_packed(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, vocab_size: int = 49408) -> list:
    """Encode ``doc_id, text`` and write one file a range partition in ascending doc_id order.

    Returns the manifest rows ``(shard, path, n_docs, n_ids)`` in shard order, one for each non-empty
    partition. A retried task writes under its own attempt's name and only the name in the manifest is read,
    so a lost executor costs its shards again and nothing else. Null texts are empty; null doc_ids come
    first; equal doc_ids are ordered by a hash of their text. Ids can be of any type. Rows with equal or null
    ids, however many, are dealt to many shards.
    """
    bits = min_bits(max(vocab_size, end_id + 1))
    end = np.array([end_id], "<u4")
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = encode = None
        task = TaskContext.get()
        path = f"{out_dir}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.blpk"
        for batch in batches:
            if writer is None:
                encode, out = _encoder(tokenizer_path), _open(path, "w")
                writer = PackWriter(out, bits, id_type)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, np.concatenate((np.frombuffer(encode(text.as_py() or ""), "<u4"), end)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([len(writer.counts)]), pa.array([writer.n_ids])],
                names=MANIFEST.names,
            )

    spark = docs.sparkSession
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of files; beyond a petabyte it isn't known
    by_size = -(-stored // SHARD_BYTES) if stored < 1 << 50 else 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(by_size, 100_000))
    keys = ["doc_id", "_mark", "_row"]
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_mark"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    # one row a shard: bounded by the number of partitions, not of documents
    return sorted(ordered.mapInArrow(shard, MANIFEST).collect())


def read_packed(spark, manifest: list, id_type: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """Read packed files back: ``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored ids."""
    start, rows = 0, []
    kinds = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.int64()]
    for shard, path, _, n_ids in manifest:
        rows.append((shard, path, start))
        start += n_ids

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                with _open(row["path"], "r") as file:
                    for doc_id, n, crc in PackReader(file).crcs():
                        out.append((doc_id, at, n, crc))
                        at += n
                        if len(out) >= 20_000:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    def _batch(out):
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a slice: each file is read in its own task
    rdd = spark.sparkContext.parallelize(rows, max(1, len(rows)))
    return spark.createDataFrame(rdd, "shard int, path string, start long").mapInArrow(digests, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, vocab_size: int = 49408) -> DataFrame:
    """Write the packed files below the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    written = write_packed(docs, fresh_path(spark, "tokens"), tokenizer_path, end_id, vocab_size)
    return read_packed(spark, written, docs.schema["doc_id"].dataType)
