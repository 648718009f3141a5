"""Removal of long repeated byte strings by prefix-free parsing.

A string of ``LENGTH`` bytes repeats if it starts at two places of the corpus. Rolling hashes of ``K`` bytes give
triggers: the trigger of a start is the least hash among the K-grams of its string (the leftmost on ties), so
equal strings have their trigger at the same place. Neighbouring starts with one trigger make a *phrase*: all
bytes of their strings. Phrases overlap by what lies ahead, up to the length that matters, which stands in for
the order of the parse: two suffixes that agree on a phrase need nothing beyond it to be told apart or joined.

* Phrases whose trigger occurs once hold no repeated string and go at once; of the rest a phrase that occurs
  twice as a whole is repeated throughout.
* The dictionary is what is left: distinct phrases that share a trigger with another one. Its suffixes are
  sorted by prefix doubling down to ``LENGTH`` bytes; neighbours in that order that agree so far are repeats.
  Phrases are dealt out by trigger. A trigger of very many phrases is first divided by the bytes that all
  strings within a range of offsets share, again and again, so that no group outgrows a task.

All counts are of the whole corpus; strings never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import hot_keys, spread_join, stash
from barloom.llm.lines import doc_key

LENGTH, K = 200, 32
WIDTH = LENGTH - K + 1  # K-grams of a string
SEGMENT = 1 << 21  # bytes that one round of numpy works on
GROUP = 1024  # phrases of one trigger that a task takes
DICTIONARY = 1 << 20  # bytes of phrases that are sorted at once, rounded up to whole groups
BROADCAST_TRIGGERS = 2_000_000  # shared triggers that are sent to every task; more are joined by document

_RNG = np.random.default_rng(99)
_BYTES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as far as a segment reaches."""
    if not _POWERS:
        n = SEGMENT + 2 * LENGTH + 1
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.ones(n, np.uint64)
            out[1:] = base
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


def _rolling(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of the base, up to each position: the rolling hash of any range is a difference, shifted back."""
    power, _ = _powers()
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)))


def _grams(total: np.ndarray) -> np.ndarray:
    """The mixed rolling hash of the K bytes from each position."""
    h = (total[K:] - total[:-K]) * _powers()[1][: len(total) - K]
    h ^= h >> np.uint64(31)
    h *= _MULTIPLY[6]
    return h ^ (h >> np.uint64(29))


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the pieces ``data[starts:ends]`` that lie one after another.

    Returns arrays: the piece, its first and last start, the trigger's place (all within ``data``), the trigger's hash and the phrase's hash.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    total = _rolling(data)
    hashes = _grams(total)
    low = np.uint64((1 << 22) - 1)
    marked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    trigger = (_window_min(marked, WIDTH) & low).astype(np.int64)  # by start
    valid = np.zeros(len(trigger) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    head = np.zeros(len(data) + 1, bool)
    head[starts] = True
    fresh |= valid & head[: len(valid)]  # pieces that touch
    first = np.flatnonzero(fresh)
    if not len(first):
        return none, none, none, none, none, none
    at = np.flatnonzero(valid)
    last = at[np.append(np.searchsorted(at, first[1:]) - 1, len(at) - 1)]
    inverse = _powers()[1]
    whole = (total[last + LENGTH] - total[first]) * inverse[first]
    whole = (whole ^ (whole >> np.uint64(31))) * _MULTIPLY[7] + ((trigger[first] - first) * 512 + (last - first)).astype(np.uint64)
    whole ^= whole >> np.uint64(33)
    return np.searchsorted(starts, first, side="right") - 1, first, last, trigger[first], hashes[trigger[first]].view(np.int64), whole.view(np.int64)


def _segments(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of documents, joined to segments: (bytes, starts, ends, document, place in it). Pieces of a long document overlap by LENGTH - 1."""
    parts, docs, places, size = [], [], [], 0

    def flush():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends, np.array(docs), np.array(places)

    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, SEGMENT - LENGTH):
            piece = text[at : at + SEGMENT - 1]
            if parts and size + len(piece) > SEGMENT:
                yield flush()
                parts, docs, places, size = [], [], [], 0
            parts.append(piece)
            docs.append(k)
            places.append(at)
            size += len(piece)
    if parts:
        yield flush()


def _body() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


PHRASES = "d1 long, d2 long, a int, lo int, hi int, trigger long, whole long"


def parse(docs: DataFrame) -> DataFrame:
    """``d1, d2, a, lo, hi, trigger, whole``: every phrase; its strings start ``lo`` to ``hi`` bytes before the trigger at ``a``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, starts, ends, doc, place in _segments(t.as_py() for t in batch.column(2)):
                piece, first, last, at, trigger, whole = phrases(data, starts, ends)
                of = doc[piece] if len(piece) else piece
                a = at - starts[piece] + place[piece] if len(piece) else piece
                columns = [d1[of], d2[of], a.astype(np.int32), (at - last).astype(np.int32), (at - first).astype(np.int32), trigger, whole]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d1", "d2", "a", "lo", "hi", "trigger", "whole"])

    return docs.select(*doc_key(F.col("doc_id"), F.col("text").cast("string")), _body().alias("body")).mapInArrow(run, PHRASES)


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``trigger, whole, lo, hi, bytes``: the dictionary's phrases, ``wanted`` being ``trigger, whole`` and one place of each.

    A bounded number of triggers goes to every task, which parses its documents again and hands out the bytes;
    a larger one is joined by document.
    """
    schema = "trigger long, whole long, lo int, hi int, bytes binary"
    names = ["trigger", "whole", "lo", "hi", "bytes"]
    keys = wanted.select("trigger").distinct()
    if keys.count() <= BROADCAST_TRIGGERS:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared = known.value
            if not len(shared):
                return
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                for data, starts, ends, _, _ in _segments(t.as_py() for t in batch.column(0)):
                    _, first, last, at, trigger, whole = phrases(data, starts, ends)
                    if not len(first):
                        continue
                    k = np.minimum(np.searchsorted(shared, trigger), len(shared) - 1)
                    rows = []
                    for i in np.flatnonzero(shared[k] == trigger):
                        key = (int(trigger[i]), int(whole[i]))
                        if key not in seen:  # once a task, as far as the bound goes; again does no harm
                            if len(seen) < 500_000:
                                seen.add(key)
                            rows.append((*key, int(at[i] - last[i]), int(at[i] - first[i]), data[first[i] : last[i] + LENGTH].tobytes()))
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        found = docs.select(_body()).mapInArrow(run, schema)
    else:
        body = docs.select(*doc_key(F.col("doc_id"), F.col("text").cast("string")), _body().alias("body")).dropDuplicates(["d1", "d2"])
        span = F.expr(f"substring(body, a - hi + 1, hi - lo + {LENGTH})")
        found = body.join(wanted, ["d1", "d2"]).select("trigger", "whole", "lo", "hi", span.alias("bytes"))
    return found.groupBy("trigger", "whole").agg(F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"), F.any_value("bytes").alias("bytes"))


def string_classes(data: np.ndarray) -> np.ndarray:
    """The rank of the LENGTH-byte string at each position among all of them, by prefix doubling; equal strings have equal ranks."""
    x = data.astype(np.uint64)
    size = 1
    while size < 8:  # eight bytes fit a word, whose order is theirs
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
        size *= 2
    rank = np.unique(x, return_inverse=True)[1]
    while True:
        step = min(size, LENGTH - size)
        rank = np.unique(rank[:-step] * np.int64(len(data) + 1) + rank[step:], return_inverse=True)[1]
        size += step
        if size == LENGTH:
            return rank


def _repeats(rows: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(trigger, whole, lo, hi): the offset ranges whose strings repeat, of rows (trigger, whole, n, lo, hi, bytes)."""
    if not rows:
        return
    lengths = np.array([len(r[5]) for r in rows])
    ends = np.cumsum(lengths)
    begin = ends - lengths
    rank = string_classes(np.frombuffer(b"".join(r[5] for r in rows), np.uint8))
    n_starts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(rows)), n_starts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    of = rank[begin[owner] + offset]
    weight = np.array([r[2] for r in rows], float)
    repeated = np.bincount(of, weight[owner])[of] > 1
    edge = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8)))
    cuts = np.cumsum(n_starts)
    for a, b in edge.reshape(-1, 2):
        while a < b:  # a run may go on into the next phrase
            k = int(owner[a])
            stop = min(b, int(cuts[k]))
            trigger, whole, n, lo, hi, _ = rows[k]
            if n == 1:  # what occurs twice as a whole is known to be repeated
                yield trigger, whole, hi - int(offset[stop - 1]), hi - int(offset[a])
            a = stop


REPEATS = "trigger long, whole long, lo int, hi int"


def _sorted_groups(nodes: DataFrame) -> DataFrame:
    """Repeated offset ranges within groups ``g``, each of which arrives whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, size, at = [], 0, None
        for batch in batches:
            out: list[tuple] = []
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if g != at and size >= DICTIONARY:
                    out += _repeats(left)
                    left, size = [], 0
                at = g
                left.append(tuple(row))
                size += len(row[5])
            yield _batch(out)
        yield _batch(list(_repeats(left)))

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["trigger", "whole", "lo", "hi"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("g", "trigger", "whole", "n", "lo", "hi", "bytes").repartition(n, "g").sortWithinPartitions("g")
    return rows.mapInArrow(run, REPEATS)


def partial_repeats(dictionary: DataFrame) -> DataFrame:
    """``trigger, whole, lo, hi``: repeated offset ranges of phrases that occur once; ``dictionary`` has ``trigger, whole, n, lo, hi, bytes``."""
    nodes = stash(dictionary.withColumn("g", F.col("trigger")), "dictionary")
    out, cell = None, 128
    while True:
        sizes = nodes.groupBy("g").agg(F.count("*").alias("members"))
        large = stash(sizes.where(F.col("members") > GROUP), "large")
        few = F.broadcast(large.select("g")) if large.count() <= BROADCAST_TRIGGERS else large.select("g")
        here = _sorted_groups(nodes.join(few, "g", "left_anti"))
        out = here if out is None else out.unionByName(here)
        if large.isEmpty():
            return out
        # divide: within a cell of offsets all strings share LENGTH - cell + 1 bytes, which make the new group
        spread = nodes.join(few, "g").withColumn("cell", F.explode(F.expr(f"sequence(lo div {cell}, hi div {cell})"))).withColumn("top", F.col("hi"))
        low, high = F.expr(f"greatest(lo, cell * {cell})"), F.expr(f"least(hi, cell * {cell} + {cell - 1})")
        spread = spread.withColumn("lo2", low).withColumn("hi2", high)
        common = F.expr(f"substring(bytes, top - cell * {cell} + 1, {LENGTH - cell + 1})")
        part = F.expr(f"substring(bytes, top - hi2 + 1, hi2 - lo2 + {LENGTH})")
        spread = spread.select(F.xxhash64("g", "cell", common).alias("g"), "trigger", "whole", "n", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), part.alias("bytes"))
        spread = stash(spread.withColumn("same", F.xxhash64("lo", "hi", "bytes")), "cells")
        # equal parts: repeated as they are; one of them goes on, to be found by others
        equal = spread.groupBy("g", "same").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("trigger", "whole", "lo", "hi", "bytes")])
        again = spread.where("n = 1").join(equal.where("n > 1").select("g", "same"), ["g", "same"], "left_semi")
        out = out.unionByName(again.select("trigger", "whole", "lo", "hi"))
        if cell == 1:
            return out
        alone = equal.groupBy("g").agg(F.count("*").alias("members")).where("members > 1").select("g")
        nodes = stash(equal.join(alone, "g").select("g", "trigger", "whole", "n", "lo", "hi", "bytes"), "nodes")
        cell //= 2


def removed_spans(docs: DataFrame) -> DataFrame:
    """``d1, d2, spans``: byte ranges (start, end) to remove from each document that has any; they may overlap."""
    rows = stash(parse(docs), "phrases")
    counts = rows.groupBy("trigger").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1")
    counts = stash(counts, "counts")
    # a trigger of very many phrases, or a phrase of very many places, is dealt to many tasks
    shared = stash(spread_join(rows, counts.drop("n"), ["trigger"], hot_keys(counts, ["trigger"])), "shared")
    span = F.struct(F.expr("a - hi").alias("start"), F.expr(f"a - lo + {LENGTH}").alias("end")).alias("span")
    mixed = shared.where("mixed")
    wanted = stash(mixed.groupBy("trigger", "whole").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "a", "lo", "hi")).alias("at")), "wanted")
    places = wanted.select("trigger", "whole", "at.*")
    dictionary = _bytes_of(docs, places).join(wanted.select("trigger", "whole", "n"), ["trigger", "whole"])
    partial = stash(partial_repeats(dictionary), "partial")
    # a phrase that occurs once is in one row, so no key of this join is frequent on both sides
    ranges = partial.join(wanted.where("n = 1").select("trigger", "whole", "at.d1", "at.d2", "at.a"), ["trigger", "whole"]).select("d1", "d2", span)
    again = wanted.where("n > 1").select("trigger", "whole", "n")
    counted = spread_join(mixed, again.select("trigger", "whole"), ["trigger", "whole"], hot_keys(again, ["trigger", "whole"]))
    whole = shared.where("not mixed").select("d1", "d2", span).unionByName(counted.select("d1", "d2", span))
    # rows that repeat a document have its spans again: a set holds them once
    return whole.unionByName(ranges).groupBy("d1", "d2").agg(F.collect_set("span").alias("spans"))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(body: bytes, spans: list | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many maximal runs go."""
    if not spans:
        return body, 0
    change = np.zeros(len(body) + 1, np.int32)
    np.add.at(change, [s["start"] for s in spans], 1)
    np.add.at(change, [s["end"] for s in spans], -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(body, np.uint8)[~gone].tobytes(), runs


def _with_spans(docs: DataFrame) -> DataFrame:
    left = docs.select("doc_id", *doc_key(F.col("doc_id"), F.col("text").cast("string")), _body().alias("body"))
    return left.join(removed_spans(docs), ["d1", "d2"], "left").select("doc_id", "body", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, kept``: the bytes that stay of every document. Cuts may split a character, so these are bytes.

    Null texts are empty. Repeated rows are places of their own: a row that occurs twice repeats itself.
    """

    def run(batches):
        for batch in batches:
            kept = [_kept(b, s)[0] for b, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return _with_spans(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, runs = _kept(body, spans)
                rows.append((len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
