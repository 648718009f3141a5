"""N-gram Jaccard self-join of texts by chosen paths.

Sets are five-word shingles, embedded as minhash signatures of ``SIGNATURE`` tokens (coordinate, value): two sets
share a token with a probability equal to their similarity. A run starts with all distinct texts in one set and
splits recursively: at a node, ``CHILDREN`` coordinates are drawn from the node's path and every text goes to the
child named by its token there. Runs repeat until a pair at the threshold shares a bucket of the last level with
probability ``recall``.

* Buckets of at most ``SMALL`` members are compared member by member on their signatures.
* In larger ones every member is compared with the bucket's pivot. Members that all but equal it (``TIGHT``) stay
  behind with it: whatever is at the threshold to them resembles the pivot too, by the triangle inequality of the
  Jaccard distance, and so is tied to it.
* If the rest resembles the pivot so much that splitting gives no fewer rows than it takes, or the last level is
  reached, the bucket is compared member by member as well, in tasks of two bounded blocks; else it splits again.

Candidate groups are then checked exactly on the shingle sets themselves, in tasks of two bounded blocks whose sizes
allow the threshold. That gives each text its number of links and, as a spanning forest, the links that connect a
class; pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, hot_keys, spread_join, stash
from barloom.llm.memory import claim, keep
from barloom.llm.tokenpack import GenerationCache

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
SIGNATURE, CHILDREN, LEVELS, SMALL = 64, 2, 4, 64
CANDIDATE = 0.55  # estimated similarity that makes a candidate: five standard deviations below the threshold
TIGHT = 0.9  # estimated similarity to a pivot that lets it stand for a text
BLOCK, SIGNATURE_BLOCK = 256, 512  # texts in a block of the exact check, and of a large bucket
BROADCAST_KEYS = 200_000  # keys that are sent to every task at most

_ODD = np.random.default_rng(20240607).integers(0, 2**63, SIGNATURE + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.random.default_rng(7).integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_WORDS = GenerationCache(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)
keep("shingles", _WORDS)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, children: int = CHILDREN, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the last level with the wanted probability."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - (1 - similarity * meet) ** children
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word n-grams of the lower-cased text; a shorter text is one gram, a wordless one none."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _ODD[SIGNATURE + k] + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(29)
    return out * _ODD[SIGNATURE]


def signature(grams: np.ndarray) -> np.ndarray:
    """Minimum over the set of the high 32 bits of each coordinate's hash; long sets go in pieces."""
    least = np.full(SIGNATURE, 2**32 - 1, np.uint32)
    for k in range(0, len(grams), 4096):
        part = grams[k : k + 4096]
        mixed = part[None, :] * _ODD[:SIGNATURE, None] + _SHIFT[:, None]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * _ODD[:SIGNATURE, None] >> np.uint64(32)).min(axis=1).astype(np.uint32), out=least)
    return least


def _key() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, key, sig``: the text's 128-bit key and its signature (null for a wordless text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            sigs = []
            for text in batch.column(2):
                grams = shingles(text.as_py())
                sigs.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], names=["doc_id", "key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, sig binary")


def _split(rows: DataFrame, children: int) -> DataFrame:
    """Rows ``path, key, sig`` to their children: one row for each drawn coordinate."""
    drawn = F.explode(F.sequence(F.lit(0), F.lit(children - 1)))
    rows = rows.select("path", "key", "sig", drawn.alias("child"))
    at = F.expr(f"cast(pmod(xxhash64(path, child), {SIGNATURE}) as int)")
    rows = rows.withColumn("at", at)
    return rows.select(F.expr("xxhash64(path, child, at, substring(sig, at * 4 + 1, 4))").alias("path"), "key")


def _full(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows in buckets of two members at least, with the bucket's size ``n``, its pivot ``b``, the smallest key, and in large buckets
    the pivot's signature ``pivot``: all that a bucket's rows need to know of it, so that they are joined with it once."""
    rows = stash(rows, "paths")
    sizes = stash(rows.groupBy("path").agg(F.count("*").alias("n"), F.min("key").alias("b")).where("n > 1"), "sizes")
    large = sizes.where(F.col("n") > SMALL)
    if not large.isEmpty():
        pivots = large.join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("pivot")), "b").select("path", "n", "b", "pivot")
        sizes = stash(sizes.where(F.col("n") <= SMALL).withColumn("pivot", F.lit(None).cast("binary")).unionByName(pivots), "sizes")
    else:
        sizes = sizes.withColumn("pivot", F.lit(None).cast("binary"))
    return rows.join(sizes, "path")  # written first, the sizes have an exchange of their own, so Spark can split a hot path


def _bucket_edges(rows: DataFrame, even: bool = False) -> DataFrame:
    """A spanning forest of the candidate pairs of each ``path, i, j``; ``rows`` also has ``key, sig``.

    Groups arrive whole and in order; one group, of two blocks at most, is in memory at a time. ``even`` deals groups out
    by ranges, which are sampled first, so that no task gets several large ones.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, at = [], None
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for path, i, j, key, sig in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (path, i, j) != at:
                    _forest(left, out)
                    left, at = [], (path, i, j)
                left.append((key, sig))
            yield _edge_batch(out)
        out = []
        _forest(left, out)
        yield _edge_batch(out)

    rows = rows.select("path", "i", "j", "key", "sig")
    dealt = (rows.repartitionByRange if even else rows.repartition)(_partitions(rows), "path", "i", "j")
    ordered = dealt.sortWithinPartitions("path", "i", "j", "key")
    return ordered.mapInArrow(run, "a binary, b binary")


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members ``path, key, sig`` of the large buckets ``sizes`` (``path, m``), once for each pair of blocks ``i, j`` that they are in."""
    sizes = sizes.select("path", F.ceil(F.col("m") / SIGNATURE_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "path").withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "sig")


def _edge_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], names=["a", "b"])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _roots(similar: np.ndarray) -> np.ndarray:
    """The smallest index connected with each, by a symmetric boolean matrix."""
    root = np.arange(len(similar))
    reach = similar | np.eye(len(similar), dtype=bool)
    while True:
        new = np.where(reach, root[None, :], len(root)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _forest(members: list[tuple[bytes, bytes]], out: list) -> None:
    if len(members) < 2:
        return
    sigs = np.frombuffer(b"".join(s for _, s in members), "<u4").reshape(-1, SIGNATURE)
    similar = np.empty((len(sigs), len(sigs)), bool)
    for k in range(0, len(sigs), 128):
        similar[k : k + 128] = (sigs[k : k + 128, None, :] == sigs[None, :, :]).sum(axis=2) >= CANDIDATE * SIGNATURE
    for k, r in enumerate(_roots(similar)):
        if r != k:
            out.append((members[k][0], members[r][0]))


def candidates(texts: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Edges ``a, b`` that connect every pair of ``key, sig`` rows which met in some bucket of some run."""
    sigs = texts.select("key", "sig").where("sig is not null")
    runs = runs_needed(similarity, recall)
    # the first level of all runs in one step
    root = sigs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(r))).alias("path"), "key", "sig")
    one = F.lit(0)
    edges, level = None, 1
    rows = _split(root, CHILDREN)
    while True:
        full = stash(_full(rows, sigs), "buckets")
        small = full.where(F.col("n") <= SMALL).join(sigs, "key").select("path", one.alias("i"), one.alias("j"), "key", "sig")
        found = _bucket_edges(small)
        edges = found if edges is None else edges.unionByName(found)
        large = full.where(F.col("n") > SMALL)
        if large.isEmpty():
            return edges.distinct()
        near = _against_pivot(large, sigs)
        edges = edges.unionByName(near.where((F.col("alike") >= CANDIDATE) & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b"))
        left = near.where((F.col("alike") < TIGHT) | (F.col("key") == F.col("b")))
        rest = stash(left.groupBy("path").agg(F.count("*").alias("m"), F.avg("alike").alias("mean")).where("m > 1"), "rest")
        whole = (F.col("mean") >= 1 / CHILDREN) | F.lit(level == LEVELS) | (F.col("m") <= SMALL)
        dense, sparse = rest.where(whole), rest.where(~whole).select("path")
        edges = edges.unionByName(_bucket_edges(_in_blocks(left.select("path", "key", "sig"), dense), even=True))
        if sparse.isEmpty():
            return edges.distinct()
        again = left.join(F.broadcast(sparse) if sparse.count() <= BROADCAST_KEYS else sparse, "path", "left_semi")
        rows, level = _split(again.select("path", "key", "sig"), CHILDREN), level + 1


def _against_pivot(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """``path, key, sig, b, alike`` of large buckets: the estimated similarity to the pivot."""
    joined = large.join(sigs, "key")
    same = F.expr(f"size(filter(sequence(0, {SIGNATURE - 1}), i -> substring(sig, i * 4 + 1, 4) = substring(pivot, i * 4 + 1, 4)))")
    return stash(joined.select("path", "key", "sig", "b", (same / SIGNATURE).alias("alike")), "near")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over columns of 4096 shared shingles at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    shared = column >= 0
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, width, 4096):
        a, b = np.searchsorted(column, (k, k + 4096))
        x = np.zeros((n, min(4096, width - k)), np.float32)
        x[owner[a:b], column[a:b] - k] = 1
        total += x @ x.T
    return total


def _check(members: list[tuple[bytes, int, bytes]], within: bool, similarity: float) -> Iterator[tuple[bytes, int, bytes]]:
    """(key, links, root's key) of the members ``(key, block, shingles)`` of a task: pairs ``within`` its one block, or across its two."""
    if len(members) < 2:
        return
    block = np.array([b for _, b, _ in members])
    sets = [np.frombuffer(s, "<u8") for _, _, s in members]
    size = np.array([len(s) for s in sets], np.float32)
    shared = _intersections(sets)
    similar = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-3
    np.fill_diagonal(similar, False)
    if not within:  # pairs within a block belong to the block's own task
        similar &= block[:, None] != block[None, :]
    links = similar.sum(axis=1)
    for k, r in enumerate(_roots(similar)):
        if links[k]:
            yield members[k][0], int(links[k]), members[r][0]


def _cells(rows: DataFrame, similarity: float) -> DataFrame:
    """``cells``: the pairs of blocks that each row of ``label, key, size`` is in, as structs ``(i, j, block)``.

    A group of more than a block is cut by size classes first: sets of classes further apart than one can't reach the
    threshold. Classes are cut into blocks by a hash of the key.
    """
    large = stash(rows.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK).select("label"), "large")
    step = math.log(1 / similarity) if similarity < 1 else 1.0
    member = rows.select("label", "size").join(large, "label").withColumn("class", F.floor(F.log("size") / step).cast("int"))
    classes = member.groupBy("label", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    table = stash(classes.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("blocks")), "classes")
    # classes are a logarithm of the longest text: one short map a group
    rows = rows.join(F.broadcast(table) if table.count() <= BROADCAST_KEYS else table, "label", "left")
    rows = rows.withColumn("class", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.floor(F.log("size") / step).cast("int")))
    of = lambda k: f"coalesce(try_element_at(blocks, {k}), 0)"
    rows = rows.withColumn("at", F.expr(f"if(blocks is null, 0, cast(pmod(xxhash64(key), {of('class')}) as int))"))
    # a block's number: its class and its place in it
    number = lambda c, k: f"shiftleft(cast({c} as bigint), 32) + {k}"
    cell = lambda other: f"named_struct('i', least({number('class', 'at')}, {other}), 'j', greatest({number('class', 'at')}, {other}), 'block', {number('class', 'at')})"
    pairs = ", ".join(f"transform(filter(sequence(0, {of(f'class + {d}')}), o -> o < {of(f'class + {d}')}), o -> {cell(number(f'class + {d}', 'o'))})" for d in (-1, 0, 1))
    alone = f"array({cell(number('class', 'at'))})"
    return rows.withColumn("cells", F.expr(f"if(blocks is null, {alone}, concat({pairs}))")).drop("blocks", "class", "at")


def exact_links(texts: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key, links, root`` by task; ``texts`` has ``key, text`` once a key, ``groups`` has ``node, label``."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            grams = [np.unique(shingles(t.as_py())) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([len(g) for g in grams], pa.int32()), pa.array([g.tobytes() for g in grams], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "key", "size", "grams"])

    def check(batches):
        left, at = [], None
        for batch in batches:
            out = []
            for label, i, j, key, block, grams in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (label, i, j) != at:
                    out += _check(left, at is not None and at[1] == at[2], similarity)
                    left, at = [], (label, i, j)
                left.append((key, block, grams))
            yield _batch(out)
        yield _batch(list(_check(left, at is not None and at[1] == at[2], similarity)))

    def _batch(out):
        kinds = (pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["key", "links", "root"])

    members = groups.select(F.col("node").alias("key"), "label")
    rows = texts.join(members, "key").select("label", "key", "text").mapInArrow(sets, "label binary, key binary, size int, grams binary")
    rows = _cells(stash(rows, "sets"), similarity)
    rows = rows.select("label", F.explode("cells").alias("cell"), "key", "grams").select("label", "cell.i", "cell.j", "key", "cell.block", "grams")
    # by ranges: pairs of blocks are of like size, and ranges deal them out evenly
    rows = rows.repartitionByRange(_partitions(texts), "label", "i", "j").sortWithinPartitions("label", "i", "j", "key")
    return rows.mapInArrow(check, "key binary, links long, root binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id, key, class_id, n_links, n_copies, member`` of every row.

    ``class_id`` is the smallest doc_id that the row is connected with through equal texts and links (Jaccard of
    five-word shingles of the lower-cased text at least ``similarity``); ``n_links`` is the number of other texts
    linked to this one; ``n_copies`` the number of other rows with exactly this text. A text under five words is
    one shingle. Wordless and null texts are similar to nothing: their class is their own id.

    ``member`` is what rows of one class share and no other row has: the least key of the texts linked, or the text's
    own key; null for a wordless row, which is a class by itself. ``class_id`` can't serve for that, as it is null
    where all ids are, and texts that aren't linked can have the same doc_id.
    """
    signed = stash(sign(docs), "signed")
    texts = stash(signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.any_value("sig").alias("sig")), "texts")
    groups = stash(components(candidates(texts, similarity, recall)), "groups")
    wanted = groups.select(F.col("node").alias("key"))
    wanted = F.broadcast(wanted) if groups.count() <= BROADCAST_KEYS else wanted
    bodies = docs.select(_key().alias("key"), F.col("text").cast("string").alias("text")).join(wanted, "key", "left_semi").dropDuplicates(["key"])
    checked = stash(exact_links(bodies, groups, similarity), "links")
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    linked = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    joined = texts.drop("sig").join(linked.withColumnRenamed("node", "key"), "key", "left")
    least = joined.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = joined.join(least, "label", "left").join(links, "key", "left")
    named = named.select("key", F.coalesce("label", "key").alias("member"), F.coalesce("least", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    named = stash(named, "named")
    wordless = F.col("sig").isNull()
    # a text with very many copies is dealt to many tasks
    rows = spread_join(signed.select("doc_id", "key", wordless.alias("wordless")), named, ["key"], hot_keys(texts, ["key"]))
    own = F.when(F.col("wordless"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return rows.select("doc_id", "key", own, "n_links", "n_copies", F.when(~F.col("wordless"), F.col("member")).alias("member"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every row; see :func:`classes`.

    Null and empty texts are wordless; rows that repeat stay repeated; null doc_ids are rows like any other, so a class of
    them alone has a null ``class_id``; other columns are ignored; an empty table gives an empty result.
    """
    return classes(docs, similarity, recall).drop("key", "member")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns: of each class the one with the smallest doc_id (null ids last, ties by
    the text's key), and every wordless row.

    Rows that repeat the kept doc_id and text are one document, of which one row stays.
    """
    of = stash(classes(docs, similarity, recall), "of")
    # a text without a member is wordless: all its rows stay
    worded = of.where("member is not null")
    winners = worded.groupBy("member").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("w")).select(F.col("w.doc_id").alias("_w_id"), F.col("w.key").alias("_w_key"), F.lit(False).alias("_all"))
    every = of.where("member is null").select(F.col("doc_id").alias("_w_id"), F.col("key").alias("_w_key"), F.lit(True).alias("_all")).distinct()
    winners = stash(winners.unionByName(every), "winners")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id").alias("_id"), _key().alias("_key"))
    kept = rows.join(winners, F.col("_id").eqNullSafe(F.col("_w_id")) & (F.col("_key") == F.col("_w_key")))
    repeats = not worded.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    if repeats:
        kept = kept.withColumn("_row", F.when(F.col("_all"), F.monotonically_increasing_id())).dropDuplicates(["_id", "_key", "_row"])
    return kept.select("doc.*")
