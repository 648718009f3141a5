"""Line deduplication over the whole corpus, in DataFrame operations only.

Lines become 128-bit key hashes with their document and position. Hashes are range-partitioned, with the document
as secondary key so that one very common line spreads over many ranges, and sorted by document and position, so
that a range streams each key's documents in order, the first occurrence first; partial aggregation joins what
ranges say of a key. Only lines whose key is common go on. What comes back for a document is not text but its keep
bitmap, run-length compressed: the runs of lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import hot_keys, spread_join, stash

BROADCAST_KEYS = 200_000  # common lines that are sent to every task
# fixed values of the contract: the characters stripped from both ends, and the letters lower-cased
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without outer ASCII white space, A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a document: rows with equal id and text are one document."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(17), doc_id, body).alias("d1"), F.xxhash64(F.lit(29), body, doc_id).alias("d2")]


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """``d1, d2, n_lines, kept, n_dropped`` of the documents that lose lines.

    A line goes if its key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents; with ``keep="first"`` the first occurrence by (doc_id, position) stays. ``kept`` is the document's
    bitmap of ``n_lines`` bits as its runs of ones, ``(start, length)`` in order; a document without a row keeps all.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    body = F.col("text").cast("string")
    split = docs.select("doc_id", *doc_key(F.col("doc_id"), body), split_lines(body).alias("lines"))
    rows = split.select("doc_id", "d1", "d2", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = stash(
        rows.select("doc_id", "d1", "d2", "n_lines", "pos", key.alias("key")).where(F.char_length("key") >= max(min_chars, 0))
        .select("doc_id", "d1", "d2", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(31), "key").alias("h2")),
        "lines",
    )
    by_doc = (
        lines.select("h1", "h2", "doc_id", "d1", "d2", "pos")
        .repartitionByRange(_partitions(docs), "h1", "h2", "doc_id", "d1", "d2")
        .sortWithinPartitions("h1", "h2", "doc_id", "d1", "d2", "pos")
        .groupBy("h1", "h2", "doc_id", "d1", "d2")
        .agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    )
    first = F.min(F.struct("doc_id", "pos", "d1", "d2")).alias("first")
    common = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), first).where(F.col("docs") >= min_docs)
    common = stash(common.select("h1", "h2", "n", "first"), "common")
    found = common.drop("n")
    # a bounded list goes to every task; a longer one is joined, with very common lines dealt to many tasks
    if common.count() <= BROADCAST_KEYS:
        gone = lines.join(F.broadcast(found), ["h1", "h2"])
    else:
        gone = spread_join(lines, found, ["h1", "h2"], hot_keys(common, ["h1", "h2"]))
    if keep == "first":
        gone = gone.where((F.col("first.d1") != F.col("d1")) | (F.col("first.d2") != F.col("d2")) | (F.col("first.pos") != F.col("pos")))
    gone = gone.groupBy("d1", "d2").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    # a run of kept lines lies before, between and behind those that go
    start, end = "if(i = 0, 0, get(gone, i - 1) + 1)", "if(i = size(gone), n_lines, get(gone, i))"
    kept = F.expr(f"filter(transform(sequence(0, size(gone)), i -> named_struct('start', {start}, 'length', {end} - {start})), r -> r.length > 0)")
    return gone.select("d1", "d2", "n_lines", kept.alias("kept"), F.size("gone").cast("long").alias("n_dropped"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut to the kept lines and, with ``counts``, ``_n_lines`` and ``_n_dropped``.

    A column ``n_chars`` is the text's length again.
    """
    names = docs.columns
    body = F.col("text").cast("string")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), *doc_key(F.col("doc_id"), body), body.alias("body"))
    joined = left.join(bitmaps.select("d1", "d2", "kept", "n_dropped"), ["d1", "d2"], "left").select("doc", "kept", "n_dropped", split_lines(F.col("body")).alias("lines"))
    # lines are named twice: named once inside a lambda, the text would be split anew for each run
    kept = F.expr("if(size(lines) > 0, array_join(flatten(transform(kept, r -> slice(lines, r.start + 1, r.length))), '\n'), '')")
    text = F.when(F.col("kept").isNull(), F.coalesce(F.col("doc.text").cast("string"), F.lit(""))).otherwise(kept)
    joined = joined.select("doc", "n_dropped", "lines", text.alias("_left"))
    made = {"text": F.col("_left"), "n_chars": F.length("_left")}
    if "n_chars" in names:
        made["n_chars"] = made["n_chars"].cast(docs.schema["n_chars"].dataType)
    columns = [(made[c] if c in made else F.col("doc").getField(c)).alias(c) for c in names]
    if not counts:
        return joined.select(*columns)
    return joined.select(*columns, F.size("lines").cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("_n_dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", counts: bool = True) -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents; with ``counts`` also ``_n_lines`` and ``_n_dropped``.

    Null and empty texts are one empty line, which has no key and stays. Rows with equal doc_id and text count
    as one document and are treated alike; null doc_ids are documents too. An empty table gives an empty result.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep), counts)


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
