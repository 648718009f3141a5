"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then a check of overlap.

The index holds the items; every passage of every training document is a query. A passage is two neighbouring
stretches of ``reach`` words, ``reach`` being the longest item's length, so an item that a document holds lies
wholly in one passage. An item's score is divided by what the item itself would score, which gives one threshold
for all items. Postings are cut into blocks at the same item boundaries in every list. Retrieval is block-max WAND: the
sum of a block's maxima over a passage's terms decides whether the cursors enter the block or skip it; inside, they are
kept in order of their item, and the pivot is the first item whose terms' block maxima can reach the threshold together;
only pivots that all cursors before them reach are scored. Whatever is retrieved must then hold the item's question (its five-word shingles) and its
answer (its words).
"""

from __future__ import annotations

import dataclasses
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barloom.llm.common import stash
from barloom.llm.memory import claim, keep
from barloom.llm.tokenpack import GenerationCache

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the item's own score
OVERLAP = 0.8  # of the question's shingles, and of the answer's words
SHINGLE = 5
BLOCKS = 64  # item blocks at most; each holds eight items at least
SHARD_ITEMS, SHARD_CHARS = 20_000, 20_000_000  # one index holds so much at most; more items make more indexes
EMPTY = -2


def term_of(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else "".join(filter(str.isalnum, low))


def terms_of(text: str | None) -> list[str]:
    return [t for t in map(term_of, (text or "").split()) if t]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last line is the answer, or the last sentence of a single line; one sentence is all question."""
    text = text.strip()
    head, mark, tail = text.rpartition("\n")
    if not mark:
        head, mark, tail = text.rstrip(".!? ").rpartition(". ")
    question, answer = terms_of(head), terms_of(tail)
    return (question, answer) if question and answer else (terms_of(text), [])


@dataclasses.dataclass
class Statistics:
    """What scores depend on, over the items of all shards: their number, mean and greatest length, and each term's items."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple[list[str], list[str]]]) -> Statistics:
        lengths = [len(q) + len(a) for q, a in items] or [0]
        return cls(len(items), sum(lengths) / len(lengths), max(lengths), Counter(w for q, a in items for w in {*q, *a}))


@dataclasses.dataclass
class Index:
    ids: list
    vocabulary: dict[str, int]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    reach: int
    items: np.ndarray  # postings, by term then item
    impacts: np.ndarray
    starts: np.ndarray  # (terms, blocks + 1): where a term's postings of a block begin
    maxima: np.ndarray  # (terms, blocks)
    opened: int = 0  # postings that were scored

    @classmethod
    def build(cls, rows: list[tuple], statistics: Statistics | None = None) -> Index:
        """``rows``: (id, text). Items without words can't be found and are left out. ``statistics`` are those of all items, these by default."""
        rows = [(i, *question_and_answer(t or "")) for i, t in rows]
        rows = [r for r in rows if r[1]]
        rows.sort(key=lambda r: (len(r[1]) + len(r[2]), str(r[0])))  # items of like length share a block
        statistics = statistics or Statistics.of([(q, a) for _, q, a in rows])
        vocabulary: dict[str, int] = {}
        number = lambda words: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        question, answer = [number(r[1]) for r in rows], [number(r[2]) for r in rows]
        n, v = len(rows), max(1, len(vocabulary))
        lengths = np.array([len(q) + len(a) for q, a in zip(question, answer, strict=True)], float)
        found = [np.unique(np.concatenate(x), return_counts=True) for x in zip(question, answer, strict=True)]
        term = np.concatenate([t for t, _ in found]) if n else np.empty(0, np.int64)
        count = np.concatenate([c for _, c in found]) if n else np.empty(0)
        item = np.repeat(np.arange(n), [len(t) for t, _ in found]) if n else np.empty(0, np.int64)
        df = np.zeros(v)
        df[: len(vocabulary)] = [statistics.df[w] for w in vocabulary]
        idf = np.log(1 + (statistics.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / statistics.mean) if n else lengths
        impact = idf[term] * count * (K1 + 1) / (count + norm[item])
        impact /= np.bincount(item, impact, n)[item]
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        blocks = max(1, min(BLOCKS, -(-n // 8)))
        maxima = np.zeros(v * blocks, np.float32)
        np.maximum.at(maxima, term * blocks + item * blocks // max(1, n), np.nextafter(impact.astype(np.float32), np.float32(2)))
        starts = np.searchsorted(term * blocks + item * blocks // max(1, n), np.arange(v * blocks + 1))
        starts = np.concatenate((starts[:-1].reshape(v, blocks), starts[blocks::blocks][:, None]), axis=1)
        return cls([r[0] for r in rows], vocabulary, question, answer, max(8, statistics.longest), item, impact, starts, maxima.reshape(v, blocks))

    def retrieve(self, terms: np.ndarray, threshold: float, bounds: np.ndarray | None = None) -> Iterator[tuple[int, float]]:
        """Items that score ``threshold`` at least for a passage's distinct terms, and their scores; ``bounds`` are the blocks' sums of maxima."""
        if bounds is None:
            bounds = self.maxima[terms].sum(axis=0)
        if not hasattr(self, "_lists"):  # lists are quicker to step through; made once a worker
            self._lists = self.items.tolist(), self.impacts.tolist()
        items, impacts = self._lists
        enough = threshold - 1e-4
        for block in np.flatnonzero(bounds >= enough).tolist():
            top = self.maxima[terms, block]
            live = terms[top > 0]
            # a cursor: its item, its place, the end of its postings in the block, their greatest impact
            begin = self.starts[live, block].tolist()
            cursors = [[items[a], a, b, m] for a, b, m in zip(begin, self.starts[live, block + 1].tolist(), top[top > 0].tolist(), strict=True)]
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for k, c in enumerate(cursors):
                    bound += c[3]
                    if bound >= enough:
                        pivot = k
                        break
                if pivot < 0:
                    break
                at = cursors[pivot][0]
                if cursors[0][0] == at:
                    while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                        pivot += 1
                    self.opened += pivot + 1
                    score = sum([impacts[c[1]] for c in cursors[: pivot + 1]])
                    if score >= threshold:
                        yield at, score
                    moved, target = cursors[: pivot + 1], at + 1
                else:
                    moved, target = cursors[:pivot], at
                out = False
                for c in moved:
                    if c[0] < target:
                        c[1] = k = bisect_left(items, target, c[1], c[2])
                        if k < c[2]:
                            c[0] = items[k]
                        else:
                            c[0], out = -1, True
                if out:
                    cursors = [c for c in cursors if c[0] >= 0]

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage has."""
        question, answer = self.question[item], self.answer[item]
        size = min(SHINGLE, len(question))
        grams = lambda x: {tuple(g) for g in np.lib.stride_tricks.sliding_window_view(x, size).tolist()} if len(x) >= size else set()
        want = grams(question)
        q = len(want & grams(passage)) / len(want)
        words = set(answer.tolist())
        return q, len(words.intersection(passage.tolist())) / len(words) if words else 1.0


class Searcher:
    """One index in one Python worker."""

    def __init__(self, index: Index):
        self.index = index
        vocabulary = index.vocabulary

        def number(word: str) -> int:
            term = term_of(word)
            return vocabulary.get(term, -1) if term else EMPTY

        self.words = GenerationCache(number, 200_000)

    def search(self, texts: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float]]:
        """(text's place, item, score, question overlap, answer overlap), the best passage of each pair."""
        index, words = self.index, self.words
        reach, v = index.reach, len(index.vocabulary)
        if not index.ids:
            return
        tokens, windows = [], [0]
        for text in texts:
            split = text.split()
            found = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
            tokens.append(found[found != EMPTY])
            windows.append(windows[-1] + max(1, -(-len(tokens[-1]) // reach)))
        keys = []
        for base, found in zip(windows, tokens, strict=False):
            at = np.flatnonzero(found >= 0)
            half = at // reach
            key = (base + half) * v + found[at]
            keys += [key, key[half > 0] - v]  # a stretch is the first half of one passage and the second of another
        keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(keys):
            return
        window, term = keys // v, keys % v
        heads = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        bounds = np.add.reduceat(index.maxima[term], heads, axis=0)
        ends = np.append(heads[1:], len(keys))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k in np.flatnonzero((bounds >= threshold - 1e-4).any(axis=1)):
            w = window[heads[k]]
            retrieved = list(index.retrieve(term[heads[k] : ends[k]], threshold, bounds[k]))
            if not retrieved:
                continue
            place = int(np.searchsorted(windows, w, side="right")) - 1
            start = (w - windows[place]) * reach
            passage = tokens[place][start : start + 2 * reach]
            for item, score in retrieved:
                q, a = index.overlap(item, passage)
                if q >= overlap and a >= overlap:
                    best[place, item] = max(best.get((place, item), (0.0, 0.0, 0.0)), (score, q, a))
        for (place, item), x in sorted(best.items()):
            yield place, item, *x


ITEMS = "n_words int, terms array<string>"


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over all items, one in memory at a time. Their size is checked first: items are read in shards, by a hash
    of id and text, that each stay within the bound. Scores depend on statistics of all items, not on the shards."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms = [], []
            for text in batch.column(0):
                question, answer = question_and_answer(text.as_py() or "")
                sizes.append(len(question) + len(answer))
                terms.append(sorted({*question, *answer}))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.string()))], names=["n_words", "terms"])

    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))
    if shards == 1:
        yield Index.build([tuple(r) for r in items.collect()])
        return
    measured = stash(items.select("text").mapInArrow(measure, ITEMS).where("n_words > 0"), "items")
    total, mean, longest = measured.agg(F.count("*"), F.coalesce(F.avg("n_words"), F.lit(1.0)), F.coalesce(F.max("n_words"), F.lit(0))).first()
    df = stash(measured.select(F.explode("terms").alias("term")).groupBy("term").count(), "df")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    for k in range(shards):
        rows = [tuple(r) for r in items.where(part == k).collect()]
        words = sorted({w for _, t in rows for w in terms_of(t)})
        known = df.join(F.broadcast(df.sparkSession.createDataFrame([(w,) for w in words], "term string")), "term", "left_semi").collect()
        yield Index.build(rows, Statistics(total, mean, longest, dict(map(tuple, known))))


_SEARCHERS: dict[str, Searcher] = {}  # the index that this Python worker used last


def _searcher(name: str, shared) -> Searcher:
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[name] = Searcher(shared.value)
        keep("leaks", _SEARCHERS[name].words, instead=True)
    claim("leaks")
    return _SEARCHERS[name]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: every item that a document holds.

    Null texts hold nothing; null or wordless items are never held; equal items are all named; a repeated row
    gives its rows again; item ids keep their type. One pass over the documents for each index shard.
    """
    spark = docs.sparkSession
    out = None
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    for index in indexes(benchmark):
        out_part = _search(docs, index, spark, doc_kind, item_kind, threshold, overlap)
        out = out_part if out is None else out.unionByName(out_part)
    return out


def _chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of ``most`` characters or a single longer text, with the place of the first."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def _search(docs, index, spark, doc_kind, item_kind, threshold, overlap) -> DataFrame:
    import uuid

    shared, name = spark.sparkContext.broadcast(index), uuid.uuid4().hex
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    item_type = to_arrow_type(item_kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(name, shared)
        ids = searcher.index.ids
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            places, found = [], []
            for first, part in _chunks(texts):
                for place, item, score, q, a in searcher.search(part, threshold, overlap):
                    places.append(first + place)
                    found.append((ids[item], round(score, 6), round(q, 6), round(a, 6)))
            cols = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = [None, pa.float64(), pa.float64(), pa.float64()]
            item_col = pa.array(cols[0], type=item_type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), item_col, *[pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True)]], names=names
            )

    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    import uuid

    spark, schema, out = docs.sparkSession, docs.schema, docs
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared, name = spark.sparkContext.broadcast(index), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            searcher = _searcher(name, shared)
            for batch in batches:
                texts = [t.as_py() or "" for t in batch.column(at)]
                held = {first + place for first, part in _chunks(texts) for place, *_ in searcher.search(part, threshold, overlap)}
                yield batch.filter(pa.array([k not in held for k in range(len(texts))], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
