"""SentencePiece encoding as a streaming Viterbi, and decoding.

The best segmentation of every prefix is kept with one backpointer: the last piece and the boundary it starts
at. Only boundaries within the longest piece's length of the current position can be continued, so the window
of live backpointers is bounded; whenever all of them trace back through one boundary, the ids before it are
committed and forgotten. Memory is bounded by the longest piece, not by the text.

What "best" means follows the model file:

* unigram models: the largest sum of piece scores;
* BPE models: the segmentation that merging by rank gives. Each prefix has exactly one; its last piece is the
  one that is *compatible* with the last piece of the prefix before it, that is, no merge across their
  boundary would have come before the merges that made them.

For BPE models the ids equal the library's own; for unigram models their sum of scores is the greatest there is.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.memory import claim, keep

SPACE = "▁"
RUNS = re.compile(f"(?<!{SPACE}){SPACE}")
ONE = (1,)
CACHE, PARTS = 400_000, 100_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            yield key >> 3, data[at : at + 8]
            at += 8


class PieceModel:
    """Pieces, scores and text rules of a SentencePiece model file. ``data`` replaces the file's bytes in tests."""

    # fixed values of the file format
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    UNIGRAM, BPE = 1, 2

    def __init__(self, path: str, data: bytes | None = None):
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = self.UNIGRAM, False
        self.dummy_prefix = self.trim = self.escape = True
        charsmap = b""
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x.get(1, b"").decode("utf-8"))
                self.scores.append(x.get(2, 0.0))
                self.types.append(x.get(3, self.NORMAL))
            elif field == 2:
                x = dict(_fields(value))
                self.kind, self.byte_fallback = x.get(3, self.UNIGRAM), bool(x.get(35, 0))
                if x.get(24, 0):
                    raise ValueError("models that put white space behind words are not supported")
            elif field == 3:
                x = dict(_fields(value))
                charsmap = x.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
        if charsmap:
            raise ValueError("only models with the identity normalizer are supported")
        if self.kind not in (self.UNIGRAM, self.BPE):
            raise ValueError("only unigram and BPE models are supported")
        if self.USER in self.types:
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == self.NORMAL}
        self.unk = self.types.index(self.UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == self.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        low = min(self.scores[i] for i in self.ids.values())
        self.unknown_score = low - 10.0  # the library's penalty for a character outside the vocabulary
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # character pairs that some piece spans
        if self.kind == self.BPE:
            self._halves()

    def _halves(self) -> None:
        """How merging builds each piece; pieces that merging their own characters doesn't give are never used."""
        scores = {p: self.scores[i] for p, i in self.ids.items()}
        self.order = {p: -s for p, s in scores.items()}  # the smaller merges earlier
        tied = {s for s, n in zip(*np.unique(list(scores.values()), return_counts=True), strict=True) if n > 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.plain: set[str] = set()  # pieces whose halves come before them all the way down
        usable = {}
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                usable[p] = i
                self.plain.add(p)
                continue
            symbols, last = self._merge(p)
            if symbols == [p]:
                usable[p] = i
                self.halves[p] = last
                a, b = last
                if a in self.plain and b in self.plain and scores[p] not in tied and all(len(x) == 1 or self.order[x] < self.order[p] for x in last):
                    self.plain.add(p)
        self.usable = usable
        # the lengths of the usable pieces that end in these three characters (or are these two), longest first
        lengths: dict[str, set[int]] = {}
        for p in usable:
            lengths.setdefault(p[-3:], {1}).add(len(p))
        for p in [x for x in lengths if len(x) == 3]:
            if p[1:] in usable:
                lengths[p].add(2)
        self.lengths = {p: tuple(sorted(x, reverse=True)) for p, x in lengths.items()}
        self.fits: dict[tuple[str, str], bool] = {}

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge by best score, leftmost first on ties; for short strings."""
        symbols, last, ids, scores = list(text), None, self.ids, self.scores
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                return symbols, last
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = ["".join(last)]

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` leaves a boundary between the two."""
        if a not in self.plain or b not in self.plain:
            return len(a) and self._merge(a + b)[0] == [a, b]
        order, ids = self.order, self.ids
        end_a = end_b = float("inf")  # when a later merge takes the edge piece away
        while True:
            both = order.get(a + b) if a + b in ids else None
            if both is not None and (both < end_b and both < end_a or both == end_b < end_a):
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            made_a = order[a] if len(a) > 1 else -float("inf")
            made_b = order[b] if len(b) > 1 else -float("inf")
            if made_a >= made_b:
                end_a, a = made_a, self.halves[a][1]
            else:
                end_b, b = made_b, self.halves[b][0]

    def fit(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[a, b] = bool(self._fit(a, b))
        return known

    # text rules

    def prepare(self, text: str) -> str:
        """The normalized text that pieces are looked up in."""
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def spell(self, char: str) -> list[int]:
        """Ids of one character outside the vocabulary."""
        if self.byte_fallback:
            return [self.bytes[b] for b in char.encode("utf-8")]
        return [self.unk]

    def decode(self, ids: Iterable[int]) -> str:
        """The text that ids stand for; invalid byte runs become U+FFFD."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.types[i] == self.UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] != self.CONTROL:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class StreamingViterbi:
    """Feed characters; ids come out as soon as they are certain. ``held`` is the number of live positions."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.bpe = model.kind == model.BPE
        self.vocabulary = model.usable if self.bpe else model.ids
        self.step = 4 * model.longest
        self._advance = self._merges if self.bpe else self._sums
        self.start()

    def start(self) -> None:
        self.text = ""  # characters after the last committed boundary
        self.best = [0.0]
        self.last: list[str] = [""]  # by position in text: the backpointer, as the last piece before it

    def feed(self, chars: str) -> list[int]:
        step, out = self.step, []
        for k in range(0, len(chars), step):
            self._advance(chars[k : k + step])
            if len(self.last) > step:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        out = self._ids(len(self.text))
        self.start()
        return out

    def _merges(self, chars: str) -> None:
        """The one last piece of each new prefix that fits the prefix before it."""
        done, self.text = len(self.text), self.text + chars
        text, last, vocabulary = self.text, self.last, self.vocabulary
        put = last.append
        lengths, fit, known = self.model.lengths.get, self.model.fit, self.model.fits.get
        for end in range(done + 1, len(text) + 1):
            for n in lengths(text[end - 3 : end] if end > 3 else text[:end]) or lengths(text[end - 2 : end], ONE):
                at = end - n
                if at < 0:
                    continue
                piece = text[at:end]
                if piece in vocabulary:
                    before = last[at]
                    if not before:
                        break
                    good = known((before, piece))
                    if good or (good is None and fit(before, piece)):
                        break
            else:
                piece = text[end - 1]
            put(piece)

    def _sums(self, chars: str) -> None:
        """The last piece of each new prefix that gives the greatest sum of scores."""
        done, self.text = len(self.text), self.text + chars
        text, best, last = self.text, self.best, self.last
        vocabulary, model = self.vocabulary, self.model
        scores, longest = model.scores, model.longest
        for end in range(done + 1, len(text) + 1):
            top, came = None, end - 1
            for at in range(max(0, end - longest), end):
                i = vocabulary.get(text[at:end])
                if i is not None and (top is None or best[at] + scores[i] > top):
                    top, came = best[at] + scores[i], at
            if text[end - 1] not in vocabulary and (top is None or best[end - 1] + model.unknown_score > top):
                top, came = best[end - 1] + model.unknown_score, end - 1
            best.append(top)
            last.append(text[came:end])

    def _commit(self) -> list[int]:
        """Commit up to the last boundary that every live backpointer path goes through."""
        n = len(self.text)
        live = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(live) > 1:  # step back from the furthest until the paths meet
            far = max(live)
            live.discard(far)
            live.add(far - len(self.last[far]))
        meet = live.pop()
        if meet == 0:
            return []
        out = self._ids(meet)
        self.text = self.text[meet:]
        if not self.bpe:
            self.best = [b - self.best[meet] for b in self.best[meet:]]
        self.last = self.last[meet:]
        return out

    def _ids(self, end: int) -> list[int]:
        ids, last, out = self.vocabulary, self.last, []
        while end > 0:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        found = [ids.get(p) for p in out]
        return self._spell(out, found) if None in found else found

    def _spell(self, pieces: list[str], found: list[int | None]) -> list[int]:
        """Ids where some pieces are characters outside the vocabulary."""
        out: list[int] = []
        unknown = False
        for p, i in zip(pieces, found, strict=True):
            if i is not None:
                out.append(i)
                unknown = False
            elif self.model.byte_fallback or not unknown:  # without bytes, neighbouring unknowns are one id
                out += self.model.spell(p)
                unknown = True
        return out


class Encoder:
    """Texts to ids (u32 bytes) by the streaming Viterbi, remembering words that it has encoded.

    A boundary between two characters that no piece holds side by side is on every path: the Viterbi commits there,
    so it is fed what lies between such boundaries, and whole words between white-space marks are looked up before.
    ``fed`` counts the characters that it was fed.
    """

    def __init__(self, path: str):
        from barloom.llm.tokenpack import GenerationCache

        self.model = PieceModel(path)
        self.viterbi = StreamingViterbi(self.model)
        self.fed = 0
        self.words = GenerationCache(self._word, CACHE)
        self.parts = GenerationCache(self._part, PARTS)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(self.model.pieces))]
        #: a mark begins a word unless a piece has it elsewhere than at its start, as runs of marks have
        self.splits = all(x == SPACE * 2 or x[1] != SPACE for x in self.model.inside) and self.model.byte_fallback

    def forget(self) -> None:
        self.words.forget()
        self.parts.forget()
        if self.viterbi.bpe:
            self.model.fits.clear()

    def _part(self, part: str) -> bytes:
        self.fed += len(part)
        known = self.id_bytes
        return b"".join([known[i] for i in self.viterbi.feed(part) + self.viterbi.finish()])

    def _word(self, word: str) -> bytes:
        text, inside, parts = SPACE + word, self.model.inside, self.parts
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inside]
        if not cuts:
            return self._part(text)  # remembered as a word
        return b"".join([parts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        prepared = self.model.prepare(text)
        if not self.splits or not prepared.startswith(SPACE):
            return self._part(prepared)
        words = self.words
        if SPACE + SPACE not in prepared:
            return b"".join([words[w] for w in prepared[1:].split(SPACE)])
        # runs of marks can be pieces: a word with the run before it is one part
        out, at = [], 0
        for m in RUNS.finditer(prepared, 1):
            out.append(self._between(prepared, at, m.start()))
            at = m.start()
        return b"".join([*out, self._between(prepared, at, len(prepared))])

    def _between(self, prepared: str, at: int, end: int) -> bytes:
        if prepared[at + 1 : at + 2] != SPACE:
            return self.words[prepared[at + 1 : end]]
        return self._part(prepared[at:end])


_ENCODERS: dict[str, Encoder] = {}  # one a Python worker


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        keep("pieces", _ENCODERS[path])
    claim("pieces")
    return _ENCODERS[path]




def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_equal`` of every whole text; other columns are ignored.

    Null texts are empty and have no ids. ``decoded_equal`` tells whether decoding the ids gives the text back.
    Repeated rows give repeated rows; ids keep their type.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        pieces = np.array(enc.model.pieces, dtype=object)
        plain = np.array([t == PieceModel.NORMAL for t in enc.model.types])
        for batch in batches:
            counts, same, raw = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                data = enc(text)
                ids = np.frombuffer(data, "<u4")
                if plain[ids].all():
                    back = "".join(pieces[ids].tolist()).replace(SPACE, " ")
                    back = back[1:] if enc.model.dummy_prefix and back.startswith(" ") else back
                else:
                    back = enc.model.decode(ids.tolist())
                raw.append(data)
                counts.append(len(ids))
                same.append(back == text)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), ids, pa.array(same)], names=["doc_id", "n_tokens", "ids", "decoded_equal"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded_equal boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give an empty text."""

    def run(batches):
        model = encoder(model_path).model
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
