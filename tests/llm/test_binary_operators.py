"""Token files, SentencePiece, media, joins, repeated strings and the pipeline against brute force and round trips."""

import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from barloom.llm.queries import tokenizer_path

ODD_TEXTS = ["", " ", "   a  b   ", "a▁b ▁▁c", "日本語 🙂🙂\n\n\tx", "It's a DON'T we'll 12½ ², x²y", "a<|endoftext|>b", "naïve Straße ÀÉ İ ΣΑΣ", "a\x85b a\x1cb a b", "\x00\x01 �", " " * 70 + "z", "x" * 3000]


def some_texts(docs):
    return [r["text"] for r in docs.select("text").limit(60).collect()] + ODD_TEXTS


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing_round_trip(bits):
    from barloom.llm.tokenpack import pack, unpack

    ids = np.random.default_rng(1).integers(0, 2**bits, 1003).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (unpack(data, bits, 1003) == ids).all()
    with pytest.raises(ValueError):
        pack(np.array([4], "<u4"), 2)


def test_packed_file_random_access():
    from barloom.llm.tokenpack import PackReader, PackWriter, min_bits

    out = io.BytesIO()
    writer = PackWriter(out, min_bits(49408))
    draw = np.random.default_rng(2)
    docs = [draw.integers(0, 49408, n).astype("<u4") for n in (0, 1, 70_000, 5, 200_000, 3)]
    for k, d in enumerate(docs):
        writer.add(None if k == 3 else k, d)
    writer.close()
    reader = PackReader(out)
    for k in (4, 0, 5, 2, 1, 3):
        assert (reader.document(k) == docs[k]).all()
    assert list(reader.crcs()) == [(None if k == 3 else k, len(d), zlib.crc32(d.tobytes())) for k, d in enumerate(docs)]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    from barloom.llm.tokenpack import token_files

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(10_000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, None), (10_000, "again")]
    path = tokenizer_path("ids")
    got = [tuple(r) for r in token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path).collect()]
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows if i != 10_000}
    at, seen = 0, []
    for doc_id, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        seen.append(-1 if doc_id is None else doc_id)
        if doc_id != 10_000:
            assert n == len(ids[doc_id]) and crc == zlib.crc32(np.array(ids[doc_id], "<u4").tobytes())
    assert seen == sorted(seen) and len(seen) == len(rows)


def test_token_files_of_named_and_unnamed_rows(spark):
    from barloom.llm.tokenpack import token_files

    rows = [(None, f"text {i}") for i in range(40)] + [(None, "same")] * 40 + [("b", "x"), ("a", "x")]
    got = sorted(token_files(spark.createDataFrame(rows, "doc_id string, text string"), tokenizer_path("ids")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 80 + ["a", "b"]
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(got, got[1:], strict=False))


def test_sentencepiece_equals_the_library(spark, docs):
    import sentencepiece

    from barloom.llm.spviterbi import decode, encode

    path = tokenizer_path("pieces")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = some_texts(docs)
    rows = [*enumerate(texts), (None, None)]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = {r["doc_id"]: r for r in out.collect()}
    for k, t in enumerate(texts):
        assert got[k]["ids"] == sp.encode(t) and got[k]["n_tokens"] == len(got[k]["ids"])
        assert got[k]["decoded_equal"] == (sp.decode(sp.encode(t)) == t)
    assert got[None]["ids"] == [] and got[None]["decoded_equal"]
    back = {r["doc_id"]: r["text"] for r in decode(out, path).collect()}
    assert all(back[k] == sp.decode(sp.encode(t)) for k, t in enumerate(texts))


def test_every_new_word_goes_through_the_viterbi(docs, monkeypatch):
    from barloom.llm import spviterbi

    fed = []
    feed = spviterbi.StreamingViterbi.feed
    monkeypatch.setattr(spviterbi.StreamingViterbi, "feed", lambda self, chars: fed.append(chars) or feed(self, chars))
    enc = spviterbi.Encoder(tokenizer_path("pieces"))
    text = " ".join(next(t for t in some_texts(docs) if len(t.split()) > 100).split())
    first = enc(text)
    assert set("".join(fed)) == set(enc.model.prepare(text)) and enc.fed == sum(map(len, fed))
    words = set(text.split())
    assert enc.fed <= sum(len(w) + 1 for w in words)  # equal parts are fed once
    assert enc(text) == first and enc.fed == sum(map(len, fed))


def test_streaming_viterbi_window_is_bounded(docs):
    import sentencepiece

    from barloom.llm.spviterbi import PieceModel, StreamingViterbi

    path = tokenizer_path("pieces")
    model = PieceModel(path)
    viterbi = StreamingViterbi(model)
    text = "".join(some_texts(docs)).replace(" ", "").replace("\n", "")[:30_000]
    ids, most = [], 0
    for k in range(0, len(text), 501):
        ids += viterbi.feed(text[k : k + 501])
        most = max(most, len(viterbi.last))
    ids += viterbi.finish()
    assert most <= 16 * model.longest
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.decode(ids) == text
    assert [*viterbi.feed(model.prepare(text)), *viterbi.finish()] == sp.encode(text)


def test_unigram_model(docs):
    import sentencepiece

    from barloom.llm.spviterbi import PieceModel, StreamingViterbi

    with open(tokenizer_path("pieces"), "rb") as f:
        raw = f.read()
    at = raw.rindex(b"tok_v0\x18\x02")
    uni = raw[: at + 7] + b"\x01" + raw[at + 8 :]  # the same pieces, read as a unigram model
    model, sp = PieceModel("", uni), sentencepiece.SentencePieceProcessor(model_proto=uni)
    viterbi = StreamingViterbi(model)
    for t in [" ".join(t[:150].split()) for t in some_texts(docs)]:
        if any(c not in model.ids for c in t.replace(" ", "")):
            continue
        ids = [*viterbi.feed(model.prepare(t)), *viterbi.finish()]
        total = lambda x: sum(model.scores[i] for i in x)
        assert "".join(model.pieces[i] for i in ids) == model.prepare(t)
        assert total(ids) == best_sum(model, model.prepare(t)) >= total(sp.encode(t))


def best_sum(model, text):
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max(best[at] + model.scores[model.ids[text[at:end]]] for at in range(end) if text[at:end] in model.ids))
    return best[-1]


def test_media(spark, odd, none):
    from barloom.llm.audio import PATCH, extract, media_digest, read_tensors, store

    texts = collections.Counter((r["doc_id"], r["text"]) for r in odd.collect())
    by_text = {}
    for r in media_digest(odd).collect():
        text = next(t for (i, t) in texts if i == r["doc_id"])
        data = (text or "").encode()
        payload = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]
    import pyarrow as pa

    row = extract(store(odd)).where("doc_id = 4").first()
    table = pa.ipc.open_stream(bytes(row["tensors"])).read_all()
    assert table.schema.field("log_mel").type.shape == [PATCH, 16] and table["start_ms"][1].as_py() == table["end_ms"][0].as_py()
    assert read_tensors(bytes(row["tensors"]))[0].shape == (len(table), PATCH, 16)
    assert media_digest(none).count() == 0
    named = odd.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {r["doc_id"] for r in media_digest(named).collect()} == {f"d{k}" for k in range(1, 8)} | {None}


def test_features_by_hand(docs):
    """Log-mel energies and segments from their definitions, sample by sample."""
    import math

    from barloom.llm import audio as A

    text = next(r["text"] for r in docs.collect() if r["text"] and len(r["text"]) > 8000)
    payload, _ = A.payload_of(text)
    patches, spans, segs = A.features(payload)
    y = A.resample((np.frombuffer(payload, np.uint8) - 128.0) / 128)
    mel, hz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    rate = A.RATE * A.UP / A.DOWN
    edges = [hz(mel(60) + k * (mel(rate / 2) - mel(60)) / (A.MELS + 1)) for k in range(A.MELS + 2)]
    energy, n = [], (len(y) - A.FRAME) // A.HOP + 1
    for f in range(n):
        frame = y[f * A.HOP : f * A.HOP + A.FRAME]
        energy.append(10 * math.log10(sum(v * v for v in frame) / A.FRAME + 1e-9))
        if f in (0, 7, n - 1):
            turn = np.exp(-2j * np.pi * np.outer(np.arange(A.FFT // 2 + 1), np.arange(A.FRAME)) / A.FFT)
            power = np.abs(turn @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(A.FRAME) / (A.FRAME - 1))))) ** 2
            for k in range(A.MELS):
                a, b, c = edges[k : k + 3]
                total = sum(p * max(0.0, min((q * rate / A.FFT - a) / (b - a), (c - q * rate / A.FFT) / (c - b))) for q, p in enumerate(power))
                assert abs(patches[f // A.PATCH, f % A.PATCH, k] - math.log(total + 1e-6)) < 5e-3
    want, start, top = [], None, max(energy)
    for f, e in enumerate([*energy, -1e9]):
        if start is None and e - top >= A.ON_DB:
            start = f
        elif start is not None and e - top < A.OFF_DB:
            want += [[start * 10, f * 10]] if f - start >= A.MIN_FRAMES else []
            start = None
    assert segs.tolist() == want and spans[-1].tolist() == [(len(patches) - 1) * 320, n * 10]


def test_resampling_is_filtering():
    from barloom.llm.audio import TAPS, _lowpass, resample, segments

    x = np.random.default_rng(0).normal(size=501)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        h = _lowpass(TAPS * up, 1 / max(up, down)) * up
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        full = np.concatenate((np.convolve(wide, h), np.zeros(10)))[(len(h) - 1) // 2 :: down]
        assert np.allclose(resample(x, up, down), full[: -(-len(x) * up // down)])
    assert segments(np.array([0, -20, -20, 0, -12, -12, -20, -20.0]), least=2).tolist() == [[3, 6]]


def near_copies():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choices(words, k=120) for _ in range(5)]
    rows = []
    for i in range(260):
        b = list(draw.choice(base))
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            b[draw.randrange(120)] = draw.choice(words)
        rows.append((i, " ".join(b)))
    return [*rows, (1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "x y z"), (None, "x y z"), (1005, " "), (1006, rows[0][1]), (1006, rows[0][1])]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    names = list(texts)
    sets = [grams(t) for t in names]
    root, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[find(a)] = find(b)
    least = {}
    for k, t in enumerate(names):
        for i in texts[t]:
            if i is not None:
                least[find(k)] = min(least.get(find(k), i), i)
    return sorted(str((i, least.get(find(k)) if sets[k] else i, links[k], len(texts[t]) - 1)) for k, t in enumerate(names) for i in texts[t])


@pytest.mark.parametrize(("small", "tight"), [(64, 0.9), (4, 0.9), (4, 2.0)])
def test_near_duplicates(spark, monkeypatch, small, tight):
    from barloom.llm import jaccard

    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TIGHT", tight)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "SIGNATURE_BLOCK", 30)
    rows = near_copies()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"])) for r in got.collect()) == brute_classes(rows)


def test_recall_against_brute_force(spark):
    """Documents whose id is divisible by 50 against all rows."""
    from barloom.llm.jaccard import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["text"] or ""].append(r["doc_id"])
    sets = {t: grams(t) for t in texts}
    found = {r["doc_id"]: r["n_links"] for r in near_duplicates(docs).collect()}
    true = got = 0
    for t, ids in texts.items():
        for i in ids:
            if i % 50 == 0:
                near = [s for u, s in sets.items() if u != t and 0.8 * len(sets[t]) <= len(s) <= 1.25 * len(sets[t]) and s]
                n = sum(1 for s in near if len(s & sets[t]) >= 0.8 * len(s | sets[t]) - 1e-9)
                assert found[i] <= n
                true, got = true + n, got + found[i]
    print(f"recall {got}/{true}")
    assert true > 0 and got >= 0.99 * true


def test_one_of_each_class_stays(spark, odd, none):
    from barloom.llm.jaccard import keep_one, near_duplicates

    out = keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "4", "5", "6", "7"]
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def repeated_texts():
    draw = random.Random(5)
    parts = ["".join(draw.choice("abcd ") for _ in range(900)) for _ in range(4)] + ["ab" * 400, "x" * 700]
    rows = []
    for i in range(70):
        text = ""
        for _ in range(draw.randint(0, 4)):
            if draw.random() < 0.6:
                p, a = draw.choice(parts), draw.randint(0, 600)
                q = p[a : a + draw.randint(150, 450)]
                if draw.random() < 0.3 and q:
                    k = draw.randrange(len(q))
                    q = q[:k] + "é" + q[k + 1 :]
                text += q
            else:
                text += "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 300)))
        rows.append((i, text))
    return [*rows, (500, None), (501, ""), (502, "z" * 199), (503, "y" * 200), (504, "y" * 201)]


@pytest.mark.parametrize(("group", "bound"), [(4096, 10**6), (3, 10**6), (3, 0)])
def test_repeated_strings(spark, monkeypatch, group, bound):
    from barloom.llm import pfp

    monkeypatch.setattr(pfp, "GROUP", group)
    monkeypatch.setattr(pfp, "BROADCAST_TRIGGERS", bound)
    rows = [(i, (t or "").encode()) for i, t in repeated_texts()]
    seen = collections.Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    got = {r["doc_id"]: tuple(r)[1:] for r in pfp.repeat_digest(spark.createDataFrame(repeated_texts(), "doc_id long, text string").repartition(3)).collect()}
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert got[i] == (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_long_documents_are_cut_to_segments(monkeypatch):
    from barloom.llm import pfp

    text = bytes(random.Random(3).choice(b"abcdef") for _ in range(9000))
    whole = {tuple(x[3:6]) for x in []}
    monkeypatch.setattr(pfp, "SEGMENT", 1500)
    starts = set()
    for data, begin, end, doc, place in pfp._segments([text]):
        piece, first, last, *_ = pfp.phrases(data, begin, end)
        for p, a, b in zip(piece, first, last, strict=True):
            starts.update(range(a - begin[p] + place[p], b - begin[p] + place[p] + 1))
    assert starts == set(range(len(text) - 199)) and not whole


def test_empty_table_of_repeats(none, odd):
    from barloom.llm.pfp import remove_repeats, repeat_digest

    assert repeat_digest(none).count() == 0
    assert remove_repeats(odd).count() == 9


def test_components(spark):
    from barloom.llm.common import components

    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_pipeline_stages(spark, sf_dir, docs):
    import sentencepiece

    import corpus_pipeline as P
    from barloom.llm.decontaminate import question_and_answer, terms_of
    from barloom.llm.lines import LOWER, UPPER
    from barloom.llm.quality import score, train

    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "tokens"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now, before = docs, None
    for name, stage in P.STAGES[:-1]:
        before, now = now, stage(spark, now, sf_dir).persist()
        assert now.columns == docs.columns
        was, got = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality":
            model = train(docs, labels)
            assert set(got) == {r["doc_id"] for r in score(docs, model).where("predicted = 1").collect()}
        elif name == "lines":
            key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans(UPPER, LOWER))
            n = collections.Counter(k for t in was.values() for k in {key(x) for x in (t or "").split("\n")} if k)
            assert got == {i: "\n".join(x for x in (t or "").split("\n") if n[key(x)] < 10) for i, t in was.items()}
        elif name == "near_duplicates":
            said = [eval(x) for x in brute_classes(list(was.items()))]  # noqa: S307
            assert set(got) == {c if grams(was[i]) else i for i, c, _, _ in said}
        else:
            held = set()
            items = [question_and_answer(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for i, t in was.items():
                w = terms_of(t)
                g = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
                for q, a in items:
                    want = {tuple(q[k : k + 5]) for k in range(len(q) - 4)}
                    if want and len(want & g) >= 0.8 * len(want) and len(set(a) & set(w)) >= 0.8 * len(set(a)):
                        held.add(i)
            assert set(got) == set(was) - held
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("pieces"))
    out = P.STAGES[-1][1](spark, now, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert {r["doc_id"]: r["ids"] for r in out} == {i: sp.encode(t or "") for i, t in texts.items()}
