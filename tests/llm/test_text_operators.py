"""Quality, PII, line dedup, HTML and decontamination against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np


def spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = {}
    for kind, pattern in kinds.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c._x@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0 001.002.003.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (678) 555-5272+44 20 7946 0958", "é🙂a.b@c-d.ef,x@y", "++1 2", "@a.b a@b a@.c",
    "9" * 300, "a" * 5000 + "@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49 (0)30 123456 7890 12345678", "x%+-@y.z-.w", "1.1.1.1.", "00000000000000", "+1-------------------2",
]


def test_base_spans(spark, docs):
    from barloom.llm.pii import pii_digest

    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = pii_digest(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = spans(texts[r["doc_id"]])
        said = [f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in want[k]]
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("id:")] == said


def test_contexts_find_unseen_identifiers(spark):
    from barloom.llm.pii import find_pii

    rows = [(i, f"some text. passport number 10.0.0.{i} was seen") for i in range(6)]
    rows += [(10, "his passport number ZX-998121 was lost"), (11, "the order count AB-12345 is not one"), (12, "see version 2.0.1-rc1 of it")]
    got = {r["doc_id"]: [tuple(x) for x in r["id"]] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == [(20, 29)] and rows[6][1][20:29] == "ZX-998121"
    assert all(not v for k, v in got.items() if k != 10)


def discovered(texts, rounds=3, min_support=3, min_score=0.8):
    """The bootstrap, in plain loops over all tokens."""
    import regex

    token = regex.compile(r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]")
    tokens = lambda t: token.findall(re.sub("[0-9]", "0", t.lower()))
    places, around = collections.Counter(), collections.defaultdict(list)
    shape = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]*[0-9][A-Za-z0-9_/+-]*")
    for d, text in texts.items():
        t = tokens(text)
        for n in (2, 3):
            places.update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
        base = [m for v in spans(text).values() for m in v]
        found = [(a, b, True, text[a:b]) for a, b in base]
        for m in shape.finditer(text):
            x = m[0].strip("_/+-")
            a = m.start() + len(m[0]) - len(m[0].lstrip("_/+-"))
            if len(x) >= 4 and all(b <= a or a + len(x) <= c for c, b in base):
                found.append((a, a + len(x), False, x))
        for a, b, is_base, x in found:
            left, right = tokens(text[:a]), tokens(text[b:])
            keys = [("l", tuple(left[-n:])) for n in (2, 3) if len(left) >= n] + ([("r", tuple(right[:2]))] if len(right) >= 2 else [])
            for k in keys:
                around[k].append((x, is_base or bool(re.fullmatch("(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}", x)), d, a, b, is_base))
    around = {k: v for k, v in around.items() if len({x[0] for x in v}) >= min_support}
    seeds = {x[0] for v in around.values() for x in v if x[1]}
    score = dict.fromkeys(seeds, 1.0)
    for left in range(rounds, 0, -1):
        p = {k: min(1.0, sum(score.get(x[0], 0.0) for x in v) / places[k[1]]) for k, v in around.items() if places[k[1]] and sum(score.get(x, 0.0) for x in {y[0] for y in v}) >= min_support}
        p = {k: s for k, s in p.items() if s >= min_score}
        if left > 1:
            miss = collections.defaultdict(lambda: 1.0)
            for k, s in p.items():
                for x in {y[0] for y in around[k]}:
                    miss[x] *= max(1 - s, 1e-9)
            score = {x: 1 - m for x, m in miss.items() if 1 - m >= min_score} | dict.fromkeys(seeds, 1.0)
    out = collections.defaultdict(set)
    for k in p:
        for _, _, d, a, b, is_base in around[k]:
            if not is_base:
                out[d].add((a, b))
    return out


def test_bootstrap_against_brute_force(spark, docs):
    from barloom.llm.pii import find_pii

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made = [f"my badge no {i}{'XYZ'[i % 3]}-7 (issued)" for i in range(5)] + [f"my badge no 10.1.{i}.9 (issued) and 4111 1111 1111 1111" for i in range(60)]
    made += ["the card key : QQ17/5 (issued) x", "a 1234 b", "9x9x9x", "key = '" + "0a" * 20 + "' z", "key = '" + "0b" * 20 + "' z", "key = '" + "0C" * 17 + "' z", "key = '" + "0d" * 17 + "' z", "key = 'short77' z"]
    texts |= {100_000 + i: t for i, t in enumerate(made)}
    want = discovered(texts)
    got = {r["doc_id"]: {tuple(x) for x in r["id"]} for r in find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {d: v for d, v in got.items() if v} == {d: v for d, v in want.items() if v}
    assert got[100_000] and got[100_072]


def test_many_matches_in_one_text(spark):
    from barloom.llm.pii import find_pii

    text = " ".join(f"10.0.{i % 256}.{i // 256}" for i in range(3000))
    got = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x["start"], x["end"]) for x in got["ip"]] == [m.span() for m in re.finditer(r"\S+", text)]


def test_lines_agree_with_sql(spark, sf_dir, duck, same):
    from barloom.llm.lines import DIGEST_SQL, line_digest

    same(line_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas(), duck.execute(DIGEST_SQL).df())


def test_lines_keep_first(spark):
    from barloom.llm.lines import line_dedup

    df = spark.createDataFrame([(1, "A\nx"), (2, " a\ny\nA"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup(df, min_docs=2, keep="first").collect()}
    assert got == {1: "A\nx", 2: "y", 3: "z"}


def test_keep_bitmaps_are_runs(spark, monkeypatch):
    from barloom.llm import lines

    df = spark.createDataFrame([(1, "a\nx\na\na\ny\nz"), (2, "A\nq\nx"), (3, "own"), (2, "A\nq\nx")], "doc_id long, text string")
    for bound in (10, 0):
        monkeypatch.setattr(lines, "BROADCAST_KEYS", bound)
        got = {r["n_lines"]: ([tuple(x) for x in r["kept"]], r["n_dropped"]) for r in lines.keep_bitmaps(df, min_docs=2).collect()}
        assert got == {6: ([(4, 2)], 4), 3: ([(1, 1)], 2)}


def test_many_runs_in_one_text(spark):
    import time

    from barloom.llm.lines import line_dedup

    text = "\n".join(f"own {i}" if i % 2 else "common" for i in range(40_000))
    df = spark.createDataFrame([(i, text) for i in range(2)], "doc_id long, text string")
    began = time.perf_counter()
    got = line_dedup(df.withColumn("text", df.text), min_docs=2, counts=False).collect()
    assert [r["text"] for r in got] == ["", ""] and time.perf_counter() - began < 60
    df = spark.createDataFrame([(1, text), (2, "common")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup(df, min_docs=2, counts=False).collect()}
    assert got[1] == "\n".join(f"own {i}" for i in range(1, 40_000, 2)) and time.perf_counter() - began < 60


def test_lines_of_odd_rows(odd, none):
    from barloom.llm.lines import line_dedup

    out = line_dedup(odd, min_docs=2, counts=False)
    assert out.columns == odd.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[(1, "")] == 1 and got[(3, "")] == 2 and got[(None, "")] == 1 and got[(5, "A\n\n b \nA")] == 1
    assert line_dedup(none).count() == 0


def test_main_text_of_pages(spark, sf_dir):
    import html  # noqa

    from barloom.llm.html import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_noise_and_broken_markup():
    from barloom.llm.html import Page, main_text

    text = lambda h: main_text(*Page(h).tree())
    assert text(None) == "" and text("") == "" and text("plain &lt;b&gt;") == "plain <b>"
    page = (
        '<body><header><h1>Site</h1></header><nav><a href=/>home</a></nav><div class="cookie-notice">ok?</div><main><article class="post"><header><h1>Title</h1></header><p>One<br>two'
        '<p>three <b>four</b><script>var t="</p>";</script><div class="share">share</div><aside>more</aside><section id="comments"><article class="comment"><p>nice</p></article></section></article></main>'
        '<div id="sidebar">side</div><form><p>mail</p></form><footer>end</footer>'
    )
    assert text(page) == "Title\nOne two\nthree four"
    assert text("<div id=content><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div>") == "a\nb\nc d"
    assert text("<p title='a>b'>x</p><!-- y --><p>z") == "x\nz"
    assert text("<" * 2000 + "a" + "<div>" * 3000 + "deep") != ""


def neutral(html):
    """The page without markup that tells what is what; paragraphs, which the pages leave open, keep theirs."""
    html = re.sub(r"<(/?)(?:nav|ul|li|article|footer|aside|section|h1)\b[^>]*>", r"<\1div>", html)
    return re.sub(r' class="[^"]*"', ' class="x"', html)


def article_of(html):
    import html as h

    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_style_tree_decides_where_markup_does_not(spark):
    from barloom.llm.html import extract

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.collect()
    want = {r["page_id"]: article_of(r["html"]) for r in rows}
    bare = spark.createDataFrame([(r["page_id"], r["url"], neutral(r["html"])) for r in rows], "page_id long, url string, html string")
    share = lambda df: np.mean([r["text"] == want[r["page_id"]] for r in df.collect()])
    none, tree = share(extract(bare, min_pages=10**9)), share(extract(bare))
    alone = share(extract(pages, markup=False))
    print(f"neutral markup: without tree {none:.3f}, with tree {tree:.3f}; given markup, tree alone {alone:.3f}")
    assert none == 0 and tree > 0.9 and alone > 0.9


def test_hostile_markup_is_linear():
    import time

    from barloom.llm.html import Page

    def seconds(html):
        began = time.perf_counter()
        Page(html)
        return time.perf_counter() - began

    makers = [lambda n: "<div>" * n + "</section>" * n, lambda n: "<a " * n, lambda n: "<a x=\">\"" * n, lambda n: "<p><button>" + "<center>" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<!-" * n]
    for make in makers:
        assert seconds(make(40_000)) < 20 * max(seconds(make(4_000)), 0.01)


def test_importance_by_hand(spark):
    """Two slots and a region on six pages: figures from the definitions."""
    import math

    from barloom.llm import html as H

    page = lambda i: f"<div class=a>same</div><div class=b>own {i}</div><div class=c>{'<i>x</i><section>s</section>' if i < 3 else '<section>t</section><section>u</section>'}</div>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    seen = {}
    whole = H.importance

    def keep(nodes, shapes, texts):
        seen["rows"] = whole(nodes, shapes, texts)
        return seen["rows"]

    H.importance, H.SHARE = keep, 0.01
    try:
        H.style_verdicts(H.parse(pages))
    finally:
        H.importance = whole
    rows = [r.asDict() for r in seen["rows"].collect()]
    top = sorted((round(r["importance"], 6), r["m"]) for r in rows if r["m"] == 6 and r["parent"] == 0 and not (r["node"] == 0))
    # a: one text on all pages; b: a text a page; c: two presentations, each on three pages
    x, s = 1 - math.log(3) / math.log(6), 0.9 * (1 - 1)
    first = (s + x) / 2  # text x and a section that three pages share
    second = (s + s + x) / 3
    assert top[0] == (0.0, 6) and top[-1][0] == round(max(0.9, 1 - 0.81 + 0.81 * (first + second) / 2), 6)


def test_style_tree_drops_what_a_host_repeats(spark):
    from barloom.llm.html import extract

    rows = [(i, f"http://h.example/{i}", f"<body><div class=x1><span>Same words on every page</span></div><div class=x2><p>Text number {i} of its own</p></div>") for i in range(12)]
    rows += [(100, None, None), (101, "no host", "<p>a</p>"), (100, None, None)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got)[3] == (3, "Text number 3 of its own", 24)
    assert sorted(got)[-3:] == [(100, "", 0), (100, "", 0), (101, "a", 1)]


def test_quality_on_held_out_rows(spark):
    from barloom.llm.quality import score, train

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs, train(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    test = got[got["held_out"]]
    assert (test["predicted"] == test["quality"]).mean() > 0.93
    good, bad = test[test["quality"] == 1]["score"].to_numpy(), test[test["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_quality_of_odd_rows(odd, none, spark):
    from barloom.llm.quality import Model, fit, keep_good, score, train

    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (3, None, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = train(odd, labels)
    assert isinstance(model, Model)
    got = score(odd, model).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all()
    assert keep_good(odd, model, 0.0).columns == odd.columns and keep_good(odd, model, 0.0).count() == 9
    assert score(none, train(none, labels)).count() == 0
    assert np.allclose(fit(np.empty((0, 19)), np.empty(0)).score(np.zeros((2, 19))), 0.5)


def test_leaks_against_brute_force(spark, sf_dir, docs):
    from barloom.llm.decontaminate import keep_clean, leaks, question_and_answer, terms_of

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    extra = [(200_000 + k, "before words " * 40 + (r["text"].upper() if k % 2 else r["text"].replace("\n", " ")) + " after words" * k) for k, r in enumerate(bench.collect())]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*extra, (1, None)], "doc_id long, text string"))
    want = set()
    for r in both.collect():
        w = terms_of(r["text"])
        grams = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for b in bench.collect():
            q, a = question_and_answer(b["text"])
            n = min(5, len(q))
            g = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
            if len(g & grams[n]) >= 0.8 * len(g) and len(set(a) & set(w)) >= 0.8 * len(set(a)):
                want.add((r["doc_id"], b["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in leaks(both, bench).collect()} == want and len(want) >= len(extra)
    left = {r["doc_id"] for r in keep_clean(both, bench).collect()}
    assert left == {r["doc_id"] for r in both.collect()} - {d for d, _ in want}


def test_wand_equals_scoring_every_item(docs):
    from barloom.llm.decontaminate import Index, terms_of

    texts = [" ".join((r["text"] or "").split()[:60]) for r in docs.limit(150).collect()]
    index = Index.build(list(enumerate(t for t in texts if t)))
    postings = index.starts[:, -1] - index.starts[:, 0]
    read = every = found = 0
    for text in texts[::5]:
        terms = np.unique([index.vocabulary[w] for w in terms_of(text + " " + texts[3]) if w in index.vocabulary])
        scores = np.zeros(len(index.ids))
        for t in terms:
            at = slice(index.starts[t, 0], index.starts[t, -1])
            scores[index.items[at]] += index.impacts[at]
        for threshold in (0.2, 0.6, 0.95):
            got = dict(index.retrieve(terms, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold).tolist()) and all(abs(scores[i] - s) < 1e-9 for i, s in got.items())
            if threshold == 0.6:
                found, every = found + len(got), every + postings[terms].sum()
        before = index.opened
        list(index.retrieve(terms, 0.6))
        read += index.opened - before
    assert found > 20 and read < 0.5 * every


def test_shards_share_their_statistics(spark, sf_dir, docs, monkeypatch):
    from barloom.llm import decontaminate

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("cast(item_id as decimal(20,0)) as item_id", "text")
    said = lambda: sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    one = said()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 30)
    assert said() == one


def test_leaks_of_odd_rows(odd, none, spark):
    from barloom.llm.decontaminate import keep_clean, leaks

    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in leaks(odd, bench).collect()) == [("3", 3), ("3", 3), ("3", 4), ("3", 4), ("None", 3), ("None", 4)]
    assert keep_clean(odd, bench).columns == odd.columns and keep_clean(odd, bench).count() == 6
    assert leaks(none, bench).count() == 0 and leaks(odd, bench.where("false")).count() == 0
