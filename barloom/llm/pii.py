"""Personal data in texts, in DataFrame operations only.

Base kinds come from patterns with checks (Luhn, part and digit limits). Around them runs a bootstrapped contextual
extraction. Seed entities are the base matches and strings of ``SECRET`` shape (long hexadecimal keys). Lexical
patterns are the two and three tokens before an entity and the two behind it, lower-cased and with digits alike; the
slot between is any identifier-shaped string. Patterns and instances form a graph that is scored in rounds: a pattern
by the scores of its instances over *all* places where its tokens occur in the corpus, so that everyday words are no
evidence; an instance by the patterns around it. What stands in the slot of a high-confidence pattern and touches no
base match is a discovered identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import stash
from barloom.llm.lines import doc_key

# The contract's patterns. Possessive repeats and the look-behinds change no match; they keep the search linear
# on long runs: a run that fails at its first character fails at all others, except right after a match (\G).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# identifier-shaped strings: runs of letters, digits and _ / + - that hold a digit; LEAST characters without outer marks
SHAPE = r"(?<![A-Za-z0-9_/+-])[_/+-]*+(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]++"
MARKS, LEAST = "_/+-", 4
SECRET = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"  # identifier-shaped strings that are seeds by themselves
TOKEN = r"[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"
BEFORE, BEHIND = 3, 2  # tokens of context
NEAR = 256  # characters that are looked at first for these tokens; all, if they don't lie there
BROADCAST_GRAMS = 2_000_000  # hashes of patterns that are sent to every task; more are joined
NEW = "id"  # kind of discovered identifiers


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(text: str) -> str:
    """SQL: a text's tokens, lower-cased, each digit as 0."""
    return f"regexp_extract_all(translate(lower({text}), '123456789', '000000000'), {_sql(TOKEN)}, 0)"


def _last(tokens: str, n: int) -> str:
    return f"slice({tokens}, greatest(size({tokens}) - {n - 1}, 1), {n})"


def _prefix_sums(lengths: str) -> str:
    """SQL for the sums before each element, in blocks, so that the cost stays linear for long arrays."""
    fold = "aggregate({x}, named_struct('s', {s}, 'a', cast(array() as array<bigint>)), (z, n) -> named_struct('s', z.s + n, 'a', array_append(z.a, z.s)), z -> z.a)"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div 256), b -> slice({lengths}, b * 256 + 1, 256))"
    sums = f"transform({blocks}, x -> aggregate(x, 0L, (s, n) -> s + n))"
    heads = fold.format(x=sums, s="0L")
    inner = fold.format(x="x", s="h")
    return f"if(size({lengths}) = 0, cast(array() as array<bigint>), flatten(zip_with({blocks}, {heads}, (x, h) -> {inner})))"


def _spans(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds ``name``: every leftmost non-overlapping match as (start, end, text, before, behind); places in code points, contexts as tokens.

    A match's context goes on over its neighbours: they are tokens like any other.
    """
    kind = "array<struct<start:bigint,end:bigint,text:string,before:array<string>,behind:array<string>>>"
    df = df.withColumn("_hits", F.when(when, F.expr(f"regexp_extract_all(body, {_sql(pattern)}, 0)")))
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.expr(f"split(body, {_sql(pattern)}, -1)")))
    df = df.withColumn("_lengths", F.expr("zip_with(_hits, slice(_gaps, 1, size(_hits)), (h, g) -> cast(length(h) + length(g) as bigint))"))
    df = df.withColumn("_before", F.expr(f"if(_gaps is null, null, {_prefix_sums('_lengths')})"))
    # the tokens at both ends of a gap: those of its last or first characters, if there are more of them than needed
    tail = f"if(length(g) > {NEAR} and size({_tokens(f'right(g, {NEAR})')}) > {BEFORE}, {_tokens(f'right(g, {NEAR})')}, {_tokens('g')})"
    head = f"if(length(g) > {NEAR} and size({_tokens(f'left(g, {NEAR})')}) > {BEHIND}, {_tokens(f'left(g, {NEAR})')}, {_tokens('g')})"
    df = df.withColumn("_tails", F.expr(f"transform(transform(_gaps, g -> {tail}), t -> {_last('t', BEFORE)})"))
    df = df.withColumn("_heads", F.expr(f"transform(transform(_gaps, g -> {head}), t -> slice(t, 1, {BEHIND}))"))
    df = df.withColumn("_own", F.expr(f"transform(_hits, h -> {_tokens('h')})"))
    none = "cast(array() as array<string>)"
    of = lambda a, k: f"coalesce(get({a}, {k}), {none})"
    before = "concat(" + ", ".join([f"{of('_own', f'i - {k}')}, {of('_tails', f'i - {k - 1}')}" for k in range(BEFORE, 0, -1)]) + ")"
    behind = "concat(" + ", ".join([f"{of('_heads', f'i + {k}')}, {of('_own', f'i + {k}')}" for k in range(1, BEHIND + 1)]) + ")"
    df = df.withColumn("_left", F.expr(f"transform(transform(_hits, (h, i) -> {before}), t -> {_last('t', BEFORE)})"))
    df = df.withColumn("_right", F.expr(f"transform(_hits, (h, i) -> slice({behind}, 1, {BEHIND}))"))
    # arrays meet by zipping: named once inside a lambda, an array would be made anew for each element
    df = df.withColumn("_at", F.expr("zip_with(_before, slice(_gaps, 1, size(_hits)), (b, g) -> b + length(g))"))
    zipped = "arrays_zip(_at, _hits, _left, _right)"
    spans = F.expr(f"transform({zipped}, z -> named_struct('start', z._at, 'end', z._at + length(z._hits), 'text', z._hits, 'before', z._left, 'behind', z._right))")
    empty = F.expr(f"cast(array() as {kind})")
    gone = ["_hits", "_gaps", "_lengths", "_before", "_tails", "_heads", "_own", "_left", "_right", "_at"]
    return df.withColumn(name, F.when(F.col("_gaps").isNotNull(), spans.cast(kind)).otherwise(empty)).drop(*gone)


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether a digit string passes the Luhn check. From the right, every second digit counts twice."""
    value = f"cast(substring({digits}, -i, 1) as int)"
    doubled = f"(if({value} > 4, 2 * {value} - 9, 2 * {value}))"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 0, {doubled}, {value})) % 10 = 0"


#: what a match must also satisfy, in SQL over ``m``
CHECKS = {
    "email": "true",
    "ip": r"forall(split(m.text, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"case when length(m.text) > 64 then false when length({_digits('m.text')}) between 13 and 19 then {_luhn(_digits('m.text'))} else false end",
    "phone": f"length({_digits('m.text')}) between 9 and 15",
}


def find_base(docs: DataFrame) -> DataFrame:
    """``doc_id, d1, d2``, an array of (start, end, text, before, behind) for each base kind, and ``shaped`` candidates."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", *doc_key(F.col("doc_id"), F.col("text").cast("string")), body.alias("body"))
    digit = F.col("body").rlike("[0-9]")
    df = df.withColumn("_digit", digit)
    for kind in KINDS:
        when = F.col("body").contains("@") if kind == "email" else F.col("_digit")
        if kind == "phone":
            when = when & F.col("body").contains("+")
        df = _spans(df, kind, PATTERNS[kind], when)
        if CHECKS[kind] != "true":
            df = df.withColumn(kind, F.expr(f"filter({kind}, m -> {CHECKS[kind]})"))
    df = _spans(df, "shaped", SHAPE, F.col("_digit"))
    bare, first = f"trim(BOTH '{MARKS}' FROM m.text)", f"length(m.text) - length(ltrim('{MARKS}', m.text))"
    trimmed = f"named_struct('start', m.start + {first}, 'end', m.start + {first} + length({bare}), 'text', {bare}, 'before', m.before, 'behind', m.behind)"
    df = df.withColumn("shaped", F.expr(f"filter(transform(shaped, m -> {trimmed}), m -> length(m.text) >= {LEAST})"))
    return df.select("doc_id", "d1", "d2", *KINDS, "shaped")


def _free_candidates(found: DataFrame) -> DataFrame:
    """Shaped strings and base matches as rows ``d1, d2, base, start, end, text, before, behind``; shaped strings that touch a base match are left out.

    One pass over each document's rows in order of position: memory and time are those of one document.
    """
    every = F.expr("concat(" + ", ".join(f"transform({k}, m -> named_struct('base', true, 'm', m))" for k in KINDS) + ", transform(shaped, m -> named_struct('base', false, 'm', m)))")
    rows = found.where("size(shaped) > 0 or " + " or ".join(f"size({k}) > 0" for k in KINDS)).dropDuplicates(["d1", "d2"])
    rows = rows.select("d1", "d2", F.explode(every).alias("x")).select("d1", "d2", "x.base", "x.m.*")
    order = W.partitionBy("d1", "d2").orderBy("start", F.col("base").desc(), "end")
    back = order.rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("d1", "d2").orderBy(F.col("start").desc(), "base", F.col("end").desc()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_end", F.max(F.when(F.col("base"), F.col("end"))).over(back))
    rows = rows.withColumn("_next", F.min(F.when(F.col("base"), F.col("start"))).over(ahead))
    clear = (F.coalesce(F.col("_end"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_next"), F.col("end")) >= F.col("end"))
    return rows.where(F.col("base") | clear).drop("_end", "_next")


def _patterns() -> Column:
    """The patterns around a row's entity: side and size in the first character, and the hash of the tokens."""
    said = [f"if(size(before) >= {n}, struct('l{n}' as side, xxhash64({', '.join(f'get(before, size(before) - {k})' for k in range(n, 0, -1))}) as gram), null)" for n in range(2, BEFORE + 1)]
    said.append(f"if(size(behind) >= {BEHIND}, struct('r{BEHIND}' as side, xxhash64({', '.join(f'get(behind, {k})' for k in range(BEHIND))}) as gram), null)")
    return F.expr(f"filter(array({', '.join(said)}), x -> x is not null)")


def _occurrences(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, places``: how often each of ``grams`` (hashes of two or three tokens) occurs in all texts."""
    tokens = docs.select(F.expr(_tokens("coalesce(cast(text as string), '')")).alias("t"))
    hashes = [f"transform(slice(t, 1, greatest(size(t) - {n - 1}, 0)), (x, i) -> xxhash64(x, {', '.join(f'get(t, i + {k})' for k in range(1, n))}))" for n in range(2, BEFORE + 1)]
    places = tokens.select(F.explode(F.expr(f"concat({', '.join(hashes)})")).alias("gram"))
    wanted = stash(grams.select("gram").distinct(), "grams")
    if wanted.count() <= BROADCAST_GRAMS:
        places = places.join(F.broadcast(wanted), "gram")
    else:
        places = places.groupBy("gram").agg(F.count("*").alias("n")).join(wanted, "gram").select("gram", "n")
        return places.withColumnRenamed("n", "places")
    return places.groupBy("gram").agg(F.count("*").alias("places"))


def bootstrap(rows: DataFrame, docs: DataFrame, rounds: int = 3, min_support: int = 3, min_score: float = 0.8) -> DataFrame:
    """High-confidence patterns ``side, gram``.

    ``rows`` has ``text, seed, pattern``, one a place and pattern. A seed scores 1, any other instance 0 at first. In each
    round a pattern scores the sum of its places' instance scores over all places of its tokens in ``docs``, and counts
    if its distinct instances' scores sum to ``min_support`` at least; an instance then scores 1 - prod(1 - score) over
    its patterns of at least ``min_score``, if that reaches ``min_score`` too.
    """
    graph = rows.groupBy("pattern.side", "pattern.gram", "text").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    graph = stash(graph, "graph")
    # a pattern with fewer instances can never count
    able = stash(graph.groupBy("side", "gram").agg(F.count("*").alias("m")).where(F.col("m") >= min_support).select("side", "gram"), "able")
    known = stash(able.join(_occurrences(docs, able), "gram"), "known")
    score = F.col("seed").cast("double")
    scored = graph.withColumn("score", score)
    for left in range(rounds, 0, -1):
        patterns = scored.groupBy("side", "gram").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("score").alias("support"))
        patterns = patterns.where(F.col("support") >= min_support).join(known, ["side", "gram"])
        patterns = patterns.select("side", "gram", F.least(F.col("hits") / F.col("places"), F.lit(1.0)).alias("p")).where(F.col("p") >= min_score)
        if left == 1:
            return patterns.select("side", "gram")
        # the logarithm of the product; a perfect pattern's factor is kept just above 0
        miss = F.sum(F.when(F.col("p").isNotNull(), F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))
        joined = graph.join(patterns, ["side", "gram"], "left")
        instances = joined.groupBy("text").agg((1 - F.exp(F.coalesce(miss, F.lit(0.0)))).alias("s"), F.max("seed").alias("known"))
        instances = instances.select("text", F.when(F.col("known"), F.lit(1.0)).when(F.col("s") >= min_score, F.col("s")).otherwise(F.lit(0.0)).alias("score"))
        scored = stash(graph.join(instances, "text"), "scored")
    raise ValueError("rounds is 1 at least")


def find_pii(docs: DataFrame, rounds: int = 3, min_support: int = 3, min_score: float = 0.8) -> DataFrame:
    """``doc_id``, an array of (start, end) for each base kind and one of discovered identifiers, ``id``.

    Positions are in code points, ends exclusive. Null texts are empty; rows with equal doc_id and text are one
    document and get the same result. The text is read twice, for matches and for how often patterns occur.
    """
    found = stash(find_base(docs), "pii")
    rows = _free_candidates(found).withColumn("seed", F.col("base") | F.col("text").rlike(SECRET))
    rows = stash(rows.withColumn("patterns", _patterns()).drop("before", "behind"), "pii-rows")
    around = rows.withColumn("pattern", F.explode("patterns"))
    patterns = bootstrap(around, docs, rounds, min_support, min_score)
    extra = (
        around.where("not base").join(patterns, (F.col("pattern.side") == patterns["side"]) & (F.col("pattern.gram") == patterns["gram"]), "left_semi")
        .groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(NEW))
    )
    bare = [F.expr(f"transform({k}, m -> named_struct('start', m.start, 'end', m.end))").alias(k) for k in KINDS]
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return found.select("doc_id", "d1", "d2", *bare).join(extra, ["d1", "d2"], "left").select("doc_id", *KINDS, F.coalesce(NEW, none).alias(NEW))


def pii_digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    said = lambda kinds: "array_join(concat(" + ", ".join(f"transform({k}, m -> concat('{k}:', m.start, ':', m.end))" for k in kinds) + "), ',')"
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({said(KINDS)}, 256)").alias("base_sha256"),
        F.expr(said([*KINDS, NEW])).alias("spans"),
        F.size(NEW).cast("long").alias("n_found"),
    )
