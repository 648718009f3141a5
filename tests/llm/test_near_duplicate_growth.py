"""Rows that a dense group of near copies makes in the joins of its buckets."""

import random


def near_copies(m):
    """Texts of 200 words that differ from one another in three places each: all linked, none equal."""
    base = [f"w{i}" for i in range(200)]
    draw = random.Random(m)
    out = []
    for k in range(m):
        words = list(base)
        for at in draw.sample(range(200), 3):
            words[at] = f"x{k}_{at}"
        out.append(" ".join(words))
    return out


def test_bucket_joins_grow_with_the_group_and_meet_each_row_once(spark, monkeypatch):
    from barloom.llm import jaccard as J

    frame, made = type(spark.range(1)), []
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "path" and how is None:
            made.append(out.count())
        return out

    def rows(m):
        made.clear()
        with monkeypatch.context() as patch:
            patch.setattr(frame, "join", counted)
            docs = spark.createDataFrame(list(enumerate(near_copies(m))), "doc_id long, text string")
            edges = J.candidates(J.sign(docs).select("key", "sig")).collect()
        assert len({k for e in edges for k in (e["a"], e["b"])}) == m
        return list(made)

    small, large = rows(100), rows(200)
    assert sum(large) <= 2.3 * sum(small)
    runs = J.runs_needed()
    # one join gives a bucket's rows its size and pivot, one the number of blocks
    assert len(large) <= 2 * J.LEVELS and sum(large) <= 2 * runs * J.CHILDREN * 200
