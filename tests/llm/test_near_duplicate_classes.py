"""Classes of near-duplicates when ids are missing or name more than one text."""

import collections

TEXTS = [" ".join(f"{name}{i}" for i in range(12)) for name in ("red", "green", "blue", "grey")]


def test_unlinked_texts_without_or_with_equal_ids_stay(spark):
    from barloom.llm.jaccard import keep_one, near_duplicates

    a, b, c, d = TEXTS
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d), (None, ""), (None, None), (None, "  "), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"]) for r in keep_one(df).collect())
    assert got == collections.Counter([(None, a), (None, b), (7, c), (7, d), (None, ""), (None, None), (None, "  "), (9, ""), (9, "")])
    assert near_duplicates(df).columns == ["doc_id", "class_id", "n_links", "n_copies"]
