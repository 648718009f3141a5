"""Fronts, ranks and counts of dominators against a comparison of every pair, with ties and missing objectives."""

import random

import pytest

from barloom.operators import selection as X

NAN = float("nan")


def rows_of(size, values, draw):
    pick = lambda: draw.choice([None, NAN, float("inf")]) if draw.random() < 0.03 else draw.choice(values)
    return [(i, pick(), pick(), draw.choice([None, -1.0, 0.0, 0.0, 0.0, 1.0, 2.5])) for i in range(size)]


def beats(b, a, violation=False):
    if violation and ((a[3] or 0) > 0 or (b[3] or 0) > 0):
        return a[3] is not None and b[3] is not None and b[3] < a[3]
    if None in (*a[1:3], *b[1:3]):
        return False
    key = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  NaN is the greatest
    pairs = [(key(q), key(p)) for q, p in zip(b[1:3], a[1:3], strict=True)]
    return all(q >= p for q, p in pairs) and any(q > p for q, p in pairs)


@pytest.fixture(params=["ties", "spread", "one", "line"])
def pop(request, spark, monkeypatch):
    monkeypatch.setattr(X, "SLAB", 40)  # several parts of each order
    monkeypatch.setattr(X, "POPULATION", 10)  # no pairs
    draw = random.Random(request.param)
    values = {"ties": [float(k) for k in range(6)], "spread": [draw.uniform(-1, 1) for _ in range(500)], "one": [2.0], "line": [0.0]}[request.param]
    rows = [(i, float(i), float(-i // 3), 0.0) for i in range(150)] if request.param == "line" else rows_of(220, values, draw)
    return rows, spark.createDataFrame(rows, "id long, o1 double, o2 double, viol double")


def test_counts_of_dominators(pop):
    rows, df = pop
    want = {a[0]: n for a in rows if (n := sum(beats(b, a) for b in rows))}
    assert {r["id"]: r["n"] for r in X.dominators(df, ["o1", "o2"]).collect()} == want


def test_pareto_front(pop):
    rows, df = pop
    got = X.pareto_front(df, ["o1", "o2"])
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == [a[0] for a in rows if not any(beats(b, a) for b in rows)]


@pytest.mark.parametrize("violation", [None, "viol"])
def test_ranks(pop, violation):
    rows, df = pop
    above = {a[0]: [b[0] for b in rows if beats(b, a, bool(violation))] for a in rows}
    ranks = {}
    while len(ranks) < len(rows):
        ranks |= {i: max((ranks[j] + 1 for j in a), default=0) for i, a in above.items() if i not in ranks and all(j in ranks for j in a)}
    got = X.front_ranks(df, ["o1", "o2"], violation)
    assert got.columns == [*df.columns, "rank"]
    assert {r["id"]: r["rank"] for r in got.collect()} == ranks


def test_no_rows_and_other_numbers_of_objectives(spark):
    none = spark.createDataFrame([], "id long, o1 double, o2 double, viol double")
    assert X.dominators(none, ["o1", "o2"]).count() == X.pareto_front(none, ["o1", "o2"]).count() == X.front_ranks(none, ["o1", "o2"], "viol").count() == 0
    three = spark.createDataFrame([(0, 1, 1, 1), (1, 2, 1, 1), (2, 0, 5, 0), (3, 0, 4, 0)], "id long, a long, b long, c long")
    assert sorted(r["id"] for r in X.pareto_front(three, ["a", "b", "c"]).collect()) == [1, 2]
    assert {r["id"]: r["rank"] for r in X.front_ranks(three, ["a", "b", "c"]).collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
    assert {r["id"]: r["n"] for r in X.dominators(three, ["a", "b", "c"]).collect()} == {0: 1, 3: 1}


def test_crowding_needs_no_pairs(spark, sf_dir, duck, same, monkeypatch):
    from barloom.queries import load

    monkeypatch.setattr(X, "POPULATION", 10)
    queries, sql = load()
    same(queries["win_crowding"](spark, sf_dir).toPandas(), duck.execute(sql["win_crowding"]).df())


def test_tournament_needs_no_pairs(spark, sf_dir, duck, same, monkeypatch):
    from barloom.queries import load

    monkeypatch.setattr(X, "POPULATION", 10)
    queries, sql = load()
    same(queries["sel_tournament_bin"](spark, sf_dir).toPandas(), duck.execute(sql["sel_tournament_bin"]).df())


@pytest.fixture
def stored(monkeypatch):
    """Name and columns of each table that ranking stores."""
    seen, store = [], X._stored
    monkeypatch.setattr(X, "_stored", lambda df, name: seen.append((name, df.columns)) or store(df, name))
    return seen


def test_tournament_ranks_only_the_columns_it_compares(spark, sf_dir, stored):
    from barloom.queries import load

    assert load()[0]["sel_tournament_bin"](spark, sf_dir).count() == 50
    assert stored and all(set(columns) <= {"id", "o1", "o2", "viol", "rank"} for _, columns in stored)


def test_crowding_ranks_only_the_columns_it_compares(spark, sf_dir, stored):
    from barloom.queries import load

    assert load()[0]["win_crowding"](spark, sf_dir).count() > 0
    assert stored and all(set(columns) <= {"id", "o1", "o2", "viol", "rank"} for _, columns in stored)
