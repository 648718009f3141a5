"""Selection reads every user's strategies, not only those of the first forty."""

import datetime
import random

import pytest

from barloom.queries import load

QUERIES, _ = load()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Events of 60 users, two kinds each; users from 40 on have the greatest values."""
    draw, rows = random.Random(4), []
    for user in range(60):
        for kind in ("click", "view"):
            for _ in range(4):
                rows.append((len(rows), user, kind, draw.uniform(1, 50) + 3 * user, '{"k": %d}' % draw.randrange(9), datetime.datetime(2024, 1, 1 + len(rows) % 28)))
    path = tmp_path_factory.mktemp("wide")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{path}/events.parquet")
    return str(path), rows


def brute(rows):
    """(id, mean, greatest) of each (user, kind), ids in their order."""
    keys = sorted({(r[1], r[2]) for r in rows})
    values = [[r[3] for r in rows if (r[1], r[2]) == k] for k in keys]
    return [(i, round(sum(v) / len(v), 6), round(max(v), 6)) for i, v in enumerate(values)]


def test_population_fronts_and_ranks_cover_all_users(spark, wide):
    path, rows = wide
    pop = brute(rows)
    beats = lambda b, a: b[1] >= a[1] and b[2] >= a[2] and (b[1] > a[1] or b[2] > a[2])
    above = {a[0]: [b[0] for b in pop if beats(b, a)] for a in pop}
    ranks: dict[int, int] = {}
    for i in sorted(above, key=lambda i: len(above[i])):
        ranks[i] = max((ranks[j] + 1 for j in above[i]), default=0)
    got = lambda name: QUERIES[name](spark, path).collect()
    assert {r["id"] for r in got("sel_pareto_front")} == {i for i, a in above.items() if not a}
    assert {r["id"]: r["n"] for r in got("join_theta_dominance")} == {i: len(a) for i, a in above.items() if a}
    assert {r["id"]: r["rank"] for r in got("sel_nds_ranks")} == ranks
    assert {r["id"] for r in got("sel_topk")} == {i for i, *_ in sorted(pop, key=lambda x: -x[1])[:25]}
