"""Walk-forward and random windows reach the table's own last bar."""

HOUR, TEN_DAYS = 3600, 864000


def hours(spark, n):
    return spark.createDataFrame([("a", 1704067200 + k * HOUR, 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(n)], "symbol string, ts bigint, open double, high double, low double, close double, volume double")


def test_walk_forward_windows_reach_the_last_bar(spark):
    from barloom.queries.statistics import wf_windows

    for n in (10, 700, 720, 1000):
        made = wf_windows(hours(spark, n))
        assert made[0][0] == 1704067200 and made[-1][1] == 1704067200 + (n - 1) * HOUR
        assert all(a[1] == b[0] for a, b in zip(made, made[1:], strict=False))
        assert all(b - a == TEN_DAYS for a, b in made[:-1])


def test_random_windows_are_drawn_over_all_bars(spark, monkeypatch):
    from barloom.operators import splits
    from barloom.queries import load, relational

    asked, draw = [], splits.random_starts
    monkeypatch.setattr(relational.B, "event_bars", lambda spark, sf_dir: hours(spark, 900))
    monkeypatch.setattr(splits, "random_starts", lambda spark, total, **more: asked.append(total) or draw(spark, total=total, **more))
    for name in ("spl_rand_windows", "spl_cma_windows"):
        assert {r["n"] for r in load()[0][name](spark, "").collect()} <= {96, 48}
    assert asked == [900, 900]
