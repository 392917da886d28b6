"""Choices of thresholds against a plain loop over decisions."""

import random

import pytest

from tidemark.operators import thresholds as T

SHAPE = "symbol string, event_date string, seq long, p double, ret double"


def decisions(seed, good):
    """Scores whose returns rise above ``good``, in three windows alike."""
    rng = random.Random(seed)
    rows = []
    for k in range(1500):
        p = rng.choice([0.5, 0.56, 0.58, 0.61, 0.63, 0.66, 0.68, 0.72])
        ret = rng.gauss(0.02, 0.02) if p >= good else rng.gauss(0.0, 0.013)
        rows.append((f"S{rng.randrange(30)}", f"2024-01-{k // 60 + 1:02d}", k, p, ret))
    return rows


def by_loop(rows, current, tolerance=0.002):
    """(best, consistent, stable, recommended) by measuring every threshold on every window's decisions."""
    steps = list(T.THRESHOLDS)

    def measure(part, t):
        hit = [r for r in part if r[3] >= t]
        gains, losses = sum(r[4] >= 0.03 for r in part), sum(r[4] < -0.03 for r in part)
        if not hit:
            return None
        n, g, b = len(hit), sum(r[4] >= 0.03 for r in hit), sum(r[4] < -0.03 for r in hit)
        utility = sum(r[4] for r in hit) / n - sum(max(-r[4], 0) for r in hit) / n - b / n + 0.1 * g / gains
        most = max(sum(r[0] == s for r in hit) for s in {r[0] for r in hit}) / n
        return {"n": n, "u": utility, "b": b, "rate": b / losses, "capture": g / gains, "most": most}

    def passes(m, now):
        return m is not None and not (m["b"] > now["b"] or m["rate"] > now["rate"] or m["capture"] < 0.1 or m["n"] < max(10, now["n"] / 4) or m["most"] > 0.5)

    def choose(part):
        table = [measure(part, t) for t in steps]
        now = table[current]
        able = [k for k, m in enumerate(table) if passes(m, now)]
        if not able:
            return current
        top = max(table[k]["u"] for k in able)
        runs = []
        for k in able:
            if table[k]["u"] >= top - tolerance:
                if runs and runs[-1][-1] == k - 1:
                    runs[-1].append(k)
                else:
                    runs.append([k])
        run = sorted(runs, key=lambda r: (-len(r), -max(table[k]["u"] for k in r), r[0]))[0]
        middle = run[(len(run) - 1) // 2]
        return current if current in run or now["u"] >= table[middle]["u"] else middle

    best = choose(rows)
    windows = [rows[:500], rows[500:1000], rows[1000:]]
    moved = best != current
    wins = [passes(measure(w, steps[best]), measure(w, steps[current])) and measure(w, steps[best])["u"] > measure(w, steps[current])["u"] for w in windows]
    own = [steps[choose(w)] for w in windows]
    stable = moved and max(own) - min(own) <= 0.05 + 1e-9 and sum(abs(t - steps[best]) <= 0.025 + 1e-9 for t in own) >= 2
    change = moved and all(wins) and stable
    return steps[best], moved and all(wins), stable, steps[best] if change else steps[current]


@pytest.mark.parametrize("seed, good, current", [(1, 0.65, 0), (2, 0.6, 3)])
def test_recommendation_equals_a_loop(spark, seed, good, current):
    rows = decisions(seed, good)
    df = T.row_windows(spark.createDataFrame(rows, SHAPE).repartition(5), "event_date", ["seq"], 3).cache()
    got = T.recommendation(df, T.cells(df, "p", "ret"), current + 1).first()
    want = by_loop(rows, current)
    assert (got["best"], got["consistent"], got["stable"], got["recommended"]) == want and got["supported"]
    if seed == 1:
        assert got["recommended"] > got["current"]


def test_windows_are_of_equal_rows(spark):
    rows = decisions(5, 0.6)[:1000]
    df = T.row_windows(spark.createDataFrame(rows, SHAPE), "event_date", ["seq"], 3).collect()
    assert [sum(r["window"] == w for r in df) for w in (1, 2, 3)] == [334, 333, 333]
    assert all(r["window"] == 1 + (r["seq"] >= 334) + (r["seq"] >= 667) for r in df)
