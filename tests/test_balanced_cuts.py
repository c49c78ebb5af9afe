"""Balanced splits without an order of the units, against plain Python."""

import hashlib
import random

import pytest

from groupwise.operators.splits import balance_units, pair_cold


def _hash(seed, unit):
    return hashlib.sha256(f"{seed}:{unit}".encode()).hexdigest()


def _balanced(units, seed, shares):
    """units: (unit, n, forced); where each midpoint falls."""
    total, forced = sum(n for _, n, _ in units), sum(n for _, n, f in units if f)
    train = max(0.0, shares[0] * total - forced)
    val = max(total - forced - train, 0.0) * (shares[1] / (shares[1] + shares[2]))
    out, run = {u: "train" for u, _, f in units if f}, 0
    for unit, n, _ in sorted((x for x in units if not x[2]), key=lambda x: _hash(seed, x[0])):
        run += n
        mid = run - n / 2
        out[unit] = "train" if mid < train else "val" if mid < train + val else "test"
    return out


@pytest.mark.parametrize(("count", "share_forced", "shares"), [(1, 0, (0.7, 0.15, 0.15)), (7, 0.3, (0.7, 0.15, 0.15)), (3000, 0.02, (0.7, 0.15, 0.15)), (400, 0.9, (0.7, 0.15, 0.15)), (300, 0, (0.85, 0.15, 0.0))])
def test_balance_is_that_of_the_midpoints(spark, count, share_forced, shares):
    rng = random.Random(count)
    units = [(f"u{i}", rng.choice([1, 1, 2, 9, 200]), rng.random() < share_forced) for i in range(count)]
    table = spark.createDataFrame([(u, 1, n, 1.0, f) for u, n, f in units], "unit string, n_groups long, n_records long, unit_weight double, forced boolean")
    out = balance_units(table, [1, 2, 5], shares)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # no unit is put in order
    found = {(r.seed, r.unit): r.partition for r in out.collect()}
    assert found == {(s, u): p for s in (1, 2, 5) for u, p in _balanced(units, s, shares).items()}


@pytest.mark.parametrize("any_forced", [False, True])
def test_pair_cold_is_the_best_repaired_seed(spark, any_forced):
    rng, shares, seeds = random.Random(3), (0.7, 0.15, 0.15), list(range(70))
    rows = [(i, f"u{rng.randrange(300)}", rng.choice([None, *range(40)]), rng.randrange(60)) for i in range(900)]
    sizes = {}
    for _, u, _, _ in rows:
        sizes[u] = sizes.get(u, 0) + 1
    units = [(u, n, any_forced and u.endswith("7")) for u, n in sizes.items()]
    best = None
    for seed in seeds:
        part, weak = _balanced(units, seed, shares), set()
        for k in (2, 3):
            for key in {r[k] for r in rows if r[k] is not None}:
                own = [r[1] for r in rows if r[k] == key]
                if sum(part[u] == "train" for u in own) < 5:
                    weak.update(own)
        part = {u: "train" if u in weak else p for u, p in part.items()}
        gap = round(sum(abs(sum(part[r[1]] == p for r in rows) / len(rows) - x) for p, x in zip(("train", "val", "test"), shares, strict=True)), 12)
        if best is None or gap < best[0]:
            best = gap, seed, part
    d = spark.createDataFrame(rows, "record long, unit string, donor long, acceptor long")
    of_units = spark.createDataFrame(units, "unit string, n_records long, forced boolean")
    found = pair_cold(d, of_units, ["donor", "acceptor"], seeds, "record").collect()
    assert {r.seed for r in found} == {best[1]} and {r.record: r.partition for r in found} == {r[0]: best[2][r[1]] for r in rows}
