"""Krippendorff's alpha of values against a plain version over all pairs of the pool."""

import pytest

from fieldloom.operators import agreement


def plain(units):
    """Values are equal or not; every pair of the pool."""
    units = [u for u in units if len(u) >= 2]
    different = lambda v: sum(a != b for k, a in enumerate(v) for b in v[k + 1 :])
    pool = [v for u in units for v in u]
    d_o = sum(2 * different(u) / (len(u) - 1) for u in units) / len(pool)
    d_e = different(pool) / (len(pool) * (len(pool) - 1) / 2)
    return 1 - d_o / d_e if d_e else 1.0


def found(spark, units, **options):
    rows = [(f"u{k}", "l", f"p{i}", "f", "exact_match", [v]) for i, u in enumerate(units) for k, v in enumerate(u)]
    table = spark.createDataFrame(rows, "user string, layout_id string, page string, field string, metric string, vals array<string>")
    return agreement.content_alpha(table, **options).first()


def test_all_pairs_of_a_small_pool(spark):
    units = [["a", "a", "b"], ["b", "b"], ["a", "c", "c"], ["d"], ["a", "a", "a"]]
    r = found(spark, units)
    assert (r.alpha, r.units, r.n_values) == (round(plain(units), 3), 4, 11)


@pytest.mark.parametrize("odd", [0, 7, 211, 399])
def test_every_value_takes_part_in_a_large_pool(spark, odd):
    # one cell of 400 is unlike all others: known only if its two values meet their neighbours
    units = [["odd", "other"] if i == odd else ["same", "same"] for i in range(400)]
    assert found(spark, units, max_pairs=200).alpha == pytest.approx(plain(units), abs=0.2)
    assert abs(found(spark, units).alpha - plain(units)) < 0.05


def test_many_values(spark):
    units = [[f"v{i % 7}", f"v{i % 7 if i % 3 else 1}"] for i in range(1500)]
    assert abs(found(spark, units).alpha - plain(units)) < 0.01
