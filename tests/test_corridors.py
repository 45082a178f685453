"""Middle lines of strips and of the space between outlines."""

import math

import numpy as np

from terrarow.operators import corridors

RING = "ring array<struct<x:double,y:double>>"


def strip(x0, y0, dx, dy, length=40.0, half=0.6):
    """Ring and axis of a strip from (x0, y0) along d."""
    n = np.array([-dy, dx]) * half
    a, b = np.array([x0, y0]), np.array([x0 + length * dx, y0 + length * dy])
    return [tuple(map(float, p)) for p in (a - n, b - n, b + n, a + n)], *map(float, (*a, *b))


def strips(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"strip int, {RING}, x0 double, y0 double, x1 double, y1 double")


def test_the_space_between_rows_is_walked_down_the_middle(spark):
    got = corridors.gap_corridors(strips(spark, [strip(x, 0, 0, 1) for x in (0, 2.5, 5)]), 6.0).collect()
    assert {(e.a, e.b) for e in got} == {(0, 1), (1, 2)}  # the one between stands in the way of the outer two
    for e in got:
        x = 1.25 if e.a == 0 else 3.75
        assert abs(e.x0 - x) < 1e-9 and abs(e.x1 - x) < 1e-9 and abs(e.half - 0.65) < 1e-9
    assert min(e.y0 for e in got) == 0 and max(e.y1 for e in got) == 40 and len(got) == 8


def test_a_diagonal_space_is_walked_down_the_middle(spark):
    d = 1 / math.sqrt(2)
    rows = [strip(0, 0, d, d), strip(-2.5 * d, 2.5 * d, d, d)]
    got = corridors.gap_corridors(strips(spark, rows), 6.0).collect()
    assert len(got) == 4
    for e in got:
        assert abs((e.y0 - e.x0) * d - 1.25) < 1e-9 and abs((e.y1 - e.x1) * d - 1.25) < 1e-9
    assert corridors.gap_corridors(strips(spark, rows), 2.0).isEmpty()
    assert corridors.gap_corridors(strips(spark, [rows[0], strip(-2.5, 2.5, 0, 1)]), 6.0).isEmpty()


def test_zones_cut_corridors_into_runs(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 0.0), (2, 0.0, 9.0, 4.0, 9.0), (3, 0.0, 20.0, 12.0, 29.0)], "line int, x0 double, y0 double, x1 double, y1 double")
    zone = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    zones = spark.createDataFrame([(1, zone(9.0, -1.0, 3.0, 2.0)), (2, zone(21.0, -1.0, 2.0, 2.0))], f"passage int, {RING}")
    got = sorted((e.line, e.run, e.k, round(e.w, 6)) for e in corridors.centre_edges(lines, zones).collect())
    # the node at 10 lies in the first zone; the second crosses the edge from 20 to 25; line 2 is too short
    assert got == [(1, 0, 0, 5.0), (1, 3, 3, 5.0), (1, 3, 5, 5.0), (3, 0, 0, 5.0), (3, 0, 1, 5.0), (3, 0, 2, 5.0)]
    assert corridors.centre_edges(lines, zones.limit(0)).count() == 6 + 3
