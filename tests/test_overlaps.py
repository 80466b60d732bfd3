"""Areas that zones share, points inside and merged parts against counts of cells."""

import random

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import topology


def cell(x, y, shear):
    at = lambda a, b: {"x": float(a) + shear * b, "y": float(b)}
    return [[at(x, y), at(x + 1, y), at(x + 1, y + 1), at(x, y + 1), at(x, y)]]


def zones(spark, cells, shear):
    rows = [(k, [cell(x, y, shear)]) for k, own in cells.items() for x, y in own]
    return spark.createDataFrame(rows, "zone string, geometry " + g.MULTIPOLYGON.simpleString())


def test_overlaps_are_those_of_cells(spark):
    """Random sets of cells have holes, several parts and no convex outline; sheared ones have slanted edges and the same areas."""
    rng = random.Random(3)
    cells = {k: {(rng.randint(0, 6) + dx, rng.randint(0, 6)) for _ in range(30)} for k, dx in (("a", 0), ("b", 1), ("c", 3), ("d", 40))}
    for shear in (0.0, 0.5, -1.25):
        shapes = zones(spark, cells, shear)
        outline = topology.dissolve(topology.edges(shapes, "zone", "geometry"), "zone")
        box = outline.groupBy("zone").agg(*[f(F.least(f"a{v}", f"b{v}")).alias(f"{n}_{v}") if n == "min" else f(F.greatest(f"a{v}", f"b{v}")).alias(f"{n}_{v}") for n, f in (("min", F.min), ("max", F.max)) for v in "xy"])
        pairs = topology.near_pairs(box, "zone", 2.0)
        got = {(r["left"], r["right"]): r for r in topology.pair_report(outline, "zone", pairs, 0.5, 0.0).collect()}
        assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
        for (p, q), r in got.items():
            both = len(cells[p] & cells[q])
            assert abs(r["overlap"] - both) < 1e-9 and abs(r["difference"] - len(cells[p] - cells[q])) < 1e-9 and abs(r["symmetric_difference"] - len(cells[p] ^ cells[q])) < 1e-9 and r["passes"] == (both <= 0.5)
        # the middles of all cells, by the even-odd rule
        points = [(x, y, x + 0.5 + shear * (y + 0.5), y + 0.5) for x in range(-1, 50) for y in range(-1, 9)]
        inside = topology.inside(spark.createDataFrame(points, "i long, j long, px double, py double"), outline, "zone", box, 3.0)
        assert {(r["zone"], r["i"], r["j"]) for r in inside.collect()} == {(k, x, y) for k, own in cells.items() for x, y in own}


def test_repair_keeps_area_and_reports_lines(spark):
    square, away = [cell(0, 0, 0.0), cell(1, 0, 0.0)], [cell(0, 0, 0.0), cell(5, 0, 0.0)]
    shapes = spark.createDataFrame([("joined", square), ("apart", away)], "zone string, geometry " + g.MULTIPOLYGON.simpleString())
    outline, report = topology.repair(shapes, "zone", "geometry", 1e-9, 0.0)
    assert [(r["zone"], r["discarded"], r["discarded_length"], r["area_before"], r["area_after"], r["passes"]) for r in report.collect()] == [("joined", 1, 1.0, 2.0, 2.0, True)]
    assert {r["zone"]: r["count"] for r in outline.groupBy("zone").count().collect()} == {"joined": 6, "apart": 8}
