import random

import pytest

from pagegrain.operators import regions


def inside(x, y, polygon):
    """Edges to the right of a point, by ray casting."""
    odd = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        rise = by - ay or 1e-9
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / rise + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("per_task", [20, 10**6])
def test_many_profiles_with_many_zones(spark, per_task):
    rng = random.Random(per_task)

    def polygon():
        cx, cy, n = rng.uniform(-300, 1000), rng.uniform(-300, 1000), rng.randint(3, 7)
        return [[cx + rng.uniform(-90, 90), cy + rng.uniform(-90, 90)] for _ in range(n)]

    zones = [(f"p{i % 7}", rng.randint(0, 500), f"z{i}", polygon()) for i in range(3000)] + [("p0", 1, "line", [[0.0, 0.0], [9.0, 9.0]]), (None, 1, "none", polygon())]
    points = [(i, f"p{i % 9}", rng.uniform(-400, 1100), rng.uniform(-400, 1100)) for i in range(3000)]
    points += [(5000 + i, "p3", 123.25, 321.5) for i in range(400)]  # one cell holds very many
    points += [(9001, "p1", None, 1.0), (9002, None, 1.0, 1.0), (9003, "p1", float("nan"), 1.0), (9004, "p1", 100.0, 200.0), (9004, "p1", 100.0, 200.0)]
    df = spark.createDataFrame([(*p, "own") for p in points], "id long, profile string, x double, y double, pos string")
    found = regions.in_zones(df, spark.createDataFrame(zones, "profile string, pos int, zone string, polygon array<array<double>>"), 60.0, per_task)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.columns == ["id", "profile", "x", "y", "pos", "zone"]
    by = {}
    for p, pos, zone, poly in zones:
        if p and len(poly) > 2:
            by.setdefault(p, []).append((pos, zone, poly))
    expected = sorted((i, min(((pos, z) for pos, z, poly in by.get(p, []) if inside(x, y, poly)), default=(0, None))[1] or "") for i, p, x, y in points if x is not None and x == x)
    expected = sorted(expected + [(9001, ""), (9003, "")])
    assert sorted((r["id"], r["zone"] or "") for r in found.collect()) == expected
    assert sum(bool(z) for _, z in expected) > 500


def test_empty_sides(spark):
    points = spark.createDataFrame([("a", 1.0, 1.0)], "profile string, x double, y double")
    zones = spark.createDataFrame([("a", 0, "z", [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]])], "profile string, pos int, zone string, polygon array<array<double>>")
    assert regions.in_zones(points, zones).first()["zone"] == "z"
    assert regions.in_zones(points, zones.limit(0)).first()["zone"] is None
    assert regions.in_zones(points.limit(0), zones).count() == 0


def rows_joined(df):
    """Rows that the joins of a query have made."""
    df.collect()
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(made)


def test_equal_polygons_are_looked_at_once(spark):
    """A thousand zones on the same two squares: the first of each is what points meet."""
    square = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]
    zones = [("a", 1000 - i, f"z{i:03}", [[x + i % 2, y] for x, y in square]) for i in range(1000)] + [("a", 1, "a tie", [[x + 1.0, y] for x, y in square]), ("b", 5, "other", square)]
    points = [(i, "a" if i % 3 else "b", i % 8 + 0.5, 4.0) for i in range(200)] + [(900, "a", 9.5, 4.0)]
    found = regions.in_zones(spark.createDataFrame(points, "id int, profile string, x double, y double"), spark.createDataFrame(zones, "profile string, pos int, zone string, polygon array<array<double>>"))
    expected = {i: "other" if p == "b" else "z998" if x < 1 else "a tie" for i, p, x, _ in points}
    assert {r["id"]: r["zone"] for r in found.collect()} == expected
    assert rows_joined(found) < 3000
