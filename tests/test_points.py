import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from eventlens.operators import density as D
from eventlens.operators import points as P
from eventlens.operators.components import connected_components

from .brute import clusters, components

EPS = 1.0


def make_points(seed=7, n=160):
    """A crowded place with a third of all points, some of them copies, and scattered ones."""
    rnd = random.Random(seed)
    rows = [(i, round(rnd.gauss(0, 0.3), 3), round(rnd.gauss(0, 0.3), 3)) for i in range(n // 3)]
    rows += [(i, 0.1, 0.1) for i in range(n // 3, n // 3 + 12)]
    rows += [(i, rnd.uniform(-6, 6), rnd.uniform(-6, 6)) for i in range(n // 3 + 12, n)]
    return rows


def near_pairs(rows, distance):
    return [
        (a[0], b[0]) for a, b in itertools.combinations(rows, 2) if round(distance(a, b), 9) <= EPS
    ]


def euclid(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def manhattan(a, b):
    return abs(a[1] - b[1]) + abs(a[2] - b[2])


def result(clustering):
    return {r["id"]: (r["n"], r["core"], r["cluster"]) for r in clustering.points.collect()}


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(make_points(), "id bigint, x double, y double")


@pytest.mark.parametrize("rule,border", [("ge", "bridge"), ("gt", "min"), ("gt", "bridge"), ("ge", "min")])
@pytest.mark.parametrize("limits", [{}, {"leaf_pairs": 4, "heavy_rows": 5}])
def test_dbscan_equals_brute_force(points, rule, border, limits):
    rows = make_points()
    is_core = (lambda n: n >= 4) if rule == "ge" else (lambda n: n > 4)
    want = clusters([r[0] for r in rows], near_pairs(rows, euclid), is_core, border)
    assert result(P.dbscan(points, 4, EPS, rule, border, **limits)) == want


def make_copies(copies=30):
    """Few places with many points each, so close that no box proves all of them neighbours."""
    rnd = random.Random(5)
    places = [(round(rnd.uniform(0, 3), 3), round(rnd.uniform(0, 3), 3)) for _ in range(12)]
    return [(i, *places[i % 12]) for i in range(12 * copies)] + [(900, 9.0, 9.0)]


@pytest.mark.parametrize("border", ["bridge", "min"])
def test_copies_are_counted_not_paired(spark, border):
    rows = make_copies()
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    want = clusters([r[0] for r in rows], near_pairs(rows, euclid), lambda n: n >= 40, border)
    got = P.dbscan(df, 40, EPS, border=border)
    assert result(got) == want
    assert got.found.total == 13
    assert sum(leaf.count() for leaf in got.found.leaves) <= 13 * 14 / 2
    counts = {r["id"]: r["n"] for r in P.point_counts(df, EPS).collect()}
    assert counts == {i: n for i, (n, _, _) in want.items()}


def test_points_without_a_place_are_noise(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, -0.0), (3, 0.5, 0.5), (4, None, 0.0), (5, float("nan"), 0.1), (6, 0.2, None)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    got = result(P.dbscan(df, 2, EPS))
    assert got == {i: (2, True, 1) if i <= 3 else (0, False, -2) for i in range(1, 7)}


def test_crowded_cell_is_not_expanded(points):
    found = P.point_neighbors(points, EPS, leaf_pairs=16)
    leaves = sum(leaf.count() for leaf in found.leaves)
    crowd = 160 // 3 + 12
    assert found.inside and leaves < crowd * (crowd - 1) / 2


def test_dbscan_with_another_distance(points):
    rows = make_points()
    want = clusters([r[0] for r in rows], near_pairs(rows, manhattan), lambda n: n > 4)
    assert result(P.dbscan(points, 4, EPS, "gt", norm=P.manhattan)) == want


@pytest.mark.parametrize("part_rows", [20_000, 3])
def test_eps_join(points, part_rows):
    got = {(r["src"], r["dst"]) for r in P.eps_join(points, EPS, part_rows=part_rows).collect()}
    assert got == set(near_pairs(make_points(), euclid))


def test_one_dimension(spark):
    rows = [(i, float(x)) for i, x in enumerate([0, 0.5, 1.4, 3, 3.2, 9])]
    df = spark.createDataFrame(rows, "id bigint, x double")
    found = {(r["src"], r["dst"]) for r in P.eps_join(df, EPS, coords=["x"]).collect()}
    assert found == {(0, 1), (1, 2), (3, 4)}


def test_metric_objects_and_copies(spark):
    words = ["cat", "cat", "cat", "bat", "rat", "house", "mouse", "mouse", "tree", ""]
    rows = list(enumerate(words))
    df = spark.createDataFrame(rows, "id bigint, word string")
    found = P.metric_neighbors(df, "word", lambda a, b: P.F.levenshtein(a, b), 1)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [(a, b) for (a, u), (b, v) in itertools.combinations(rows, 2) if lev(u, v) <= 1]
    want = clusters(range(len(words)), pairs, lambda n: n >= 2)
    assert result(D.density_clusters(found, 2)) == want


@pytest.mark.parametrize("heavy_rows", [1_000_000, 4])
def test_components(spark, heavy_rows):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)]  # a path
    edges += [(7, i) for i in range(200, 260)]  # a hub
    edges += [(rnd.randrange(300, 380), rnd.randrange(300, 380)) for _ in range(45)]
    edges += [(500, 500), (3, 2), (2, 1), (1, 3)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in connected_components(df, heavy_rows=heavy_rows).collect()}
    assert got == components(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([], "src bigint, dst bigint")
    assert connected_components(df).count() == 0


@pytest.mark.parametrize("limits", [{}, {"part_rows": 9, "bunch_ids": 4}])
def test_links_of_copies_are_all_pairs(spark, limits):
    """Places with many points, an id that comes twice, and points that have no place."""
    rows = make_copies(9) + [(900, 0.5, 0.5), (900, 0.5, 0.5), (901, None, 0.5), (902, math.nan, 0.5), (903, math.inf, 0.5)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double").withColumn("odd", F.expr("nullif(id % 2, 0) = 1"))
    usable = [r for r in rows if r[0] not in (901, 902, 903)]
    want = sorted(tuple(sorted(p)) for p in near_pairs(usable, euclid) if p[0] != p[1])
    assert sorted((r["src"], r["dst"]) for r in P.eps_join(df, EPS, **limits).collect()) == want
    both = sorted(want + [(b, a) for a, b in want])
    assert sorted((r["src"], r["dst"]) for r in P.eps_links(df, EPS, **limits).collect()) == both
    odd = P.eps_links(df, EPS, source="odd", **limits).collect()
    assert sorted((r["src"], r["dst"]) for r in odd) == [p for p in both if p[0] % 2]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("join", [P.eps_join, P.eps_links])
def test_pairs_of_points_are_made_after_the_only_join_of_places(points, join):
    """The join meets places, and pairs of ids come from generators above it."""
    plan = _plan(join(points, EPS))
    met = plan.index("Join Inner")
    assert plan.count("Join Inner") == 1
    assert plan[:met].count("explode(ids_") + plan[:met].count("explode(from") + plan[:met].count("explode(to") == 2


def test_core_edges_are_not_joined_again(spark):
    """Cores are marked on the points, so no join takes in pairs of ids."""
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["core_edges"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Join") == plan[max(plan.index("explode(from"), plan.index("explode(to")):].count("Join") > 0


def test_cluster_lines_hold_the_points_as_they_are(spark):
    import __spark_entry__ as entry
    from eventlens.plans import inputs

    sf = "/root/testdata/sf0.001"
    lines = [r["value"].split(",") for r in entry.queries()["cluster_csv"](spark, sf).collect()]
    want = sorted((r["x"], r["y"]) for r in inputs.points(spark, sf).collect())
    assert sorted((float(x), float(y)) for x, y, _ in lines) == want
