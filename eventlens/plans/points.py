"""Queries over points: range joins, neighbourhoods, density clustering, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as D
from ..operators import points as P
from ..operators.cellgraph import cell_clusters
from ..operators.components import connected_components
from ..operators.series import number_rows
from ..session import new_path
from ..sources import files, store
from . import inputs, sql
from .registry import query

EPS = 2.0
MIN_PTS = 4


def _clustered(spark, sf, **options):
    return P.dbscan(inputs.points(spark, sf), MIN_PTS, EPS, **options)


def _labelled(spark, sf, **options):
    """Where neighbours need no counts: clusters by the graph of cells."""
    return cell_clusters(inputs.points(spark, sf), MIN_PTS, EPS, **options)


@query("euclidean", f"""
WITH {sql.POINTS}, nxt AS (SELECT id, x, y, lead(x) OVER (ORDER BY id) AS x2, lead(y) OVER (ORDER BY id) AS y2 FROM pts)
SELECT id, round(sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)), 6) AS distance FROM nxt WHERE x2 IS NOT NULL
""")
def _euclidean(spark, sf):
    points = inputs.stored(inputs.points(spark, sf))
    after = points.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    diffs = [F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2"))]
    return points.join(after, "id").select("id", F.round(P.euclidean(diffs), 6).alias("distance"))


@query("eps_join_points", f"""
WITH {sql.POINTS}, {sql.point_pairs(EPS)}
SELECT src, dst, distance FROM near
""")
def _eps_join(spark, sf):
    return P.eps_join(inputs.stored(inputs.points(spark, sf)), EPS)


@query("neighbor_pairs", f"""
WITH {sql.POINTS}, {sql.point_pairs(EPS)}
SELECT src, dst, 'first' AS execution FROM near UNION ALL SELECT dst, src, 'first' FROM near
UNION ALL SELECT src, dst, 'second' FROM near WHERE distance <= 1
UNION ALL SELECT dst, src, 'second' FROM near WHERE distance <= 1
""")
def _neighbor_pairs(spark, sf):
    points = inputs.stored(inputs.points(spark, sf))
    path = new_path(spark, "neighbor-pairs")
    store.save_neighbor_pairs(P.eps_links(points, EPS), path, "first")
    store.save_neighbor_pairs(P.eps_links(points, 1.0), path, "second")
    return spark.read.schema("src bigint, dst bigint, execution string").parquet(path)


NEIGHBORS = f"WITH RECURSIVE {sql.POINTS}, {sql.point_pairs(EPS)}, {sql.clusters('>= 4')}"
NEIGHBORS_GT = f"WITH RECURSIVE {sql.POINTS}, {sql.point_pairs(EPS)}, {sql.clusters('> 4')}"
CLASSIC = f"WITH RECURSIVE {sql.POINTS}, {sql.point_pairs(EPS)}, {sql.core_clusters('>= 4')}"


@query("neighborhoods", f"{NEIGHBORS} SELECT id, n FROM counts WHERE n > 0")
def _neighborhoods(spark, sf):
    return P.point_counts(inputs.points(spark, sf), EPS).filter("n > 0")


@query("core_points", f"{NEIGHBORS} SELECT id, n FROM counts WHERE n >= 4")
def _core_points(spark, sf):
    counts = P.point_counts(inputs.points(spark, sf), EPS)
    return counts.filter(D.core_test(F.col("n"), MIN_PTS))


@query("core_points_gt", f"{NEIGHBORS} SELECT id, n FROM counts WHERE n > 4")
def _core_points_gt(spark, sf):
    counts = P.point_counts(inputs.points(spark, sf), EPS)
    return counts.filter(D.core_test(F.col("n"), MIN_PTS, "gt"))


@query("core_edges", f"{NEIGHBORS} SELECT src, dst FROM core_links")
def _core_edges(spark, sf):
    points = inputs.stored(inputs.points(spark, sf))
    counts = P.point_counts(points, EPS)
    cores = counts.filter(D.core_test(F.col("n"), MIN_PTS)).select("id").distinct()
    marked = points.join(cores.withColumn("core", F.lit(True)), "id", "left")
    return P.eps_links(marked, EPS, source="core").select("src", "dst")


LABELLED = "SELECT id, coalesce(cluster, -2) AS cluster FROM pts LEFT JOIN labels USING (id)"


@query("dbscan_points", f"{NEIGHBORS} {LABELLED}")
def _dbscan(spark, sf):
    return _labelled(spark, sf).select("id", "cluster")


@query("dbscan_points_gt", f"{NEIGHBORS_GT} {LABELLED}")
def _dbscan_gt(spark, sf):
    return _clustered(spark, sf, core_rule="gt").points.select("id", "cluster")


@query("label_noise", f"""
{NEIGHBORS} SELECT id, round(x, 6) AS x, y, coalesce(cluster, -2) AS cluster
FROM pts LEFT JOIN labels USING (id)
""")
def _label_noise(spark, sf):
    labels = _clustered(spark, sf).points.filter(F.col("cluster") != D.NOISE).select("id", "cluster")
    points = inputs.points(spark, sf)
    return store.label_points(points, labels).withColumn("x", F.round("x", 6))


@query("clustered_only", f"{NEIGHBORS} SELECT id, round(x, 6) AS x, y, cluster FROM pts JOIN labels USING (id)")
def _clustered_only(spark, sf):
    labels = _clustered(spark, sf).points.filter(F.col("cluster") != D.NOISE).select("id", "cluster")
    return inputs.points(spark, sf).join(labels, "id").withColumn("x", F.round("x", 6))


@query("cluster_report", f"""
{NEIGHBORS} SELECT id, coalesce(cluster, -2) AS cid, n AS nc FROM counts LEFT JOIN labels USING (id)
""")
def _cluster_report(spark, sf):
    path = new_path(spark, "clusters")
    store.cluster_report(_clustered(spark, sf).points).write.parquet(path)
    return spark.read.parquet(path)


@query("cluster_csv", f"""
{NEIGHBORS} SELECT x, y, coalesce(cluster, -2) AS cluster FROM pts LEFT JOIN labels USING (id)
""")
def _cluster_csv(spark, sf):
    """The lines as they are read again: engines write doubles differently, so numbers are compared."""
    labelled = _clustered(spark, sf).points.join(inputs.points(spark, sf), "id").select("x", "y", "cluster")
    path = new_path(spark, "cluster-lines")
    store.cluster_lines(labelled).write.text(path)
    return spark.read.schema("x double, y double, cluster long").csv(path)


@query("cluster_count", f"{NEIGHBORS} SELECT count(DISTINCT cluster) AS clusters, count(*) AS members FROM labels")
def _cluster_count(spark, sf):
    labels = _clustered(spark, sf).points.filter(F.col("cluster") != D.NOISE)
    return labels.agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("members"))


@query("cluster_stats", f"""
{NEIGHBORS} SELECT (SELECT count(*) FROM cores) AS cores, (SELECT CAST(sum(n) AS BIGINT) FROM counts WHERE n >= 4)
AS edges, count(DISTINCT cluster) AS clusters, max(cluster) AS last_cluster FROM labels
""")
def _cluster_stats(spark, sf):
    points = _clustered(spark, sf).points
    in_cluster = F.when(F.col("cluster") != D.NOISE, F.col("cluster"))
    return points.agg(
        F.count_if("core").alias("cores"),
        F.sum(F.when(F.col("core"), F.col("n"))).alias("edges"),
        F.count_distinct(in_cluster).alias("clusters"),
        F.max(in_cluster).alias("last_cluster"),
    )


@query("dbscan_classic", f"""
{CLASSIC}, numbers AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS number FROM
(SELECT DISTINCT cluster FROM labels))
SELECT id, coalesce(number, -2) AS cluster FROM pts LEFT JOIN labels USING (id) LEFT JOIN numbers USING (cluster)
""")
def _dbscan_classic(spark, sf):
    points = inputs.stored(_labelled(spark, sf, border="min").select("id", "cluster"))
    names = points.filter(F.col("cluster") != D.NOISE).select("cluster").distinct()
    numbers = number_rows(names, [F.col("cluster")]).select("cluster", (F.col("number") + 1).alias("number"))
    return points.join(numbers, "cluster", "left").select(
        "id", F.coalesce("number", F.lit(D.NOISE)).cast("bigint").alias("cluster")
    )


@query("border_conflicts", f"""
{CLASSIC} SELECT id, array_to_string(list_sort(list(cluster)), ' ') AS clusters FROM claims
GROUP BY id HAVING count(*) > 1
""")
def _border_conflicts(spark, sf):
    result = _clustered(spark, sf, border="min")
    cores = result.labels.filter("core").select("id", "cluster")
    claims = result.spots.rows(D.border_claims(result.found, result.marked, cores), each_row=False)
    rows = claims.groupBy("id").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    return rows.filter(F.size("clusters") > 1).withColumn(
        "clusters", F.array_join(F.transform("clusters", lambda c: c.cast("string")), " ")
    )


@query("rank_cores", f"""
{NEIGHBORS} SELECT id, n, row_number() OVER (ORDER BY n, id) - 1 AS number FROM counts WHERE n >= 4
""")
def _rank_cores(spark, sf):
    counts = P.point_counts(inputs.points(spark, sf), EPS)
    cores = counts.filter(D.core_test(F.col("n"), MIN_PTS))
    return number_rows(cores, [F.col("n"), F.col("id")]).withColumn("number", F.col("number").cast("bigint"))


@query("connected_components", """
WITH RECURSIVE steps AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations),
links AS (SELECT src, dst FROM steps UNION SELECT dst, src FROM steps),
reach AS (SELECT DISTINCT src AS id, src AS label FROM links
          UNION SELECT l.dst, r.label FROM reach r JOIN links l ON l.src = r.id WHERE l.dst > r.label)
SELECT id, min(label) AS component FROM reach GROUP BY id
""")
def _components(spark, sf):
    turn = F.col("conv_id") * 1000 + F.col("turn")
    turns = inputs.table(spark, sf, "conversations")
    return connected_components(turns.select(turn.alias("src"), (turn + 1).alias("dst")))


MANHATTAN = "abs(a.x - b.x) + abs(a.y - b.y)"


@query("dbscan_manhattan", f"""
WITH RECURSIVE {sql.POINTS}, {sql.point_pairs(EPS, MANHATTAN)}, {sql.clusters('> 4')} {LABELLED}
""")
def _dbscan_manhattan(spark, sf):
    return _labelled(spark, sf, core_rule="gt", norm=P.manhattan).select("id", "cluster")


URL_EPS = 6


@query("dbscan_custom_distance", f"""
WITH RECURSIVE pts AS (SELECT page_id AS id, url FROM pages),
near AS (SELECT a.id AS src, b.id AS dst FROM pts a JOIN pts b ON a.id < b.id
         WHERE levenshtein(a.url, b.url) <= {URL_EPS}), {sql.clusters('> 4')} {LABELLED}
""")
def _dbscan_custom(spark, sf):
    pages = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url")
    found = P.metric_neighbors(
        pages, "url", lambda a, b: F.levenshtein(a, b), URL_EPS, near=lambda a, b: F.levenshtein(a, b, URL_EPS) >= 0
    )
    return D.density_clusters(found, MIN_PTS, "gt").points.select("id", "cluster")


@query("read_points", f"""
WITH {sql.POINTS} SELECT id, round(x, 6) AS x, y FROM pts
""")
def _read_points(spark, sf):
    path = new_path(spark, "point-lines")
    points = inputs.points(spark, sf)
    fields = [F.col(c).cast("string") for c in ("id", "x", "y")]
    points.select(F.concat_ws("\t", *fields, F.lit("1"))).write.text(path, lineSep="\r\n")
    return files.read_points(spark, path).withColumn("x", F.round("x", 6))
