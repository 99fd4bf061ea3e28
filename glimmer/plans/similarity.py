"""Search by likeness, similar pairs, clusters and centroids, on the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions.scalars import cover_score, display_score, document_verdict, face_quality, similarity_of
from glimmer.operators.clustering import components, density_clusters, linked, representatives
from glimmer.operators.sequences import score_cut
from glimmer.operators.sync import ordered_union
from glimmer.operators.vectors import centroids, confidence, distance_quantiles, l2, linear_head, merge_suggestions, nearest_anchor, nearest_each, norm, prompt_margin, similar_links, similar_pairs
from glimmer.store import written
from glimmer.plans.registry import query

EPSILON = 0.62
#: Cosine distance in SQL, of two DOUBLE[] expressions.
_COS = "1 - greatest(-1, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_HITS = f"""{_V}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
hits AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) ** 2))) AS d FROM v, q WHERE vec_id <> 0),
shown AS (SELECT vec_id, greatest(0, least(1, (1 - d * d / 2) / 0.5)) AS s FROM (SELECT * FROM hits ORDER BY d, vec_id LIMIT 50))"""


def _hits(t, k=50):
    """The k nearest of vector 0, with their displayed score. The query is one row that every partition gets."""
    rows = t("embeddings")
    asked = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    near = rows.filter("vec_id <> 0").crossJoin(F.broadcast(asked)).withColumn("distance", l2(F.col("embedding"), F.col("q"))).orderBy("distance", "vec_id").limit(k)
    return near.select("vec_id", "distance", display_score(similarity_of(F.col("distance")), 0.0, 0.5).alias("score"))


@query("VEC-01 VEC-02 VEC-06 RM-05", f"WITH {_HITS} SELECT vec_id, round(d, 6) AS distance, round(1 - d * d / 2, 6) AS similarity FROM hits ORDER BY d, vec_id LIMIT 20")
def knn_topk(t):
    return _hits(t, 20).select("vec_id", F.round("distance", 6).alias("distance"), F.round(similarity_of(F.col("distance")), 6).alias("similarity"))


@query("VEC-03 VEC-04 PRJ-03", f"WITH {_HITS} SELECT vec_id, round(s, 6) AS score FROM shown WHERE s >= 0.3")
def knn_display(t):
    return _hits(t).filter("score >= 0.3").select("vec_id", F.round("score", 6).alias("score"))


_CUT = """, placed AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS p, s - lead(s) OVER (ORDER BY s DESC, vec_id) AS drop, count(*) OVER () AS n, max(s) OVER () AS best FROM shown),
figures AS (SELECT max(drop) AS most, avg(drop) AS mean, any_value(n) AS n, min(CASE WHEN p > 0 AND s < 0.7 * best THEN p END) AS line FROM placed),
cut AS (SELECT greatest(1, CASE WHEN n < 3 THEN n WHEN most >= greatest(0.1, 2 * mean) THEN (SELECT min(p) + 1 FROM placed WHERE drop = most) ELSE coalesce(line, n) END) AS c FROM figures)"""


@query("WIN-05 VEC-05", f"WITH {_HITS}{_CUT} SELECT vec_id, p::BIGINT AS position, p >= c AS below_cut FROM placed, cut")
def score_cut_tiers(t):
    # 50 rows: what a search returns
    rows = score_cut(_hits(t).withColumn("page", F.lit(0)), "score", ["page"], 0.7, ["vec_id"])
    return rows.select("vec_id", F.col("position").cast("long").alias("position"), "below_cut")


@query("SET-02 Q-01", f"""WITH {_HITS}{_CUT}, words AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS p FROM v WHERE label = 3 AND vec_id % 7 = 0),
u AS (SELECT vec_id, min((source, p)) AS m FROM (SELECT vec_id, 0 AS source, p FROM words UNION ALL SELECT vec_id, 1, p FROM placed) GROUP BY 1)
SELECT vec_id, CASE WHEN m[1] = 0 THEN 'text' ELSE 'semantic' END AS matched_by, row_number() OVER (ORDER BY m[1], m[2], vec_id) - 1 AS position FROM u""".replace("min((source, p)) AS m", "min([source, p]) AS m"))
def smart_search(t):
    words = t("embeddings").filter("label = 3 AND vec_id % 7 = 0").select("vec_id").withColumn("position", F.row_number().over(Window.orderBy(F.desc("vec_id"))) - 1)
    likely = _hits(t).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1)
    both = ordered_union(words, likely, "vec_id")
    return both.select("vec_id", F.when(F.col("source") == 0, "text").otherwise("semantic").alias("matched_by"), F.col("position").cast("long").alias("position"))


@query("VEC-01 JN-02", f"""WITH {_V}, d AS (SELECT q.vec_id AS query, r.vec_id AS neighbor, sqrt(greatest(0, list_dot_product(q.e, q.e) + list_dot_product(r.e, r.e) - 2 * list_dot_product(q.e, r.e))) AS d FROM v q JOIN v r ON q.vec_id % 20 = 0)
SELECT query, neighbor, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 9), neighbor) AS r FROM d) WHERE r <= 10""")
def knn_each(t):
    rows = t("embeddings")
    near = nearest_each(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return near.select("query", "neighbor", F.round("distance", 5).alias("distance"))


_PAIRS = f"pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a='a.e', b='b.e')} AS d FROM v a JOIN v b ON a.vec_id < b.vec_id)"


@query("JN-21 VEC-07 VEC-10", f"WITH {_V}, {_PAIRS} SELECT a, b, round(d, 6) AS distance FROM pairs WHERE d <= {EPSILON}")
def similarity_pairs(t):
    return similar_pairs(t("embeddings"), "vec_id", "embedding", EPSILON).select("a", "b", F.round("distance", 6).alias("distance"))


_COMPONENTS = f"""WITH RECURSIVE {_V}, {_PAIRS}, links AS (SELECT a, b FROM pairs WHERE d <= {{e}} UNION ALL SELECT b, a FROM pairs WHERE d <= {{e}}),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT vec_id, b FROM reach JOIN links ON r = a), c AS (SELECT vec_id, min(r) AS cluster FROM reach GROUP BY 1)"""


@query("VEC-08 VEC-09 SET-07", _COMPONENTS.format(e=EPSILON) + " SELECT vec_id, cluster FROM c")
def dbscan_labels(t):
    rows = t("embeddings")
    labels = density_clusters(rows.select(F.col("vec_id").alias("id")), similar_links(rows, "vec_id", "embedding", [EPSILON]))
    return labels.select(F.col("id").alias("vec_id"), "cluster")


@query("AG-26", _COMPONENTS.format(e=EPSILON) + " SELECT n AS size, count(*)::BIGINT AS clusters FROM (SELECT cluster, count(*)::BIGINT AS n FROM c GROUP BY 1) GROUP BY 1")
def cluster_sizes(t):
    return dbscan_labels(t).groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query("VEC-17", _COMPONENTS.format(e=0.6) + ", big AS (SELECT cluster, vec_id, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END DESC, vec_id) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM c JOIN v USING (vec_id)) SELECT cluster, vec_id AS best, n::BIGINT AS members FROM big WHERE r = 1 AND n > 1")
def near_dup_groups(t):
    rows = t("embeddings")
    groups = components(rows.select(F.col("vec_id").alias("id")), similar_links(rows, "vec_id", "embedding", [0.6]))
    joined = groups.join(rows, F.col("id") == F.col("vec_id")).withColumn("score", F.when(F.col("vec_id") % 4 != 0, F.col("label").cast("double")))
    best = representatives(joined, ["component"], "score", "vec_id").select("component", "vec_id")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members")).filter("members > 1")
    return sizes.join(best, "component").select(F.col("component").alias("cluster"), F.col("vec_id").alias("best"), "members")


_CENTERS = "dims AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v) GROUP BY 1, 2), centers AS (SELECT label, list(m ORDER BY i) AS c, max(n) AS n FROM dims GROUP BY 1)"


@query("AG-22 AG-23 VEC-12", f"WITH {_V}, {_CENTERS} SELECT label, round(CASE WHEN count(*) = 1 THEN 1 ELSE greatest(0, least(1, avg(1 - ({_COS.format(a='e', b='c')})))) END, 6) AS confidence, count(*)::BIGINT AS members FROM v JOIN centers USING (label) GROUP BY 1")
def centroid_confidence(t):
    rows = t("embeddings")
    return confidence(rows, centroids(rows, ["label"], "embedding").drop("n"), ["label"], "embedding").select("label", F.round("confidence", 6).alias("confidence"), "members")


@query("JN-20 SNK-19 RM-13", f"WITH {_V}, {_CENTERS} SELECT a, b, round(d, 6) AS distance FROM (SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, {_COS.format(a='a.c', b='b.c')} AS d FROM centers a JOIN centers b ON a.label < b.label) WHERE d > 0.62 AND d < 0.98 AND (a, b) NOT IN (SELECT (1, 2))".replace("(a, b) NOT IN (SELECT (1, 2))", "NOT (a = 1 AND b = 2)"))
def merge_band(t):
    rows = t("embeddings")
    centers = centroids(rows, ["label"], "embedding").select(F.col("label").cast("long").alias("label"), "centroid")
    rejected = rows.limit(1).select(F.lit(2).cast("long").alias("person_a"), F.lit(1).cast("long").alias("person_b"))
    return merge_suggestions(centers, "label", 0.62, 0.98, rejected).select("a", "b", F.round("distance", 6).alias("distance"))


@query("VEC-19", f"""WITH {_V}, p AS (SELECT vec_id AS p, e AS pe FROM v WHERE vec_id < 6), s AS (SELECT vec_id, p, 1 - ({_COS.format(a='e', b='pe')}) AS s FROM v, p)
SELECT vec_id, round(max(s) FILTER (p < 3) - max(s) FILTER (p >= 3), 6) AS margin FROM s GROUP BY 1""")
def zero_shot_margin(t):
    rows = t("embeddings")
    prompts = rows.filter("vec_id < 6").groupBy().agg(*[F.first(F.when(F.col("vec_id") == i, F.col("embedding")), ignorenulls=True).alias(f"p{i}") for i in range(6)])
    joined = rows.crossJoin(F.broadcast(prompts))  # one row of six prompts
    margin = prompt_margin(F.col("embedding"), [F.col(f"p{i}") for i in range(3)], [F.col(f"p{i}") for i in range(3, 6)])
    return joined.select("vec_id", F.round(margin, 6).alias("margin"))


@query("VEC-21", f"""WITH {_V}, p AS (SELECT vec_id AS p, e AS pe FROM v WHERE vec_id < 6), s AS (SELECT vec_id, p, 1 - ({_COS.format(a='e', b='pe')}) AS s FROM v, p),
m AS (SELECT vec_id, round(max(s) FILTER (p < 3) - max(s) FILTER (p >= 3), 6) AS margin FROM s GROUP BY 1)
SELECT vec_id, 0.65 * greatest(0, least(1, (margin + 0.1) / 0.2)) + 0.35 * ((vec_id % 11) / 10.0) >= 0.5 - 1e-9 AS is_doc FROM m""")
def document_verdicts(t):
    return zero_shot_margin(t).select("vec_id", document_verdict(F.col("margin"), (F.col("vec_id") % 11) / 10.0, -0.1, 0.1).alias("is_doc"))


@query("VEC-22", f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * (i % 7 - 3) / 10.0)) / sqrt(list_dot_product(e, e)) + 5, 6) AS score FROM v")
def linear_head_scores(t):
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 7 - 3) / 10.0)
    return t("embeddings").select("vec_id", F.round(linear_head(F.col("embedding"), weights, 5.0), 6).alias("score"))


@query("JN-19 VEC-11", f"WITH {_V}, {_CENTERS} SELECT vec_id, arg_max(label, (-d, label))::BIGINT AS anchor FROM (SELECT vec_id, c.label, round({_COS.format(a='e', b='c.c')}, 9) AS d FROM v, centers c) WHERE d <= 0.7 GROUP BY 1")
def snap_to_anchor(t):
    rows = t("embeddings")
    anchors = centroids(rows, ["label"], "embedding").select(F.col("label").cast("long").alias("anchor"), "centroid")
    return nearest_anchor(rows, anchors, "vec_id", "embedding", 0.7).select(F.col("query").alias("vec_id"), "anchor")


@query("VEC-13 VEC-14", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 1 + l_discount * 80 END AS aes, l_quantity * 1000 AS area, 400 AS w, 300 AS h, l_tax * 10 AS det, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_discount * 10 END AS front FROM lineitem),
s AS (SELECT *, CASE WHEN aes IS NULL THEN -1 ELSE greatest(0, least(1, (aes - 1) / 9)) * least(area / (w * h), 1) * greatest(0, least(1, det)) * coalesce(0.5 + 0.5 * greatest(0, least(1, front)), 1) END AS score FROM f)
SELECT l_orderkey, l_partkey AS cover, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, area DESC, l_partkey, l_linenumber) AS r FROM s) WHERE r = 1""")
def hybrid_cover(t):
    from glimmer.operators.sequences import best_row

    aesthetic = F.when(F.col("l_partkey") % 9 != 0, 1 + F.col("l_discount") * 80)
    quality = face_quality(F.col("l_tax") * 10, F.when(F.col("l_partkey") % 4 != 0, F.col("l_discount") * 10), F.lit(None).cast("double"))
    area = F.col("l_quantity") * 1000
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", area.alias("area"), cover_score(aesthetic, area, F.lit(400), F.lit(300), quality).alias("score"))
    best = best_row(rows, ["l_orderkey"], [F.desc(F.round("score", 9)), F.desc("area"), F.asc("l_partkey"), F.asc("l_linenumber")])
    return best.select("l_orderkey", F.col("l_partkey").alias("cover"), F.round("score", 6).alias("score"))


@query("AG-27 VEC-23", f"""WITH {_V}, {_PAIRS}, inside AS (SELECT x.label, d FROM pairs JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b WHERE x.label = y.label)
SELECT label, round(min(d), 6) AS low, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS high, round(avg(d), 6) AS mean FROM inside GROUP BY 1""")
def distance_stats(t):
    rows = t("embeddings")
    found = distance_quantiles(rows, "vec_id", "embedding", "label", [0.1, 0.5, 0.9])
    q = F.col("q")
    return found.select("label", *[F.round(c, 6).alias(n) for n, c in (("low", F.col("low")), ("p10", q[0]), ("median", q[1]), ("p90", q[2]), ("high", F.col("high")), ("mean", F.col("mean")))])


@query("VEC-23", f"WITH {_V}, {_PAIRS} SELECT id AS vec_id, round(min(d), 6) AS nearest FROM (SELECT a AS id, d FROM pairs UNION ALL SELECT b, d FROM pairs) GROUP BY 1")
def nearest_neighbor_distance(t):
    size = norm(F.col("embedding"))
    rows = t("embeddings").withColumn("n", size).select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("embedding"))
    near = nearest_each(rows, rows, "vec_id", "embedding", 2).filter("query <> neighbor")
    return near.groupBy(F.col("query").alias("vec_id")).agg(F.round(F.min(F.col("distance") * F.col("distance") / 2), 6).alias("nearest"))


#: All radii of a sweep: the reference's, 0.40 to 0.60, and on to 0.72, as the cliff moves down as rows grow in number.
SWEEP = tuple(e / 100 for e in range(40, 73, 2))


@query("", " UNION ALL ".join(
    "SELECT * FROM (" + _COMPONENTS.format(e=e) + f" SELECT {e}::DOUBLE AS epsilon, count(DISTINCT cluster)::BIGINT AS clusters, max(n)::BIGINT AS largest, round(avg(pure), 6) AS purity FROM (SELECT cluster, count(*) AS n, max(k) * 1.0 / count(*) AS pure FROM (SELECT cluster, label, count(*) OVER (PARTITION BY cluster, label) AS k FROM c JOIN v USING (vec_id)) GROUP BY 1))" for e in SWEEP))
def sweep_eval(t):
    """For each radius: clusters, rows of the largest, and purity against the labels, from where few rows meet to beyond the cliff."""
    rows, labels, found = t("embeddings"), None, None
    links = written(similar_links(rows, "vec_id", "embedding", list(SWEEP), nested=True), "links")
    for k in range(len(SWEEP)):
        more = links.filter(F.col("radius") == k).select("a", "b")
        labels = linked(more if labels is None else more.union(labels))  # what a smaller radius connects stays so
        found = labels.withColumn("radius", F.lit(k)) if found is None else found.unionByName(labels.withColumn("radius", F.lit(k)))
    each = rows.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), "label", F.explode(F.sequence(F.lit(0), F.lit(len(SWEEP) - 1))).alias("radius"))
    of = each.join(found, ["radius", "id"], "left").withColumn("component", F.coalesce("component", "id"))
    kinds = of.groupBy("radius", "component", "label").agg(F.count("*").alias("k")).groupBy("radius", "component").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("pure"))
    sums = kinds.groupBy("radius").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.round(F.avg("pure"), 6).alias("purity"))
    radii = rows.sparkSession.range(len(SWEEP)).select(F.col("id").cast("int").alias("radius"))  # also where there are no rows
    return radii.join(sums, "radius", "left").select(F.get(F.array(*map(F.lit, SWEEP)), F.col("radius")).alias("epsilon"), F.coalesce("clusters", F.lit(0).cast("long")).alias("clusters"), "largest", "purity")


@query("VEC-20 AG-29", """
WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS i, l_discount AS x, l_linenumber / 10.0 AS y, 0.5 + l_tax AS w, 0.03 + (l_partkey % 3) / 100.0 AS h, (l_suppkey % 5) / 100.0 AS k FROM lineitem),
f AS (SELECT doc, w * h AS area, abs(degrees(atan2(k, w))) AS a, h, x AS l, x + w / 2 AS c FROM b)
SELECT doc, count(*)::BIGINT AS line_count, round(least(sum(area), 1), 6) AS coverage, round(CASE WHEN count(*) < 3 THEN 0.5 ELSE (greatest(0, least(1, 1 - avg(a) / 15)) + greatest(0, least(1, 1 - stddev_pop(h) / avg(h) / 0.75)) + greatest(0, least(1, 1 - least(stddev_pop(l), stddev_pop(c)) / 0.15))) / 3 END, 5) AS regularity
FROM f GROUP BY 1""")
def line_layout(t):
    from glimmer.functions.scalars import quad_area
    from glimmer.operators.vectors import line_regularity

    x, y, w, h, k = F.col("l_discount"), F.col("l_linenumber") / 10.0, 0.5 + F.col("l_tax"), 0.03 + (F.col("l_partkey") % 3) / 100.0, (F.col("l_suppkey") % 5) / 100.0
    quads = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.array(x, y, x + w, y + k, x + w, y + k + h, x, y + h).alias("box"))
    sums = quads.groupBy("doc").agg(F.count("*").alias("line_count"), F.round(F.least(F.sum(quad_area(F.col("box"))), F.lit(1.0)), 6).alias("coverage"))
    return sums.join(line_regularity(quads, ["doc"]).select("doc", F.round("regularity", 5).alias("regularity")), "doc")
