"""Catalogue: vector and clustering jobs over ``embeddings`` (64 floats per row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import cluster as CL
from postlens.operators import hierarchy as HI
from postlens.operators import vectors as V
from postlens.plans.registry import register
from postlens.sources.tables import posts_from_documents, table

K = 5


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_PAIRS = f"""
{_E},
pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbor,
         sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
nn AS (SELECT vec_id, neighbor, distance,
              row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank
       FROM pairs QUALIFY rank <= {K})
"""


@register("unit_vectors", f"""
WITH {_E}
SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS unit FROM e
""")
def unit_vectors(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", V.unit(V.as_double_array("embedding")).alias("unit"))


@register("knn_exact", f"WITH {_PAIRS} SELECT vec_id, neighbor, distance, rank FROM nn")
def knn_exact(spark, sf_dir):
    return V.knn(_emb(spark, sf_dir), "vec_id", "embedding", K)


@register("kdist_elbow", f"""
WITH {_PAIRS},
kd AS (SELECT vec_id, distance AS kdist FROM nn WHERE rank = {K}),
r AS (SELECT kdist, CAST(row_number() OVER (ORDER BY kdist, vec_id) - 1 AS DOUBLE) AS x,
             count(*) OVER () AS n FROM kd)
SELECT regr_slope(kdist, x) FILTER (WHERE x < floor(n * 0.8)) AS m1,
       regr_slope(kdist, x) FILTER (WHERE x >= floor(n * 0.9)) AS m2,
       regr_slope(kdist, x) FILTER (WHERE x >= floor(n * 0.9))
         - regr_slope(kdist, x) FILTER (WHERE x < floor(n * 0.8)) AS sharpness
FROM r
""")
def kdist_elbow(spark, sf_dir):
    nn = V.knn(_emb(spark, sf_dir), "vec_id", "embedding", K)
    return V.elbow_sharpness(V.kth_distance(nn, "vec_id", K), "vec_id")


@register("twonn_dim", f"""
WITH {_PAIRS},
r AS (SELECT vec_id, max(CASE WHEN rank = 1 THEN distance END) AS r1,
             max(CASE WHEN rank = 2 THEN distance END) AS r2 FROM nn GROUP BY vec_id),
m AS (SELECT vec_id, r2 / r1 AS mu FROM r WHERE r1 > 0),
o AS (SELECT mu, row_number() OVER (ORDER BY mu, vec_id) - 1 AS i, count(*) OVER () AS n FROM m),
k AS (SELECT ln(mu) AS x, -ln(1.0 - i / n) AS y, n FROM o WHERE i < floor(n * 0.9)),
d AS (SELECT sum(x * y) / sum(x * x) AS dimension, first(n) AS n FROM k)
SELECT dimension, n, CAST(least(greatest(round_even(dimension, 0), 5.0), 50.0) AS INTEGER) AS intrinsic_dim FROM d
""")
def twonn_dim(spark, sf_dir):
    nn = V.knn(_emb(spark, sf_dir), "vec_id", "embedding", 2)
    return V.twonn_dimension(nn, "vec_id")


@register("cosine_keywords", f"""
WITH {_E},
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
c AS (SELECT list(m ORDER BY i) AS centroid FROM (SELECT i, avg(x) AS m FROM u GROUP BY i)),
s AS (SELECT vec_id,
             list_sum(list_transform(list_zip(v, centroid), lambda z: z[1] * z[2]))
             / (sqrt(list_sum(list_transform(v, lambda y: y * y)))
                * sqrt(list_sum(list_transform(centroid, lambda y: y * y)))) AS similarity
      FROM e, c)
SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id ASC LIMIT 50
""")
def cosine_keywords(spark, sf_dir):
    return V.centroid_similarity(_emb(spark, sf_dir), "vec_id", "embedding", 50)


@register("reduce_dims")
def reduce_dims(spark, sf_dir):
    return V.reduce_dims(_emb(spark, sf_dir), "embedding", 10).select("vec_id", "reduced")


@register("kmeans_search")
def kmeans_search(spark, sf_dir):
    scores, _, _ = V.kmeans_search(_emb(spark, sf_dir), "embedding")
    return scores


def _density_sql(where: str) -> str:
    """CTEs of H5 on the rows of ``embeddings`` that ``where`` names: nn, core, eps, lab, mx."""
    pairs = _PAIRS.replace("FROM embeddings)", f"FROM embeddings WHERE {where})").replace(f"rank <= {K}", "rank <= 4")
    return f"""
WITH RECURSIVE {pairs},
core AS (SELECT vec_id, distance AS core FROM nn WHERE rank = 4),
eps AS (SELECT quantile_disc(core, 0.6) AS eps FROM core),
ed AS (SELECT n.vec_id AS a, n.neighbor AS b, greatest(c.core, d.core, n.distance) AS m
       FROM nn n JOIN core c ON c.vec_id = n.vec_id JOIN core d ON d.vec_id = n.neighbor),
eb AS (SELECT a, b FROM ed, eps WHERE m <= eps UNION SELECT b, a FROM ed, eps WHERE m <= eps),
reach(v, c) AS (SELECT vec_id, vec_id FROM core, eps WHERE core <= eps
                UNION SELECT eb.b, reach.c FROM reach JOIN eb ON eb.a = reach.v),
comp AS (SELECT v, min(c) AS comp FROM reach GROUP BY v),
big AS (SELECT comp FROM comp GROUP BY comp HAVING count(*) >= 5),
num AS (SELECT comp, CAST(row_number() OVER (
          ORDER BY ('0x' || substr(md5('42:' || CAST(comp AS VARCHAR)), 1, 15))::BIGINT, comp) - 1 AS INTEGER) AS cluster FROM big),
lab AS (SELECT v AS vec_id, cluster FROM comp JOIN num USING (comp)),
mx AS (SELECT cluster, min(core) AS cmin FROM lab JOIN core USING (vec_id) GROUP BY cluster),
model AS (SELECT e.vec_id, e.v, coalesce(cluster, -1) AS cluster,
                 CASE WHEN cluster IS NULL THEN 0.0 WHEN core = 0 THEN 1.0 ELSE least(1.0, cmin / core) END AS probability,
                 core, (SELECT eps FROM eps) AS eps
          FROM e LEFT JOIN core USING (vec_id) LEFT JOIN lab USING (vec_id) LEFT JOIN mx USING (cluster))
"""


@register("density_cluster")
def density_hierarchy(spark, sf_dir):
    """H5: clusters of the condensed tree; no density is given."""
    return HI.density_clusters(_emb(spark, sf_dir), "vec_id", "embedding", min_samples=5, min_cluster_size=5)


@register("cluster_predict")
def hierarchy_predict(spark, sf_dir):
    """H9: the tree of the even-numbered half places the odd-numbered half."""
    emb = _emb(spark, sf_dir)
    model = HI.hierarchy(emb.where(F.col("vec_id") % 2 == 0), "vec_id", "embedding", 5, 5)
    return HI.predict(model, emb.where(F.col("vec_id") % 2 == 1), "vec_id", "embedding", 5)


@register("cluster_validity")
def hierarchy_dbcv(spark, sf_dir):
    """H7 (dbcv) of the given labels as clusters."""
    emb = _emb(spark, sf_dir)
    return HI.dbcv(emb.select("vec_id", F.col("label").alias("cluster")), emb, "vec_id", "embedding")


@register("cluster_stability")
def hierarchy_validity(spark, sf_dir):
    """H7 (relative validity) of the clusters of the condensed tree."""
    return HI.relative_validity(HI.hierarchy(_emb(spark, sf_dir), "vec_id", "embedding", 5, 5))


@register("density_cluster_eps", _density_sql("true") + "SELECT vec_id, cluster, probability, core, eps FROM model")
def density_cluster(spark, sf_dir):
    return CL.density_cluster(_emb(spark, sf_dir), "vec_id", "embedding", min_samples=5, min_cluster_size=5,
                              eps_quantile=0.6)


@register("reduce_cluster")
def reduce_cluster(spark, sf_dir):
    """H2, H3 twice, H5: the chain of the study."""
    return CL.reduce_and_cluster(_emb(spark, sf_dir), "vec_id", "embedding", min_samples=5, min_cluster_size=5, eps_quantile=0.6)


@register("cluster_predict_eps", _density_sql("vec_id % 2 = 0") + """
, o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
near AS (SELECT o.vec_id, m.cluster, m.probability, m.eps,
                sqrt(list_sum(list_transform(list_zip(o.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance, m.vec_id AS nb
         FROM o LEFT JOIN model m ON m.cluster >= 0
         QUALIFY row_number() OVER (PARTITION BY o.vec_id ORDER BY distance, nb) = 1)
SELECT vec_id, CASE WHEN distance <= eps THEN cluster ELSE -1 END AS cluster,
       CASE WHEN distance <= eps THEN probability ELSE 0.0 END AS probability FROM near
""")
def cluster_predict(spark, sf_dir):
    """H9: cluster the even-numbered half, then place the odd-numbered half."""
    emb = _emb(spark, sf_dir)
    ref = emb.where(F.col("vec_id") % 2 == 0)
    new = emb.where(F.col("vec_id") % 2 == 1)
    model = CL.density_cluster(ref, "vec_id", "embedding", 5, 5, eps_quantile=0.6)
    return CL.predict_clusters(model, ref, new, "vec_id", "embedding")


_VALIDITY_SQL = f"""
WITH {_PAIRS.replace(f"rank <= {K}", "rank <= 4")},
core AS (SELECT vec_id, distance AS core FROM nn WHERE rank = 4),
lb AS (SELECT vec_id, label FROM embeddings),
ed AS (SELECT n.vec_id AS a, n.neighbor AS b, greatest(c.core, d.core, n.distance) AS m
       FROM nn n JOIN core c ON c.vec_id = n.vec_id JOIN core d ON d.vec_id = n.neighbor),
kl AS (SELECT x.label AS ka, y.label AS kb, m FROM (SELECT a, b, m FROM ed UNION ALL SELECT b, a, m FROM ed) t
       JOIN lb x ON x.vec_id = t.a JOIN lb y ON y.vec_id = t.b),
"""


@register("cluster_validity_edges", _VALIDITY_SQL + """
sp AS (SELECT ka AS label, max(m) FILTER (WHERE ka = kb) AS sparse FROM kl GROUP BY ka),
fr AS (SELECT p.vec_id, p.neighbor, p.distance, x.label FROM pairs p
       JOIN lb x ON x.vec_id = p.vec_id JOIN lb y ON y.vec_id = p.neighbor WHERE x.label <> y.label
       QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY p.distance, p.neighbor) = 1),
se AS (SELECT fr.label, min(greatest(c.core, d.core, fr.distance)) AS sep
       FROM fr JOIN core c ON c.vec_id = fr.vec_id JOIN core d ON d.vec_id = fr.neighbor GROUP BY fr.label),
sz AS (SELECT label, count(*) AS n FROM lb GROUP BY label)
SELECT sum((sep - coalesce(sparse, 0)) / greatest(sep, coalesce(sparse, 0)) * n / (SELECT count(*) FROM lb)) AS validity,
       count(*) AS n_clusters
FROM sz JOIN sp USING (label) JOIN se USING (label)
""")
def cluster_validity(spark, sf_dir):
    """H7 (dbcv) of the given labels as clusters."""
    emb = _emb(spark, sf_dir).withColumnRenamed("label", "cluster")
    nn = V.knn(emb, "vec_id", "embedding", 4)
    return CL.validity(emb, nn, "vec_id", 5, "dbcv", emb.drop("cluster"), "embedding")


@register("cluster_stability_edges", _VALIDITY_SQL + """
st AS (SELECT ka AS label, max(m) FILTER (WHERE ka = kb) AS sparse, min(m) FILTER (WHERE ka <> kb) AS sep FROM kl GROUP BY ka),
w AS (SELECT label, coalesce(sparse, 0) AS sparse, coalesce(sep, (SELECT 2 * max(m) FROM kl)) AS sep FROM st),
sz AS (SELECT label, count(*) AS n FROM lb GROUP BY label)
SELECT sum((sep - sparse) / greatest(sep, sparse) * n / (SELECT count(*) FROM lb)) AS validity, count(*) AS n_clusters
FROM sz JOIN w USING (label)
""")
def cluster_stability(spark, sf_dir):
    """H7 (relative validity) of the given labels as clusters."""
    emb = _emb(spark, sf_dir).withColumnRenamed("label", "cluster")
    nn = V.knn(emb, "vec_id", "embedding", 4)
    return CL.validity(emb, nn, "vec_id", 5, "stability")


@register("cluster_param_search")
def cluster_param_search(spark, sf_dir):
    """H6, heuristic mode over its whole range."""
    scores, _, _ = CL.search_parameters(_emb(spark, sf_dir), "vec_id", "embedding", "heuristic")
    return scores


@register("cluster_param_mix")
def cluster_param_mix(spark, sf_dir):
    return CL.search_parameters(_emb(spark, sf_dir), "vec_id", "embedding", "mix")[0]


@register("cluster_param_dbcv")
def cluster_param_dbcv(spark, sf_dir):
    return CL.search_parameters(_emb(spark, sf_dir), "vec_id", "embedding", "dbcv")[0]


@register("cluster_param_stability")
def cluster_param_stability(spark, sf_dir):
    return CL.search_parameters(_emb(spark, sf_dir), "vec_id", "embedding", "stability")[0]


@register("embed_text")
def embed_text(spark, sf_dir):
    return V.embed_text(posts_from_documents(spark, sf_dir), "content", 256).select("tweet_id", "embedding")
