"""Queries on ``embeddings``: a vector's label is its node; vectors whose id is divisible by 50 are queries, and each is
compared with all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import assets, duplicates, retrieval as R

from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

PAIRS = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    q AS (SELECT * FROM e WHERE vec_id % 50 = 0), g AS (SELECT * FROM e),
    p AS (SELECT q.vec_id AS qid, q.label AS q_label, g.vec_id AS gid, g.label AS g_label,
                 list_cosine_similarity(q.v, g.v) AS score FROM q, g WHERE q.vec_id <> g.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM p)"""


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, sf_dir, "embeddings")
    query = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("q_label"))
    return query, e.select(F.col("vec_id").alias("gid"), F.col("embedding").alias("vec"), F.col("label").alias("g_label"))


def ranked(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine") -> DataFrame:
    q, g = split(spark, sf_dir)
    rows = R.scored_pairs(q, g, k, metric)
    return rows.join(q.select("qid", "q_label"), "qid").join(g.select("gid", "g_label"), "gid")


@register(f"WITH {PAIRS} SELECT qid, gid, rank, round(greatest(0, 3 - sqrt(list_sum(list_transform(list_zip(qv, gv), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))), 6) AS score FROM (SELECT q.vec_id AS qid, g.vec_id AS gid, q.v AS qv, g.v AS gv, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, g.v), g.vec_id) AS rank FROM q, g WHERE q.vec_id <> g.vec_id) WHERE rank <= 10")
def t1_vector_topk(spark, sf_dir):
    rows = ranked(spark, sf_dir, 10, "l2")
    return rows.select("qid", "gid", "rank", F.round(V.similarity(-F.col("score"), "text"), 6).alias("score"))


@register(f"WITH {PAIRS} SELECT qid, gid, rank, round(score, 6) AS score FROM r")
def t4_full_ranking(spark, sf_dir):
    return R.scored_pairs(*split(spark, sf_dir), None).select("qid", "gid", "rank", F.round("score", 6).alias("score"))


@register(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, g_label ORDER BY score DESC) AS k FROM p)
    SELECT qid, g_label, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(avg(score) FILTER (k <= 3), 6) AS top3_mean,
           round(0.7 * max(score) + 0.3 * avg(score) FILTER (k <= 3), 6) AS hybrid_score FROM n GROUP BY ALL""")
def a4_node_scores(spark, sf_dir):
    out = R.label_scores(*split(spark, sf_dir))
    return out.select("qid", "g_label", *[F.round(c, 6).alias(c) for c in ("max_score", "mean_score", "top3_mean", "hybrid_score")])


CENTROIDS = """u AS (SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM e),
    m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY ALL)"""


@register(f"WITH {PAIRS}, {CENTROIDS} SELECT q.vec_id AS qid, c.label, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM q, c")
def a5_centroid_scores(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    c = R.centroids(e, "label", "embedding").withColumnRenamed("centroid", "vec").withColumn("gid", -1 - F.col("label").cast("long"))
    q, _ = split(spark, sf_dir)
    # Numbers below 0 for labels: no centroid is a query itself.
    return R.scored_pairs(q, c, None).select("qid", (-1 - F.col("gid")).cast("int").alias("label"), F.round("score", 6).alias("score"))


@register(f"""WITH {PAIRS}, h AS (SELECT qid, min(rank) FILTER (q_label = g_label) AS hit FROM r GROUP BY ALL)
    SELECT count(*) AS cases, avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0 END) AS recall_5,
           avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0 END) AS recall_10, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM h""")
def a17_recall_mrr(spark, sf_dir):
    return R.topk_metrics(R.first_hits(*split(spark, sf_dir)), [], "hit", [1, 5, 10]).withColumn("mrr", F.round("mrr", 6))


@register(f"WITH {PAIRS} SELECT qid, min(rank) FILTER (q_label = g_label) AS hit FROM r GROUP BY ALL")
def w3_first_hit_rank(spark, sf_dir):
    return R.first_hits(*split(spark, sf_dir)).select("qid", "hit")


NODES = f"""{PAIRS}, s AS (SELECT qid, q_label, g_label, round(max(score), 2) AS s FROM p GROUP BY ALL),
    k AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY s DESC) AS node_rank, count(*) OVER (PARTITION BY qid, s) AS tied FROM s)"""


def node_ranks(spark, sf_dir):
    best = R.label_scores(*split(spark, sf_dir)).select("qid", "q_label", "g_label", F.round("max_score", 2).alias("s"))
    return R.tolerant_ranks(best, ["qid"], "s", "g_label").withColumnRenamed("rank", "node_rank")


@register(f"WITH {NODES} SELECT qid, g_label, s, node_rank, CASE WHEN tied > 1 THEN 'tied' ELSE 'unique' END AS tie_status, tied AS tie_size FROM k")
def w2_rank_with_ties(spark, sf_dir):
    return node_ranks(spark, sf_dir).select("qid", "g_label", "s", "node_rank", "tie_status", F.size("tie_group").cast("long").alias("tie_size"))


@register(f"""WITH {NODES}, h AS (SELECT qid, max(node_rank) FILTER (q_label = g_label) AS own, max(tied) FILTER (q_label = g_label) AS own_tied FROM k GROUP BY ALL)
    SELECT count(*) AS cases, avg(CASE WHEN own = 1 AND own_tied = 1 THEN 1.0 ELSE 0 END) AS strict_top1, avg(CASE WHEN own <= 1 THEN 1.0 ELSE 0 END) AS tie_aware_top1,
           avg(CASE WHEN own_tied > 1 THEN 1.0 ELSE 0 END) AS tie_rate, avg(CASE WHEN own IS NULL THEN 1.0 ELSE 0 END) AS null_rate FROM h""")
def a18_node_metrics(spark, sf_dir):
    k = node_ranks(spark, sf_dir)
    own = F.col("q_label") == F.col("g_label")
    h = k.groupBy("qid").agg(F.max(F.when(own, F.col("node_rank"))).alias("own"), F.max(F.when(own, F.size("tie_group"))).alias("tied"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return h.agg(
        F.count(F.lit(1)).alias("cases"), share((F.col("own") == 1) & (F.col("tied") == 1)).alias("strict_top1"), share(F.col("own") <= 1).alias("tie_aware_top1"),
        share(F.col("tied") > 1).alias("tie_rate"), share(F.col("own").isNull()).alias("null_rate"),
    )


@register(f"""WITH {PAIRS}, x AS (SELECT q.vec_id AS qid, q.label AS ql, g.vec_id AS gid, g.label AS gl, list_cosine_similarity(q.v[1:32], g.v[1:32]) AS a, list_cosine_similarity(q.v[33:64], g.v[33:64]) AS b FROM q, g WHERE q.vec_id <> g.vec_id),
    w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha), z AS (SELECT alpha, qid, ql, gl, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * a + (1 - alpha) * b, 9) DESC, gid) AS rank FROM x, w),
    h AS (SELECT alpha, qid, min(rank) FILTER (ql = gl) AS hit FROM z GROUP BY ALL)
    SELECT alpha, count(*) AS cases, avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0 END) AS recall_5, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM h GROUP BY ALL""")
def a19_alpha_sweep(spark, sf_dir):
    halves = [rows.withColumns({"one": F.slice("vec", 1, 32), "two": F.slice("vec", 33, 32)}) for rows in split(spark, sf_dir)]
    hits = R.first_hits(*halves, ["one", "two"], [(x, 1 - x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    return R.topk_metrics(hits, ["alpha"], "hit", [1, 5]).withColumn("mrr", F.round("mrr", 6))


@register("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 > 0 AND vec_id % 4 > 0), p AS (SELECT q.vec_id AS qid, q.label AS ql, g.vec_id AS gid, g.label AS gl, 0.6 * list_cosine_similarity(q.v[1:32], g.v[1:32]) + 0.4 * list_cosine_similarity(q.v[33:64], g.v[33:64]) AS s
        FROM e q, e g WHERE q.vec_id % 50 = 25 AND q.vec_id <> g.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, gid) AS rank FROM p) SELECT qid, min(rank) FILTER (ql = gl) AS hit FROM r GROUP BY qid""")
def j22_common_assets(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    left = e.where("vec_id % 3 > 0").select("vec_id", "label", F.slice("embedding", 1, 32).alias("one"))
    right = e.where("vec_id % 4 > 0").select("vec_id", F.slice("embedding", 33, 32).alias("two"))
    both = R.common_vectors(left, right, "vec_id")
    queries = both.where("vec_id % 50 = 25").select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"), "one", "two")
    gallery = both.select(F.col("vec_id").alias("gid"), F.col("label").alias("g_label"), "one", "two")
    return R.first_hits(queries, gallery, ["one", "two"], [(0.6, 0.4)]).select("qid", "hit")


@register("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), o AS (SELECT v FROM e WHERE vec_id = 7)
    SELECT label, round(min(list_distance(e.v, o.v)), 6) AS distance, count(*) AS n FROM e, o GROUP BY ALL""")
def a3_group_min_distance(spark, sf_dir):
    return nearest_by_label(spark, sf_dir)


def nearest_by_label(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    # One query vector, so its side is one row.
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return e.crossJoin(F.broadcast(one)).groupBy("label").agg(F.round(F.min(V.l2(F.col("embedding"), F.col("q"))), 6).alias("distance"), F.count(F.lit(1)).alias("n"))


@register("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), o AS (SELECT v FROM e WHERE vec_id = 7)
    SELECT vec_id, round(greatest(0, 1 - list_distance(e.v, o.v) / 2), 6) AS score FROM e, o ORDER BY list_distance(e.v, o.v), vec_id LIMIT 20""")
def t3_image_evidence_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    rows = e.crossJoin(F.broadcast(one)).select("vec_id", V.l2(F.col("embedding"), F.col("q")).alias("d")).orderBy("d", "vec_id").limit(20)
    return rows.select("vec_id", F.round(V.similarity(F.col("d"), "image"), 6).alias("score"))


@register(f"WITH {PAIRS} SELECT qid, gid AS nearest, q_label = g_label AS matched FROM r WHERE rank = 1")
def t2_nearest_verification(spark, sf_dir):
    return ranked(spark, sf_dir, 1).select("qid", F.col("gid").alias("nearest"), (F.col("q_label") == F.col("g_label")).alias("matched"))


@register(f"""WITH {PAIRS}, m AS (SELECT qid, g_label, max(score) AS s FROM p GROUP BY ALL) SELECT qid, g_label, round(s, 6) AS s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, g_label) AS node_rank FROM m""")
def w4_first_occurrence_rank(spark, sf_dir):
    best = R.label_scores(*split(spark, sf_dir)).select("qid", "g_label", F.col("max_score").alias("s"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("s"), "g_label"))
    return best.select("qid", "g_label", rank.alias("node_rank"), F.round("s", 6).alias("s"))


@register(f"""WITH {PAIRS} SELECT q_label % 2 AS split, count(*) AS cases, count(*) FILTER (top1) AS top1, count(*) FILTER (top3) AS top3
    FROM (SELECT qid, q_label, bool_or(rank = 1 AND q_label = g_label) AS top1, bool_or(rank <= 3 AND q_label = g_label) AS top3 FROM r GROUP BY ALL) GROUP BY ALL""")
def a20_split_hits(spark, sf_dir):
    hits = ranked(spark, sf_dir, 3).groupBy("qid", "q_label").agg(F.min(F.when(F.col("q_label") == F.col("g_label"), F.col("rank"))).alias("hit"))
    return hits.groupBy((F.col("q_label") % 2).alias("split")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("hit") == 1).alias("top1"), F.count_if(F.col("hit") <= 3).alias("top3"))


@register(f"""WITH {PAIRS}, f AS (SELECT qid, min(rank) FILTER (q_label = g_label) AS hit FROM r GROUP BY ALL),
    k AS (SELECT qid, unnest(list_filter([CASE WHEN hit IS NULL OR hit > 1 THEN 'image_top1' END, CASE WHEN hit IS NULL OR hit > 5 THEN 'image_top5' END], lambda x: x IS NOT NULL)) AS failure FROM f)
    SELECT failure, k.qid, list(gid ORDER BY rank) AS top FROM k JOIN r ON k.qid = r.qid AND rank <= 5 GROUP BY ALL""")
def f19_failure_cases(spark, sf_dir):
    q, g = split(spark, sf_dir)
    top = F.transform(F.sort_array(F.collect_list(F.struct("rank", "gid"))), lambda x: x["gid"]).alias("top")
    cases = R.first_hits(q, g).select("qid", "hit").join(R.scored_pairs(q, g, 5).groupBy("qid").agg(top), "qid")
    hit = F.coalesce("hit", F.lit(1 << 30))
    failures = F.array_compact(F.array(F.when(hit > 1, "image_top1"), F.when(hit > 5, "image_top5")))
    return cases.select(F.explode(failures).alias("failure"), "qid", "top")


@register("SELECT vec_id, '[' || list_aggregate(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), 'string_agg', ',') || ']' AS literal FROM embeddings")
def s15_vector_literal(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", V.literal(F.col("embedding")).alias("literal"))


@register("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total, len(v) AS dim FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def s14_normalize(spark, sf_dir):
    v = V.normalized(F.col("embedding"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"), F.size("embedding").cast("long").alias("dim"))


HASHES = "h AS (SELECT vec_id, label, list_aggregate(list_transform(v, lambda x: CASE WHEN x >= list_sum(v) / len(v) THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"


@register(f"WITH {HASHES} SELECT vec_id, bits FROM h")
def h38_average_hash(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", V.average_hash(F.col("embedding")).alias("bits"))


#: Every vector's hash, and one more asset of the next node whose first id % 9 bits are the other way.
ASSETS = f"""{HASHES}, h2 AS (SELECT vec_id * 2 AS id, label, bits FROM h UNION ALL SELECT vec_id * 2 + 1, (label + vec_id % 3) % 10, translate(bits[1 : vec_id % 9], '01', '10') || bits[vec_id % 9 + 1 : 64] FROM h)"""
NEAR = f"{ASSETS}, d AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same_label, hamming(a.bits, b.bits) AS distance FROM h2 a JOIN h2 b ON a.id < b.id WHERE hamming(a.bits, b.bits) <= 5)"


def hashed_assets(spark, sf_dir):
    h = t(spark, sf_dir, "embeddings").select("vec_id", "label", V.average_hash(F.col("embedding")).alias("bits"))
    n = (F.col("vec_id") % 9).cast("int")
    flipped = F.concat(F.translate(F.substring("bits", 1, n), "01", "10"), F.substring("bits", n + 1, F.lit(64)))
    return h.select((F.col("vec_id") * 2).alias("id"), "label", "bits").unionByName(h.select((F.col("vec_id") * 2 + 1).alias("id"), ((F.col("label") + F.col("vec_id") % 3) % 10).cast("int").alias("label"), flipped.alias("bits")))


def near(spark, sf_dir):
    h = hashed_assets(spark, sf_dir)
    pairs = duplicates.hamming_pairs(h.select("id", "bits"), 5)
    one, two = (h.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").withColumn("same_label", F.col("label_a") == F.col("label_b"))


@register(f"WITH {NEAR} SELECT a, b, distance, CASE WHEN same_label THEN 'same_node_duplicate_keep_one' ELSE 'cross_node_near_duplicate_manual_review' END AS action FROM d")
def j12_near_duplicate_pairs(spark, sf_dir):
    return near(spark, sf_dir).select("a", "b", F.col("distance").cast("long").alias("distance"), assets.pair_action(F.col("same_label"), F.lit(None), F.lit(None), F.lit(None), F.col("distance")).alias("action"))


@register(f"WITH {NEAR} SELECT a, list(b ORDER BY b) AS members FROM d GROUP BY ALL")
def j13_one_sided_groups(spark, sf_dir):
    return near(spark, sf_dir).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("members"))


@register(f"""WITH RECURSIVE {NEAR}, s AS (SELECT a AS x, b AS y FROM d UNION SELECT b, a FROM d), c(x, root) AS (SELECT x, x FROM s UNION SELECT s.y, c.root FROM c JOIN s ON s.x = c.x)
    SELECT x AS id, min(root) AS component FROM c GROUP BY ALL""")
def u7_connected_components(spark, sf_dir):
    return duplicates.components(near(spark, sf_dir).select("a", "b"))


@register(f"""WITH RECURSIVE {NEAR}, s AS (SELECT a AS x, b AS y FROM d UNION SELECT b, a FROM d), c(x, root) AS (SELECT x, x FROM s UNION SELECT s.y, c.root FROM c JOIN s ON s.x = c.x),
    m AS (SELECT x AS id, min(root) AS component FROM c GROUP BY ALL), n AS (SELECT component, count(*) AS size FROM m GROUP BY ALL)
    SELECT component, size, printf('near_cluster_%04d', row_number() OVER (ORDER BY size DESC, component)) AS cluster FROM n""")
def w13_cluster_ids(spark, sf_dir):
    return duplicates.cluster_names(duplicates.components(near(spark, sf_dir).select("a", "b")))
