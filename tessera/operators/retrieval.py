"""Vector and keyword retrieval, merging and diversity ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import texts, vectors
from tessera.sources import stages

from . import vector_index

#: Texts that stand for no content.
PLACEHOLDERS = ["暂无内容", "暂无", "无", "null"]


def met_in_blocks(
    queries: DataFrame, gallery: DataFrame, reduce: Callable[..., pd.DataFrame], schema: str, vec: Sequence[str] = ("vec",), of_query: Sequence[str] = (), of_gallery: Sequence[str] = (), metric: str = "cosine"
) -> DataFrame:
    """What ``reduce(qids, gids, [scores by each vector], query columns, gallery columns)`` makes of every meeting of a block of
    ``queries`` (qid, *vec, *of_query) with one of the ``gallery`` (gid, *vec, *of_gallery).  No vector meets itself: the score of a
    gid with its equal qid is -inf."""
    index = vector_index.build(gallery, "gid", vec, of_gallery, metric, cells=1)
    return vector_index.meet(queries, "qid", index, vector_index.everywhere, reduce, schema, of_query)


def scored_pairs(queries: DataFrame, gallery: DataFrame, k: int | None, metric: str = "cosine") -> DataFrame:
    """(qid, gid, score, rank): the gallery ranked for each query by ``metric`` (``cosine``, ``dot`` or ``l2``), best
    first and ties by gid; the first ``k`` of them, or all.

    ``queries`` has (qid, vec), ``gallery`` (gid, vec).  The first ``k`` by a metric of distances come from an exact index; by
    another one a meeting of blocks keeps its own best ``k``.  All are ranked where a group of queries has met every block."""
    if not k:
        return vector_index.ranked_all(queries, gallery, metric)
    if metric != "dot":
        return vector_index.top_k(queries, gallery, k, metric)

    def best(qid, gid, every, _, __):  # noqa: ANN001, ANN202
        top = min(k, len(gid))
        order = np.stack([np.lexsort((gid, -s))[:top] for s in every[0]])
        out = pd.DataFrame({"qid": np.repeat(qid, top), "gid": gid[order].ravel(), "score": np.take_along_axis(every[0], order, 1).ravel()})
        return out[np.isfinite(out["score"])]

    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "gid"))
    return met_in_blocks(queries, gallery, best, "qid long, gid long, score double", metric=metric).withColumn("rank", rank).where(F.col("rank") <= k)


def common_vectors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of two models' vectors for the assets that both have; of assets that repeat in either, the rows meet each other."""
    return left.where(F.col(key).isNotNull()).join(right, key)


def label_scores(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(qid, q_label, g_label, max_score, mean_score, top3_mean, hybrid_score) of cosines, over the gallery's vectors of each label:
    the last is 0.7 of the best with 0.3 of the mean of the best three.  A meeting of blocks keeps a row per query and label."""

    def per_label(qid, gid, every, of_query, of_gallery):  # noqa: ANN001, ANN202
        label, out = of_gallery["g_label"], []
        for name in np.unique(label[~np.isnan(label)]):
            s = -np.sort(-every[0][:, label == name], axis=1)
            finite = np.isfinite(s)
            n = finite.sum(axis=1)
            some = n > 0
            out.append(pd.DataFrame({"qid": qid[some], "q_label": of_query["q_label"][some], "g_label": name, "n": n[some], "total": np.where(finite, s, 0).sum(axis=1)[some], "top": [list(x[np.isfinite(x)]) for x in s[some, :3]]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("qid", "q_label", "g_label", "n", "total", "top")})

    schema = "qid long, q_label double, g_label double, n long, total double, top array<double>"
    rows = met_in_blocks(queries, gallery, per_label, schema, of_query=["q_label"], of_gallery=["g_label"])
    top = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, 3).alias("top")
    out = rows.groupBy("qid", "q_label", "g_label").agg((F.sum("total") / F.sum("n")).alias("mean_score"), top)
    out = out.withColumns({"max_score": F.element_at("top", 1), "top3_mean": F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")})
    out = out.withColumn("hybrid_score", 0.7 * F.col("max_score") + 0.3 * F.col("top3_mean"))
    return out.select("qid", F.col("q_label").cast("int"), F.col("g_label").cast("int"), "max_score", "mean_score", "top3_mean", "hybrid_score")


def first_hits(queries: DataFrame, gallery: DataFrame, vec: Sequence[str] = ("vec",), weights: Sequence[Sequence[float]] = ((1.0,),)) -> DataFrame:
    """(alpha, qid, hit): the rank of the first vector of a query's own label by the weighted sum of cosines of the columns
    ``vec``, for each of the ``weights`` (alpha is the first weight); null where there is none.

    A query first meets the vectors of its own label alone, for the best of them; then those that can come before it are
    counted: by one vector, those within its radius; by several, all."""

    def mixed(every, w):  # noqa: ANN001, ANN202
        return np.round(sum(x * s for x, s in zip(w, every, strict=True) if x), 9) if len(w) > 1 else every[0]

    def best(qid, gid, every, of_query, of_gallery):  # noqa: ANN001, ANN202
        own, out = of_query["q_label"][:, None] == of_gallery["g_label"][None], []
        for w in weights:
            s = np.where(own, mixed(every, w), -np.inf)
            order = np.array([np.lexsort((gid, -x))[0] for x in s])
            top = s[np.arange(len(qid)), order]
            out.append(pd.DataFrame({"alpha": w[0], "qid": qid, "score": top, "gid": gid[order]})[np.isfinite(top)])
        return pd.concat(out)

    index = vector_index.build(gallery, "gid", vec, ["g_label"], within="g_label")
    asked = queries.withColumn("_cell", vector_index.cell_of(F.col("q_label")))
    schema = "alpha double, qid long, score double, gid long"
    found = vector_index.meet(asked, "qid", index, vector_index.own_cell(index, "_cell"), best, schema, ["q_label", "_cell"])
    first = found.groupBy("alpha", "qid").agg(F.max(F.struct("score", (-F.col("gid")).alias("g"))).alias("x"))
    if len(vec) == 1:
        hits = first.select("qid", "x.score", (-F.col("x.g")).alias("hit"))
        asked = stages.stage(queries.select("qid", F.col(vec[0]).alias("vec")).join(hits, "qid", "left"), "own-hits")
        n = vector_index.count_ahead(asked, gallery.select("gid", F.col(vec[0]).alias("vec")))
        return queries.select("qid").join(n, "qid", "left").select(F.lit(float(weights[0][0])).alias("alpha"), "qid", (F.col("n") + 1).cast("int").alias("hit"))
    wide = first.groupBy("qid").agg(*[F.max(F.when(F.col("alpha") == w[0], x)).alias(f"{c}{k}") for k, w in enumerate(weights) for c, x in (("s", F.col("x.score")), ("g", -F.col("x.g")))])
    names = [f"{c}{k}" for k in range(len(weights)) for c in "sg"]

    def ahead(qid, gid, every, of_query, _):  # noqa: ANN001, ANN202
        out = []
        for k, w in enumerate(weights):
            s, at, g = mixed(every, w), of_query[f"s{k}"][:, None], of_query[f"g{k}"][:, None]
            n = ((s > at) | ((s == at) & (gid[None] < g))).sum(axis=1)
            out.append(pd.DataFrame({"alpha": w[0], "qid": qid, "n": n})[~np.isnan(at[:, 0])])
        return pd.concat(out)

    asked = queries.join(wide, "qid", "left")
    counts = met_in_blocks(asked, gallery, ahead, "alpha double, qid long, n long", vec, names).groupBy("alpha", "qid").agg((F.sum("n") + 1).cast("int").alias("hit"))
    every = queries.select("qid", F.explode(F.array(*[F.lit(float(w[0])) for w in weights])).alias("alpha"))
    return every.join(counts, ["alpha", "qid"], "left")


def centroids(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, centroid): the mean of the normalised vectors, at length 1."""
    each = rows.select(key, F.posexplode(vectors.normalized(F.col(vec))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return each.groupBy(key).agg(mean.alias("centroid")).withColumn("centroid", vectors.normalized(F.col("centroid")))


def tolerant_ranks(rows: DataFrame, keys: list[str], score: str, node: str, tolerance: float = 1e-9) -> DataFrame:
    """``rows`` with rank, tie_status and tie_group (nodes in order): competition ranks by score within ``keys``, ties by the node as
    a string.  A tie group begins with a score and holds those after it that are no more than ``tolerance`` below that first one.

    Scores without a larger gap are a chain.  A chain no wider than the tolerance is a group; only a wider one is gone through
    in order, from group to group."""
    order = [F.desc(score), F.col(node).cast("string")]
    part = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({"_n": F.row_number().over(part), "_gap": F.lag(score).over(part) - F.col(score)})
    rows = rows.withColumn("_chain", F.sum(F.when(F.coalesce(F.col("_gap") <= tolerance, F.lit(False)), 0).otherwise(1)).over(part))
    chain = W.partitionBy(*keys, "_chain")
    rows = rows.withColumns({"_first": F.min("_n").over(chain), "_wide": F.max(score).over(chain) - F.min(score).over(chain) > tolerance})
    ordered = F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(score).cast("double").alias("s"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(float("inf")).alias("s"), F.array().cast("array<struct<n:int,at:int>>").alias("out"))

    def step(acc, x):  # noqa: ANN001, ANN202
        new = acc["s"] - x["s"] > tolerance
        n, s = F.when(new, x["n"]).otherwise(acc["n"]), F.when(new, x["s"]).otherwise(acc["s"])
        return F.struct(n.alias("n"), s.alias("s"), F.concat(acc["out"], F.array(F.struct(x["n"].alias("n"), n.alias("at")))).alias("out"))

    wide = rows.where("_wide").groupBy(*keys, "_chain").agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("_z"))
    wide = wide.select(*keys, F.inline("_z")).select(*keys, F.col("n").alias("_n"), "at")
    rows = rows.join(wide, [*keys, "_n"], "left").withColumn("rank", F.coalesce("at", "_first"))
    group = F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(node).alias("_node"))).over(W.partitionBy(*keys, "rank"))), lambda x: x["_node"])
    rows = rows.withColumn("tie_group", group).withColumn("tie_status", F.when(F.size("tie_group") > 1, "tied").otherwise("unique"))
    return rows.drop("_n", "_gap", "_chain", "_first", "_wide", "at")


def topk_metrics(ranks: DataFrame, by: list[str], rank: str, ks: list[int]) -> DataFrame:
    """recall@k and mean reciprocal rank of first-hit ranks (null: no hit); no rows give 0."""
    hits = [F.coalesce(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    mrr = F.coalesce(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), F.lit(0.0)).alias("mrr")
    rows = ranks.groupBy(*by) if by else ranks.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("cases"), *hits, mrr)


def keyword_search(docs: DataFrame, text: str, words: list[str], base: float = 1.5) -> DataFrame:
    """Rows that hold any of the words, with the number of words held and a score of that plus ``base``."""
    hits = texts.keyword_hits(F.col(text), words[:16])
    return docs.withColumn("hits", hits).where("hits > 0").withColumn("score", F.col("hits") + F.lit(base))


def has_content(text: Column, least: int = 10) -> Column:
    """Long enough and no placeholder."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= least) & ~t.isin(PLACEHOLDERS)


def merged_search(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(id, content, similarity, channel) of two channels: the first one's rows come first, each id and each content
    once, cut to ``k``, and only then sorted by similarity.

    Ids are settled before contents; as an id has one content, that equals going through the rows one by one."""
    rows = first.withColumn("channel", F.lit(0)).unionByName(second.withColumn("channel", F.lit(1)))
    rows = rows.withColumn("_key", F.md5(F.lower(F.trim("content"))))
    order = [F.col("channel"), F.desc("similarity"), F.col("id")]
    for key in ("id", "_key"):
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1")
    return rows.orderBy(*order).limit(k).drop("_n", "_key").orderBy(F.desc("similarity"), "id")


def first_by_key(rows: DataFrame, key: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def interleaved(rows: DataFrame, by: list[str], source: str, family: str, score: str, key: str, families: list[str]) -> DataFrame:
    """Round-robin over families within ``by``: the best row of each source, families in the order given, one row of each
    in turn; ``place`` counts from 1."""
    best = first_by_key(rows, [*by, family, source], [F.desc(score), F.col(key)])
    turn = F.row_number().over(W.partitionBy(*by, family).orderBy(F.desc(score), key))
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in families]), F.col(family)).cast("int"), F.lit(0))
    order = F.when(order == 0, len(families) + 1).otherwise(order)
    best = best.withColumns({"_turn": turn, "_family": order})
    return best.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("_turn", "_family", key))).drop("_turn", "_family")


def recall_channels(rows: DataFrame, node: str, score: str, method: str) -> DataFrame:
    """One row per node: its best score and the methods that found it, best first."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(method).alias("m"))))
    return rows.groupBy(node).agg(F.max(score).alias("score"), F.array_distinct(F.transform(ordered, lambda x: x["m"])).alias("methods"))


def relevance_tier(name: Column, query: str, is_root: Column) -> Column:
    """100 for the name itself, 80 for its beginning, 60 for a part of it, else 30; without a query 20 for a root, else 0."""
    q, low = query.strip().lower(), F.lower(name)
    if not q:
        return F.when(is_root, 20).otherwise(0)
    return F.when(low == q, 100).when(low.startswith(q), 80).when(F.contains(low, F.lit(q)), 60).otherwise(30)


def fused_channels(hits: DataFrame, key: str, channel: str, score: str, weights: dict[str, float]) -> DataFrame:
    """(key, score): the weighted sum of a key's best score in each channel; a channel without a hit adds nothing."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col(channel) == name, w).otherwise(weight)
    best = hits.groupBy(key, channel).agg(F.max(score).alias("_s"))
    return best.groupBy(key).agg(F.sum(F.col("_s") * weight).alias("score"))


#: Lengths of the stretches that join passages to texts; one of n characters serves passages of 2n - 1 or more.
GRAMS = (12, 4, 1)


def held_beginnings(docs: DataFrame, passages: DataFrame, doc: str, text: str, item: str, passage: str, length: int) -> DataFrame:
    """(doc, item, whole): texts that hold the first ``length`` characters of a passage, and whether they hold all of it.
    Passages without a character are in no text.

    A text is cut into stretches of n characters, by one pass of a pattern.  A beginning of 2n - 1 characters or more that
    lies in it covers one of them as a whole, which is the beginning's stretch at one of n offsets.  So these join the two,
    and only what they find is compared as a whole."""
    size = F.lit(None).cast("int")
    for n in sorted(GRAMS):
        size = F.when(F.length("_b") >= 2 * n - 1, n).otherwise(size)
    asked = passages.where(F.length(passage) > 0).withColumn("_b", F.substring(passage, 1, length))
    asked = stages.stage(asked.select(item, passage, "_b", size.alias("_n")), "passages")
    hits = None
    for n in GRAMS:
        some = asked.where(F.col("_n") == n)
        if some.isEmpty():
            continue
        offsets = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.col("_b"), i, F.lit(n)))  # noqa: B023
        keys = some.select(item, F.explode(F.array_distinct(offsets)).alias("_gram"))
        grams = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s).{{{n}}}"), F.lit(0)))).alias("_gram")
        found = docs.select(doc, grams).join(keys, "_gram").select(doc, item).distinct()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.select(doc).join(asked.select(item), F.lit(False)).withColumn("whole", F.lit(False))
    rows = hits.join(docs.select(doc, text), doc).join(asked.select(item, passage, "_b"), item)
    return rows.where(F.contains(text, F.col("_b"))).select(doc, item, F.contains(text, F.col(passage)).alias("whole"))
