"""Image assets: bindings to nodes, pairs that may be one image, what their letters say, and review decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import texts

from .retrieval import first_by_key

#: Letters are looked at from this score on.
LEAST_SCORE = 0.55
#: What a review's action makes of an asset.
REASONS = {"exclude_shared": "shared_image_excluded", "needs_rebind": "wrong_binding_needs_rebind"}


def binding_reasons(bindings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bindings (asset, target, object_type) with ``reason``, OK or why not; ``nodes`` has (target)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    known = nodes.select(F.trim(F.col("target").cast("string")).alias("_t")).where("_t <> ''").distinct().withColumn("_known", F.lit(True))
    rows = bindings.withColumn("_t", F.trim(F.col("target").cast("string"))).join(known, "_t", "left")
    reason = (
        F.when(F.coalesce("object_type", F.lit("node")) != "node", "UNSUPPORTED_OBJECT_TYPE").when(blank("asset"), "ASSET_ID_REQUIRED")
        .when(blank("target"), "TARGET_NODE_ID_REQUIRED").when(F.col("_known").isNull(), "TARGET_NODE_NOT_FOUND").otherwise("OK")
    )
    return rows.withColumn("reason", reason).drop("_t", "_known")


def pair_action(same_node: Column, same_url: Column, same_sha: Column, vector_distance: Column, hash_distance: Column) -> Column:
    """What to do about two images; null distances say nothing."""
    no = F.lit(False)
    return (
        F.when(same_node, "same_node_duplicate_keep_one").when(F.coalesce(same_url, no) | F.coalesce(same_sha, no), "cross_node_exact_duplicate_manual_review")
        .when(vector_distance <= 1e-6, "cross_node_simclr_identical_manual_review").when(hash_distance <= 5, "cross_node_near_duplicate_manual_review").otherwise("no_action")
    )


def exact_pairs(assets: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b), a < b, of assets (id, *keys) that share a key's value.  Of those that share one, each is paired with the
    smallest alone, which says the same and makes no group's square."""
    pairs = []
    for key in keys:
        first = assets.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs.append(assets.select("id", key).join(first, key).where("id > a").select("a", F.col("id").alias("b")))
    return reduce(DataFrame.unionByName, pairs).distinct()


def last_of_each(clusters: DataFrame, done: DataFrame) -> DataFrame:
    """(asset, ordinal): the assets of clusters (cluster, ordinal, assets), each once with its last cluster's ordinal, but for
    those that are done (asset)."""
    rows = clusters.select("ordinal", F.posexplode("assets").alias("pos", "asset"))
    return first_by_key(rows, ["asset"], [F.desc("ordinal"), F.desc("pos")]).join(done.select("asset"), "asset", "left_anti").select("asset", "ordinal")


def letters_status(assets: DataFrame, terms: DataFrame, parents: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``assets`` (cluster, asset, node, text, state, score) with ``status`` and ``matched`` (nodes, in order): which nodes of
    the cluster their letters name.  ``terms`` has (cluster, node, term, is_name), ``parents`` (node, term); a cluster's
    terms meet its assets alone."""
    key = lambda c: texts.name_key(F.col(c))
    rows = assets.withColumn("_key", key("text"))
    named = rows.select("cluster", "asset", "node", "_key").join(terms.select("cluster", F.col("node").alias("other"), key("term").alias("_term"), "is_name"), "cluster")
    named = named.where((F.col("_term") != "") & F.contains("_key", F.col("_term")))
    own = F.col("other") == F.col("node")
    hits = named.groupBy("cluster", "asset").agg(F.sort_array(F.collect_set("other")).alias("matched"), F.bool_or(own & F.col("is_name")).alias("by_name"), F.bool_or(own).alias("own"))
    above = rows.select("cluster", "asset", "node", "_key").join(parents.select("node", key("term").alias("_term")), "node").where((F.col("_term") != "") & F.contains("_key", F.col("_term")))
    rows = rows.join(hits, ["cluster", "asset"], "left").join(above.select("cluster", "asset", F.lit(True).alias("above")).distinct(), ["cluster", "asset"], "left")
    n, mine = F.size(F.coalesce("matched", F.array().cast(dict(hits.dtypes)["matched"]))), F.coalesce("own", F.lit(False))
    status = (
        F.when(F.coalesce("state", F.lit("")) != "ok", "unresolved").when(F.col("_key") == "", "no_effective_text").when(F.coalesce("score", F.lit(0.0)) < least, "low_confidence")
        .when(mine & (n == 1), F.when(F.col("by_name"), "exact_node_match").otherwise("alias_match")).when(mine, "multi_node_match").when(n > 0, "conflicting_node_match")
        .when(F.col("above"), "parent_only_match").otherwise("no_effective_text")
    )
    looked = ~status.isin("unresolved", "low_confidence")
    return rows.withColumn("status", status).withColumn("matched", F.when(looked, F.col("matched"))).drop("_key", "by_name", "own", "above")


def cluster_decision(rows: DataFrame) -> DataFrame:
    """(cluster, n, useful, decision) from the statuses of a cluster's assets."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    c = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - count("no_effective_text", "low_confidence", "unresolved")).alias("useful"), count("conflicting_node_match").alias("_conflict"),
        count("multi_node_match").alias("_multi"), count("parent_only_match").alias("_parent"), count("exact_node_match", "alias_match").alias("_match"),
    )
    decision = (
        F.when(F.col("useful") <= 0, "unresolved").when(F.col("_conflict") > 0, "possible_wrong_binding").when(F.col("_multi") > 0, "possible_shared_image")
        .when(F.col("_parent") == F.col("useful"), "unresolved").when((F.col("_match") == F.col("useful")) & (F.col("useful") == F.col("n")), "auto_hard_negative")
        .when(F.col("_match") > 0, "mixed").otherwise("unresolved")
    )
    return c.select("cluster", "n", "useful", decision.alias("decision"))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items (asset, node, role, usable) after review decisions (asset, action): keep makes usable, anything else does not,
    and then nodes left without a query or without a gallery item lose the rest.  ``reason`` says why one is not usable."""
    rows = items.join(decisions.select("asset", "action"), "asset", "left")
    usable = F.when(F.col("action").isNull(), F.coalesce("usable", F.lit(True))).otherwise(F.col("action") == "keep")
    reason = F.when(F.col("action").isNull() | (F.col("action") == "keep"), F.lit(None))
    for action, text in REASONS.items():
        reason = reason.when(F.col("action") == action, text)
    rows = rows.withColumns({"usable": usable, "reason": reason.otherwise("duplicate_excluded")})
    # A node's usable items have both roles or none is left.
    roles = rows.where("usable").groupBy("node").agg(F.bool_or(F.col("role") == "query").alias("_q"), F.bool_or(F.col("role") == "gallery").alias("_g"))
    rows = rows.join(roles, "node", "left").withColumn("_whole", F.coalesce(F.col("_q") & F.col("_g"), F.lit(False)))
    return rows.withColumns({"reason": F.when(F.col("usable") & ~F.col("_whole"), "node_without_query_gallery").otherwise(F.col("reason")), "usable": F.col("usable") & F.col("_whole")}).drop("_q", "_g", "_whole")


def ranked_evidence(claims: DataFrame, assets: DataFrame, scores: DataFrame, per_node: int = 3, per_run: int = 300) -> DataFrame:
    """(claim, status, asset_count, support, assets): a claim's image evidence, best first.

    ``claims`` has (run, claim, node), ``assets`` (asset, node, url, updated), ``scores`` (claim, asset, score) from a reranker.
    A node brings its ``per_node`` latest assets with a URL, a run ``per_run`` assets at most, in order of node.  A claim
    without assets has no row; one whose assets have no score is UNAVAILABLE."""
    shown = assets.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    shown = first_by_key(shown, ["node"], [F.col("updated").desc_nulls_last(), F.col("asset")], per_node)
    nodes = claims.select("run", "node").distinct().join(shown.select("node", "asset"), "node")
    nodes = first_by_key(nodes, ["run"], [F.col("node"), F.col("asset")], per_run)
    rows = claims.join(nodes, ["run", "node"]).join(scores, ["claim", "asset"], "left")
    item = F.struct((-F.round("score", 4)).alias("s"), F.col("asset"))
    out = rows.groupBy("claim").agg(F.count(F.lit(1)).alias("asset_count"), F.round(F.max("score"), 4).alias("support"), F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), item))).alias("x"))
    return out.select("claim", F.when(F.size("x") > 0, "SCORED").otherwise("UNAVAILABLE").alias("status"), "asset_count", "support", F.transform("x", lambda y: y["asset"]).alias("assets"))
