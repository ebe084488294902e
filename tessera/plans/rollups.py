"""Queries on events as jobs and task events, and roll-ups of documents, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import claims as C
from tessera.operators import queues as Q
from tessera.operators import splits as P
from tessera.operators import variants

from .fixtures import pick
from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

NOW = "2024-01-02 00:00:00"
JOBS = f"""j AS (SELECT event_id AS job_id, user_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
    json_extract_string(props, '$.k')::INT % 5 AS attempts, json_extract_string(props, '$.k')::INT // 10 AS priority, ts AS next_at, TIMESTAMP '{NOW}' AS now FROM events)"""


def jobs(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.col("event_type")
    kind = F.when(status == "signup", "PENDING").when(status == "view", "RUNNING").when(status == "purchase", "DONE").when(status == "error", "FAILED").otherwise("PENDING")
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), "user_id", kind.alias("status"), (k % 5).alias("attempts"), F.floor(k / 10).cast("int").alias("priority"), F.col("ts").alias("next_at"))


def now():
    return F.lit(NOW).cast("timestamp")


@register(f"WITH {JOBS} SELECT job_id, priority FROM j WHERE status = 'PENDING' AND attempts < 3 AND next_at <= now ORDER BY priority DESC, next_at, job_id LIMIT 50")
def q1_claimable_jobs(spark, sf_dir):
    return Q.claimable(jobs(spark, sf_dir), now(), 3, 50).select("job_id", "priority")


@register(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'RUNNING' AND next_at < now THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END ELSE status END AS status FROM j")
def q2_stale_leases(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", Q.recovered(F.col("status"), F.col("next_at"), F.col("attempts"), now(), 3).alias("status"))


@register(f"WITH {JOBS} SELECT job_id, max(priority) OVER (PARTITION BY user_id ORDER BY job_id) AS progress FROM j")
def q3_monotone_progress(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", F.max("priority").over(W.partitionBy("user_id").orderBy("job_id").rowsBetween(W.unboundedPreceding, 0)).alias("progress"))


@register(f"WITH {JOBS} SELECT job_id, least(300, pow(2, greatest(attempts, 1))) AS wait FROM j")
def q4_retry_backoff(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", Q.backoff(F.col("attempts")).alias("wait"))


@register(f"WITH {JOBS} SELECT user_id, count(*) AS scopes, count(*) FILTER (status IN ('DONE', 'PENDING')) AS processed, CASE WHEN count(*) > 0 AND count(*) FILTER (status IN ('DONE', 'PENDING')) = count(*) THEN 'ADVANCED' ELSE 'OPEN' END AS cursor_state FROM j GROUP BY user_id")
def q5_source_cursor(spark, sf_dir):
    rows = jobs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("scopes"), F.count_if(F.col("status").isin("DONE", "PENDING")).alias("processed"))
    return rows.withColumn("cursor_state", Q.cursor_state(F.col("scopes"), F.col("processed")))


@register(f"WITH {JOBS}, r AS (SELECT job_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, job_id) AS n FROM j) SELECT user_id, job_id, (n - 1) // 5 AS batch FROM r")
def k2_question_batches(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("priority"), "job_id"))
    return jobs(spark, sf_dir).select("user_id", "job_id", F.floor((n - 1) / 5).alias("batch"))


@register(f"WITH {JOBS} SELECT user_id, priority, min(job_id) AS job_id, count(*) AS requests FROM j GROUP BY user_id, priority")
def q7_idempotent_enqueue(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("user_id", "priority").agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("requests"))


@register(f"WITH {JOBS} SELECT job_id, CASE WHEN status NOT IN ('RUNNING', 'DONE') THEN status WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRYABLE' END AS status FROM j")
def q8_failure_marking(spark, sf_dir):
    owned = F.col("status").isin("RUNNING", "DONE")
    return jobs(spark, sf_dir).select("job_id", F.when(~owned, F.col("status")).when(F.col("attempts") >= 3, "FAILED").otherwise("RETRYABLE").alias("status"))


EVENT = "CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'RESET' ELSE 'NONE' END"


def task_events(rows: DataFrame) -> DataFrame:
    e = F.col("event_type")
    return rows.select("user_id", "ts", "event_id", F.when(e == "signup", "START").when(e == "purchase", "COMPLETE").when(e == "error", "FAIL").when(e == "click", "RESET").otherwise("NONE").alias("event"))


@register(f"""WITH RECURSIVE e AS (SELECT user_id, {EVENT} AS ev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT user_id, 'IDLE' AS state, 0 AS moves, 0 AS n FROM (SELECT DISTINCT user_id FROM events) UNION ALL
        SELECT m.user_id, z.s, m.moves + (z.s <> m.state)::INT, e.n FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1, LATERAL (SELECT CASE WHEN m.state = 'IDLE' AND ev = 'START' THEN 'IN_PROGRESS' WHEN m.state = 'IN_PROGRESS' AND ev = 'COMPLETE' THEN 'COMPLETED'
        WHEN m.state = 'IN_PROGRESS' AND ev = 'FAIL' THEN 'FAILED' WHEN m.state IN ('COMPLETED', 'FAILED', 'IN_PROGRESS') AND ev = 'RESET' THEN 'IDLE' ELSE m.state END AS s) z)
    SELECT user_id, arg_max(state, n) AS state, max(moves) AS moves FROM m GROUP BY user_id""")
def q9_state_machine(spark, sf_dir):
    return Q.final_states(task_events(t(spark, sf_dir, "events")), "user_id", ["ts", "event_id"], "event")


@register("""WITH f AS (SELECT user_id, event_type AS name, count(*) AS value FROM events GROUP BY ALL), p AS (SELECT user_id, max(value) FILTER (name = 'purchase') AS buys, max(value) FILTER (name = 'view') AS views, max(value) FILTER (name = 'error') AS errors FROM f GROUP BY ALL)
    SELECT user_id, CASE WHEN buys >= 15 AND views >= 15 THEN 'loyal' WHEN errors >= 22 THEN 'at_risk' ELSE 'DEFAULT' END AS assessment FROM p""")
def q10_rule_engine(spark, sf_dir):
    facts = t(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    rules = [(1, 1, "purchase", 15, "loyal"), (1, 1, "view", 15, "loyal"), (2, 2, "error", 22, "at_risk")]
    return Q.first_rule(facts, "user_id", spark.createDataFrame(rules, "rule int, priority int, name string, least int, assessment string"))


@register("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT < 50 AND event_type <> 'error' THEN 'KEEP' ELSE event_type END AS state FROM events")
def q11_relevance_bypass(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf_dir, "events").select("event_id", F.when((k < 50) & (F.col("event_type") != "error"), "KEEP").otherwise(F.col("event_type")).alias("state"))


@register(f"WITH {JOBS} SELECT user_id, CASE WHEN bool_or(status = 'FAILED') THEN 'failed' WHEN bool_and(status = 'DONE') THEN 'published' ELSE 'pending' END AS sync, list_sort(list_distinct(list(priority))) AS affected FROM j GROUP BY user_id")
def q13_publication_status(spark, sf_dir):
    s = F.col("status")
    sync = F.when(F.bool_or(s == "FAILED"), "failed").when(F.bool_and(s == "DONE"), "published").otherwise("pending")
    return jobs(spark, sf_dir).groupBy("user_id").agg(sync.alias("sync"), F.sort_array(F.collect_set("priority")).alias("affected"))


@register(f"""WITH {JOBS}, c AS (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'DONE') AS d, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'RUNNING') AS r FROM j GROUP BY ALL)
    SELECT user_id, CASE WHEN n = 0 THEN 'EMPTY' WHEN d + f = n AND f > 0 THEN 'PARTIAL_FAILED' WHEN d = n THEN 'COMPLETED' WHEN r > 0 THEN 'RUNNING' ELSE 'PENDING' END AS status, floor(100.0 * (d + f) / n)::BIGINT AS progress FROM c""")
def a23_batch_status(spark, sf_dir):
    s = F.col("status")
    c = jobs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "DONE").alias("d"), F.count_if(s == "FAILED").alias("f"), F.count_if(s == "RUNNING").alias("r"))
    return c.select("user_id", Q.batch_status(F.col("n"), F.col("d"), F.col("f"), F.col("r")).alias("status"), F.floor(100.0 * (F.col("d") + F.col("f")) / F.col("n")).alias("progress"))


@register(f"WITH {JOBS} SELECT user_id, string_agg(status, ',' ORDER BY job_id) AS states FROM j GROUP BY user_id")
def a15_ordered_states(spark, sf_dir):
    seq = F.transform(F.sort_array(F.collect_list(F.struct("job_id", "status"))), lambda x: x["status"])
    return jobs(spark, sf_dir).groupBy("user_id").agg(F.array_join(seq, ",").alias("states"))


@register("SELECT source, CASE WHEN bool_and(coalesce(quality, 1) = 1) THEN 'done' WHEN bool_or(quality = 0) THEN 'failed' ELSE 'pending' END AS status, count(*) AS docs, count(*) FILTER (quality = 0) AS bad FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a1_filtered_counts(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    status = F.when(F.bool_and(F.coalesce("quality", F.lit(1)) == 1), "done").when(F.bool_or(bad), "failed").otherwise("pending")
    return rows.groupBy("source").agg(status.alias("status"), F.count(F.lit(1)).alias("docs"), F.count_if(bad).alias("bad"))


@register("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def a2_distinct_counts(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@register("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT n AS images, count(*) AS nodes FROM c GROUP BY n")
def a16_histogram(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("images")).groupBy("images").agg(F.count(F.lit(1)).alias("nodes"))


@register("SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS lines, count(DISTINCT l_partkey) AS parts, round(count(DISTINCT l_partkey) / count(*), 4) AS novelty, round(count(DISTINCT l_orderkey) / count(*), 4) AS aggregation FROM lineitem")
def a24_run_summary(spark, sf_dir):
    n = F.count(F.lit(1))
    part, order = F.countDistinct("l_partkey"), F.countDistinct("l_orderkey")
    return t(spark, sf_dir, "lineitem").agg(n.alias("rows"), F.sum("l_linenumber").alias("lines"), part.alias("parts"), F.round(part / n, 4).alias("novelty"), F.round(order / n, 4).alias("aggregation"))


@register(f"WITH {JOBS} SELECT job_id, 'CLAIMED_WITHOUT_RESULT' AS issue FROM j WHERE status = 'RUNNING' AND attempts = 0 UNION ALL SELECT job_id, 'PROCESSED_WITHOUT_RESULT' FROM j WHERE status = 'DONE' AND priority = 0")
def a25_audit_issues(spark, sf_dir):
    j = jobs(spark, sf_dir)
    one = j.where("status = 'RUNNING' AND attempts = 0").select("job_id", F.lit("CLAIMED_WITHOUT_RESULT").alias("issue"))
    return one.unionByName(j.where("status = 'DONE' AND priority = 0").select("job_id", F.lit("PROCESSED_WITHOUT_RESULT").alias("issue")))


@register("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS evidence, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) AS candidates FROM orders""")
def a26_question_statistics(spark, sf_dir):
    c = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("e"), F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("c"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey").join(c, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("e", F.lit(0)).alias("evidence"), F.coalesce("c", F.lit(0)).alias("candidates"))


@register("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'EMPTY' WHEN bool_or(o_orderstatus = 'P') THEN 'RUNNING' WHEN bool_or(o_orderstatus = 'O') THEN 'PENDING_REVIEW' ELSE 'COMPLETED' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a28_node_status(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey").join(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey", "left")
    s = F.col("o_orderstatus")
    return rows.groupBy("c_custkey").agg(F.when(F.count("o_orderkey") == 0, "EMPTY").when(F.bool_or(s == "P"), "RUNNING").when(F.bool_or(s == "O"), "PENDING_REVIEW").otherwise("COMPLETED").alias("status"))


@register("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN 0.5 WHEN event_type = 'signup' THEN 0.25 ELSE 0 END), 3) AS score FROM events GROUP BY user_id")
def a30_completion_score(spark, sf_dir):
    e = F.col("event_type")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.when(e == "purchase", 0.5).when(e == "signup", 0.25).otherwise(0.0)), 3).alias("score"))


@register("SELECT o_custkey, sum(o_totalprice::DECIMAL(12, 2))::DOUBLE AS total FROM orders GROUP BY o_custkey")
def a31_decimal_total(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total"))


@register("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a32_extraction_statistics(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@register("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events) AS events")
def a35_system_statistics(spark, sf_dir):
    n = lambda name, alias: t(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(alias))
    return n("documents", "documents").crossJoin(n("pages", "pages")).crossJoin(n("embeddings", "vectors")).crossJoin(n("events", "events"))


@register("""SELECT o_orderkey, list_sort(list_distinct(list(l_partkey) FILTER (l_discount > 0.05))) AS candidates, CASE WHEN count(*) FILTER (l_discount > 0.05) > 0 THEN 'CANDIDATE' WHEN count(l_partkey) > 0 THEN 'EVIDENCE_ONLY' ELSE 'NO_CHANGE' END AS outcome
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""".replace("list_sort(list_distinct(list(l_partkey) FILTER (l_discount > 0.05)))", "coalesce(list_sort(list_distinct(list(l_partkey) FILTER (l_discount > 0.05))), [])"))
def a36_unit_outcomes(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", (F.col("l_discount") > 0.05).alias("good"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left").groupBy("o_orderkey")
    seen = F.sort_array(F.collect_set(F.when(F.col("good"), F.col("l_partkey"))))
    return rows.agg(seen.alias("candidates"), F.when(F.count_if("good") > 0, "CANDIDATE").when(F.count("l_partkey") > 0, "EVIDENCE_ONLY").otherwise("NO_CHANGE").alias("outcome"))


@register("""WITH s AS (SELECT p.p_partkey, p_brand, sum(l_quantity)::DOUBLE AS stock FROM part p LEFT JOIN lineitem ON l_partkey = p.p_partkey WHERE NOT contains(p_name, 'red') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(stock, 0) DESC, p_partkey) AS n FROM s) SELECT p_brand, p_partkey, coalesce(stock, 0) AS stock FROM r WHERE n <= 3""")
def j18_allergen_safe_products(spark, sf_dir):
    words = F.split("p_name", " ")
    safe = t(spark, sf_dir, "part").where(~F.arrays_overlap(words, F.array(F.lit("red")))).select("p_partkey", "p_brand")
    stock = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("stock"))
    rows = safe.join(stock, "p_partkey", "left").withColumn("stock", F.coalesce("stock", F.lit(0.0)))
    n = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("stock"), "p_partkey"))
    return rows.withColumn("n", n).where("n <= 3").select("p_brand", "p_partkey", "stock")


@register("""SELECT o_orderkey, l.l_partkey AS first_part FROM orders LEFT JOIN LATERAL (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25 ORDER BY l_linenumber, l_partkey LIMIT 1) l ON true""")
def j3_lateral_first_row(spark, sf_dir):
    first = t(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))
    return t(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey", "left")


@register("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j2_composite_left_join(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@register("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def j5_anti_join(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey").join(t(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def j6_semi_join(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey").join(t(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@register("""WITH e AS (SELECT event_id, md5(concat_ws('|', user_id, event_type)) AS k FROM events), c AS (SELECT md5(concat_ws('|', user_id, event_type)) AS k, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL) SELECT event_id, coalesce(n, 0) AS matches FROM e LEFT JOIN c USING (k)""")
def j7_computed_key_join(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("k", F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")))
    c = e.where("value > 50").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return e.join(c, "k", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("matches"))


@register("SELECT s_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_custkey) AS customers FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY s_suppkey")
def j8_fan_out_audit(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_partkey")
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # Each count meets the rows that it needs alone; a supplier without any comes from its own table.
    s = t(spark, sf_dir, "supplier").select("s_suppkey").distinct()
    held = li.join(s, "s_suppkey", "left_semi")
    n = C.distinct_counts(held, ["s_suppkey"], ["l_orderkey", "l_partkey"]).unionByName(C.distinct_counts(held.join(o, "l_orderkey"), ["s_suppkey"], ["o_custkey"]), allowMissingColumns=True)
    count = lambda c: F.coalesce(F.max(c), F.lit(0))
    return s.unionByName(n, allowMissingColumns=True).groupBy("s_suppkey").agg(count("n_l_orderkey").alias("orders"), count("n_l_partkey").alias("parts"), count("n_o_custkey").alias("customers"))


@register("""WITH n AS (SELECT lower(n_name) AS k, n_nationkey AS id, 1 AS prio FROM nation UNION ALL SELECT lower(n_name[1:3]), n_nationkey, 2 FROM nation), m AS (SELECT DISTINCT lower(c_mktsegment[1:3]) AS k FROM customer UNION SELECT lower(n_name) FROM nation),
    b AS (SELECT m.k, id, prio, min(prio) OVER (PARTITION BY m.k) AS best FROM m LEFT JOIN n USING (k)) SELECT k, CASE count(id) WHEN 0 THEN 'NEW_ENTITY' WHEN 1 THEN 'MATCH' ELSE 'AMBIGUOUS' END AS resolution FROM b WHERE prio IS NULL OR prio = best GROUP BY k""")
def j10_alias_fallback(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    index = n.select(F.lower("n_name").alias("k"), F.col("n_nationkey").alias("id"), F.lit(1).alias("prio")).unionByName(n.select(F.lower(F.substring("n_name", 1, 3)).alias("k"), F.col("n_nationkey").alias("id"), F.lit(2).alias("prio")))
    m = t(spark, sf_dir, "customer").select(F.lower(F.substring("c_mktsegment", 1, 3)).alias("k")).union(n.select(F.lower("n_name"))).distinct()
    rows = m.join(index, "k", "left")
    best = rows.groupBy("k").agg(F.min("prio").alias("best"))
    rows = rows.join(best, "k").where("prio IS NULL OR prio = best").groupBy("k").agg(F.count("id").alias("n"))
    return rows.select("k", F.when(F.col("n") == 0, "NEW_ENTITY").when(F.col("n") == 1, "MATCH").otherwise("AMBIGUOUS").alias("resolution"))


@register("SELECT o_orderkey, CASE WHEN n = returned THEN 'R' WHEN n IS NULL THEN o_orderstatus ELSE 'M' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def j17_update_from_join(spark, sf_dir):
    c = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(c, "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(F.col("n") == F.col("r"), "R").when(F.col("n").isNull(), F.col("o_orderstatus")).otherwise("M").alias("status"))


@register("""WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY ALL), u AS (SELECT l_orderkey, unnest(ids) AS id FROM g) SELECT l_orderkey, count(*) AS items, round(sum(p_retailprice), 2) AS price FROM u JOIN part ON p_partkey = id GROUP BY ALL""")
def j20_id_array_lookup(spark, sf_dir):
    ids = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    rows = ids.select("l_orderkey", F.explode("ids").alias("p_partkey")).join(t(spark, sf_dir, "part"), "p_partkey")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(F.col("p_retailprice").cast("decimal(12,2)")).cast("double"), 2).alias("price"))


@register(f"WITH {JOBS}, l AS (SELECT user_id, max(job_id) AS last_job FROM j GROUP BY ALL) SELECT j.job_id, j.status, l.last_job, b.status AS last_status FROM j LEFT JOIN l USING (user_id) LEFT JOIN j b ON b.job_id = l.last_job")
def j21_job_status_join(spark, sf_dir):
    j = jobs(spark, sf_dir)
    last = j.groupBy("user_id").agg(F.max("job_id").alias("last_job"), F.max_by("status", "job_id").alias("last_status"))
    return j.join(last, "user_id", "left").select("job_id", "status", "last_job", "last_status")


SPLIT = """c AS (SELECT DISTINCT lang, source FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(source || 'seed'), source) AS k FROM c),
    s AS (SELECT lang, source, CASE WHEN k <= least(n - 1, greatest(1, floor(n * 0.3 + 0.5))) THEN 'query' ELSE 'gallery' END AS role FROM n)"""


def split_docs(spark, sf_dir):
    return P.stratified(t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", 0.3, F.md5(F.concat("source", F.lit("seed"))))


@register(f"WITH {SPLIT} SELECT doc_id, role FROM documents JOIN s USING (lang, source)")
def w11_stratified_split(spark, sf_dir):
    return split_docs(spark, sf_dir).select("doc_id", "role")


@register("""WITH k AS (SELECT count(DISTINCT lang) AS n FROM documents), a AS (SELECT doc_id, lang, md5(doc_id::VARCHAR || 's') AS o, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || 's'), doc_id) AS r FROM documents) SELECT doc_id, lang FROM a, k ORDER BY (r > greatest(1, floor(90 / n)))::INT, o, doc_id LIMIT 90""")
def w12_sample_with_top_up(spark, sf_dir):
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("s")))
    return P.sample_with_top_up(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 90, order, "doc_id")


@register("SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS representative FROM documents")
def w14_cluster_representative(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.join(d.groupBy("source", "lang").agg(F.min("doc_id").alias("representative")), ["source", "lang"]).select("doc_id", "representative")


@register(f"WITH {SPLIT}, d AS (SELECT doc_id, source, lang, role FROM documents JOIN s USING (lang, source)) SELECT doc_id FROM d WHERE lang IN (SELECT lang FROM d GROUP BY lang HAVING count(DISTINCT role) = 2)")
def w15_complete_roles(spark, sf_dir):
    return P.complete_roles(split_docs(spark, sf_dir), "lang", "role").select("doc_id")


@register(f"WITH {SPLIT}, d AS (SELECT doc_id, source, lang, role FROM documents JOIN s USING (lang, source)) SELECT (SELECT count(*) FROM (SELECT lang, source FROM d GROUP BY ALL HAVING count(DISTINCT role) > 1)) AS leaking, count(*) FILTER (role = 'query') AS queries, count(*) FILTER (role = 'gallery') AS gallery FROM d")
def a34_split_validation(spark, sf_dir):
    d = split_docs(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "lang", "source"))
    n = P.leaks(d, "cluster", "role").agg(F.count(F.lit(1)).alias("leaking"))
    return n.crossJoin(d.agg(F.count_if(F.col("role") == "query").alias("queries"), F.count_if(F.col("role") == "gallery").alias("gallery")))


@register(f"WITH {JOBS} SELECT job_id, priority FROM j WHERE status = 'PENDING' ORDER BY priority DESC, job_id LIMIT 100")
def t7_priority_order(spark, sf_dir):
    return jobs(spark, sf_dir).where("status = 'PENDING'").orderBy(F.desc("priority"), "job_id").limit(100).select("job_id", "priority")


@register("SELECT user_id, hour(ts) AS hour_of_day, (hour(ts) + 1) % 24 // 2 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def h33_two_hour_buckets(spark, sf_dir):
    h = F.hour("ts")
    return t(spark, sf_dir, "events").groupBy("user_id", h.cast("long").alias("hour_of_day"), F.floor(((h + 1) % 24) / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


REPLIES = ['Sure:\n```json\n{"k": K, "name": "a"}\n```\nbye', '[{"k": K, "name": "b"}, {"k": 1}]', "no object", 'so {"k": K, "name": "c"} it is', '```\n{"k": K}\n```', '{"k": K, "name"', "[]", "[1]", None]


@register(f"""WITH r AS (SELECT event_id, event_id % 9 AS i FROM events) SELECT event_id, i IN (0, 1, 3, 4) AS valid, CASE WHEN i IN (0, 1, 3, 4) THEN event_id::INT ELSE 0 END AS k, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 3 THEN 'c' END AS name FROM r""")
def h35_json_reply(spark, sf_dir):
    i = F.col("event_id")
    x = variants.reply(F.replace(pick(REPLIES, i), F.lit("K"), i.cast("string")), "k int, name string").alias("x")
    return t(spark, sf_dir, "events").select("event_id", x).select("event_id", "x.valid", F.coalesce("x.data.k", F.lit(0)).alias("k"), "x.data.name")


@register("SELECT p_partkey, concat_ws('_', lower(p_type[1:4]), replace(p_name, ' ', '')[1:12], row_number() OVER (PARTITION BY p_type ORDER BY p_partkey)) AS slug FROM part")
def h41_entity_slug(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))
    return t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", F.lower(F.substring("p_type", 1, 4)), F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 1, 12), n.cast("string")).alias("slug"))


@register("""SELECT p_partkey, variant, profile FROM (SELECT p_partkey, p_name AS T1, concat_ws(' ', p_name, p_type) AS T2, concat_ws(', ', p_name, p_brand, p_type) AS T3, CASE WHEN p_size > 25 THEN concat_ws(' of size ', p_name, p_size) ELSE p_name END AS T4 FROM part) UNPIVOT (profile FOR variant IN (T1, T2, T3, T4))""")
def h31_text_profiles(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    four = F.when(F.col("p_size") > 25, F.concat_ws(" of size ", "p_name", F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    wide = p.select("p_partkey", F.col("p_name").alias("T1"), F.concat_ws(" ", "p_name", "p_type").alias("T2"), F.concat_ws(", ", "p_name", "p_brand", "p_type").alias("T3"), four.alias("T4"))
    return wide.unpivot("p_partkey", ["T1", "T2", "T3", "T4"], "variant", "profile")


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def x_tumbling_window(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
