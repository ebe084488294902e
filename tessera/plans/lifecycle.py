"""Queries of the life of jobs and of snapshot tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import consumption
from tessera.sources import snapshots, stages
from tessera.streaming import jobs

from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: Events of users as those of jobs, an hour as a minute.
TOLD = """v AS (SELECT user_id AS job, make_timestamp(epoch_us(ts) // 60) AS at_, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'SCOPE' ELSE CASE event_type WHEN 'signup' THEN 'ENQUEUE' WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'HEARTBEAT' WHEN 'purchase' THEN 'DONE' ELSE 'FAIL' END END AS ev,
        'w' || event_id % 2 AS worker, (event_id % 130)::INT AS progress, (event_id % 4)::VARCHAR AS scope, CASE WHEN event_id % 5 > 0 THEN 'Processed' ELSE 'RETRYABLE' END AS state FROM events),
    e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY at_, ev, worker, scope, state) AS n FROM v)"""


def told(rows):
    kind, i = F.col("event_type"), F.col("event_id")
    event = F.when((kind == "click") & (i % 3 == 0), "SCOPE").when(kind == "signup", "ENQUEUE").when(kind == "view", "CLAIM").when(kind == "click", "HEARTBEAT").when(kind == "purchase", "DONE").otherwise("FAIL")
    return rows.select(
        F.col("user_id").cast("long").alias("job"), F.expr("timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 60)").alias("at"), event.alias("event"), F.concat(F.lit("w"), (i % 2).cast("string")).alias("worker"),
        (i % 130).cast("int").alias("progress"), (i % 4).cast("string").alias("scope"), F.when(i % 5 > 0, "Processed").otherwise("RETRYABLE").alias("state"),
    )


@register(f"""WITH RECURSIVE {TOLD}, m AS (SELECT DISTINCT job, 'NEW' AS status, 0 AS attempts, 0 AS progress, '' AS owner, NULL::TIMESTAMP AS lease, 0::BIGINT AS n FROM v UNION ALL
    SELECT m.job, y.status, y.attempts, y.progress, CASE WHEN y.status = 'RUNNING' THEN y.owner ELSE '' END, CASE WHEN y.status = 'RUNNING' THEN y.lease END, e.n FROM m JOIN e ON e.job = m.job AND e.n = m.n + 1,
        LATERAL (SELECT coalesce(m.status = 'RUNNING' AND m.lease < e.at_, false) AS lost) l,
        LATERAL (SELECT CASE WHEN lost AND m.attempts >= 3 THEN 'FAILED' WHEN lost THEN 'PENDING' ELSE m.status END AS st, CASE WHEN lost AND m.attempts >= 3 THEN 100 ELSE m.progress END AS pr) x,
        LATERAL (SELECT x.st = 'RUNNING' AND m.owner = e.worker AS mine, e.ev = 'CLAIM' AND x.st IN ('PENDING', 'RETRYABLE') AND m.attempts < 3 AS taken) z,
        LATERAL (SELECT CASE WHEN e.ev = 'ENQUEUE' AND x.st = 'NEW' THEN 'PENDING' WHEN z.taken THEN 'RUNNING' WHEN e.ev = 'DONE' AND z.mine THEN 'DONE' WHEN e.ev = 'FAIL' AND z.mine THEN CASE WHEN m.attempts >= 3 THEN 'FAILED' ELSE 'RETRYABLE' END ELSE x.st END AS status,
            m.attempts + z.taken::INT AS attempts, CASE WHEN z.mine AND e.ev = 'HEARTBEAT' THEN greatest(x.pr, least(100, e.progress)) WHEN z.mine AND e.ev = 'DONE' THEN 100 ELSE x.pr END AS progress,
            CASE WHEN z.taken THEN e.worker ELSE m.owner END AS owner, CASE WHEN z.taken OR (z.mine AND e.ev = 'HEARTBEAT') THEN e.at_ + INTERVAL 900 SECOND ELSE m.lease END AS lease) y),
    last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1), sc AS (SELECT job, scope, arg_max(state, n) AS state FROM e WHERE ev = 'SCOPE' GROUP BY ALL),
    c AS (SELECT job, count(*) AS scopes, count(*) FILTER (state = 'Processed') AS processed FROM sc GROUP BY job)
    SELECT job, status, attempts, progress, owner, epoch_us(lease) AS lease, coalesce(scopes, 0)::INT AS scopes, coalesce(processed, 0)::INT AS processed, CASE WHEN scopes > 0 AND scopes = processed THEN 'ADVANCED' ELSE 'OPEN' END AS cursor FROM last LEFT JOIN c USING (job)""")
def q2_job_lives(spark, sf_dir):
    return jobs.lives(told(t(spark, sf_dir, "events"))).withColumn("lease", F.expr("unix_micros(lease)"))


@register("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE doc_id % 3 + 1 END::BIGINT AS version FROM documents WHERE doc_id % 7 > 0""")
def s18_snapshot_upserts(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.lit(1).alias("at"))
    table = snapshots.Snapshots(spark, stages.new_path(spark, "snapshots"), ["doc_id"])
    order = [F.col("at")]
    table.upsert(d.where("doc_id % 3 = 0"), order, "first")
    changed = d.where("doc_id % 6 = 0").withColumns({"n_chars": F.col("n_chars") + 1, "at": F.lit(2)})
    second = d.where("doc_id % 3 < 2").unionByName(changed)
    table.upsert(second, order, "second")
    table.upsert(second, order, "second")  # a batch that comes again
    third = d.where("doc_id % 3 = 2 OR doc_id % 7 = 0")
    table.upsert(third, order, "third", deleted=F.col("doc_id") % 7 == 0)
    return table.read().select("doc_id", "n_chars", "version")


#: Three workers take documents in turn: the first ends its batch, the second's lease ends, and the third comes after that.
STEPS = """u AS (SELECT doc_id, source, doc_id % 4 = 0 AS image FROM documents), a AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY image ORDER BY doc_id) <= CASE WHEN image THEN 16 ELSE 100 END),
    p AS (SELECT doc_id FROM a WHERE doc_id % 3 > 0 AND doc_id % 5 > 0), r AS (SELECT * FROM u ANTI JOIN p USING (doc_id)),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY image ORDER BY doc_id) <= CASE WHEN image THEN 16 ELSE 100 END)"""


def consumed(spark, sf_dir):
    d, start = t(spark, sf_dir, "documents"), dt.datetime(2024, 1, 1)
    units = d.select(F.col("doc_id").alias("unit"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), (F.col("doc_id") % 4 == 0).alias("is_image"), F.col("doc_id").alias("created"), "source")
    store = consumption.table(spark, stages.new_path(spark, "consumption"))
    first = consumption.claim(store, units, "a", "a1", start, 100)
    results = first.where("unit % 5 > 0").select("unit", "hash", (F.col("unit") % 3 > 0).alias("ok"), (F.col("unit") % 2).alias("candidates"))
    consumption.finish(store, results, "a", "a1")
    consumption.claim(store, units, "b", "b1", start + dt.timedelta(seconds=60), 100)
    consumption.claim(store, units, "c", "c1", start + dt.timedelta(seconds=2000), 100)
    consumption.finish(store, results, "b", "b1")  # too late: another one has them
    return store, units


@register(f"""WITH {STEPS} SELECT doc_id AS unit, 'PROCESSED' AS state, 'a' AS owner, CASE WHEN doc_id % 2 = 1 THEN 'CANDIDATE' ELSE 'NO_CHANGE' END AS result FROM p UNION ALL SELECT doc_id, 'CLAIMED', 'c', NULL FROM b
    UNION ALL SELECT doc_id, 'RETRYABLE', 'a', 'FAILED' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM p) AND doc_id NOT IN (SELECT doc_id FROM b)""")
def q6_claimed_batches(spark, sf_dir):
    return consumed(spark, sf_dir)[0].read().select("unit", "state", "owner", "result")


@register(f"""WITH {STEPS} SELECT source, count(*) AS expected, count(p.doc_id) AS processed, CASE WHEN count(*) = count(p.doc_id) THEN 'ADVANCED' ELSE 'OPEN' END AS cursor FROM u LEFT JOIN p ON p.doc_id = u.doc_id GROUP BY source""")
def q5_cursors_of_batches(spark, sf_dir):
    return consumption.cursors(*consumed(spark, sf_dir), "source")
