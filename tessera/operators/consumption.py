"""Evidence that workers take in batches with leases, kept in a snapshot table: each unit (unit, hash) has a state, an owner, the
end of its lease and a result.

A unit may be taken while it has no row, has failed or is to be tried again, or while its claim's lease has ended.  A claim and
its end are batches of the table, so a step that is tried again after a crash, or comes twice, has its effect once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.snapshots import Snapshots

from .evidence import IMAGES, LEASE, TEXTS
from .queues import cursor_state

KEY = ["unit", "hash"]
OPEN = ("FAILED", "RETRYABLE")


def table(spark, path: str) -> Snapshots:  # noqa: ANN001
    return Snapshots(spark, path, KEY)


def claimable(units: DataFrame, consumed: DataFrame | None, now: dt.datetime) -> DataFrame:
    """The ``units`` (unit, hash, is_image, created) that may be taken at a time."""
    if consumed is None:
        return units
    held = F.col("state").isin(*OPEN) | ((F.col("state") == "CLAIMED") & (F.col("lease") < F.lit(now)))
    taken = consumed.where(~F.coalesce(held, F.lit(False))).select(*KEY)
    return units.join(taken, KEY, "left_anti")


def claim(store: Snapshots, units: DataFrame, worker: str, batch: str, now: dt.datetime, texts: int = TEXTS, images: int = IMAGES) -> DataFrame:
    """What a worker gets as the batch of a name: the first ``texts`` texts and ``images`` images that may be taken, by time and unit.
    The same name gives the same units again."""
    if f"claim:{batch}" not in store.manifest()["batches"]:
        rows = claimable(units, store.read(), now)
        place = F.row_number().over(W.partitionBy("is_image").orderBy("created", "unit"))
        first = rows.orderBy("created", "unit")
        # A top-k of either kind; what is numbered has no more rows than that.
        some = first.where("NOT is_image").limit(texts).unionByName(first.where("is_image").limit(images)).withColumn("place", place)
        lease = F.lit(now + dt.timedelta(seconds=LEASE))
        rows = some.select(*KEY, F.lit("CLAIMED").alias("state"), F.lit(worker).alias("owner"), F.lit(batch).alias("batch"), lease.alias("lease"), F.lit(None).cast("string").alias("result"))
        store.upsert(rows, [F.col("unit")], f"claim:{batch}")
    return store.read().where((F.col("batch") == batch) & (F.col("state") == "CLAIMED")).select(*KEY)


def finish(store: Snapshots, results: DataFrame, worker: str, batch: str) -> None:
    """End a worker's batch with results (unit, hash, ok, candidates): units that went well are PROCESSED, as CANDIDATE or NO_CHANGE; those
    that failed or have no result are RETRYABLE.  Units that another worker has taken meanwhile are left alone."""
    now = store.read()
    if now is None:
        return
    own = now.where((F.col("batch") == batch) & (F.col("owner") == worker) & (F.col("state") == "CLAIMED")).select(*KEY)
    one = results.groupBy(*KEY).agg(F.min("ok").alias("ok"), F.max("candidates").alias("candidates"))
    ok = F.coalesce("ok", F.lit(False))
    result = F.when(~ok, "FAILED").when(F.coalesce("candidates", F.lit(0)) > 0, "CANDIDATE").otherwise("NO_CHANGE")
    rows = own.join(one, KEY, "left").select(
        *KEY, F.when(ok, "PROCESSED").otherwise("RETRYABLE").alias("state"), F.lit(worker).alias("owner"), F.lit(batch).alias("batch"), F.lit(None).cast("timestamp").alias("lease"), result.alias("result")
    )
    store.upsert(rows, [F.col("unit")], f"finish:{batch}")


def cursors(store: Snapshots, units: DataFrame, source: str) -> DataFrame:
    """(source, expected, processed, cursor) over all units (unit, hash, source) of each source: ADVANCED when all are PROCESSED."""
    now = store.read()
    done = units.select(*KEY).where("false") if now is None else now.where("state = 'PROCESSED'").select(*KEY)
    rows = units.join(done.withColumn("_done", F.lit(1)), KEY, "left").groupBy(source).agg(F.count(F.lit(1)).alias("expected"), F.count("_done").alias("processed"))
    return rows.withColumn("cursor", cursor_state(F.col("expected"), F.col("processed")))
