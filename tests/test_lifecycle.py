import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import consumption
from tessera.sources import snapshots
from tessera.streaming import jobs

BASE = dt.datetime(2024, 1, 1)


def some_events(rng, n):
    kinds = ["ENQUEUE", "CLAIM", "HEARTBEAT", "DONE", "FAIL", "SCOPE"]
    at = 0
    for _ in range(n):
        at += rng.randrange(1, 700)
        e = rng.choices(kinds, [1, 4, 4, 1, 2, 2])[0]
        yield rng.randrange(6), BASE + dt.timedelta(seconds=at), e, rng.choice("vw"), rng.choice([None, rng.randrange(140)]), rng.choice("xyz"), rng.choice(["PROCESSED", "processed", "RETRYABLE"])


def plain(events, now):
    """One job at a time, in a style of its own."""
    out = {}
    for key in {e[0] for e in events}:
        s, n, p, owner, lease, scopes = "NEW", 0, 0, "", None, {}

        def lapse(at):
            nonlocal s, p, owner, lease
            if s == "RUNNING" and lease < at:  # noqa: B023
                s, p, owner, lease = ("FAILED", 100, "", None) if n >= 3 else ("PENDING", p, "", None)  # noqa: B023

        for _, at, e, w, q, scope, state in sorted((x for x in events if x[0] == key), key=lambda x: x[1]):
            lapse(at)
            own = s == "RUNNING" and owner == w
            if e == "SCOPE":
                scopes[scope] = state
            elif e == "ENQUEUE" and s == "NEW":
                s = "PENDING"
            elif e == "CLAIM" and s in ("PENDING", "RETRYABLE") and n < 3:
                s, n, owner, lease = "RUNNING", n + 1, w, at + dt.timedelta(seconds=900)
            elif e == "HEARTBEAT" and own:
                p, lease = max(p, min(100, q or 0)), at + dt.timedelta(seconds=900)
            elif e == "DONE" and own:
                s, p, owner, lease = "DONE", 100, "", None
            elif e == "FAIL" and own:
                s, owner, lease = ("FAILED" if n >= 3 else "RETRYABLE"), "", None
        lapse(now)
        done = sum(x.upper() == "PROCESSED" for x in scopes.values())
        out[key] = (s, n, p, owner, lease, len(scopes), done, "ADVANCED" if scopes and done == len(scopes) else "OPEN")
    return out


def by_job(rows):
    return {r["job"]: tuple(r)[1:9] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_lives_equal_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    events = list(some_events(rng, 120))
    now = events[-1][1] + dt.timedelta(seconds=rng.choice([1, 5000]))
    got = jobs.lives(spark.createDataFrame([*events, (None, BASE, "CLAIM", "w", 1, "x", "y")], jobs.EVENTS), now).collect()
    assert by_job(got) == plain(events, now)


def test_the_stream_ends_as_the_batch_does_across_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(9)
    events = list(some_events(rng, 60))
    end = events[-1][1] + dt.timedelta(days=1)
    # A last event far behind them moves the watermark past all leases.
    late = [(99, end, "ENQUEUE", "v", 0, "x", "y")]
    parts = [events[:20], events[20:40], events[40:], late, [(99, end + dt.timedelta(hours=2), "SCOPE", "v", 0, "x", "PROCESSED")]]
    table = snapshots.Snapshots(spark, f"{tmp_path}/table", ["job"])
    for k, part in enumerate(parts):
        spark.createDataFrame(part, jobs.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # Each run begins from the checkpoint of the one before.
        stream = jobs.live(spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        stream = stream.withColumn("k", F.struct("attempts", "scopes", "progress", F.col("status") != "RUNNING"))
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).foreachBatch(table.sink([F.col("k")], "lives")).start().awaitTermination()
        assert k or table.read().count()
    got = by_job(table.read().drop("k", "digest", "version").select("job", "status", "attempts", "progress", "owner", "lease", "scopes", "processed", "cursor").collect())
    assert got == plain([*events, *late, *parts[4]], end)


def rows(spark, *items):
    return spark.createDataFrame(items, "id long, name string, at int")


def test_a_batch_is_applied_once_and_known_rows_stay(spark, tmp_path):
    t = snapshots.Snapshots(spark, f"{tmp_path}/t", ["id"])
    assert t.read() is None
    order = [F.col("at")]
    first = t.upsert(rows(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1)), order, "x:0")
    assert (first["version"], first["rows"], first["changed"]) == (1, 3, 3)
    assert t.upsert(rows(spark, (9, "z", 1)), order, "x:0") == first
    again = t.upsert(rows(spark, (1, "b", 2), (None, "n", 1)), order, "y:0")
    assert (again["rows"], again["changed"]) == (3, 0)
    third = t.upsert(rows(spark, (1, "B", 3), (2, None, 2), (3, "d", 1)), order, "x:1", deleted=F.col("name").isNull())
    assert (third["rows"], third["changed"]) == (3, 2)
    assert sorted((str(r["id"]), r["name"], r["version"]) for r in t.read().collect()) == [("1", "B", 3), ("3", "d", 3), ("None", "n", 1)]
    assert sorted(r["name"] for r in t.read(1).collect()) == ["b", "c", "n"]


def test_a_killed_batch_leaves_the_table_and_runs_again(spark, tmp_path, monkeypatch):
    t, order = snapshots.Snapshots(spark, f"{tmp_path}/t", ["id"]), [F.col("at")]
    t.upsert(rows(spark, (1, "a", 1)), order, "x:0")

    def die(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "put", die)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows(spark, (2, "b", 1)), order, "x:1")
    assert [r["id"] for r in t.read().collect()] == [1] and t.latest() == 1
    t.upsert(rows(spark, (2, "b", 1)), order, "x:1")
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2]


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    t, order, other = snapshots.Snapshots(spark, f"{tmp_path}/t", ["id"]), [F.col("at")], []
    put = snapshots.put

    def late(spark, path, text, replace):
        if not other:
            other.append(1)
            snapshots.Snapshots(spark, f"{tmp_path}/t", ["id"]).upsert(rows(spark, (7, "o", 1)), order, "o:0")
        put(spark, path, text, replace)

    monkeypatch.setattr(snapshots, "put", late)
    m = t.upsert(rows(spark, (1, "a", 1)), order, "x:0")
    assert m["version"] == 2 and m["batches"] == ["o:0", "x:0"]
    assert sorted(r["id"] for r in t.read().collect()) == [1, 7]


def test_documents_are_replaced_at_once(spark, tmp_path):
    path = f"{tmp_path}/d/x.json"
    assert snapshots.get(spark, path) is None
    snapshots.put(spark, path, '{"é": 1}', replace=True)
    snapshots.put(spark, path, "[2]", replace=True)
    assert snapshots.get(spark, path) == "[2]"
    with pytest.raises(snapshots.Conflict):
        snapshots.put(spark, path, "3", replace=False)
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_batches_of_evidence_are_taken_once(spark, tmp_path):
    units = spark.createDataFrame([(k, f"h{k}", k % 3 == 0, 10 - k) for k in range(10)], "unit long, hash string, is_image boolean, created int")
    store = consumption.table(spark, f"{tmp_path}/c")
    ids = lambda rows: sorted(r["unit"] for r in rows.collect())
    take = lambda worker, name, seconds: ids(consumption.claim(store, units, worker, name, BASE + dt.timedelta(seconds=seconds), 2, 1))
    assert take("a", "1", 0) == [7, 8, 9] == take("a", "1", 5)  # by time, so from the last unit on
    assert take("b", "2", 10) == [4, 5, 6]
    result = spark.createDataFrame([(7, "h7", True, 0), (8, "h8", True, 2), (8, "h8", False, 2), (4, "h4", True, 1)], "unit long, hash string, ok boolean, candidates int")
    consumption.finish(store, result, "a", "1")
    consumption.finish(store, result, "a", "1")
    state = {r["unit"]: (r["state"], r["owner"], r["result"]) for r in store.read().collect()}
    assert state[7] == ("PROCESSED", "a", "NO_CHANGE") and state[8] == ("RETRYABLE", "a", "FAILED") and state[9] == ("RETRYABLE", "a", "FAILED") and state[4] == ("CLAIMED", "b", None)
    assert take("c", "3", 20) == [2, 8, 9] and take("d", "4", 911) == [4, 5, 6]
    # A changed text is another unit.
    again = consumption.claim(store, units.where("unit = 7").withColumn("hash", F.lit("new")), "e", "5", BASE, 5, 5)
    assert ids(again) == [7]
