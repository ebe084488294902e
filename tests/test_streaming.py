from pyspark.sql import functions as F

from tessera.plans import rollups
from tessera.streaming import states

SMALL = "/root/testdata/sf0.001"


def test_stream_of_states_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id")
    for k, (lo, hi) in enumerate(((0, 300), (300, 700), (700, 10**9))):
        events.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = rollups.task_events(states.read_events(spark, str(tmp_path / "in"), schema))
    states.run_once(states.machine_states(stream, "user_id", ["ts", "event_id"], "event"), "machine", str(tmp_path / "ck"))
    got = {r["user_id"]: (r["state"], r["moves"]) for r in spark.table("machine").collect()}
    want = {r["user_id"]: (r["state"], r["moves"]) for r in rollups.q9_state_machine(spark, SMALL).collect()}
    assert got == want


def test_windowed_counts_see_every_event(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = states.windowed_counts(states.read_events(spark, str(tmp_path / "in"), schema), "ts", "event_type")
    states.run_once(rows, "windows", str(tmp_path / "ck"), "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()
