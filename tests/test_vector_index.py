import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index


def clustered(rng, n, dim=12, spread=0.15):
    centers = rng.normal(size=(9, dim))
    x = centers[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, dim))
    x[5] = 0
    x[7:11] = x[6]  # ties
    return x


def frame(spark, ids, x, key, kind="double", **more):
    rows = [(int(i), [float(v) for v in r], *[c[k] for c in more.values()]) for k, (i, r) in enumerate(zip(ids, x, strict=True))]
    return spark.createDataFrame(rows, f"{key} long, vec array<{kind}>" + "".join(f", {c} int" for c in more))


def brute(qid, q, gid, g, metric):
    s = vector_index.scores(q, g, metric)
    for i, a in enumerate(qid):
        order = sorted((-s[i, j], int(b)) for j, b in enumerate(gid) if a != b)
        yield int(a), [(b, -x) for x, b in order]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("cells", [1, 7, 40])
def test_top_k_equals_all_pairs(spark, metric, cells):
    rng = np.random.default_rng(cells)
    x = clustered(rng, 700)
    ids = np.arange(700) + (1 << 60)
    q, qid = x[::20], ids[::20]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None] + [0.0] * 10), (4, [float("nan")] * 12), (5, [1.0])], "gid long, vec array<double>")
    gallery = frame(spark, ids, x, "gid")
    gallery = gallery.unionByName(odd if cells > 1 else odd.where("gid < 5"))
    got = {}
    for r in vector_index.top_k(frame(spark, qid, q, "qid"), gallery, 6, metric, cells).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["gid"], r["score"]))
    for a, want in brute(qid, q, ids, x, metric):
        assert [b for b, _ in got[a]] == [b for b, _ in want[:6]]
        assert np.allclose([s for _, s in got[a]], [s for _, s in want[:6]], atol=1e-9)


def test_pruning_leaves_cells_out(spark):
    rng = np.random.default_rng(0)
    x = clustered(rng, 2000, spread=0.02)
    gallery = frame(spark, range(2000), x, "gid")
    index = vector_index.build(gallery, "gid", metric="l2", cells=9)
    first = vector_index._first(index, 5)
    reached = vector_index._reached(index, "radius")
    radius = np.sort(vector_index.distances(x[::50], x), axis=1)[:, 6]
    assert (reached(x[::50], {"radius": radius}) | first(x[::50], {})).mean() < 0.4


@pytest.mark.parametrize("cells", [1, 12])
def test_count_ahead_and_first_hits(spark, cells):
    rng = np.random.default_rng(3)
    x, labels = clustered(rng, 600), rng.integers(0, 40, 600)
    ids = np.arange(600) * 3 + (1 << 61)
    labels[0] = 99  # no other vector has it
    q = frame(spark, ids[::30], x[::30], "qid", q_label=[int(v) for v in labels[::30]])
    g = frame(spark, ids, x, "gid", g_label=[int(v) for v in labels])
    label = dict(zip(ids.tolist(), labels.tolist(), strict=True))
    want, hits = {}, []
    for a, order in brute(ids[::30], x[::30], ids, x, "cosine"):
        want[a] = next((k for k, (b, _) in enumerate(order, 1) if label[b] == label[a]), None)
        hits.append((a, float(order[9][1]), order[9][0]))
    assert {r["qid"]: r["hit"] for r in retrieval.first_hits(q, g).collect()} == want and None in want.values()
    asked = q.join(spark.createDataFrame(hits, "qid long, score double, hit long"), "qid")
    assert {r["n"] for r in vector_index.count_ahead(asked, g, cells=cells).collect()} == {9}


def test_floats_stay_floats_and_empty_galleries_give_nothing(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 60).astype(np.float32)
    g = frame(spark, range(60), x, "gid", "float")
    rows = vector_index.packed(g, "gid", ["vec"]).select(F.length("vec")).distinct().collect()
    assert [r[0] for r in rows] == [48]
    q = frame(spark, [5, 100], x[5:7], "qid", "float")
    got = vector_index.top_k(q, g, 3).collect()
    assert len(got) == 6
    assert vector_index.top_k(q, g.limit(0), 3).collect() == [] == vector_index.top_k(q.limit(0), g, 3).collect()
    assert not any("CartesianProduct" in line or "NestedLoop" in line for line in retrieval.scored_pairs(q, g, 3)._jdf.queryExecution().toString().split("\n"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_scores_are_those_of_a_plain_loop_to_the_last_bit(metric):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(37, 64)), rng.normal(size=(50, 64))
    b[9] = b[8]
    b[9, 5] = np.nextafter(b[8, 5], 9)  # no more than a last bit apart

    def plain(x, y):
        dot = xx = yy = far = 0.0
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            dot, xx, yy, far = dot + p * q, xx + p * p, yy + q * q, far + (p - q) * (p - q)
        return dot / np.sqrt(xx * yy) if metric == "cosine" else -np.sqrt(far)

    assert (vector_index.scores(a, b, metric) == np.array([[plain(x, y) for y in b] for x in a])).all()


def test_vectors_meet_centers_in_slices():
    x = np.random.default_rng(3).normal(size=(2500, 4)).astype("f4")
    lists = [None if i % 7 == 0 else r for i, r in enumerate(x.tolist())]
    batch = pa.record_batch([pa.array(range(2500)), pa.array(lists, pa.list_(pa.float32()))], names=["id", "vec"])
    parts = list(vector_index.slices(iter([batch])))
    assert [p.num_rows for p in parts] == [1024, 1024, 452] and vector_index.SLICE == 1024
    packed = [vector_index.pack(p, "id", ["vec"], ["<f4"], []) for p in parts]
    assert pa.Table.from_batches(packed).to_pydict() == vector_index.pack(batch, "id", ["vec"], ["<f4"], []).to_pydict()


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_full_rankings_shuffle_no_pairs(spark, monkeypatch, metric):
    """A task holds no more than a group's scores, and results are those of all pairs."""
    monkeypatch.setattr(vector_index, "HELD", 8 * 300 * 7)
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "ROWS_OUT", 700)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[7] = x[3]
    g = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "gid long, vec array<float>").repartition(3)
    q = g.where("gid % 6 = 1").select(F.col("gid").alias("qid"), "vec")
    ranked = retrieval.scored_pairs(q, g, None, metric)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and [t for _, t in ranked.dtypes] == ["bigint", "bigint", "double", "int"]
    got = {}
    for r in ranked.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["gid"], r["score"], r["rank"]))
    for i in range(1, 300, 6):
        s = vector_index.scores(x[i : i + 1].astype(float), x.astype(float), metric)[0]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i]
        assert got[i] == [(j, s[j], k + 1) for k, j in enumerate(order)]
    assert len(got) == 50 and retrieval.scored_pairs(q.limit(0), g, None, metric).isEmpty() and retrieval.scored_pairs(q, g.limit(0), None, metric).isEmpty()


def test_visits_are_not_broadcast(spark, tmp_path):
    """Spark's estimate leaves out that a query's row is repeated for every block, so the driver would hold them all."""
    frame(spark, range(200), np.random.default_rng(1).normal(size=(200, 4)), "gid").write.parquet(f"{tmp_path}/g")
    g = spark.read.parquet(f"{tmp_path}/g")
    q = g.where("gid % 50 = 0").select(F.col("gid").alias("qid"), "vec")
    index = vector_index.build(g, "gid")
    met = vector_index.meet(q, "qid", index, vector_index.everywhere, lambda qid, *_: pd.DataFrame({"qid": qid}), "qid long")
    assert met.count() == 4 and "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
