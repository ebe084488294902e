import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, near_dedup, quality, queries, shingles, transcripts, vector_dedup

SMALL = "/root/testdata/sf0.001"


def classes_of(links, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


# ---- near copies


def multiset(text):
    w = (text or "").lower().split()
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute_classes(rows):
    sets = {i: multiset(t) for i, t in rows}
    links = []
    for (i, _), (j, _) in itertools.combinations(rows, 2):
        both = sum((sets[i] & sets[j]).values())
        if both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
            links.append((i, j))
    return classes_of(links, [i for i, _ in rows])


def near_rows():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(40, 200)))
        if k % 3 == 0:
            base = base[:20] * 8
        for edits in (0, 1, 2, 3, 4, 6, 9):
            text = list(base)
            for at in rng.integers(0, len(text), edits):
                text[at] = f"x{rng.integers(1000)}"
            rows.append((k, " ".join(text)))
            k += 1
    return rows + [(k, ""), (k + 1, None), (k + 2, "two words"), (k + 3, "Two  WORDS"), (k + 4, "a"), (k + 5, rows[0][1].upper())]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, id long, key long, sig string")
    classes, links = near_dedup.near_groups(docs)
    assert {r["id"]: r["class_id"] for r in classes.collect()} == brute_classes(rows)
    assert all(r["similarity"] >= 0.8 for r in links.collect())


@pytest.mark.parametrize("items", [4_000_000, 300])
def test_large_buckets_of_linked_and_unlinked_texts(spark, monkeypatch, items):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "ITEMS", items)
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(60)], []
    # One large group of near copies around a text, and chains that lead away from it.
    for k in range(60):
        text = list(base)
        text[int(rng.integers(60))] = f"x{k}"
        if k % 3 == 0:
            for at in rng.integers(0, 60, 4):
                text[at] = f"y{rng.integers(9)}"
        rows.append((k, " ".join(text)))
    classes, _ = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["class_id"] for r in classes.collect()} == brute_classes(rows)


def test_a_linked_bucket_is_not_compared_with_itself(spark):
    rows = [(1, k, 9, 3000, 12, 0) for k in range(3000)] + [(2, k, 9, 3000, 12, 0 if k else 1) for k in range(3000)] + [(3, k, 9, 2, 1, k) for k in range(2)]
    got = near_dedup.meetings(spark.createDataFrame(rows, "bucket long, key long, size long, n long, blocks int, comp long"))
    count = Counter(r["bucket"] for r in got.collect())
    assert count == {2: 2999 + 13, 3: 2}


def test_dropping_near_copies_names_rows_by_id_and_text(spark):
    one, two, three = "a b c d e f g h", "z y x w v u t s", "k l m n o p q r"
    rows = [(3, one), (5, "A b c d e f g h"), (5, two), (7, three), (7, three), (7, "K l m n o p q r"), (8, three), (None, one), (9, ""), (9, None)]
    kept = lambda rows: sorted(map(str, (tuple(r) for r in near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert kept(rows) == sorted(map(str, [(3, one), (5, two), (7, "K l m n o p q r"), (None, one), (9, ""), (9, None)]))
    assert kept([(1, one), (2, one), (4, two)]) == sorted(map(str, [(1, one), (4, two)]))


def test_repeated_null_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (None, "a b c d e f"), (None, None), (2, "Z y x w v u")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert sorted(str((r["id"], r["class_id"])) for r in got) == sorted(map(str, [(1, 1), (1, 1), (1, 1), (None, 1), (None, None), (2, 1)]))
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        a = [f"w{x}" for x in rng.integers(0, 40, 100)]
        b = list(a)
        for k in rng.integers(0, 100, 5):
            b[k] = "z"
        one, two = " ".join(a * 2 + ["r"] * 300), " ".join(b * 2 + ["r"] * int(rng.integers(200, 400)))
        doc, element, count, _ = shingles.shingles([one, two])
        sig = near_dedup.signatures(doc, element, count, 2, 1000)
        x, y = multiset(one), multiset(two)
        errors.append((sig[0] == sig[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components_and_their_contraction(spark):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    edges = spark.createDataFrame([*pairs, (7, None)], "a long, b long")
    want = classes_of(pairs, {x for p in pairs for x in p})
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(i == c for i, c in want.items() if i not in got)
    part = [(r["a"], r["b"]) for r in components.contracted(edges, 2).collect()]
    assert classes_of(part, want) == want
    assert components.components(edges.limit(0)).count() == 0


# ---- vectors


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 24))
    v = np.vstack([base + rng.standard_normal((30, 24)) * s for s in (0, 0, 0.1, 0.2, 0.3, 0.35, 0.45, 0.6)]).astype(np.float32)
    rows = [(k, x.tolist(), 0, "c") for k, x in enumerate(v)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 0.0], (v[0] * 1e-20).tolist()]
    rows += [(1000 + k, x, 0, "c") for k, x in enumerate(odd)]
    out = vector_dedup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, key string"))
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    u = np.vstack([v, v[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [*range(len(v)), 1007]
    near = np.argwhere(np.triu(u @ u.T >= 0.9, 1))
    links = [(ids[i], ids[j]) for i, j in near]
    want, count = classes_of(links, [r[0] for r in rows]), Counter(x for p in links for x in p)
    assert got == {i: (count[i], want[i], want[i] == i) for i in want}


@pytest.mark.parametrize("dim", [24, 64, 200])
def test_estimates_are_unbiased_and_bounded(monkeypatch, dim):
    rng = np.random.default_rng(4)
    z = rng.standard_normal((2, 400, dim))
    one, two = (vector_dedup.unit(x) for x in (z[0], 0.9 * vector_dedup.unit(z[0]) + 0.44 * vector_dedup.unit(z[1])))
    true = np.einsum("nd,nd->n", one, two)
    off, beyond = [], 0
    for seed in range(6):
        monkeypatch.setattr(vector_dedup, "SEED", 100 + seed)
        vector_dedup.rotations.cache_clear()
        dot, error = vector_dedup.estimates(vector_dedup.sketches(one, 10_000), vector_dedup.sketches(two, 10_000), dim)
        off.append(np.diag(dot) - true)
        beyond += (np.abs(off[-1]) > 3.5 * np.diag(error) * np.sqrt(np.maximum((1 - true**2) / 0.19, 1))).sum()
    vector_dedup.rotations.cache_clear()
    assert abs(np.mean(off)) < 0.006 and beyond <= 5


def test_recall_on_planted_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    one, z = (vector_dedup.unit(x) for x in rng.standard_normal((2, 6000, 64)))
    z = vector_dedup.unit(z - np.einsum("nd,nd->n", z, one)[:, None] * one)
    cosine = rng.uniform(0.9005, 0.93, 6000)
    v = np.vstack([one, cosine[:, None] * one + np.sqrt(1 - cosine**2)[:, None] * z])
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    links = sum(r["n_links"] for r in vector_dedup.groups(frame).collect())
    assert 2 * 6000 * 0.99 <= links <= 2 * 6000


def test_equal_64_bit_hashes_make_no_node(spark):
    rows = vector_dedup.nodes_of(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert (rows[0]["one"], rows[0]["two"]) == (rows[1]["one"], rows[1]["two"]) and len({r["one"] for r in rows} | {r["two"] for r in rows}) == 4


def test_no_vectors(spark):
    assert vector_dedup.groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ---- quality


def test_held_out_accuracy_and_fold(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_byte_cnn(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.93
    assert out.where(F.col("held_out") != (F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"))).isEmpty()


def test_scores_cover_whole_texts_and_odd_ones(spark):
    w = quality.new_weights()
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "é" * 5000, 1.0), (3, "é" * 5000, 1.0)], "doc_id long, text string, score double")
    got = sorted((r["id"], r["score"]) for r in quality.score(docs, w).collect())
    assert len(got) == 4 and all(0 <= s <= 1 for _, s in got) and got[0][1] == got[1][1] and got[2] == got[3]
    long = "plain words " * 5000
    assert quality.score_texts(w, [long])[0] != quality.score_texts(w, [long + "!! ### %%%" * 40])[0]
    data, places, counts = quality.chunks(["x" * 1000, None])
    assert counts.tolist() == [3, 1] and data.shape == (4, 512) and places.tolist() == [127, 127, 25, 1]
    assert quality.score(docs.limit(0), w).count() == 0


def naive_score(w, text):
    """The network by its definition, one filter and place at a time."""
    raw, pooled, places = (text or "").encode(), [], []
    for at in range(0, max(1, len(raw) - (quality.CHUNK - quality.STEP)), quality.STEP):
        chunk = raw[at : at + quality.CHUNK]
        n = min(max(1, -(-len(chunk) // 4) - 1), 127)
        chunk = chunk.ljust(quality.CHUNK, b"\0")
        tops = []
        for f in range(quality.FILTERS):
            best = -np.inf
            for p in range(n):
                window = [w["embed"][b] for b in chunk[4 * p : 4 * p + 8]]
                kernel = np.concatenate([w["left"][:, f], w["right"][:, f]]).reshape(8, quality.EMBED)
                best = max(best, sum(float(x @ k) for x, k in zip(window, kernel, strict=True)))
            tops.append(max(best + w["bias"][f], 0))
        pooled.append(tops)
        places.append(n)
    x = np.append(np.mean(pooled, axis=0), np.log2(np.mean(places)) / 7)
    return 1 / (1 + np.exp(-(np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"][0])))


def test_scores_match_a_naive_convolution():
    w = quality.new_weights(3)
    texts = ["", None, "a", "Plain words, é and more.", "x1 " * 170, "long text " * 110]
    got = quality.score_texts(w, texts)
    assert np.allclose(got, [naive_score(w, t) for t in texts], atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in quality.new_weights(5).items()}
    data, places, owner = rng.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8), np.array([127, 20, 127, 3, 127]), np.array([0, 0, 1, 2, 2])
    labels = np.array([1.0, 0.0, 1.0])
    _, g = quality.gradients(w, data, places, owner, labels)
    for name, x in w.items():
        flat = x.reshape(-1)
        for at in np.argsort(-np.abs(np.asarray(g[name]).reshape(-1)))[[0, 1, 5] if flat.size > 5 else [0]]:
            was, step = flat[at], 1e-3
            flat[at] = was + step
            up = quality.gradients(w, data, places, owner, labels)[0]
            flat[at] = was - step
            down = quality.gradients(w, data, places, owner, labels)[0]
            flat[at] = was
            want = (up - down) / (2 * step)
            assert np.isclose(np.asarray(g[name]).reshape(-1)[at], want, rtol=0.05, atol=1e-4), (name, at)


def test_training_takes_one_text_of_a_repeated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append(len(texts)) or quality.new_weights())
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(3, "other"), (4, None)], "doc_id long, text string")
    ids = [r["id"] for r in docs.select(F.col("doc_id").alias("id")).distinct().where(quality.fold_free(F.col("id"))).collect()]
    quality.train(docs, spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert seen == [len(ids)]


def test_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    w = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert 0 <= quality.score_texts(w, ["a"])[0] <= 1
    assert 0 <= quality.score_texts(quality.fit([[b"a"], [b"b"]], np.array([1.0, 1.0], np.float32)), ["a"])[0] <= 1


# ---- transcripts


def test_viterbi_over_blocks_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = len(transcripts.STATES)
    model = transcripts.Model(rng.random(n) * 9, rng.random((n, n)) * 9, rng.random((n, transcripts.N_OBS)) * 9)
    rows = [(c, k, 0, "x", int(rng.integers(transcripts.N_OBS))) for c, size in ((1, 1), (2, 3), (3, 70)) for k in range(size)]
    lines = spark.createDataFrame(rows, "conv long, turn long, part int, line string, obs int")

    def best(obs):
        score, back = model.step[n] + model.emit[:, obs[0]], []
        for o in obs[1:]:
            every = score[:, None] + model.step
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + model.emit[:, o]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    want = {(c, k): s for c in (1, 2, 3) for k, s in enumerate(best([r[4] for r in rows if r[0] == c]))}
    for block, fan in ((64, 256), (4, 3)):
        monkeypatch.setattr(transcripts, "BLOCK", block)
        monkeypatch.setattr(transcripts, "FAN", fan)
        assert {(r["conv"], r["turn"]): r["state"] for r in transcripts.parse(lines, model).collect()} == want


def test_roles_are_recovered_from_held_out_transcripts(spark):
    sf = "/root/testdata/sf0.01"
    out, truth = queries.op6_hmm_transcripts(spark, sf), spark.read.parquet(f"{sf}/conversations.parquet")
    rows = out.withColumnRenamed("role", "found").join(truth, ["conv_id", "turn"]).where("crc32(cast(cast(conv_id as string) as binary)) % 2 = 1")
    share = rows.agg(F.avg((F.col("found") == F.col("role")).cast("double"))).first()[0]
    assert out.count() == truth.count() and share >= 0.9


def test_counts_are_over_all_transcripts(spark, monkeypatch):
    sf, fit, seen = "/root/testdata/sf0.001", transcripts.fit, []
    monkeypatch.setattr(transcripts, "fit", lambda lines: seen.append(lines.select("conv").distinct().count()) or fit(lines))
    queries.op6_hmm_transcripts(spark, sf)
    assert seen == [spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()]


def test_roles_are_recovered_without_their_counts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = transcripts.raw_turns(turns, "conv_id", "turn", "role", "text")
    half = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 2
    model = transcripts.fit(transcripts.lines_of(raw.where(half == 0), "conv_id", "turn", "text", "role"))
    found = transcripts.rendered(transcripts.parse(transcripts.lines_of(raw.where(half == 1), "conv_id", "turn", "text"), model))
    rows = found.withColumnRenamed("conv", "conv_id").withColumnRenamed("role", "found").join(turns, ["conv_id", "turn"])
    assert rows.agg(F.avg((F.col("found") == F.col("role")).cast("double"))).first()[0] >= 0.9


def test_turns_that_the_parser_splits_and_merges(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 2)
    n = len(transcripts.STATES)
    # Only a marker opens a turn, whatever its role.
    emit = np.ones((n, transcripts.N_OBS))
    for k, (role, opening) in enumerate(transcripts.STATES):
        for obs in range(transcripts.N_OBS):
            emit[k, obs] = 1e6 if opening == (obs >= 8) and (not opening or obs // 8 == role + 1) else 1e-3
    model = transcripts.Model(np.ones(n), np.ones((n, n)), emit)
    turns = [(1, 0, "User: a\nBot: b\nmore"), (1, 5, "and more"), (1, 6, "still"), (1, 9, "Human: c"), (2, 3, "System: s"), (2, 4, "")]
    lines = transcripts.lines_of(spark.createDataFrame(turns, "c long, t long, x string"), "c", "t", "x")
    parsed = transcripts.stage_table(transcripts.parse(lines, model), "parsed")
    got = sorted((r["conv"], r["turn"], r["part"], r["role"], r["lines"], r["until"], r["text"]) for r in transcripts.recovered(parsed).collect())
    assert got == [
        (1, 0, 0, "user", 1, 0, "<|user|>\na"), (1, 0, 1, "assistant", 4, 6, "<|assistant|>\nb\nmore\nand more\nstill"),
        (1, 9, 0, "user", 1, 9, "<|user|>\nc"), (2, 3, 0, "system", 2, 4, "<|system|>\ns\n"),
    ]
    rows = {(r["conv"], r["turn"]): (r["role"], r["opened"], r["text"]) for r in transcripts.rendered(parsed).collect()}
    assert rows[1, 0] == ("user", 2, "<|user|>\na\n<|assistant|>\nb\nmore\nand more\nstill") and rows[1, 5] == ("assistant", 0, None) and len(rows) == 6


def test_gaps_and_rows_without_ids(spark):
    turns = [(1, 0, "user", "User: a"), (1, 7, "assistant", "Bot: b"), (1, 900, "user", "User: c"), (None, 3, "user", "x"), (None, 4, "system", "y")]
    lines = transcripts.lines_of(spark.createDataFrame(turns, "c long, t long, r string, x string"), "c", "t", "x", "r")
    model = transcripts.fit(transcripts.stage_table(lines, "lines"))
    n = len(transcripts.STATES)
    start, step = np.zeros(n), np.zeros((n, n))
    user, assistant, system = (transcripts.STATES.index((transcripts.ROLES.index(r), True)) for r in ("user", "assistant", "system"))
    start[user], start[system], step[user, assistant], step[assistant, user] = 2, 1, 1, 1
    want = transcripts.Model(start, step, np.zeros((n, transcripts.N_OBS)))
    assert np.array_equal(model.step, want.step)
    assert lines.where("conv = -1").select("lone").distinct().count() == 2 and lines.where("conv = 1 AND lone <> 0").isEmpty()


def test_odd_turns(spark):
    turns = spark.createDataFrame([(None, None, None, 1), (1, 0, "User: a\n\nb", 1), (1, 0, "User: a\n\nb", 1), (1, -70, "[bot] hi", 1)], "conv_id long, turn long, text string, obs int")
    n = len(transcripts.STATES)
    model = transcripts.Model(np.zeros(n), np.zeros((n, n)), np.zeros((n, transcripts.N_OBS)))
    lines = transcripts.lines_of(turns, "conv_id", "turn", "text")
    rows = transcripts.rendered(transcripts.parse(lines, model)).collect()
    assert sorted((r["conv"], r["turn"]) for r in rows) == [(-1, 0), (1, -70), (1, 0)]
    assert transcripts.parse(lines.limit(0), model).count() == 0


# ---- the pipeline


def test_pipeline_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stage_table(stage(spark, kept, SMALL), name)
        assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == kept.count()
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    texts = [r["text"] for r in kept.collect()]
    assert len({" ".join(x.split()) for x in texts}) == len(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert pieces.select("doc_id").distinct().count() == counts[-1]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert all(i == c for i, c in classes.items())
