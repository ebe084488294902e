"""Lattice scores, filter interactions and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tessera.llm import filter_audit, lattice, periodic, queries

from ..oracle import check

SMALL = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use for their own."""
    return spark.createDataFrame([(*r, "x", 1, "k", 7, 5, True, "d") for r in rows], "doc_id long, text string, source string, key string, n long, part string, id long, row long, held_out boolean, digest string")


# Lattice


@pytest.fixture(scope="module")
def model():
    return lattice.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def every_way(model, text):
    """The sum over all segmentations, one by one."""
    if not text:
        return 1.0
    total = 0.0
    for k in range(1, len(text) + 1):
        if text[:k] in model.pieces:
            total += math.exp(model.pieces[text[:k]]) * every_way(model, text[k:])
    if text[0] not in model.pieces:
        total += math.exp(model.byte * len(text[0].encode())) * every_way(model, text[1:])
    return total


@pytest.mark.parametrize("word", ["a", "the", "there", "résumé", "zz9", "日本語", "a\U0001f9ff", "qqqqqq"])
def test_forward_sums_all_segmentations(model, word):
    assert model.log10(word.encode()) == pytest.approx(math.log10(every_way(model, lattice.SPACE + word)), rel=1e-12)


def test_probabilities_of_pieces_bytes_and_end_sum_to_one(model):
    assert math.fsum(map(math.exp, model.pieces.values())) + 256 * math.exp(model.byte) + math.exp(model.end) == pytest.approx(1)


def test_space_sign_in_a_word_costs_bytes(model):
    sign = math.exp(3 * model.byte)
    assert 10 ** model.log10("▁".encode()) == pytest.approx(math.exp(model.pieces["▁"]) * sign)


def plain_scores(model, rows):
    split = [(i, lattice.tokens((t or "").encode())) for i, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in split]
    c = Counter(w for (_, words), h in zip(split, held, strict=True) if not h for w in words)
    n = sum(c.values())
    for (i, words), h in zip(split, held, strict=True):
        base = math.fsum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in words)
        yield (i, h, len(words), sum(c[w] > 0 for w in words), n, base, math.fsum(map(model.log10, words)))


def same_scores(got, want):
    order = lambda r: tuple((x is None, 0 if x is None else round(x, 5)) for x in r)
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-11)


@pytest.mark.parametrize("common", [1, 64, lattice.COMMON])
def test_scores_equal_a_plain_count(spark, model, common):
    """Whether words are broadcast or joined."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same_scores(lattice.score(docs, path, common=common).collect(), plain_scores(model, list(zip(rows["doc_id"], rows["text"], strict=True))))


def test_scores_of_odd_rows(spark, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    long_word = "ab" * 5000
    rows = [(1, None, "s"), (2, "", "s"), (3, " \t\n ", "s"), (4, "A a\x0bB\x85c d", "s"), (4, "A a\x0bB\x85c d", "s"), (4, "other", "s"), (None, "a b", "s"), (None, None, "s"), (5, f"{long_word} {long_word} {long_word[:-1]}", "s"), (6, "a " * 20000, "s"), (7, "▁ 日本 é É", "s")]
    same_scores(lattice.score(documents(spark, rows), path).collect(), plain_scores(model, rows))
    same_scores(lattice.score(documents(spark, rows), path, common=2).collect(), plain_scores(model, rows))
    assert lattice.score(documents(spark, []), path).collect() == []
    held = [r for r in rows if r[0] is None]
    same_scores(lattice.score(documents(spark, held), path).collect(), plain_scores(model, held))


def test_learnt_scores_are_probabilities_near_the_base(spark, model):
    """Held-out rows score finitely and not far below the word counts; the parts are those of a plain computation."""
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = queries.op11_subword_lattice(spark, SMALL).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows["doc_id"]) and all(math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in held) > 1.25 * sum(r["base_score"] for r in held)
    split = [(i, lattice.tokens((t or "").encode())) for i, t in zip(rows["doc_id"], rows["text"], strict=True)]
    c = Counter(w for i, words in split if zlib.crc32(str(i).encode()) % 10 for w in words)
    n, once, twice = sum(c.values()), *[sum(x == k for x in c.values()) for k in (1, 2)]
    d = once / (once + 2 * twice)
    learnt = model.learnt(Counter(p for w in c if 0 < len(w) <= lattice.LONG for p in model.likeliest(lattice.signs(w))))
    assert math.fsum(map(math.exp, learnt.pieces.values())) + 256 * math.exp(learnt.byte) + math.exp(learnt.end) == pytest.approx(1)

    def plain(word):
        part = learnt.log10(word) + math.log10(d * len(c) / n)
        whole = math.log10((c[word] - d) / n) if c[word] else -math.inf
        return max(part, whole) + math.log10(1 + 10 ** -abs(part - whole))

    want = {i: math.fsum(map(plain, words)) for i, words in split}
    assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], rtol=1e-9)


def test_pieces_learn_from_long_words(spark, model):
    """Training words of any length weight the pieces, each once; those of held-out rows do not."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"A {'Longwörd' * 30} b", f"{'Longwörd' * 30} {'c_' * 40}\t{'日本語' * 9}", "x" * 64 + " " + "x" * 65, None, "d " + "é#" * 50, "held_" * 20]
    rows = [(i, t, "s") for i, t in zip(range(1, 7), texts, strict=True)]  # 6 is held out
    split = [(i, lattice.tokens((t or "").encode())) for i, t, _ in rows]
    c = Counter(w for i, words in split if zlib.crc32(str(i).encode()) % 10 for w in words)
    n, once, twice = sum(c.values()), *[sum(x == k for x in c.values()) for k in (1, 2)]
    d = once / (once + 2 * twice) if once and twice else lattice.DISCOUNT
    learnt = model.learnt(Counter(p for w in c if w for p in model.likeliest(lattice.signs(w))))

    def plain(word):
        part = learnt.log10(word) + math.log10(d * len(c) / n)
        whole = math.log10((c[word] - d) / n) if c[word] else -math.inf
        return max(part, whole) + math.log10(1 + 10 ** -abs(part - whole))

    assert sum(len(w) > lattice.LONG for w in c) == 5
    got = {r["id"]: (r["held_out"], r["score"]) for r in lattice.score(documents(spark, rows), path, learn=True).collect()}
    assert sum(h for h, _ in got.values()) == 1
    for i, words in split:
        assert got[i][1] == pytest.approx(math.fsum(map(plain, words)), rel=1e-9)


def test_learning_from_nothing_keeps_the_file(spark, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = [(None, "a b " + "ab" * 50, "s"), (None, None, "s")]
    same_scores(lattice.score(documents(spark, held), path, learn=True).collect(), plain_scores(model, held))
    assert lattice.score(documents(spark, []), path, learn=True).collect() == []


# Filters


def plain_audit(rows, labels):
    marks = []
    for i, text, source in rows:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = dict(A=len(words) < 200, B=100 * len(set(words)) < 50 * len(words), C=100 * capitals > 2 * len(text), D=any(c in "#$%&*|" for c in text), E=earlier)
        marks.append((source or "", fails, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(t == 1 for j, _, t in labels if j == i and i is not None)))
    out, removed = [], Counter()
    for part in sorted({m[0] for m in marks}):
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in marks if m[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                fails = [m for m in every if m[1][f]]
                removed[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), len(fails) - len(gone), sum(sum(m[1].values()) == 1 for m in fails), sum(m[2] for m in gone), sum(m[3] for m in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "ABC", "a # b", "w " * 300, " ".join(map(str, range(250))), " ".join(map(str, range(199))), "É" * 60 + "A", "Aé" + "a" * 97, "Aé" + "a" * 48]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "x", "y", "zé"])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(30), *range(10)]]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows).repartition(3), frame).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, labels)
    assert filter_audit.audit(documents(spark, []), frame).collect() == []
    assert sorted(map(tuple, filter_audit.audit(documents(spark, rows), frame.limit(0)).collect())) == plain_audit(rows, [])


def test_audit_matches_its_sql(spark):
    check(spark, SMALL, queries.QUERIES["op12_filter_interactions"], queries.ORACLES["op12_filter_interactions"])


def test_bitmap_counts_equal_counting(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    parts, bits = rng.integers(0, 5, 1001), rng.integers(0, 32, 1001).astype(np.int32)
    names, counts = filter_audit.bitmap_counts(pa.array([str(p) for p in parts]), bits, 3, 2)
    for k, name in enumerate(names.to_pylist()):
        own = bits[parts == int(name)]
        for subset in range(8):
            left = own[(own & subset) == 0]
            assert counts[k, subset].tolist() == [len(left), int((left >> 3 & 1).sum()), int((left >> 4 & 1).sum())]


# Periodic runs


def every_run(words):
    """Each stretch with its smallest period, widened as far as it goes."""
    n, out = len(words), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, length = i, j - i + p
            if j > i and length >= max(24, 3 * p) and not any(p % q == 0 and all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                out.add((start, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        b = min(n, a + p * rng.randrange(2, 7) + rng.randrange(p))
        words[a:b] = [words[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, b)]
    return words


@pytest.mark.parametrize("seed", range(150))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = some_words(rng, rng.randrange(1, 260), rng.choice([1, 2, 3, 8, 200]))
    ids = periodic.word_ids([str(w).encode() for w in words])
    want = every_run(words)
    assert periodic.runs(ids) == want
    assert periodic.runs(ids, direct=0) == want  # by block hashes
    top = max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    assert periodic.strongest(want) == top
    dropped = {i for s, size, q in want for i in range(s + q, s + size)}
    assert periodic.collapsed([*range(len(words))], want) == [i for i in range(len(words)) if i not in dropped]


def test_long_text_of_one_word_and_of_two_levels():
    n = 60_000
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    inner = [0] * 30 + [*range(1, 40)]
    got = periodic.runs(np.array(inner * 900))
    assert got[0] == (0, 30, 1) and (0, len(inner) * 900, len(inner)) in got and len(got) == 901


def scanned(text):
    words = [w for w in (text or "").encode().split()]
    found = every_run(words)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def test_query_equals_brute_force_with_planted_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(map(str, some_words(rng, rng.randrange(1, 150), 4))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (None, "a b " * 40, "s"), (3, rows[3][1], None), (104, "x" * 100_000, "s"), (105, "\t".join(["é", "è"] * 30), "s")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join([*words[:a], *(words[a + (k - a) % p] for k in range(a, n))]).decode()
        want.append((i, *scanned(text)))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert any(r[1] for r in want)
    assert periodic.scan(documents(spark, [])).collect() == []


def test_vector_groups_match_their_sql(spark, tmp_path):
    """On a table with links, as the given one has none."""
    import duckdb

    from ..oracle import rows

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x[200:300] = x[:100] + 0.05 * rng.normal(size=(100, 64))
    x[300:330] = x[250:280]
    x[399] = 0
    spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op9_rotation_codes"]).fetchdf()
    got = queries.op9_rotation_codes(spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(want) and got["n_links"].sum() > 200
