import random
import re

from tessera.operators import mentions


def plain(texts, nodes, most):
    names = [(n.strip(" "), i) for n, i in nodes if n is not None and i is not None]
    unique = [(n, i) for n, i in names if len(n) >= 2 and sum(n == m for m, _ in names) == 1]
    for k, text in texts:
        seen, place = set(), 0
        for name, i in sorted(unique, key=lambda x: (-len(x[0]), x[0])):
            whole = rf"(?<![0-9A-Za-z]){re.escape(name)}(?![0-9A-Za-z])" if name.isdigit() else re.escape(name)
            if text and i not in seen and place < most and re.search(whole, text):
                seen.add(i)
                place += 1
                yield k, i, name, place


def test_mentions_equal_brute_force_in_one_shard_or_many(spark):
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("ab1é 建") for _ in range(rng.randint(a, b)))
    texts = [(k, word(0, 60)) for k in range(80)] + [(100, None), (101, ""), (102, "a" * 30_000 + "b1")]
    nodes = [(word(1, 5), rng.randrange(60)) for _ in range(90)] + [(None, 1), ("ab", None), ("a" * 300, 77), ("11", 78), ("  1b ", 79)]
    t = spark.createDataFrame(texts, "k long, text string").withColumnRenamed("text", "name")  # a clashing name
    n = spark.createDataFrame(nodes, "name string, id long")
    for most, shard in ((30, mentions.SHARD), (2, 7)):
        got = sorted(map(tuple, mentions.mentions(t, n, "k", "name", most, shard).collect()))
        assert got == sorted(plain(texts, nodes, most)) and got
    assert mentions.mentions(t, n.limit(0), "k", "name", 3).collect() == [] == mentions.mentions(t.limit(0), n, "k", "name", 3).collect()


def test_an_image_is_aligned_by_its_binding(spark):
    chunks = [(1, "东门 OCR", "image", "999", "远端绑定节点"), (2, "x", "image", "a", None), (3, "x", "image", "zz", None), (4, " ", "image", "a", None), (5, "东门", "text", "a", None), (6, "东门", "image", None, None)]
    got = mentions.aligned(spark.createDataFrame(chunks, "chunk long, content string, asset_type string, node string, node_name string"), spark.createDataFrame([("b", "东门"), ("a", "南门")], "id string, name string"), 30).collect()
    assert sorted((r["chunk"], r["node"], r["node_name"], r["method"], r["score"]) for r in got) == [
        (1, "999", "远端绑定节点", "ASSET_NODE_BINDING", 0.95), (2, "a", "南门", "ASSET_NODE_BINDING", 0.95), (3, "zz", "zz", "ASSET_NODE_BINDING", 0.95), (5, "b", "东门", "EXACT_NAME", 1.0),
    ]


def test_rules_give_claims_that_their_quotes_hold(spark):
    rules = [mentions.Rule("property", "built", r"built in ([0-9]{4})", 0.9), mentions.Rule("relation", " part of ", r"part of ([A-Z]\w+)", 2.0), mentions.Rule("background", "", r"(x)", 0.5), mentions.Rule("property", "blank", r"y( )", 0.5)]
    texts = spark.createDataFrame([(1, "part of Rome, built in 1900. y x built in 2001"), (2, None), (3, "")], "id long, text string")
    got = mentions.extracted(texts, "id", "text", rules).orderBy("id", "claim_no").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "RELATION", "part of", "Rome", "part of Rome", 0, 1.0, 0.35), (1, 2, "PROPERTY", "built", "1900", "built in 1900", 14, 0.9, 0.315), (1, 3, "PROPERTY", "built", "2001", "built in 2001", 33, 0.9, 0.315),
    ]
