"""Names in whole texts by Aho-Corasick automata, and claims in texts by rules; both as Arrow table functions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import stages

#: Names of one automaton at most: they are broadcast, one shard at a time.
SHARD = 1 << 16
#: Fixed value: characters of a claim's quote at most.
QUOTE = 800
#: Fixed value: what a claim's confidence counts for before it is checked.
UNCHECKED = 0.35

_kept: dict[str, tuple] = {}


def automaton(shared, label: str) -> tuple:  # noqa: ANN001
    """(Aho-Corasick automaton, names, ids) of a broadcast (names, ids); a worker keeps the one at hand."""
    if label not in _kept:
        import ahocorasick

        names, ids = shared.value
        a = ahocorasick.Automaton()
        for k, name in enumerate(names):
            a.add_word(name, k)
        a.make_automaton()
        _kept.clear()
        _kept[label] = a, names, ids
    return _kept[label]


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no ASCII letter or digit touches text[start:end]."""
    return not any(c.isascii() and c.isalnum() for c in (text[start - 1 : start], text[end : end + 1]) if c)


def held(found: tuple, text: str, most: int) -> list[int]:
    """Numbers of the names that a text holds, the longest first, ties by name; one of each node, ``most`` at most.  A name of
    digits must stand alone."""
    a, names, ids = found
    if not names:
        return []
    numbers = {k for end, k in a.iter(text) if not names[k].isdigit() or _alone(text, end + 1 - len(names[k]), end + 1)}
    seen, out = set(), []
    for k in sorted(numbers, key=lambda k: (-len(names[k]), names[k])):
        if ids[k] not in seen:
            seen.add(ids[k])
            out.append(k)
            if len(out) == most:
                break
    return out


def finder(shared, key: str, schema: StructType, most: int):  # noqa: ANN001, ANN201
    """The table function (key, text) -> (key, id, name) over one shard of names."""
    label = uuid.uuid4().hex
    types = [pa.field(f.name, t) for f, t in zip(schema.fields, _arrow(schema), strict=True)]

    @F.arrow_udtf(returnType=schema)
    class Find:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            found = automaton(shared, label)
            keys, ids, names = [], [], []
            for row, text in enumerate(rows.column("_text")):
                for k in held(found, text.as_py() or "", most):
                    keys.append(row)
                    ids.append(found[2][k])
                    names.append(found[1][k])
            yield pa.table([rows.column(key).take(pa.array(keys, pa.int64())), pa.array(ids, types[1].type), pa.array(names, types[2].type)], schema=pa.schema(types))

    return Find


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def unique_names(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(name, id) of nodes (name, id) whose name, of ``least`` characters or more, no other row has."""
    rows = nodes.select(F.trim("name").alias("name"), "id").where((F.length("name") >= least) & F.col("id").isNotNull())
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def mentions(texts: DataFrame, nodes: DataFrame, key: str, text: str, most: int, shard: int = SHARD) -> DataFrame:
    """(key, id, name, place): the unique names of ``nodes`` (id, name) that ``texts`` (key, text) hold, the longest first and
    ties by name, a node once and ``most`` nodes a text.  A name that is a number must not touch other letters or digits.

    Names are dealt to shards of about ``shard`` by a hash.  Each shard is one pass over the texts with one automaton, whatever
    the lengths of the names; a pass hands on ``most`` rows of a text at most, which is all that can be among the first ``most``
    of all shards.  Null texts hold nothing; rows that repeat a key are one text's parts."""
    names = stages.stage(unique_names(nodes).withColumn("_h", F.xxhash64("name")), "names")
    count = max(1, -(-names.count() // shard))
    rows = texts.select(key, F.col(text).cast("string").alias("_text"))
    schema = StructType([texts.schema[key], nodes.schema["id"], nodes.schema["name"]])
    found = None
    for k in range(count):
        own = names.where(F.pmod("_h", F.lit(count)) == k).select("name", "id").toPandas()
        shared = texts.sparkSession.sparkContext.broadcast((own["name"].tolist(), own["id"].tolist()))
        part = finder(shared, key, schema, most)(rows.asTable())
        if count > 1:
            part = stages.stage(part, "mentions")
        found = part if found is None else found.unionByName(part)
    order = [F.desc(F.length("name")), F.col("name")]
    found = found.repartition(key)  # serves both windows
    found = found.withColumn("_n", F.row_number().over(W.partitionBy(key, "id").orderBy(*order))).where("_n = 1").drop("_n")
    found = found.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return found.where(F.col("place") <= most).select(key, "id", "name", "place")


def aligned(chunks: DataFrame, nodes: DataFrame, most: int, shard: int = SHARD) -> DataFrame:
    """(chunk, node, node_name, mention, method, score) of chunks (chunk, content, asset_type, node, node_name): a text's chunk is
    aligned to the nodes (id, name) that it names, an image's with some content to the node that it is bound to, whatever its
    content names.  The name of a bound node is that in ``nodes``, else the chunk's own, else its id."""
    image = F.coalesce(F.col("asset_type") == "image", F.lit(False))
    named = mentions(chunks.where(~image), nodes, "chunk", "content", most, shard)
    named = named.select("chunk", F.col("id").alias("node"), F.col("name").alias("node_name"), F.col("name").alias("mention"), F.lit("EXACT_NAME").alias("method"), F.lit(1.0).alias("score"))
    known = nodes.groupBy(F.col("id").alias("node")).agg(F.max(F.trim("name")).alias("_name"))
    bound = chunks.where(image & (F.trim(F.coalesce("content", F.lit(""))) != "") & F.col("node").isNotNull()).join(known, "node", "left")
    name = F.coalesce("_name", F.trim("node_name"), F.lit(""))
    bound = bound.select("chunk", "node", F.coalesce(F.nullif(name, F.lit("")), F.col("node").cast("string")).alias("node_name"), name.alias("mention"), F.lit("ASSET_NODE_BINDING").alias("method"), F.lit(0.95).alias("score"))
    return named.unionByName(bound)


class Rule(NamedTuple):
    """What a pattern's first group says of a text's subject; the whole match is the quote."""

    claim_type: str
    predicate: str
    pattern: str
    confidence: float


#: Claim types by the kind of rule.
KINDS = {"property": "PROPERTY", "relation": "RELATION", "background": "BACKGROUND"}


def claims_of(text: str, rules: Sequence[tuple[re.Pattern, Rule]]) -> Iterator[tuple]:
    """(claim_no, claim_type, predicate, value, quote, start, confidence, recommend_score) of a text's claims in order of their
    places.  A claim has a predicate, a value and a quote of the text that holds the value; other matches are none."""
    hits = sorted(((m.start(), k, m) for k, (pattern, _) in enumerate(rules) for m in pattern.finditer(text)), key=lambda h: h[:2])
    number = 0
    for start, k, m in hits:
        rule, value, quote = rules[k][1], (m[1] or "").strip(), m[0].strip()[:QUOTE]
        if rule.predicate.strip() and value and value in quote:
            number += 1
            sure = min(1.0, max(0.0, rule.confidence))
            yield number, KINDS[rule.claim_type], rule.predicate.strip(), value, quote, start, sure, round(sure * UNCHECKED, 3)


CLAIM = "claim_no int, claim_type string, predicate string, value string, quote string, start int, confidence double, recommend_score double"


def extracted(chunks: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per claim that ``rules`` find in the whole texts: the key's columns and those of CLAIM."""
    schema = StructType([chunks.schema[key], *StructType.fromDDL(CLAIM).fields])
    arrow = pa.schema([pa.field(f.name, t) for f, t in zip(schema.fields, _arrow(schema), strict=True)])
    rules = [*rules]

    @F.arrow_udtf(returnType=schema)
    class Extract:
        def __init__(self) -> None:
            self.rules = [(re.compile(r.pattern), r) for r in rules]

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, out = [], []
            for row, one in enumerate(rows.column("_text")):
                for claim in claims_of(one.as_py() or "", self.rules):
                    keys.append(row)
                    out.append(claim)
            columns = [*zip(*out, strict=True)] if out else [[] for _ in range(8)]
            yield pa.table([rows.column(key).take(pa.array(keys, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    return Extract(chunks.select(key, F.col(text).cast("string").alias("_text")).asTable())
