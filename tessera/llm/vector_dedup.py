"""Near-dedup of vectors by cosine, with randomised-rotation binary codes.

1. Vectors are normalised in double precision; equal ones are one node, so copies are never compared with one another.
2. Each node gets a sketch, which is stored once: the sign bits of its coordinates under random rotations (of a fixed
   seed), a correction factor, its coordinates quantised to four bits, and its cell in every hash table.  A cell is the
   place and sign of the largest of some rotated coordinates, for one or more sets of them; how many tables there are
   follows from the chance that a pair at the threshold shares none (``MISS``).
3. Only sketches travel to the tables.  In a bucket, a pair's inner product is estimated from one sketch's bits and factor
   and the other's quantised coordinates.  The estimate is unbiased, and its confidence bound rules pairs out.
4. Nodes with a pair that is left, and that no earlier table has, get their vectors in that bucket, where such pairs are
   computed exactly, in double precision; only these can become links.  So a pair counts in the first table that its
   vectors share, and link counts need no list of pairs: a bucket gives each node its number of links, and a spanning
   forest of the links for the components.
Large buckets are split into blocks, every two of which meet in one task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are
components of their own.  Only vectors of equal length can link.  Ties don't matter: a component's id is the smallest in
it.  Repeated rows are vectors of their own and link with each other; rows without an id count as vectors but name no
component.  An empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import looked_up, sorted_groups, stage_table

COSINE = 0.9
#: The chance, at most, that a pair of exactly the threshold shares no table; closer pairs are missed less often.
MISS = 1e-3
#: Standard deviations of the estimate within which a pair is computed exactly.
EPSILON = 5.0
#: Sign bits of a sketch, at least.
BITS = 64
#: Nodes that a bucket has, about, and those that meet in one task, at most.
BUCKET, BLOCK = 1024, 2048
#: Bits of the number of a table, and of that of a block.
TABLE, PART = 16, 24
SEED = 20


@lru_cache(maxsize=64)
def rotations(dim: int, rows: int) -> np.ndarray:
    """The first rows of a stack of random rotations."""
    rng = np.random.default_rng([SEED, dim])
    return np.vstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-rows // dim))])[:rows]


def largest(y: np.ndarray) -> np.ndarray:
    """Place and sign of the largest coordinate along the last axis, as one number."""
    at = np.abs(y).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(y, at[..., None], -1)[..., 0] > 0)


@lru_cache(maxsize=64)
def plan(nodes: int, dim: int, pairs: int = 4096) -> tuple[int, int, int]:
    """(coordinates of a set, sets of a table, tables) for so many nodes.  The chance that a pair at the threshold shares a
    set's cell is counted over random pairs of a fixed seed, and taken three standard deviations low."""
    cells = max(2.0, nodes / BUCKET)
    sets = max(1, math.ceil(math.log(cells) / math.log(2 * min(dim, 64))))
    some = min(dim, math.ceil(cells ** (1 / sets) / 2))
    if dim == 1:
        return 1, 1, 1
    x, z = np.random.default_rng([SEED, dim, some]).standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    share = float((largest(x[:, :some]) == largest((COSINE * x + math.sqrt(1 - COSINE**2) * z)[:, :some])).mean())
    same = max(share - 3 * math.sqrt(share * (1 - share) / pairs), 1e-3) ** sets
    return some, sets, min(math.ceil(math.log(MISS) / math.log1p(-same)), (1 << TABLE) - 1)


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their largest component first, so that squares neither vanish nor overflow."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def cells(v: np.ndarray, nodes: int) -> np.ndarray:
    """The cell of each unit row in each table; by sums of a fixed order, so that results don't hang on the batch."""
    some, sets, tables = plan(nodes, v.shape[1])
    y = np.einsum("nd,bd->nb", v, rotations(v.shape[1], some * sets * tables)).reshape(len(v), tables, sets, some)
    return largest(y) @ ((2 * some) ** np.arange(sets))


def matrix(lists: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return lists.values.to_numpy(zero_copy_only=False)[lists.offsets.to_numpy()[rows][:, None] + np.arange(dim)]


def sketch_type(dim: int, nodes: int) -> np.dtype:
    """What a sketch holds; its vector's coordinate k is about low + step * level k."""
    some, sets, tables = plan(nodes, dim)
    cell = np.min_scalar_type((2 * some) ** sets - 1)
    turns = -(-BITS // dim)
    return np.dtype([("factor", "f4"), ("low", "f4"), ("step", "f4"), ("bits", "u1", -(-turns * dim // 8)), ("levels", "u1", -(-dim // 2)), ("cells", cell, tables)])


def sketches(v: np.ndarray, nodes: int) -> np.ndarray:
    """The sketches of unit rows."""
    n, dim = v.shape
    turns = -(-BITS // dim)
    out = np.zeros(n, sketch_type(dim, nodes))
    y = v @ rotations(dim, turns * dim).T
    out["bits"] = np.packbits(y > 0, axis=1)
    # The correction factor: the inner product of the rotated row with its own sign vector.
    out["factor"] = np.abs(y).sum(axis=1)
    low = v.min(axis=1)
    step = np.maximum((v.max(axis=1) - low) / 15, 1e-30)
    # Rounding is random, and so without bias, but the same for a row whatever its batch.
    noise = np.random.default_rng([SEED, 1]).random(dim)
    noise = (noise + (np.abs(v).sum(axis=1) * 1e6 % 1)[:, None]) % 1
    level = np.clip(np.floor((v - low[:, None]) / step[:, None] + noise), 0, 15).astype(np.uint8)
    level = np.pad(level, [(0, 0), (0, dim % 2)])
    out["low"], out["step"], out["levels"] = low, step, level[:, ::2] << 4 | level[:, 1::2]
    out["cells"] = cells(v, nodes)
    return out


def estimates(one: np.ndarray, two: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, their standard deviations for a pair at the threshold) of sketches, the first by their
    quantised coordinates, the second by their bits."""
    turns = -(-BITS // dim)
    levels = np.stack([one["levels"] >> 4, one["levels"] & 15], axis=2).reshape(len(one), -1)[:, :dim]
    y = (one["low"][:, None] + one["step"][:, None] * levels) @ rotations(dim, turns * dim).T.astype(np.float32)
    signs = np.unpackbits(two["bits"], axis=1)[:, : turns * dim].astype(np.float32) * 2 - 1
    # The part of a sign vector that its row doesn't determine is random, and so is the other's rounding.
    factor = two["factor"].astype(np.float64)
    own = factor / (turns * math.sqrt(dim))
    loose = turns * dim * np.maximum(1 - own**2, 0)
    bits = (1 - COSINE**2) * loose / max(dim - 1, 1)
    rounding = (one["step"][:, None] / 2) ** 2 * (factor**2 + loose)[None]
    return (y @ signs.T) / factor[None].astype(np.float32), np.sqrt(bits[None] + rounding) / factor[None]


def likely_pairs(sketch: np.ndarray, second: np.ndarray, dim: int, tab: int, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that the estimate doesn't rule out and that share no earlier table; across ``second`` if ``crossing``."""
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, len(sketch), 256):
        dot, error = estimates(sketch[lo : lo + 256], sketch[lo:], dim)
        i, j = np.nonzero(dot >= COSINE - EPSILON * error)
        i, j = i[j > i] + lo, j[j > i] + lo
        keep = second[i] != second[j] if crossing else np.ones(len(i), bool)
        for t in range(tab):
            keep[keep] = sketch["cells"][i[keep], t] != sketch["cells"][j[keep], t]
        out_i.append(i[keep])
        out_j.append(j[keep])
    return np.concatenate(out_i), np.concatenate(out_j)


def sketched(rows: DataFrame, nodes: int) -> DataFrame:
    """(key, dim, sketch, cells) of nodes (key, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.columns[1].offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == dim)
                for lo in range(0, len(every), max(1, 4_000_000 // dim)):
                    at = every[lo : lo + max(1, 4_000_000 // dim)]
                    made = sketches(unit(matrix(batch.columns[1], at, dim)), nodes)
                    tables = made["cells"].shape[1]
                    held = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(made["cells"].ravel().astype(np.int64)))
                    columns = [batch.columns[0].take(pa.array(at)), pa.array(np.full(len(at), dim, np.int64)), pa.array([x.tobytes() for x in made], pa.binary()), held]
                    yield pa.record_batch(columns, names=["key", "dim", "sketch", "cells"])

    return rows.select("key", "v").mapInArrow(run, "key long, dim long, sketch binary, cells array<long>")


GROUP = ["lane", "cell", "meet"]


def group_of(group: pa.Table, nodes: int) -> tuple[np.ndarray, int, int, bool]:
    """(sketches, dim, table, whether two blocks meet) of a bucket's rows."""
    lane, meet = group["lane"][0].as_py(), group["meet"][0].as_py()
    dim, tab = lane >> TABLE, lane & (1 << TABLE) - 1
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), sketch_type(dim, nodes))
    return sketch, dim, tab, meet >> PART != meet & (1 << PART) - 1


def asked(buckets: DataFrame, nodes: int) -> DataFrame:
    """The rows of buckets (lane, cell, meet, key, second, sketch) that have a likely pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, GROUP):
            if len(group) > 1:
                sketch, dim, tab, crossing = group_of(group, nodes)
                i, j = likely_pairs(sketch, group["second"].to_numpy(), dim, tab, crossing)
                told = np.zeros(len(group), bool)
                told[i] = told[j] = True
                if told.any():
                    yield from group.filter(pa.array(told)).combine_chunks().to_batches()

    columns = [*GROUP, "key", "second", "sketch"]
    dealt = buckets.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*columns).mapInArrow(run, "lane long, cell long, meet long, key long, second boolean, sketch binary")


def bucket_links(buckets: DataFrame, nodes: int) -> DataFrame:
    """(key, others, root) for buckets (lane, cell, meet, key, second, sketch, copies, v): a node's links that no earlier
    table has, counted with copies, and the root of its tree in the bucket's graph of links."""

    def found(group: pa.Table) -> pa.RecordBatch | None:
        sketch, dim, tab, crossing = group_of(group, nodes)
        i, j = likely_pairs(sketch, group["second"].to_numpy(), dim, tab, crossing)
        v = unit(matrix(group["v"].combine_chunks(), np.arange(len(group)), dim))
        near = np.concatenate([np.empty(0, bool), *[np.einsum("nd,nd->n", v[i[lo : lo + 100_000]], v[j[lo : lo + 100_000]]) >= COSINE for lo in range(0, len(i), 100_000)]])
        i, j = i[near], j[near]
        if not len(i):
            return None
        key, copies = group["key"].to_numpy(), group["copies"].to_numpy()
        count = np.zeros(len(v), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        root = np.arange(len(v))
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        told = np.flatnonzero(count > 0)
        return pa.record_batch([pa.array(key[told]), pa.array(count[told]), pa.array(key[root[told]])], names=["key", "others", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, GROUP):
            if len(group) > 1 and (out := found(group)) is not None:
                yield out

    dealt = buckets.repartition(*GROUP).sortWithinPartitions(*GROUP, "key")
    return dealt.select(*GROUP, "key", "second", "sketch", "copies", "v").mapInArrow(run, "key long, others long, root long")


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, one, two): v is the vector, or null where it can't link; one and two, 128 bits together, stand for its
    components."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    fit = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding 0 makes -0.0 and 0.0 one value.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fit, F.transform(v, lambda x: x + F.lit(0.0).cast("float" if single else "double"))).alias("v"))
    there = F.col("v").isNotNull()
    return rows.withColumns({"one": F.when(there, F.xxhash64("v")), "two": F.when(there, F.xxhash64(F.lit(SEED), "v"))})


def groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = stage_table(nodes_of(vectors, id_col, vec_col), "vectors")
    each = rows.where("v IS NOT NULL").groupBy("one", "two").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # The keys are numbers that this table gives, so no two nodes share one.
    nodes = stage_table(each.withColumn("key", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    made = stage_table(sketched(nodes, n), "sketches")
    lane = (F.col("dim") * (1 << TABLE) + F.col("tab")).alias("lane")
    light = made.select("dim", F.posexplode("cells").alias("tab", "cell")).select(lane, "cell")
    large = stage_table(light.groupBy("lane", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "large-buckets")
    buckets = made.select("key", "dim", "sketch", F.posexplode("cells").alias("tab", "cell")).select(lane, "cell", "key", "sketch")
    buckets = buckets.join(large, ["lane", "cell"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))
    buckets = buckets.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # Every two blocks of a bucket meet in one task, and each block is one for the pairs within it.
    buckets = buckets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = F.least("own", "other") * (1 << PART) + F.greatest("own", "other")
    buckets = buckets.select("lane", "cell", meet.alias("meet"), "key", (F.col("own") > F.col("other")).alias("second"), "sketch")
    some = stage_table(asked(buckets, n), "asked")
    told = stage_table(bucket_links(some.join(nodes.select("key", "copies", "v"), "key"), n), "links")
    comp = components(told.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    count = told.groupBy("key").agg(F.sum("others").alias("others"))
    comp = nodes.select("key", "one", "two", "least", "copies").join(comp, "key", "left").join(count, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    comp = comp.join(names, "component").select("one", "two", "component_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = looked_up(rows.select("id", "one", "two"), stage_table(comp, "components"), ["one", "two"], "copies")
    own = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
