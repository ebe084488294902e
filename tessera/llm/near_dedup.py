"""Near-dedup of texts by BagMinHash signatures over multisets of word shingles.

1. Signatures.  A shingle of count c stands for the weight levels 1..c.  Its levels lie in dyadic intervals [0,1), [1,2),
   [2,4), ...; each interval has one Poisson process of events whose rate is its width, and each event falls on a level
   of the interval and on a register.  A register keeps the first event among those on levels below the count, so
   two texts agree in a register with probability equal to their weighted Jaccard similarity, without bias.  Only events
   before a time that fills all registers are drawn; where one stays empty, the time is doubled and they are drawn anew.
2. Texts with equal word sequences are one class; the rest works on one representative of each.
3. Bands of registers make buckets; in a bucket, the registers give an estimate for each pair, and the pairs of a
   maximum spanning forest of the pairs that may reach the threshold are verified: multisets are compared exactly.
4. The verified links are drawn together towards their components.  Texts of a bucket that may reach the threshold with a text of another
   component get their multisets in that bucket's task, where all such pairs are compared exactly; only a forest of the
   links found leaves the task.  So no pair that may link two components goes untested, and no list of pairs is made.
A large bucket is split into blocks.  In step 3 each block meets the same few leaders of the bucket alone.  In step 4 only
texts outside the bucket's largest component meet all others; so a large group of copies, which the leaders draw together,
is not compared with itself.

At similarity 0.8, 20 bands of 5 registers miss a pair with probability 0.0004; a pair is taken not to reach the
threshold where its estimate is over four standard deviations below it.

Defined results: a text without words (null, empty, white space) is a class of its own.  A text of one to four words has
one shingle.  Classes are of texts: rows that repeat an id with different texts have each the class of their text, and
rows without an id that of their text, named by the smallest id in it (null where it has none).  An empty table gives an
empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components, contracted
from .shared import looked_up, slices, sorted_groups, stage_table
from .shingles import U, mix, shingles

REGISTERS, BAND = 100, 5
SIMILARITY = 0.8
SHINGLE = 5
#: Texts of a block of a bucket, and shingles of a block, about; two blocks meet in one task.
BLOCK, ITEMS = 256, 4_000_000
#: Members of a large bucket that meet all its blocks, about.
LEADERS = 8


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The register values (n_docs x m, unsigned 32-bit) of BagMinHash; rows of texts without shingles are 0."""
    best = np.full(n_docs * m, np.iinfo(U).max, dtype=U)
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    limit = np.where(weight > 0, (np.log(m) + 3) * m / np.maximum(weight, 1), 0)
    todo = weight > 0
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64) + 1
    process = np.repeat(np.arange(len(doc)), levels)
    part = np.arange(len(process)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(part > 0, 1 << np.maximum(part - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(element[process] + part.astype(U) * U(0xD1342543DE82EF95))
    while todo.any():
        on = np.flatnonzero(todo[doc[process]])
        d, s, w, lo, top, time, k = doc[process[on]], seed[on], width[on], low[on], count[process[on]], np.zeros(len(on)), 0
        until = limit[d]
        while len(d):
            k += 1
            x = mix(s + U(k * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log((x >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w
            early = time < until
            d, s, w, lo, top, time, until, x = d[early], s[early], w[early], lo[early], top[early], time[early], until[early], x[early]
            y = mix(x)
            level = lo + ((y >> U(40)).astype(np.int64) * w >> 24)
            hit = level < top
            place = d[hit] * m + ((y[hit] & U(0xFFFFFFFF)) % U(m)).astype(np.int64)
            # Times are positive, so their bits are in the same order.
            value = (time[hit].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mix(y[hit]) >> U(32))
            np.minimum.at(best, place, value)
        empty = (best.reshape(n_docs, m) == np.iinfo(U).max).any(axis=1) & todo
        limit[empty] *= 2
        todo = empty
    out = (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, m)
    out[weight == 0] = 0
    return out


def band_keys(sig: np.ndarray, r: int = BAND) -> np.ndarray:
    """One 64-bit key per band of ``r`` registers."""
    n, m = sig.shape
    cells = sig.astype(U).reshape(n, m // r, r)
    key = np.broadcast_to(np.arange(m // r, dtype=U), (n, m // r)).copy()
    for k in range(r):
        key = mix(key * U(0x9E3779B97F4A7C15) + cells[:, :, k])
    return key.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, size, bands, sig): key stands for the word sequence (null: no words), size is the number of shingles, and
    sig has the low byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.columns[0]
            for lo, hi, texts in slices(batch.columns[1], 4_000_000):
                doc, element, count, key = shingles(texts, SHINGLE)
                sig = signatures(doc, element, count, hi - lo)
                size = np.bincount(doc, weights=count, minlength=hi - lo).astype(np.int64)
                keys = band_keys(sig)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                low = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(key.view(np.int64), mask=size == 0), pa.array(size), bands, low], names=["id", "key", "size", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key long, size long, bands array<long>, sig binary")


def with_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the key of each text as ``_key``."""
    at, names = docs.columns.index(text_col), [*docs.columns, "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [pa.array([], pa.int64())]
            for lo, hi, texts in slices(batch.columns[at], 4_000_000):
                doc, _, count, key = shingles(texts, SHINGLE)
                keys.append(pa.array(key.view(np.int64), mask=np.bincount(doc, weights=count, minlength=hi - lo) == 0))
            yield pa.record_batch([*batch.columns, pa.concat_arrays(keys)], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_key", LongType())]))


def multisets(docs: DataFrame) -> DataFrame:
    """(key, items) for texts: one number per shingle and occurrence, so that set overlap is multiset overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.columns[0], 4_000_000):
                doc, element, count, key = shingles(texts, SHINGLE)
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                items = mix(np.repeat(element, count) + nth.astype(U) * U(0xD1342543DE82EF95)).view(np.int64)
                sizes = np.bincount(np.repeat(doc, count), minlength=hi - lo)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], names=["key", "items"])

    return docs.select("text").mapInArrow(run, "key long, items array<long>")


def forest(sig: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of a maximum spanning forest over the pairs that may reach the threshold (Prim)."""
    n = len(sig)
    best, by, free = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    out, i = [], 0
    for _ in range(n - 1):
        free[i] = False
        best[i] = -2
        agree = likely(sig, size, i, np.arange(n), least)
        better = free & (agree > best)
        best[better], by[better] = agree[better], i
        i = int(best.argmax())
        if best[i] >= least:
            out.append((int(by[i]), i))
    return out


def likely(sig: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, least: int) -> np.ndarray:
    """In how many registers text i agrees with the others; 0 where that or the sizes say that the threshold isn't met."""
    agree = np.count_nonzero(sig[others] == sig[i], axis=1)
    low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
    return np.where((agree >= least) & (low >= SIMILARITY * high), agree, 0)


GROUP = ["bucket", "block_a", "block_b"]
LEAST = int(np.floor(REGISTERS * SIMILARITY - 4 * np.sqrt(REGISTERS * SIMILARITY * (1 - SIMILARITY))))


def registers(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(group), -1)


def forest_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a forest in each of the buckets (bucket, block_a, block_b, key, sig, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``sent`` saves sending the pairs of other bands again; it starts afresh when large, as distinct() below removes
        # repeats anyway.
        out, sent = [], set()

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for group in sorted_groups(batches, GROUP):
            if len(group) > 1:
                keys = group["key"].to_pylist()
                for i, j in forest(registers(group), group["size"].to_numpy(), LEAST):
                    pair = (min(keys[i], keys[j]), max(keys[i], keys[j]))
                    if pair not in sent:
                        out.append(pair)
                        sent.add(pair)
            if len(out) >= 10_000:
                yield packed()
                out = []
                if len(sent) > 200_000:
                    sent = set()
        yield packed()

    dealt = buckets.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*GROUP, "key", "sig", "size").mapInArrow(run, "a long, b long").distinct()


def crossing(buckets: DataFrame) -> DataFrame:
    """The rows (bucket, block_a, block_b, key, comp) of the buckets (..., sig, size) that may reach the threshold with a
    row of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, GROUP):
            comp = group["comp"].to_numpy()
            if (comp == comp[0]).all():
                continue
            sig, size, told = registers(group), group["size"].to_numpy(), np.zeros(len(group), bool)
            for i in range(len(group) - 1):
                rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
                near = rest[likely(sig, size, i, rest, LEAST) > 0] if len(rest) else rest
                told[near] = True
                told[i] |= len(near) > 0
            if told.any():
                yield from group.select([*GROUP, "key", "comp"]).filter(pa.array(told)).combine_chunks().to_batches()

    dealt = buckets.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*GROUP, "key", "comp", "sig", "size").mapInArrow(run, "bucket long, block_a int, block_b int, key long, comp long")


def common(items: pa.ListArray, columns: int = 1 << 14) -> np.ndarray:
    """How many items every two lists have in common: bits of the items that several lists hold, ANDed and counted."""
    n, flat = len(items), items.flatten().to_numpy()
    owner = np.repeat(np.arange(n), np.diff(items.offsets.to_numpy()))
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    owner, place = owner[shared[place]], column[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((n, n), np.int64)
    for lo in range(0, int(shared.sum()), columns):
        part = slice(*np.searchsorted(place, [lo, lo + columns]))
        bits = np.zeros((n, columns), bool)
        bits[owner[part], place[part] - lo] = True
        words = np.packbits(bits, axis=1).view(U)
        for i in range(n - 1):
            both[i, i + 1 :] += np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
    return both


def crossing_links(rows: DataFrame) -> DataFrame:
    """A forest (a, b, similarity) of the links between different components in (bucket, block_a, block_b, key, comp, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, GROUP):
            if len(group) < 2:
                continue
            keys, comp, items = group["key"].to_numpy(), group["comp"].to_numpy(), group["items"].combine_chunks()
            both, size = common(items), np.diff(items.offsets.to_numpy())
            alike = both / (size[:, None] + size[None] - both)
            found = np.argwhere((alike >= SIMILARITY) & (comp[:, None] != comp[None]))
            root = {int(c): int(c) for c in comp}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            out = []
            for i, j in found.tolist():
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(int(keys[i]), int(keys[j])), max(int(keys[i]), int(keys[j])), float(alike[i, j])))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.select(*GROUP, "key", "comp", "items").mapInArrow(run, "a long, b long, similarity double").distinct()


def with_blocks(members: DataFrame) -> DataFrame:
    """Members (bucket, key, size) of buckets of two texts or more, with n (the bucket's texts) and blocks: how many blocks of
    at most about BLOCK texts and ITEMS shingles it has.  Two blocks are no more than one task's rows, so they count as one."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("items") / ITEMS))
    sizes = sizes.select("bucket", "n", F.when(blocks <= 2, 1).otherwise(blocks).cast("int").alias("blocks"))
    return members.join(sizes, "bucket")


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("key"), blocks).cast("int")


def with_leaders(members: DataFrame) -> DataFrame:
    """(bucket, key, block_a, block_b): each block of a bucket, to which the bucket's leaders come too."""
    leads = F.pmod(F.xxhash64("key", "bucket"), F.col("n")) < LEADERS
    every = F.when(leads & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block_of(F.col("blocks"))))
    return members.select("bucket", "key", F.explode(every).alias("block_a")).withColumn("block_b", F.col("block_a"))


def meetings(members: DataFrame) -> DataFrame:
    """(bucket, key, comp, block_a, block_b) of members (bucket, key, size, n, blocks, comp): every two texts of a bucket that are of
    different components meet.  Texts of the largest component of a large bucket do not meet one another."""
    small = members.where("blocks = 1").select("bucket", "key", "comp", F.lit(0).alias("block_a"), F.lit(0).alias("block_b"))
    large = members.where("blocks > 1")
    parts = large.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"))
    rest = parts.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    rest = rest.select("bucket", F.col("top.comp").alias("top"), (F.col("m") - F.col("top.m")).alias("others"), "s").where("others > 0")
    # Blocks 0 to r - 1 are of the other components, those from r on of the largest one.
    r = F.greatest(F.ceil(F.col("others") / BLOCK), F.least(F.ceil(F.col("s") / ITEMS), F.col("others"))).cast("int")
    rows = large.join(stage_table(rest.select("bucket", "top", r.alias("r")), "rest"), "bucket").withColumn("own", F.when(F.col("comp") == F.col("top"), F.col("r") + block_of(F.col("blocks"))).otherwise(block_of(F.col("r"))))
    last = F.when(F.col("own") >= F.col("r"), F.col("r")).otherwise(F.col("r") + F.col("blocks")) - 1
    rows = rows.select("bucket", "key", "comp", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return small.unionByName(rows.select("bucket", "key", "comp", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the exact weighted Jaccard similarity of their multisets."""
    one = sets.select(F.col("key").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return out.select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links).  classes: one row per row of ``docs``: id, rep_id (smallest id with the same words), class_id
    (smallest id connected by links or equal words).  links: as in ``keyed_groups``."""
    classes, links = keyed_groups(docs, id_col, text_col)
    return classes.select("id", "rep_id", "class_id"), links


def keyed_groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, links).  classes: as in ``near_groups``, with key and class_key (the smallest key that class_id has in the
    class).  links: verified pairs (a, b, similarity) of rep_ids that connect
    the classes; not every pair within a class."""
    rows = stage_table(sketch(docs, id_col, text_col), "sketches")
    named = rows.where("key IS NOT NULL")
    reps = stage_table(named.groupBy("key").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies")), "representatives")
    own = stage_table(named.select("key", "size", "bands", "sig").dropDuplicates(["key"]), "compared")
    members = stage_table(with_blocks(own.select("key", "size", F.explode("bands").alias("bucket"))), "buckets")
    shown = own.select("key", "sig", "size")
    pairs = stage_table(forest_pairs(with_leaders(members).join(shown, "key")), "pairs")
    # A forest reaches every text that may be in a link, so step 4 needs no other texts.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(reps, "key").select(F.col("rep_id").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(asked.hint("shuffle_hash"), texts["id"].eqNullSafe(asked["id"]), "left_semi")
    sets = stage_table(multisets(found), "multisets").dropDuplicates(["key"])
    first = stage_table(verified(pairs, sets), "verified")
    links = first.where(F.col("similarity") >= SIMILARITY)
    # Two rounds leave some components in parts, which only means that step 4 compares a little more.
    stars = contracted(links.select("a", "b"), rounds=2)
    comp = stage_table(stars.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("comp")), "parts")
    parted = stage_table(members.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "members")
    rest = crossing_links(stage_table(crossing(meetings(parted).join(shown, "key")), "crossing").join(sets, "key"))
    rest = stage_table(rest, "crossing-links")
    links = links.unionByName(rest)
    comp = components(stars.unionByName(rest.select("a", "b"))).withColumnRenamed("id", "key")
    comp = reps.join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = F.min(F.when(F.col("rep_id").isNotNull(), F.struct("rep_id", "key"))).alias("first")
    least = comp.groupBy("component").agg(first).select("component", F.col("first.rep_id").alias("class_id"), F.col("first.key").alias("class_key"))
    named = stage_table(comp.join(least, "component").select("key", "rep_id", "class_id", "class_key", "copies"), "classes")
    classes = looked_up(rows.select("id", "key"), named, ["key"], "copies")
    classes = classes.select("id", "key", F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("class_id", "id").alias("class_id"), "class_key")
    one, two = (reps.select(F.col("key").alias(c), F.col("rep_id").alias(f"id_{c}")) for c in "ab")
    ids = links.join(one, "a").join(two, "b")
    return classes, ids.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns; where the class repeats that id, that with
    the smallest key and then text.  Rows without an id or without words stay."""
    classes, _ = keyed_groups(docs, id_col, text_col)
    rows = stage_table(classes.where("id IS NOT NULL").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "class_id", "class_key"), "named-classes")
    gone = rows.where("_id <> class_id OR _key <> class_key").select("_id", "_key").distinct()
    gone = stage_table(gone, "near-copies")
    repeated = stage_table(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated-ids")
    keyed = docs.withColumn("_id", F.col(id_col).cast("long"))
    if repeated.isEmpty():
        return keyed.join(gone.select("_id").hint("shuffle_hash"), "_id", "left_anti").select(*docs.columns)
    # An id alone names no row where it is repeated, so the texts of such rows are read for their keys.
    some = gone.select("_id").unionByName(repeated).distinct()
    out = keyed.join(some.hint("shuffle_hash"), "_id", "left_anti").select(*docs.columns)
    again = with_keys(keyed.join(repeated, "_id", "left_semi").select(*docs.columns, "_id"), text_col).join(gone, ["_id", "_key"], "left_anti")
    number = F.row_number().over(W.partitionBy("_id", "_key").orderBy(text_col))
    first = again.where("_key IS NOT NULL").withColumn("_n", number).where("_n = 1")
    return out.unionByName(first.select(*docs.columns)).unionByName(again.where("_key IS NULL").select(*docs.columns))
