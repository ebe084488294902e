"""Near-duplicate pairs of bit strings, their components and clusters."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import stages

from .evidence import numbered


def bands_for(rows: int, length: int, most: int) -> int:
    """How many bands make a key: the fewest with which a key has about 64 rows or fewer, were bits random."""
    together = 1
    while 2 ** (together * length // (most + together)) * 64 < rows and together < length - most:
        together += 1
    return together


def hamming_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(a, b, distance), a < b, of (id, bits) with a Hamming distance of at most ``most``.

    Bits are cut into ``most + k`` bands, of which two strings that differ in ``most`` places at most have k the same, so the join
    is by equal sets of k bands; k grows slowly with the rows, and so do the bits of a key.  All strings have one length.
    Equal strings are one node in it and are paired among themselves afterwards.  The joins are merge joins by name: the size of staged
    strings of bits tells little of that of their bands, and Spark would send these to the driver and broadcast them."""
    nodes = stages.stage(rows.groupBy("bits").agg(F.min("id").alias("n")), "hashes")
    size = nodes.agg(F.count(F.lit(1)), F.max(F.length("bits"))).first()
    length = size[1] or 1
    k = bands_for(size[0], length, most)
    cuts = [i * length // (most + k) for i in range(most + k + 1)]
    part = lambda i: F.substring("bits", cuts[i] + 1, F.lit(cuts[i + 1] - cuts[i]))
    band = F.array(*[F.struct(F.lit(n).alias("k"), F.concat(*map(part, some)).alias("part")) for n, some in enumerate(itertools.combinations(range(most + k), k))])
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.length("bits") / 32).cast("int") - 1), lambda k: F.conv(F.substring("bits", k * 32 + 1, F.lit(32)), 2, 10).cast("long"))
    bands = nodes.select("n", "bits", words.alias("words"), F.explode(band).alias("band"))
    x, y = (bands.select("band", F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"), F.col("words").alias(f"words_{c}")) for c in "xy")
    differ = F.zip_with("words_x", "words_y", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    near = x.join(y.hint("merge"), "band").where("n_x < n_y").withColumn("distance", F.aggregate(differ, F.lit(0), lambda s, d: s + d))
    near = near.where(F.col("distance") <= most).select("bits_x", "bits_y", "distance").distinct()
    same = nodes.select(F.col("bits").alias("bits_x"), F.col("bits").alias("bits_y"), F.lit(0).alias("distance"))
    both = near.select("bits_x", "bits_y", "distance").unionByName(same)
    one, two = (rows.select(F.col("bits").alias(f"bits_{c}"), F.col("id").alias(f"id_{c}")) for c in "xy")
    out = both.join(one.hint("merge"), "bits_x").join(two.hint("merge"), "bits_y").where("id_x <> id_y AND (bits_x <> bits_y OR id_x < id_y)")
    return out.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), "distance")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) is connected with, by repeated minimum.

    A round takes every node's smallest label among its neighbours and that label's own label, so labels travel twice as
    far in each; every round is a staged table, which cuts the lineage."""
    both = stages.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stages.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("a").alias("m"), F.col("l").alias("j"))
        step = stages.stage(step.join(jump, "m").select("a", "l", F.least("m", "j").alias("n")), "labels")
        if step.where("l <> n").isEmpty():
            return step.select(F.col("a").alias("id"), F.col("n").alias("component"))
        labels = step.select("a", F.col("n").alias("l"))


def cluster_names(parts: DataFrame) -> DataFrame:
    """(component, size, cluster): names numbered from the largest cluster on."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = numbered(sizes.withColumn("_all", F.lit(0)).withColumn("_least", -F.col("size")), ["_all"], ["_least", "component"])
    return rows.select("component", "size", F.format_string("near_cluster_%04d", "place").alias("cluster"))
