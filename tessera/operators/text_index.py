"""An inverted index of texts with positions, kept as a partitioned table, and ranked search in it.

Postings (term, doc, positions) lie in BUCKETS folders by a hash of the term and are sorted by term in each, so a search reads
the folders and row groups of its own terms alone.  Texts' lengths and the terms' numbers of texts lie beside them.  Nothing
is gathered by term: a common term has a row for each text that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Saturation of a term's number in a text, and how far a text's length counts.
K1, B = 1.2, 0.75
#: Letters, digits and marks of any script.
WORD = r"[\p{L}\p{N}\p{M}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def lookup(self, words: Sequence[str]) -> DataFrame:
        """(term, doc, positions, n) of the words; only their buckets are read."""
        words = sorted(set(words))
        at = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(bucket(F.col("term"))).distinct().collect()]
        return self.read("postings").where(F.col("bucket").isin(at) & F.col("term").isin(words)).drop("bucket")


def build(texts: DataFrame, doc: str, text: str, path: str) -> TextIndex:
    """The index of texts (doc, text) in a folder.  Rows without a doc are left out; rows that repeat one are one text after the
    other in no certain order."""
    spark = texts.sparkSession
    every = texts.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), terms(F.col(text)).alias("_t"))
    words = every.select("doc", F.posexplode("_t").alias("pos", "term"))
    postings = words.groupBy("term", "doc").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    postings = postings.withColumns({"n": F.size("positions"), "bucket": bucket(F.col("term"))})
    # A bucket's rows are dealt by term and text, so that a common term is not one task's.
    postings.repartition("bucket", "term", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{path}/postings")
    every.select("doc", F.size("_t").alias("length")).groupBy("doc").agg(F.sum("length").alias("length")).write.parquet(f"{path}/lengths")
    return TextIndex(spark, path)


def search(index: TextIndex, words: Sequence[str], k: int, phrase: bool = False) -> DataFrame:
    """(doc, relevance, hits, rank): the ``k`` texts that hold most of the words' weight (BM25, rounded to 9 digits; ties by doc); with
    ``phrase`` only texts in which the words stand side by side in their order.  No words find nothing."""
    words = [w.lower() for w in words]
    found = index.lookup(words) if words else index.read("postings").where("false").drop("bucket")
    if phrase and words:
        order = F.create_map(*[F.lit(x) for kv in {w: words.index(w) for w in words}.items() for x in kv])
        first = found.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(order[F.col("term")].alias("k"), "positions"))).alias("m"))  # one entry a word
        place = lambda p: [F.array_contains(F.coalesce(F.col("m")[words.index(w)], F.array().cast("array<int>")), p + i) for i, w in enumerate(words)]

        def together(p: Column) -> Column:
            out = F.lit(True)
            for x in place(p):
                out = out & x
            return out

        held = first.where(F.exists(F.coalesce(F.col("m")[0], F.array().cast("array<int>")), together)).select("doc")
        found = found.join(held, "doc", "left_semi")
    lengths = index.read("lengths")
    total = lengths.agg(F.count(F.lit(1)).alias("_docs"), F.avg("length").alias("_mean"))
    # One row for each word of the search.
    often = index.lookup(words).groupBy("term").agg(F.count(F.lit(1)).alias("_df")) if words else found.select("term", F.lit(0).alias("_df"))
    rows = found.join(F.broadcast(often), "term").join(lengths, "doc").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
    out = rows.groupBy("doc").agg(F.round(F.sum(weight), 9).alias("relevance"), F.sum("n").alias("hits"))
    top = out.orderBy(F.desc("relevance"), "doc").limit(k)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "doc", "relevance", "hits")))  # k rows
    return top.agg(ordered.alias("x")).select(F.posexplode("x").alias("at", "x")).select("x.doc", "x.relevance", "x.hits", (F.col("at") + 1).alias("rank"))
