"""The registered query of each operator, with production parameters, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, exact_dedup, filter_audit, lattice, near_dedup, packing, periodic, pieces, quality, secrets, transcripts, url_filter, vector_dedup
from .shared import stage_table, table

#: (host, path, verdict) of the rules of op10.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_dedup.near_groups(table(spark, sf_dir, "documents"))
    kept = (F.col("id") == F.col("class_id")).alias("kept")
    return classes.select(F.col("id").alias("doc_id"), F.col("rep_id").alias("copy_of"), "class_id", kept)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.read_warc(spark, archives.archive(table(spark, sf_dir, "pages")))
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def secret_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"), *secret_vocabulary())
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return rows.select(F.col("id").alias("doc_id"), *count, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = transcripts.raw_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    lines = stage_table(transcripts.lines_of(raw, "conv_id", "turn", "text", "role"), "lines")
    # Roles are read for the counts, which are over all transcripts; the parser sees lines alone.
    model = transcripts.fit(lines)
    return transcripts.rendered(transcripts.parse(lines.drop("state"), model)).withColumnRenamed("conv", "conv_id")


def op7_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select(F.col("id").alias("doc_id"), "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held_out = ~quality.fold_free(F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op9_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), learn=True).withColumnRenamed("id", "doc_id")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by the id's CRC-32, repeats some of its words from some place on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), F.floor(h / 10).alias("g"))
    planted = planted.withColumns({"n": F.size("w"), "a": F.expr("CAST(g % size(w) AS INT)")})
    planted = planted.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    words = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[a + (i - a) % p] END), ' ')")
    return planted.select("doc_id", F.when(F.col("n") > 0, words).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.scan(with_planted_runs(table(spark, sf_dir, "documents")))
    sums = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return rows.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", *sums)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_bag_minhash, op2_arc_to_warc, op3_sum_of_squares_packing, op4_token_efficiency, op5_exact_dedup, op6_hmm_transcripts, op7_streaming_viterbi,
        op8_byte_cnn, op9_rotation_codes, op10_url_language_model, op11_subword_lattice, op12_filter_interactions, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t""",
    "op9_rotation_codes": r"""
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        f AS (SELECT * FROM e WHERE len(v) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN v]) AND list_dot_product(v, v) > 0),
        d AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        n AS (SELECT a, count(*) AS n_links FROM d GROUP BY a),
        c(x, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT d.b, c.root FROM c JOIN d ON d.a = c.x),
        m AS (SELECT x, min(root) AS component_id FROM c GROUP BY x)
        SELECT x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, x = component_id AS kept FROM m LEFT JOIN n ON a = x""",
    "op12_filter_interactions": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        fails AS (
            SELECT w.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
                   [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                    regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS f
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        placed AS (SELECT part, filter_order, good, toxic, f, list_min([CASE WHEN f[k] THEN instr(filter_order, 'ABCDE'[k]) ELSE 6 END FOR k IN [1, 2, 3, 4, 5]]) AS pos FROM fails, orders),
        steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
        counted AS (
            SELECT part, filter_order, step, filter_order[step] AS letter, count_if(pos > step) AS kept, count_if(pos = step) AS removed,
                   count_if(f[instr('ABCDE', filter_order[step])] AND pos < step) AS redundant,
                   count_if(f[instr('ABCDE', filter_order[step])] AND list_sum([CASE WHEN x THEN 1 ELSE 0 END FOR x IN f]) = 1) AS unique_fails,
                   count_if(pos = step AND good) AS good_lost, count_if(pos = step AND toxic) AS toxic_lost
            FROM placed, steps GROUP BY ALL)
        SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted""",
}
