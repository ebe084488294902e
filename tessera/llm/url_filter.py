"""URL filter by a character language-model ratio (DataFrame operations only).

Rules decide what they cover.  Two variable-order Markov models of URL characters are counted over all URLs that a rule
accepts or rejects, with every context that occurs.  Probabilities are smoothed by mixing in those of the next shorter
context, which stand alone where a context never occurs.  A URL without a rule gets the difference of
the two log-likelihoods divided by its length, against a threshold calibrated on the URLs with a rule.

Defined results: a null URL, or one without ``://``, has an empty host and path.  No rule fits it, and an empty or null
URL scores 0.  Where no URL is accepted, or none rejected, by a rule, the models are uniform and the threshold is 0.
A verdict is ``allow`` where the score is at least the threshold.  Repeated rows get the same verdict each.  An empty
table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import looked_up, stage_table

#: (host, path, verdict)
Rule = tuple[str, str, str]

#: Longest context in characters.
ORDER = 4
#: No limit of the models any more: an older test still reads it, on URLs whose contexts all have such a share.
MAX_CONTEXTS = 1024
#: A context and character are looked up by broadcast where they make up at least one in so many, and else by a shuffle.
COMMON = 1024
#: Log ratios are added up in steps of one in so many.
UNIT = 1e12
#: Weight, in observations, of the next shorter context.
PRIOR = 4.0
#: Steps per unit of the length-normalised score in which the threshold is calibrated.
STEPS = 100
#: The alphabet: letters, one sign for all digits, common signs, "~" for all other characters, and the end sign.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-./:?#=&_%~$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL in the alphabet, with start signs before it and an end sign behind it."""
    low = F.lower(F.coalesce(url, F.lit("")))
    known = F.regexp_replace(F.regexp_replace(low, r"\p{Nd}", "0"), r"(?s)[^a-z0\-./:?#=&_%]", "~")
    return F.concat(F.lit("^" * ORDER), known, F.lit("$"))


def grams(rows: DataFrame) -> DataFrame:
    """One row per character and end sign: the columns of ``rows``, the ORDER characters before it (ctx) and its
    number in the alphabet (ch)."""
    at = F.explode(F.sequence(F.lit(1), F.length("sym") - ORDER)).alias("at")
    return rows.select("*", at).select(
        *rows.columns, F.expr(f"substr(sym, at, {ORDER})").alias("ctx"), F.expr(f"instr('{SYMBOLS}', substr(sym, at + {ORDER}, 1))").alias("ch")
    )


def fit(urls: DataFrame) -> DataFrame:
    """The models from rows (sym, yes, no), with distinct ``sym`` and the numbers of its URLs that a rule accepts and
    rejects: one row per ctx of ORDER characters and ch that any row has, with ``uses``, the number of times, and
    ``ratio``, log p(allow) - log p(block).  A context that no URL with a rule has gives the probabilities of the next
    shorter one."""
    sums = [F.sum(c).alias(c) for c in ("yes", "no", "uses")]
    counts = stage_table(grams(urls.withColumn("uses", F.lit(1))).groupBy("ctx", "ch").agg(*sums), "url-grams")
    # Contexts have few characters of a small alphabet: at most len(SYMBOLS) rows a window or to each row of a shorter order.
    same = Window.partitionBy("ctx")
    level: DataFrame | None = None
    for k in range(ORDER + 1):
        part = counts if k == ORDER else counts.groupBy(F.expr(f"substr(ctx, {ORDER - k + 1}, {k})").alias("ctx"), "ch").agg(*sums)
        part = part.withColumns({"all_yes": F.sum("yes").over(same), "all_no": F.sum("no").over(same)})
        if level is None:
            part = part.withColumns({"q_yes": F.lit(1.0 / len(SYMBOLS)), "q_no": F.lit(1.0 / len(SYMBOLS))})
        else:
            back = level.select(F.col("ctx").alias("short"), "ch", F.col("p_yes").alias("q_yes"), F.col("p_no").alias("q_no"))
            part = part.withColumn("short", F.expr(f"substr(ctx, 2, {k - 1})")).join(back, ["short", "ch"])
        p = [((F.col(c) + PRIOR * F.col(f"q_{c}")) / (F.col(f"all_{c}") + PRIOR)).alias(f"p_{c}") for c in ("yes", "no")]
        level = part.select("ctx", "ch", "uses", *p)
    return stage_table(level.select("ctx", "ch", "uses", (F.log("p_yes") - F.log("p_no")).alias("ratio")), "url-model")


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(sym, score) for the distinct ``sym`` that ``model`` was made from: the mean of the log ratio over the characters
    and the end sign."""
    # Every URL has the grams of "http://", so the few very common ones do not go through the shuffle.
    total = model.agg(F.sum("uses").alias("total"))
    common = model.join(F.broadcast(total), F.col("uses") * COMMON >= F.col("total")).select("ctx", "ch", "ratio")
    out, model = grams(urls.select("sym")), model.select("ctx", "ch", "ratio")
    near = out.join(F.broadcast(common), ["ctx", "ch"])
    far = out.join(F.broadcast(common.drop("ratio")), ["ctx", "ch"], "left_anti").join(model, ["ctx", "ch"])
    # Whole numbers, so that a sum does not depend on the order of its rows.
    part = F.round(F.col("ratio") * UNIT).cast("long").alias("part")
    every = near.select("sym", part).unionByName(far.select("sym", part))
    return every.groupBy("sym").agg(F.round(F.sum("part") / F.count(F.lit(1)) / UNIT, 9).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, ``cut``: the lowest step at which the share of accepted URLs below it plus that of rejected ones from it
    on is smallest; 0 where a class has no URL.  ``scored`` has score, yes and no (numbers of URLs)."""
    step = F.floor(F.col("score") * STEPS).cast("long")
    h = scored.where((F.col("yes") > 0) | (F.col("no") > 0)).groupBy(step.alias("step")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # Scores lie within the logarithm of the smallest probability, so there are few steps whatever the input.
    h = h.agg(F.sort_array(F.collect_list(F.struct("step", "yes", "no"))).alias("h"), F.sum("yes").alias("y"), F.sum("no").alias("n"))
    errors = h.where((F.col("y") > 0) & (F.col("n") > 0)).selectExpr(
        "transform(h, x -> struct(aggregate(h, 0D, (a, z) -> a + if(z.step < x.step, z.yes / y, z.no / n)) AS err, x.step AS step)) AS e"
    )
    best = errors.select("e", F.expr("array_min(transform(e, x -> struct(round(x.err, 9) AS err, x.step AS step))).step").alias("best"))
    # Between that step and the next one below it that has URLs.
    below = F.expr("coalesce(array_max(transform(filter(e, x -> x.step < best), x -> x.step)) + 1, best)")
    return best.select(((F.col("best") + below) / 2 / STEPS).alias("cut"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict and score."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), symbols(F.col(url_col)).alias("sym"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    # A score depends on the symbols alone, so equal URLs are scored once.
    ruled = [F.count_if(F.col("ruled") == v).alias(c) for c, v in (("yes", "allow"), ("no", "block"))]
    urls = rows.groupBy("sym").agg(*ruled, F.count(F.lit(1)).alias("n"))
    urls = stage_table(urls, "urls")
    scored = stage_table(score(urls, fit(urls)).join(urls, "sym"), "url-scores")
    cut = stage_table(threshold(scored), "url-threshold").agg(F.coalesce(F.max("cut"), F.lit(0.0)).alias("cut"))
    asked = looked_up(rows, scored.select("sym", "score", "n"), ["sym"], "n").withColumn("_one", F.lit(1)).join(F.broadcast(cut.withColumn("_one", F.lit(1))), "_one")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block"))
    return asked.select("id", "host", "path", "rule", verdict.alias("verdict"), "score")
