"""How far a source bears on a question, and how much its word weighs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of term lists in order, what an authority's domain and a top rank add, terms told at most.
LISTS = {"node": 3.0, "scenic": 1.6, "context": 1.0, "target": 0.35}
AUTHORITY, TOP_RANK, TOP, TOLD = 0.8, 0.4, 2, 16
AUTHORITY_DOMAINS = ("gov.cn", "xinhuanet.com", "people.com.cn", "stdaily.com", "cntour2.com")
# Scores of classes of authority, and words of titles and hosts that tell a class, in order.
AUTHORITY_SCORES = {
    "official": 0.95, "government": 0.92, "museum_or_institution": 0.88, "academic": 0.85, "encyclopedia": 0.72, "news": 0.62, "travel_platform": 0.55, "self_media": 0.35, "unknown": 0.45,
}
CLASS_WORDS = {
    "government": ("政府", "国务院", "教育部", "文化和旅游部", "文物局", "自然资源部", "住建部", "交通运输部", "卫生健康委", "人民政府", "gov.cn"),
    "official": ("官网", "官方网站", "官方", "管理委员会", "景区管理", "博物馆", "纪念馆", "研究院", "研究所", "museum", "official"),
    "academic": ("大学", "学院", "高校", "学术", "论文", "期刊", "cnki", ".edu"),
    "news": ("新华社", "人民日报", "中国新闻网", "中新网", "新闻", "xinhuanet", "people.com.cn", "chinanews"),
}
HOST_WORDS = {"encyclopedia": ("baike.baidu", "wikipedia", "wiki"), "travel_platform": ("ctrip", "mafengwo", "trip", "dianping")}
# What methods and provenances add.
METHOD_BONUS = {"provided": 0.08, "vector": 0.04, "keyword": 0.0, "web_extractor": 0.04, "web_search": 0.0, "graph_lookup": -0.05}
PROVENANCE_BONUS = {"provided": 0.06, "local_kb": 0.05, "web": 0.0, "graph": -0.08}


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def host(url: Column) -> Column:
    """In lower case; empty for a text that is no URL."""
    return F.lower(F.regexp_extract(F.trim(_text(url)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def match_term(term: Column) -> Column:
    """Letters and digits of ASCII, Chinese characters, ``_`` and ``-``, in lower case."""
    return F.regexp_replace(F.lower(_text(term)), r"[^0-9a-zA-Z\x{4e00}-\x{9fff}_\-]+", "")


def with_relevance(rows: DataFrame, texts: list[Column], url: Column, terms: dict[str, Column], rank: Column) -> DataFrame:
    """``rows`` with ``relevance`` (score, matched, reasons, domain) of a source by its texts and URL; ``terms`` has an array for each
    of LISTS, null for none.  A term counts once, in the first list that has it, if two characters or more of it are left and
    the texts hold it."""
    rows, hay = rows.withColumn("_hay", match_term(F.concat_ws(" ", *[_text(x) for x in [*texts, url]]))), F.col("_hay")
    score, matched, reasons = F.lit(0.0), F.array().cast("array<string>"), []
    for name, weight in LISTS.items():
        cleaned = F.array_distinct(F.transform(F.coalesce(terms.get(name, F.lit(None)).cast("array<string>"), F.array().cast("array<string>")), match_term))
        hits = F.array_except(F.filter(cleaned, lambda x: (F.length(x) >= 2) & F.contains(hay, x)), matched)  # noqa: B023
        score, matched = score + weight * F.size(hits), F.concat(matched, hits)
        reasons.append(F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}:"), F.size(hits).cast("string"))))
    domain = host(url)
    known = F.lit(False)
    for d in AUTHORITY_DOMAINS:
        known = known | domain.endswith(d)
    top = F.coalesce(rank <= TOP, F.lit(False))
    score = score + F.when(known, AUTHORITY).otherwise(0.0) + F.when(top, TOP_RANK).otherwise(0.0)
    reasons += [F.when(known, "authority_domain"), F.when(top, "top_rank")]
    out = F.struct(F.round(score, 2).alias("score"), F.slice(matched, 1, TOLD).alias("matched"), F.array_compact(F.array(*reasons)).alias("reasons"), domain.alias("domain"))
    return rows.withColumn("relevance", out).drop("_hay")


def provenance(source_type: Column, url: Column) -> Column:
    s = F.lower(_text(source_type))
    return (
        F.when(s.startswith("domain_kb"), "local_kb").when(s.isin("provided", "provided_evidence"), "provided").when(s.startswith("web") | (_text(url) != ""), "web")
        .when(s.startswith("graph"), "graph").otherwise("unknown")
    )


def method(source_type: Column) -> Column:
    s = F.lower(_text(source_type))
    return (
        F.when(s.contains("vector"), "vector").when(s.contains("keyword"), "keyword").when(s == "web_extractor", "web_extractor").when(s.startswith("web"), "web_search")
        .when(s.isin("provided", "provided_evidence"), "provided").when(s.startswith("graph"), "graph_lookup").when(s == "", "unknown").otherwise(s)
    )


def authority_class(explicit: Column, source_type: Column, url: Column, title: Column, source: Column, verified: Column) -> Column:
    """The class that is told, else that of the host and the words of host and title; a local or provided source without any
    is official if it is verified."""
    told, at = F.lower(F.trim(_text(explicit))), host(F.lower(url))
    words = F.concat_ws(" ", at, F.lower(F.concat_ws(" ", _text(title), _text(source))))
    any_of = lambda x, keys: F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(x, k))
    out = F.when(told != "", told).when(at.endswith(".gov.cn") | at.contains(".gov."), "government")
    for name, keys in CLASS_WORDS.items():
        out = out.when(any_of(words, keys), name)
    for name, keys in HOST_WORDS.items():
        out = out.when(any_of(at, keys), name)
    own = provenance(source_type, url).isin("local_kb", "provided")
    return out.when(own & F.coalesce(verified, F.lit(False)), "official").when(own, "museum_or_institution").otherwise("unknown")


def _table(key: Column, table: dict[str, float], other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))


def weight(explicit: Column, source_type: Column, url: Column, title: Column, source: Column, verified: Column) -> Column:
    """(provenance, method, authority, authority_score, weight) of a source."""
    p, m, a = provenance(source_type, url), method(source_type), authority_class(explicit, source_type, url, title, source, verified)
    base = _table(a, AUTHORITY_SCORES, AUTHORITY_SCORES["unknown"])
    total = base + _table(m, METHOD_BONUS, 0.0) + _table(p, PROVENANCE_BONUS, 0.0)
    total = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3)
    return F.struct(p.alias("provenance"), m.alias("method"), a.alias("authority"), base.alias("authority_score"), total.alias("weight"))
