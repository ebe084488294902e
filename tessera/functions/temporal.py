"""Times as claims tell them: years, ranges of years and periods, with how sure they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods by their names, words of doubt, patterns of years.
PERIODS = {
    "唐": "唐代", "唐朝": "唐代", "唐王朝": "唐代", "盛唐": "唐代", "中唐": "唐代", "晚唐": "唐代晚期", "宋": "宋代", "宋朝": "宋代", "北宋": "北宋时期", "南宋": "南宋时期",
    "元": "元代", "元朝": "元代", "明": "明代", "明朝": "明代", "清": "清代", "清朝": "清代", "明清": "明清时期", "隋唐": "隋唐时期", "清末": "清代晚期", "民国": "民国时期",
    "中华人民共和国": "现代", "新中国": "现代",
}
DOUBTS = ("约", "大约", "左右", "可能", "据传", "相传", "疑为", "或", "约为")
RANGE, YEAR = r"(\d{3,4})\s*(?:-|—|至|到)\s*(\d{3,4})\s*年?", r"(\d{3,4})\s*年"
# Punctuation at either end, and a bracket that tells where a value is from.
BEFORE, BEHIND = r"^[：:,，、。；;\s]+", r"[。；;，,、\s]+$"
ORIGIN = r"[（(](?:数据|资料|来源|截至|参见|见)[^）)]*[）)]$"


def without_noise(value: Column) -> Column:
    """One space for white space, and neither punctuation at the ends nor a note on the origin."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BEFORE, ""), BEHIND, ""), ORIGIN, ""))


def normalized(value: Column) -> Column:
    """(normalized, time_start, time_end, granularity, certainty) of a time: a range of years, else a year, else a period by its
    name without words of doubt, else the text itself.  Nothing at all is of unknown certainty."""
    text = without_noise(value)
    compact = F.regexp_replace(text, r"\s+", "")
    doubt, plain = F.lit(False), compact
    for word in DOUBTS:
        doubt, plain = doubt | F.contains(compact, F.lit(word)), F.replace(plain, F.lit(word), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    year = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
    first, last, only = year(RANGE, 1), year(RANGE, 2), year(YEAR, 1)
    period = F.coalesce(names[plain], names[text], text)
    shown = F.when(first.isNotNull(), F.concat(first.cast("string"), F.lit("-"), last.cast("string"), F.lit("年"))).when(only.isNotNull(), F.concat(only.cast("string"), F.lit("年"))).otherwise(period)
    kind = F.when(first.isNotNull(), "year_range").when(only.isNotNull(), "year").when(period != "", "period")
    sure = F.when(text == "", "unknown").when(doubt, "uncertain").otherwise("certain")
    return F.struct(shown.alias("normalized"), F.coalesce(first, only).alias("time_start"), F.coalesce(last, only).alias("time_end"), kind.alias("granularity"), sure.alias("certainty"))
