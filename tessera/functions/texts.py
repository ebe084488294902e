"""Text, name and URL functions as Column builders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK, OVERLAP = 1200, 180
#: Query parameters that only track.
TRACKING = ["fbclid", "gclid", "spm", "from"]


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized_lines(text: Column) -> Column:
    """White space within lines is one space, blank lines go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: stripped(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, an array, with the value computed once however often ``use`` reads it."""
    return F.flatten(F.transform(F.array(value), use))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping windows over the normalised text; the last reaches its end.

    One pass of a pattern cuts all windows (it takes a step and looks ahead for the rest), so a long text costs no more for
    each character than a short one."""
    step = size - overlap
    windows = F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}")

    def cut(clean: Column) -> Column:
        n = 1 + F.ceil(F.greatest(F.length(clean) - size, F.lit(0)) / step).cast("int")
        return F.filter(F.transform(F.slice(F.regexp_extract_all(clean, windows, F.lit(1)), 1, n), stripped), lambda x: x != "")

    return once(normalized_lines(text), cut)


def terms(text: Column, limit: int = 16) -> Column:
    """Distinct lower-case words of two or more characters, in order, ``limit`` at most.  Words keep letters of any
    script, digits, ``_`` and ``-``."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,.;:!?，。；：！？、]+")
    clean = F.transform(parts, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_-]", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2)), 1, limit)


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds, whatever their case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.when(low.contains(w.lower()), 1).otherwise(0)
    return hits


def compact(text: Column) -> Column:
    """Lower case without white space, for substring tests."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def name_key(name: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}]", ""))


def name_occurs(name: Column, content: Column) -> Column:
    """Whether a name is in a text; a number must not touch other letters or digits."""
    pattern = F.concat(F.lit("(?<![0-9A-Za-z])"), name, F.lit("(?![0-9A-Za-z])"))
    return F.when(name.rlike(r"^\d+$"), F.regexp_like(content, pattern)).otherwise(F.contains(content, name))


def multi_values(value: Column) -> Column:
    """The parts of a list written as text."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"[,，、;/；|]"), stripped), lambda x: x != "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no tracking parameters, no fragment, no slash at the end of the path."""
    url = stripped(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    name = lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1))
    kept = F.array_join(F.filter(query, lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(TRACKING)), "&")
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}._-]+", "_"), 1, 180)


def bigrams(text: Column, limit: int = 20) -> Column:
    """Adjacent pairs of words, joined."""

    def pairs(w: Column) -> Column:
        n = F.least(F.size(w) - 1, F.lit(limit))
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))

    return once(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""), pairs)


def resolved_url(base: str, url: Column) -> Column:
    """An absolute URL as it is, a rooted path behind the base."""
    return F.when(url.rlike("^https?://"), url).when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """In compatibility form and folded case, without white space at either end; a null is empty."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x or "").strip().casefold())


@F.pandas_udf(StringType())
def compatible(values: pd.Series) -> pd.Series:
    """In compatibility form, without white space at either end; a null is empty."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x or "").strip())
