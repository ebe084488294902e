"""Digest keys as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """MD5 of the columns joined by ``|``; nulls are left out."""
    return F.md5(F.concat_ws("|", *columns))


def claim_key(*columns: Column) -> Column:
    """SHA-256 of the columns joined by a unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def pair_key(a: Column, b: Column, length: int = 48) -> Column:
    """The same for either order of the two."""
    a, b = a.cast("string"), b.cast("string")
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, length)


def source_family(kind: Column, document: Column, url: Column, uid: Column) -> Column:
    """Which sources count as one: an image by its id, a document by its id, a page by its URL, else the row itself."""
    return F.coalesce(
        F.when(kind == "image", F.concat(F.lit("image:"), uid)),
        F.when(kind == "document", F.concat(F.lit("document:"), document)),
        F.when(url.isNotNull() & (url != ""), F.concat(F.lit("web:"), url)),
        F.concat(F.lit("document:"), document),
        uid,
    )
