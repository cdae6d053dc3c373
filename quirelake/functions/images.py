"""Image metadata and the identifiers that image addresses hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nonempty

#: How manuscript ids look in addresses.
MARK_PATTERN = r"MS-[A-Z]+-[A-Z]+-\d{5}-\d{5}"
FULL_PATTERN = MARK_PATTERN + r"-\d{3}-\d{5}"
SERIES_PATTERN = r"MS-TS-AS-\d{5}-\d{5}"


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def mark_in(url: Column) -> Column:
    """The shelf mark that an address holds."""
    return _found(url, MARK_PATTERN)


def full_id_in(url: Column) -> Column:
    """The id with its page numbers; an address that holds them apart is put together."""
    split = F.concat(mark_in(url), F.lit("-"), _found(url, r"/(\d+-\d{3}-\d{5})", 1))
    return F.coalesce(F.when(F.contains(url, F.lit("/1-000-00001")), split), _found(url, FULL_PATTERN))


def stored_address(url: Column, base: str) -> Column:
    """Where the picture of an address is kept; NULL without a full id."""
    return F.concat(F.lit(base + "/"), full_id_in(url), F.lit(".jpg"))


def series_mark(url: Column) -> Column:
    return F.coalesce(_found(url, SERIES_PATTERN), F.lit("unknown-shelfmark"))


def record_mark(mark: Column, doc_id: Column, idno: Column, url: Column, joined: Column, raw_id: Column) -> Column:
    """Field, own id up to a slash, idno, the address's mark, main mark of the joins, raw id: the first there is."""
    own = F.when(nonempty(doc_id), F.split_part(doc_id, F.lit("/"), F.lit(1)))
    return F.coalesce(F.when(nonempty(mark), mark), own, F.when(nonempty(idno), idno), mark_in(url), joined, F.when(nonempty(raw_id), raw_id))


def image_side(kv: Column) -> Column:
    """Of an image's key-value pairs the first that names a side."""
    hit = F.filter(kv, lambda e: F.contains(F.lower(e["k"]), F.lit("side")) | F.lower(e["v"]).rlike("recto|verso"))
    return F.lower(F.get(hit, F.lit(0))["v"])


def image_folio(kv: Column) -> Column:
    return F.get(F.filter(kv, lambda e: F.lower(e["k"]).rlike("folio|page")), F.lit(0))["v"]


def image_dimension(kv: Column, name: str) -> Column:
    """The first value under a key with the name that is a number, cut to a whole one."""
    numbers = F.transform(F.filter(kv, lambda e: F.contains(F.lower(e["k"]), F.lit(name))), lambda e: e["v"].try_cast("double").cast("int"))
    return F.get(F.filter(numbers, lambda x: x.isNotNull()), F.lit(0))


def aligned_images(urls: Column, metadata: Column) -> Column:
    """One entry per address with the metadata at the same place, NULL where that list is shorter."""
    return F.transform(urls, lambda u, i: F.struct((i + 1).alias("image_order"), u.alias("url"), F.get(metadata, i).alias("metadata")))
