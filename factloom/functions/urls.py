"""Predicates and classes of source URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Landing pages that name a site and not a record.
GENERIC_SOURCE_URLS = (
    "https://www.nmpa.gov.cn",
    "https://www.fda.gov/drugs/resources-information-approved-drugs",
)

# Host suffix and the class of source it stands for.
HOST_CLASSES = (
    ("fda.gov", "regulator_fda"),
    ("pmda.go.jp", "regulator_pmda"),
    ("nmpa.gov.cn", "regulator_nmpa"),
    ("ema.europa.eu", "regulator_ema"),
    ("hkexnews.hk", "issuer_filing"),
    ("cninfo.com.cn", "issuer_filing"),
)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_generic_url(url: Column) -> Column:
    """True for known landing pages and for URLs with a host but no path; blank is false."""
    text = F.rtrim(F.trim(F.coalesce(url, F.lit(""))), F.lit("/"))
    return text.isin(*GENERIC_SOURCE_URLS) | ((url_host(text) != "") & (url_path(text).isin("", "/")))


def source_class(url: Column, classes: tuple[tuple[str, str], ...] = HOST_CLASSES,
                 default: str = "first_party_or_other") -> Column:
    host = url_host(url)
    result = F.lit(default)
    for suffix, name in reversed(classes):
        result = F.when(host.endswith(suffix), name).otherwise(result)
    return result
