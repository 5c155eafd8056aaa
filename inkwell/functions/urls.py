"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader, beside those that begin with utm_.
TRACKING = ("ref", "rss_source", "feedburner", "fbclid", "gclid", "mc_cid", "mc_eid", "yclid", "igshid")


def canonical_url(url: Column) -> Column:
    """Host in lower case, http as https, no tracking parameters, no slash at the end of a longer path.

    What isn't a URL with a host is returned trimmed.
    """
    raw = F.btrim(url)
    part = lambda k: F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    scheme = F.when(F.lower(part(1)) == "http", "https").otherwise(part(1))
    bare = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/$", "")).otherwise(part(3))
    kept = F.filter(
        F.split(F.regexp_replace(part(4), r"^\?", ""), "&"),
        lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING),
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(scheme, F.lit("://"), F.lower(part(2)), bare, query, part(5))
    return F.when(part(2) != "", made).otherwise(raw)


def link_host(url: Column) -> Column:
    """Host in lower case, without port, user, a full stop at the end or a leading www.; null where there is none."""
    host = F.lower(F.regexp_extract(F.btrim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def covers(rule: Column, host: Column) -> Column:
    """The same host or a subdomain of it."""
    return (host == rule) | host.endswith(F.concat(F.lit("."), rule))


def feed_key(url: Column) -> Column:
    """A subscription's key: trimmed, host in lower case, no slash at the end; scheme and query stay."""
    raw = F.btrim(url)
    head = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    tail = F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(head != "", F.concat(head, F.regexp_replace(tail, "/$", ""))).otherwise(raw)


def is_document_url(url: Column) -> Column:
    """A web address with a path or a query: not a home page."""
    tail = F.regexp_extract(F.btrim(url), r"^https?://[^/?#]+(/*)([^?#]*)(\?[^#]+)?", 2)
    query = F.regexp_extract(F.btrim(url), r"^https?://[^/?#]+[^?#]*(\?[^#]+)?", 1)
    return F.coalesce(F.btrim(url).rlike(r"^https?://[^/?#]+") & ((F.regexp_replace(tail, "/", "") != "") | (query != "")), F.lit(False))
