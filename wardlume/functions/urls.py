"""Column expressions over addresses: identity keys, display forms, hosts, origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def parts(url: Column) -> dict[str, Column]:
    """scheme (https if none), host, port, path, query of an address."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, PARTS, 1))
    return {
        "scheme": F.when(scheme == "", "https").otherwise(scheme), "host": F.lower(F.regexp_extract(u, PARTS, 2)),
        "port": F.regexp_extract(u, PARTS, 3), "path": F.regexp_extract(u, PARTS, 4), "query": F.regexp_extract(u, PARTS, 5),
    }


def _place(p: dict[str, Column]) -> Column:
    shown = (p["port"] != "") & ~p["port"].isin("80", "443")
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(shown, F.concat(F.lit(":"), p["port"])).otherwise(""))


def url_key(url: Column) -> Column:
    """What a page is recognised by: scheme, host, path without its last slash, ten digits of the query's SHA-1."""
    p = parts(url)
    path = F.regexp_replace(p["path"], "/+$", "")
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), F.substring(F.sha1(p["query"].cast("binary")), 1, 10)))
    return F.substring(F.concat(_place(p), F.when(path == "", "/").otherwise(path), query), 1, 600)


def sanitized_url(url: Column) -> Column:
    """The address without query and fragment."""
    p = parts(url)
    return F.substring(F.concat(_place(p), F.when(p["path"] == "", "/").otherwise(p["path"])), 1, 2048)


def host(url: Column) -> Column:
    h = parts(url)["host"]
    return F.when(h == "", "?").otherwise(h)


def origin(url: Column) -> Column:
    """scheme, host and effective port; equal origins are the same site."""
    p = parts(url)
    port = F.when(p["port"] != "", p["port"]).when(p["scheme"] == "https", "443").otherwise("80")
    return F.concat_ws("|", p["scheme"], p["host"], port)


def suggested_link_text(url: Column) -> Column:
    """Words of the path's last segment and the host."""
    p = parts(url)
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.regexp_replace(p["path"], "/+$", ""), "/"), -1), r"\.[a-zA-Z0-9]{1,5}$", ""), r"[-_+%]+", " ")
    site = F.regexp_replace(p["host"], r"^www\.", "")
    return F.when(F.trim(name) == "", site).otherwise(F.concat(F.initcap(F.trim(name)), F.lit(" ("), site, F.lit(")")))
