"""URL functions: Column expressions where the built-in parser will do, Arrow functions for the rest."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels below which a site has a third one of its own.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu"]
_PORTS = {"http": 80, "https": 443}
_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"
_EDGES = "".join(map(chr, range(0x21)))
_PATH_SAFE = "/!$&'()*+,-.:;=@_~%|[]\\^"
_QUERY_SAFE = _PATH_SAFE + "?`{}"
_FORM_SAFE = "*-._"


# --- plain Python, for use inside Arrow functions ---


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        plain = re.sub("%2e", ".", part, flags=re.I)
        if plain == "..":
            del out[-1:]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse(raw: str | None, base: str | None = None) -> tuple[str, str, str, str | None] | None:
    """(scheme, host with port, path, query) of an http(s) URL; None for any other."""
    if raw is None:
        return None
    text = re.sub(r"[\t\r\n]", "", raw.strip(_EDGES))
    try:
        if base is not None:
            joined = text if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", text) else urljoin(base.strip(_EDGES), text.replace("\\", "/"))
        else:
            joined = text
        parts = urlsplit(joined)
        scheme = parts.scheme.lower()
        if scheme not in _PORTS:
            return None
        if not parts.netloc or parts.hostname is None or parts.hostname == "":
            return None
        host = parts.hostname.lower()
        if re.search(r"[\s<>^|%#]", host):
            return None
        if not host.isascii():
            host = host.encode("idna").decode()
        host = f"[{host}]" if ":" in host else host
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    user = parts.netloc.rpartition("@")[0]
    where = (user + "@" if user else "") + host + (f":{port}" if port is not None and port != _PORTS[scheme] else "")
    path = _dots(quote((parts.path or "/").replace("\\", "/"), safe=_PATH_SAFE))
    query = quote(parts.query, safe=_QUERY_SAFE) if "?" in joined.split("#")[0] else None
    return scheme, where, path, query


def resolve_one(raw: str | None, base: str | None) -> str | None:
    """Absolute http(s) URL without fragment, or None."""
    if raw is None or not raw.strip():
        return None
    found = parse(raw, base)
    return None if found is None else f"{found[0]}://{found[1]}{found[2]}" + (f"?{found[3]}" if found[3] is not None else "")


def _decode_unreserved(path: str) -> str:
    def one(m: re.Match) -> str:
        char = chr(int(m[1], 16))
        return char if re.match(r"[A-Za-z0-9\-._~]", char) else m[0].upper()

    return re.sub(r"%([0-9a-fA-F]{2})", one, path)


def normalize_one(raw: str | None, base: str | None = None, strip_query: bool = False, strip_params: tuple[str, ...] = ()) -> str | None:
    """Canonical form of an http(s) URL for identity, or None; query parameters are sorted stably by name."""
    found = parse(raw, base)
    if found is None:
        return None
    scheme, where, path, query = found
    path = re.sub("/{2,}", "/", _dots(_decode_unreserved(path)))
    pairs = [] if strip_query or query is None else [kv for kv in parse_qsl(query, keep_blank_values=True) if kv[0] not in strip_params]
    pairs.sort(key=lambda kv: kv[0].encode("utf-16-be"))
    form = "&".join(f"{quote_plus(k, safe=_FORM_SAFE).replace('~', '%7E')}={quote_plus(v, safe=_FORM_SAFE).replace('~', '%7E')}" for k, v in pairs)
    return f"{scheme}://{where}{path}" + (f"?{form}" if form else "")


def domain_of_host(host: str) -> str:
    """Registrable domain by the last labels; addresses stay whole."""
    host = host.strip().lower()
    host = host[:-1] if host.endswith(".") else host
    bare = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    labels = host.split(".")
    if ":" in bare or re.match(_IPV4, bare) or len(labels) <= 2:
        return host
    return ".".join(labels[-3 if labels[-2] in SECOND_LEVEL else -2 :])


def domain_of_url(url: str | None) -> str | None:
    found = parse(url)
    return None if found is None else domain_of_host(found[1].rpartition("@")[2])


# --- Columns ---


def _text(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalize(url: Column | str, base: Column | str | None = None, strip_query: bool = False, strip_params: tuple[str, ...] = ()) -> Column:
    def run(raws: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([normalize_one(r, b, strip_query, strip_params) for r, b in zip(raws.to_pylist(), bases.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(_text(url), F.lit(None).cast("string") if base is None else _text(base))


def resolve(raw: Column | str, base: Column | str) -> Column:
    def run(raws: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([resolve_one(r, b) for r, b in zip(raws.to_pylist(), bases.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(_text(raw), _text(base))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: inside functions of arrays, Spark computes an expression again each time it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def resolve_all(raws: Column | str, base: Column | str) -> Column:
    """The absolute URL of each of an array's, null where there is none."""

    def run(lists: pa.Array, bases: pa.Array) -> pa.Array:
        # a few pages at a time: addresses are many, and as objects several times as large
        some = lambda at: zip(lists.slice(at, 64).to_pylist(), bases.slice(at, 64).to_pylist())
        parts = [pa.array([None if raw is None else [resolve_one(r, b) for r in raw] for raw, b in some(at)], pa.list_(pa.string())) for at in range(0, len(lists), 64)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(_text(raws), _text(base))


def url_hash(url: Column | str) -> Column:
    return F.sha2(_text(url), 256)


def registrable_domain(host: Column | str) -> Column:
    def of(parts: Column) -> Column:
        host, labels = parts["host"], parts["labels"]
        size = F.size(labels)
        whole = (size <= 2) | host.rlike(_IPV4) | host.startswith("[") | host.contains(":")
        third = F.element_at(labels, F.when(size >= 2, -2).otherwise(-1)).isin(SECOND_LEVEL)
        last = lambda n: F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), ".")
        return F.when(whole, host).when(third, last(3)).otherwise(last(2))

    plain = F.regexp_replace(F.lower(F.trim(_text(host))), r"\.$", "")
    return bound(plain, lambda h: bound(F.struct(h.alias("host"), F.split(h, r"\.").alias("labels")), of))


def host(url: Column | str) -> Column:
    return bound(F.lower(F.regexp_extract(_text(url), r"(?i)^\s*https?://([^/?#:@]+@)?([^/?#:]+)", 2)), lambda h: F.when(h != "", h))


def origin(url: Column | str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(_text(url), r"(?i)^\s*(https?://[^/?#]+)", 1), F.lit("")))


def host_no_www(url: Column | str) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path_of(url: Column | str) -> Column:
    path = F.regexp_extract(_text(url), r"(?i)^\s*https?://[^/?#]+([^?#]*)", 1)
    return F.when(origin(url).isNotNull(), F.when(path == "", "/").otherwise(path))


def is_http(url: Column | str) -> Column:
    return F.coalesce(_text(url).rlike(r"(?i)^\s*https?://[^/?#\s]+"), F.lit(False))


def same_origin(url: Column | str, other: Column | str) -> Column:
    return F.coalesce(origin(url) == origin(other), F.lit(False))


def last_segment(url: Column | str, default: str = "Sitemap") -> Column:
    """Name from the last path segment, query left out; ``default`` where there is no text."""
    plain = F.regexp_replace(F.split_part(_text(url), F.lit("?"), F.lit(1)), r"^.*/([^/]+)$", "$1")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))
