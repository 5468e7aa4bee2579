"""URL normalisation and resolution (WHATWG serialisation of http and https), and Spark expressions over normal URLs."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PORT = {"http": "80", "https": "443"}
#: Hosts that mean the machine itself. Fixed values.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]", "0.0.0.0")
#: Parameters of campaign tracking. Fixed pattern.
TRACKING = "(?i)^(?:utm_.+|_ga|_gl|gclid)$"
_SKIPPED = ("mailto:", "tel:", "javascript:", "data:")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        low, last = p.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out) or "/"


def normalise(url: str | None) -> str | None:
    """Lower-case scheme and host, no default port, no dot segments, escapes for what must be escaped, no fragment."""
    if not url:
        return None
    url = re.sub(r"[\t\n\r]", "", url.strip())
    try:
        parts = urlsplit(url)
        scheme, host = parts.scheme.lower(), (parts.hostname or "").lower()
        if scheme not in DEFAULT_PORT or not host or re.search(r"[\s#/<>?@\\^|%]", host):
            return None
        port = f":{parts.port}" if parts.port is not None and str(parts.port) != DEFAULT_PORT[scheme] else ""
        if not host.isascii():
            host = host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    if ":" in host:
        host = f"[{host}]"
    path = quote(_dots(parts.path.replace("\\", "/") or "/"), safe="/%:@!$&'()*+,;=~[]|^-._")
    query = quote(parts.query, safe="/%:@!$&()*+,;=?~[]|^-._`{}\\")
    bare = url.split("#", 1)[0].endswith("?")
    return f"{scheme}://{host}{port}{path}" + (f"?{query}" if query or bare else "")


def resolve(base: str, href: str | None) -> str | None:
    """The absolute http(s) URL that href means, without its fragment; None for what a crawl doesn't follow."""
    if href is None:
        return None
    href = href.strip()
    if not href or href.startswith("#") or href.lower().startswith(_SKIPPED):
        return None
    try:
        return normalise(urljoin(base, href))
    except ValueError:
        return None


def scheme_host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+", 0)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1)


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    """With its question mark; empty for a bare one."""
    found = F.regexp_extract(url, "^[^?#]*(\\?[^#]*)", 1)
    return F.when(found == "?", "").otherwise(found)


def is_local(h: Column) -> Column:
    return h.isin(*LOCAL_HOSTS) | h.endswith(".localhost")


#: Characters whose escapes stay escaped for display. Fixed values.
RESERVED = ";/?:@&=+$,#"


def shown(url: str | None) -> str | None:
    """Readable: escapes of UTF-8 become characters, those of reserved characters stay; a malformed one leaves all as it is."""
    if url is None:
        return None

    def read(m: re.Match) -> str:
        raw = bytes.fromhex(m[0].replace("%", ""))
        text = raw.decode()
        return "".join(f"%{ord(c):02X}" if c in RESERVED else c for c in text)

    if re.search(r"%(?![0-9A-Fa-f]{2})", url):
        return url
    try:
        return re.sub(r"(?:%[0-9A-Fa-f]{2})+", read, url)
    except UnicodeDecodeError:
        return url


def _mapped(rows: DataFrame, column: str, out: str, f) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [f(x) for x in batch.column(batch.schema.names.index(column)).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out}` string")


def normalised(rows: DataFrame, column: str, out: str) -> DataFrame:
    return _mapped(rows, column, out, normalise)


def displayed(rows: DataFrame, column: str, out: str) -> DataFrame:
    return _mapped(rows, column, out, shown)
