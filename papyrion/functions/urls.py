"""URL algebra as Column expressions. Four kinds of keys exist and are never mixed in one join: ``comparable_url`` (clips, crawl, sync), ``page_identity`` (inventories), ``site_key`` (duplicate collections) and ``view_key`` (page view)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.functions.text import WS, js_trim

_ABSOLUTE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?((?:[/?][^#]*)?)(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(js_trim(url), _ABSOLUTE, group)


def is_absolute(url: Column) -> Column:
    return F.coalesce(js_trim(url).rlike(_ABSOLUTE) & (_part(url, 2) != ""), F.lit(False))


def hostname(url: Column) -> Column:
    """Host in lower case without port; null where there is none."""
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def host(url: Column) -> Column:
    """Host in lower case with a port that isn't the scheme's default."""
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(hostname(url).isNotNull(), F.concat(hostname(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port))))


def comparable_url(url: Column) -> Column:
    """Canonical address without fragment; what isn't an absolute address stays as it is.

    Scheme and host in lower case, default ports gone, a path always there; path case, query and trailing slash stay.
    """
    rest = _part(url, 4)
    path = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(is_absolute(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), F.replace(path, F.lit(" "), F.lit("%20")))).otherwise(url)


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def origin(url: Column) -> Column:
    return F.when(is_absolute(url), F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url)))


def site_key(url: Column) -> Column:
    """Key of the duplicate-collection test: the whole address in lower case."""
    return F.lower(js_trim(url))


def view_key(url: Column) -> Column:
    """Key of the page view: lower case without fragment."""
    return F.regexp_replace(F.lower(js_trim(url)), "#.*$", "")


def site_of_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    """Path without query; ``/`` where the address can't be read."""
    path = F.regexp_replace(_part(url, 4), r"\?.*$", "")
    return F.when(is_absolute(url) & (path != ""), path).otherwise("/")


def decode_segment(segment: Column) -> Column:
    """Percent-decoded; what can't be decoded stays. A plus sign is a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def sanitize_filename(name: Column, fallback: str = "page", longest: int = 120) -> Column:
    """A file name without signs that file systems refuse."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\x00-\x1F\\/:*?"<>|]', " ")
    c = js_trim(F.regexp_replace(c, f"{WS}+", " "))
    c = F.regexp_replace(F.substring(F.regexp_replace(c, "[. ]+$", ""), 1, longest), "[. ]+$", "")
    # As a replacement, not a CASE: each step refers to the one before once, so the expression doesn't multiply.
    return F.regexp_replace(c, r"\A\z", fallback)


# Device names that Windows reserves.
RESERVED = ["con", "prn", "aux", "nul", *[f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)]]


def sanitize_path_segment(segment: Column, fallback: str = "page") -> Column:
    return F.regexp_replace(sanitize_filename(segment, fallback), rf"(?i)\A({'|'.join(RESERVED)})\z", "_$1")


def relative_markdown_path(url: Column, fallback: str = "page") -> Column:
    """``folder/page.md`` of an address; ``index.md`` for a site's root."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    folder = F.transform(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: sanitize_path_segment(decode_segment(s), fallback))
    last = F.regexp_replace(decode_segment(F.element_at(segments, -1)), r"(?i)\.[a-z0-9]+$", "")
    return F.when(F.size(segments) == 0, "index.md").otherwise(F.array_join(F.concat(folder, F.array(F.concat(sanitize_path_segment(last, fallback), F.lit(".md")))), "/"))


def encode_path_for_link(path: Column) -> Column:
    """Percent-encoded segments, slashes kept."""
    c = F.url_encode(path)
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(encoded), F.lit(plain))
    return c


def with_markdown_extension(name: Column) -> Column:
    return F.when(name.rlike(r"(?i)\.md$"), name).otherwise(F.concat(name, F.lit(".md")))


def normalize_library_path(path: Column) -> Column:
    """Forward slashes, no empty, ``.`` or ``..`` segments, each segment sanitized."""
    segments = F.transform(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), js_trim)
    return F.array_join(F.transform(F.filter(segments, lambda s: ~s.isin("", ".", "..")), lambda s: sanitize_path_segment(s)), "/")


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions that leave ASCII letters or digits: to one character, and to several."""
    one, several = {}, {}
    for code in range(0xA0, 0x3000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "̀" <= c <= "ͯ")
        if plain != chr(code) and any(c.isascii() and c.isalnum() for c in plain):
            (one if len(plain) == 1 else several)[chr(code)] = plain
    one |= {chr(code): chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)}
    several |= {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xFB00, 0xFB07)}
    return "".join(one), "".join(one.values()), several


_ONE_FROM, _ONE_TO, _SEVERAL = _decompositions()


def slugify(value: Column, fallback: str = "page", longest: int = 80) -> Column:
    """ASCII letters and digits of the value, the rest as single hyphens."""
    c = F.translate(F.coalesce(value, F.lit("")), _ONE_FROM, _ONE_TO)
    for joined in ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "½", "¼", "¾", "™", "№", "ĳ", "Ĳ", "…"):
        if joined in _SEVERAL:
            c = F.replace(c, F.lit(joined), F.lit(_SEVERAL[joined]))
    c = F.lower(F.regexp_replace(c, "[̀-ͯ'\"]", ""))
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.regexp_replace(F.substring(c, 1, longest), "-+$", ""), r"\A\z", fallback)


def classify_collection_url(url: Column) -> Column:
    """``sharepoint``, ``confluence`` or ``website`` by host and path."""
    h = F.coalesce(hostname(url), F.lit(""))
    wiki = h.endswith(".atlassian.net") & url_path(url).startswith("/wiki") | url_path(url).rlike(r"^/(display|spaces)/") | h.contains("confluence")
    return F.when(h.endswith(".sharepoint.com") | (h == "sharepoint.com"), "sharepoint").when(wiki, "confluence").otherwise("website")


def sharepoint_site(url: Column) -> Column:
    """tenant, site_path, api_base and name of a site address; ``error`` says why there is none."""
    h, path = hostname(url), url_path(url)
    site = F.regexp_extract(path, r"(?i)^(/(?:sites|teams)/[^/]+)", 1)
    ok = F.coalesce(h.endswith(".sharepoint.com"), F.lit(False))
    name = F.when(site == "", F.regexp_replace(h, r"\..*$", "")).otherwise(decode_segment(F.regexp_extract(site, r"([^/]+)$", 1)))
    error = F.when(~is_absolute(url), "not an address").when(~ok, "not a site of this platform")
    value = lambda c: F.when(ok, c)
    return F.struct(value(F.regexp_replace(h, r"\.sharepoint\.com$", "")).alias("tenant"), value(site).alias("site_path"), value(F.concat(F.lit("https://"), h, site, F.lit("/_api"))).alias("api_base"), value(name).alias("name"), error.alias("error"))


def title_from_url(url: Column) -> Column:
    """A title from the last segment of a path, or the host."""
    last = F.regexp_replace(decode_segment(F.regexp_extract(url_path(url), r"([^/]+)/?$", 1)), r"(?i)\.[a-z0-9]+$", "")
    words = js_trim(F.regexp_replace(last, r"[-_]+", " "))
    return F.when(words != "", words).otherwise(F.coalesce(hostname(url), url))
