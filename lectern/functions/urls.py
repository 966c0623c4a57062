"""URL expressions: canonical form, dedup key, kinds of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".odt", ".rtf", ".xls", ".xlsx", ".ods", ".csv", ".ppt", ".pptx", ".odp", ".zip", ".rar", ".7z"]
ASSET_EXTENSIONS = (
    ".jpg .jpeg .png .gif .svg .webp .ico .bmp .tif .tiff .mp4 .mp3 .avi .mov .webm .wav .ogg .css .js .json .xml .woff .woff2 .ttf .eot"
).split()
DOCUMENT_TYPES = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument", "application/vnd.ms-", "application/vnd.oasis.opendocument",
    "application/rtf", "text/rtf", "text/csv", "application/zip", "application/x-zip", "application/x-rar", "application/vnd.rar", "application/x-7z",
]
DOCUMENT_HOSTS = ["drive.google.com", "docs.google.com", "actelocale.gov.md", "legis.md"]
EXPORT_FORMATS = {"document": "docx", "spreadsheets": "xlsx", "presentation": "pdf"}
DRIVE_FILE = r"drive\.google\.com/(?:file/d/|open\?id=|uc\?.*\bid=)([\w-]+)"
DRIVE_DOCUMENT = r"docs\.google\.com/(document|spreadsheets|presentation)/d/([\w-]+)"
FILE_NAME = r"""(?i)filename\*?=(?:UTF-8'')?"?([^";]+)"""
TYPE_EXTENSIONS = {
    "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/vnd.ms-powerpoint": ".ppt", "application/rtf": ".rtf", "text/csv": ".csv", "text/html": ".html", "text/plain": ".txt", "application/zip": ".zip",
}
CRAWL_DEPTH, SHALLOW_DEPTH, CRAWL_PAGES = 4, 2, 2000
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|yclid|_ga|mc_cid|mc_eid)$"
TRAP = (
    r"(?i)/wp-(admin|login|json)|/xmlrpc|/feed/?$|/cdn-cgi/|/(login|logout|register)\b|/tag/|/author/|/calendar|/print/"
    r"|[?&](s|q|search|replytocom|print|share|action|ical|month|year|day|date|tribe-bar-date|eventDisplay)="
)
_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, which: str) -> Column:
    """scheme, host, port, path or query; empty where absent."""
    return F.regexp_extract(url, _PARTS, ["", "scheme", "host", "port", "path", "query"].index(which))


def host(url: Column) -> Column:
    return F.lower(part(url, "host"))


def bare_host(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def canonical(url: Column) -> Column:
    """http(s) only: lower-case host, no default port, single slashes, no fragment, no tracking parameters, query sorted by name. Else null."""
    u = F.trim(url)
    scheme, port = F.lower(part(u, "scheme")), part(u, "port")
    path = F.regexp_replace(part(u, "path"), "/{2,}", "/")
    pairs = F.filter(F.split(part(u, "query"), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING))
    whole = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(F.array_sort(whole), "&")
    ok = scheme.isin("http", "https") & (host(u) != "")
    shown = F.concat(scheme, F.lit("://"), host(u), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))
    return F.when(ok, F.when(query == "", shown).otherwise(F.concat(shown, F.lit("?"), query)))


def key(url: Column) -> Column:
    """One key for addresses that differ in scheme, www. or a trailing slash."""
    path = F.rtrim(part(url, "path"), F.lit("/"))
    port = part(url, "port")
    shown = F.concat(bare_host(part(url, "host")), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))
    query = part(url, "query")
    return F.when(query == "", shown).otherwise(F.concat(shown, F.lit("?"), query))


def extension(url: Column) -> Column:
    """Of the last path element, with the dot, in lower case; a leading dot alone is none."""
    return F.lower(F.regexp_extract(part(url, "path"), r"[^/.][^/]*?(\.[^./]*)$", 1))


def is_document(url: Column) -> Column:
    return extension(url).isin(DOCUMENT_EXTENSIONS)


def is_document_type(content_type: Column) -> Column:
    return content_type.rlike("^(?:" + "|".join(t.replace(".", r"\.") for t in DOCUMENT_TYPES) + ")")


def is_external_document_host(url: Column) -> Column:
    h = bare_host(host(url))
    return h.rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in DOCUMENT_HOSTS) + ")$")


def is_skipped(url: Column) -> Column:
    return extension(url).isin(ASSET_EXTENSIONS) | url.rlike(TRAP)


def under_prefix(path: Column, prefix: Column) -> Column:
    """Whether a path is a prefix or below it, by whole segments."""
    p = F.rtrim(prefix, F.lit("/"))
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


def deep_link(url: Column, kind: Column, text: Column, page: Column) -> Column:
    """A link to the page of a paged file, or to the first eight words of a passage on a web page. `kind` is not needed to tell them apart."""
    paged = (page > 0) & ~F.lower(part(url, "path")).rlike(r"(?:\.html?|/)$")
    is_pdf = (extension(url) == ".pdf") | F.coalesce(paged & (kind == "file"), F.lit(False))
    start = F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, 8), " ")
    quoted = F.url_encode(start)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):  # as addresses are quoted, not forms
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return (
        F.when(url == "", "")
        .when(is_pdf, F.concat(url, F.lit("#page="), F.when(page > 0, page).otherwise(1)))
        .when(start == "", url)
        .otherwise(F.concat(url, F.lit("#:~:text="), quoted))
    )


def links(html: Column) -> Column:
    """Targets of anchors in page order, repeated ones once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'#]+)"""), F.lit(1)))


def resolved(link: Column, base: Column) -> Column:
    """A link made absolute against the page it stands on; null for other schemes."""
    root = F.concat(part(base, "scheme"), F.lit("://"), part(base, "host"), F.when(part(base, "port") == "", "").otherwise(F.concat(F.lit(":"), part(base, "port"))))
    folder = F.regexp_extract(part(base, "path"), r"^(.*/)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(part(base, "scheme"), F.lit(":"), link))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def direct_download(url: Column) -> Column:
    """The address of the file behind a viewer's link; other links as they are."""
    file, kind, document = F.regexp_extract(url, DRIVE_FILE, 1), F.regexp_extract(url, DRIVE_DOCUMENT, 1), F.regexp_extract(url, DRIVE_DOCUMENT, 2)
    form = F.create_map(*[F.lit(x) for pair in EXPORT_FORMATS.items() for x in pair])
    return (
        F.when(file != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file))
        .when(kind != "", F.concat(F.lit("https://docs.google.com/"), kind, F.lit("/d/"), document, F.lit("/export?format="), F.try_element_at(form, kind)))
        .otherwise(url)
    )


def file_extension(url: Column, disposition: Column, content_type: Column) -> Column:
    """Of a download: that of a document's address, else that of the name it is sent under, else that of its type; empty if none is known."""
    sent = F.lower(F.regexp_extract(F.try_url_decode(F.regexp_extract(F.coalesce(disposition, F.lit("")), FILE_NAME, 1)), r"[^/.][^/]*?(\.[^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_EXTENSIONS.items() for x in pair])
    return F.when(is_document(url), extension(url)).when(F.coalesce(sent, F.lit("")) != "", sent).otherwise(F.coalesce(F.try_element_at(kinds, content_type), F.lit("")))


def entered(url: Column) -> Column:
    """An address as a user types it: a scheme if it has none, a host in lower case, no closing slash but that of the root, no fragment. Null unless it is
    http(s) with a dotted host."""
    trimmed = F.trim(url)
    whole = F.when(trimmed.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    path, port, query = F.rtrim(part(whole, "path"), F.lit("/")), part(whole, "port"), part(whole, "query")
    shown = F.concat(F.lower(part(whole, "scheme")), F.lit("://"), host(whole), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.lower(part(whole, "scheme")).isin("http", "https") & F.contains(host(whole), F.lit(".")), shown)


def is_root(url: Column) -> Column:
    return part(url, "path").isin("", "/")


def crawl_limits(url: Column, kind: Column) -> Column:
    """struct<depth,pages>: a whole site from its root, a shallow crawl from a deeper page, none for a document."""
    depth = F.when(is_root(url), CRAWL_DEPTH).otherwise(SHALLOW_DEPTH)
    return F.when(kind != "document", F.struct(depth.alias("depth"), F.lit(CRAWL_PAGES).alias("pages")))
