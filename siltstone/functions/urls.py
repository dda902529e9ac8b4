"""URL expressions: split, normalise, canonicalise, resolve, scope. All are native columns.

The splitter follows RFC 3986, appendix B, after the clean-up that browsers and the standard library do
(leading control characters and blanks, and tabs and line ends anywhere, are dropped). A null or
unusable URL gives null; predicates give false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Suffixes of files that are not crawled (fixed values).
SKIPPED_SUFFIXES = (
    ".7z", ".avi", ".css", ".csv", ".doc", ".docx", ".eot", ".exe", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".json", ".mov", ".mp3", ".mp4", ".pdf",
    ".png", ".ppt", ".pptx", ".rar", ".rss", ".svg", ".tar", ".tif", ".tiff", ".ttf", ".wav", ".webp", ".woff", ".woff2", ".xls", ".xlsx", ".xml", ".zip",
)


def _col(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cleaned(url: Column | str) -> Column:
    return F.translate(F.regexp_replace(_col(url), r"^[\x00-\x20]+", ""), "\t\r\n", "")


def parts(url: Column | str) -> Column:
    """array of scheme, authority, path, query, fragment, host, port text; one match of the URL.

    Parts are empty if absent; the host is in lower case without brackets.
    """
    five = F.split(F.regexp_replace(cleaned(url), SPLIT, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")

    def seven(p: Column) -> Column:
        address = F.regexp_replace(p[1], r"^.*@", "")
        host = F.lower(F.translate(F.regexp_extract(address, r"^(\[[^\]]*\]|[^:]*)", 1), "[]", ""))
        return F.concat(p, F.array(host, F.regexp_extract(address, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)))

    return let(five, seven)


def _scheme(p: Column) -> Column:
    return F.lower(p[0])


def _port_valid(p: Column) -> Column:
    return (p[6] == "") | F.coalesce(F.when(p[6].rlike("^[0-9]{1,5}$"), p[6].cast("int")) <= 65535, F.lit(False))


def _port(p: Column) -> Column:
    return F.when(p[6].rlike("^[0-9]{1,5}$"), p[6].cast("int"))


def _effective_port(p: Column) -> Column:
    return F.coalesce(F.nullif(_port(p), F.lit(0)), F.when(_scheme(p) == "https", F.lit(443)).otherwise(F.lit(80)))


def _has_credentials(p: Column) -> Column:
    return F.regexp_extract(p[1], r"^(.*)@", 1).rlike("[^:]")


def part(url: Column | str, k: int) -> Column:
    """Part k of the split: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return parts(url)[k - 1]


def scheme(url: Column | str) -> Column:
    return F.lower(part(url, 1))


def host(url: Column | str) -> Column:
    """Host in lower case, without brackets; empty if absent."""
    return parts(url)[5]


def port_valid(url: Column | str) -> Column:
    return let(parts(url), _port_valid)


def port(url: Column | str) -> Column:
    """The explicit port, or null."""
    return let(parts(url), _port)


def effective_port(url: Column | str) -> Column:
    return let(parts(url), _effective_port)


def has_credentials(url: Column | str) -> Column:
    return let(parts(url), _has_credentials)


def _normal(p: Column) -> Column:
    s, number = _scheme(p), _port(p)
    plain = number.isNull() | ((s == "http") & (number == 80)) | ((s == "https") & (number == 443))
    text = F.concat(
        s, F.lit("://"), p[5], F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))),
        F.when(p[2] == "", F.lit("/")).otherwise(p[2]), F.when(p[3] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p[3])),
    )
    return F.when(s.isin("http", "https") & (p[5] != "") & _port_valid(p), text)


def normalise(url: Column | str) -> Column:
    """Scheme and host in lower case, no default port, no fragment, path at least `/`; else null."""
    return let(parts(url), _normal)


def suffix(path: Column) -> Column:
    """Suffix of the last path segment in lower case; a name that only begins with dots has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1))


def canonicalise(url: Column | str) -> Column:
    """The normal form, or null for suffixes that are not crawled."""
    return let(parts(url), lambda p: F.when(~suffix(p[2]).isin(*SKIPPED_SUFFIXES), _normal(p)))


def resolve(base: Column | str, reference: Column) -> Column:
    """A reference against an absolute base: absolute, network-path, root-relative, query, fragment and
    relative forms; dot segments are left to the normal form of the server."""

    def resolved(pair: Column) -> Column:
        p, ref = pair["p"], pair["ref"]
        origin = F.concat(p[0], F.lit("://"), p[1])
        folder = F.regexp_extract(p[2], r"^(.*/)", 1)
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        return (
            F.when(ref == "", _col(base))
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(p[0], F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref.startswith("?"), F.concat(origin, p[2], ref))
            .when(ref.startswith("#"), F.concat(origin, p[2], F.when(p[3] != "", F.concat(F.lit("?"), p[3])).otherwise(F.lit("")), ref))
            .otherwise(F.concat(origin, folder, ref))
        )

    return let(F.struct(parts(base).alias("p"), cleaned(reference).alias("ref")), resolved)


def _both(candidate: Column | str, other: Column | str, body: Callable[[Column, Column], Column]) -> Column:
    pair = F.struct(parts(candidate).alias("a"), parts(other).alias("b"))
    return F.coalesce(let(pair, lambda p: body(p["a"], p["b"])), F.lit(False))


def _same_origin(a: Column, b: Column) -> Column:
    return (_scheme(a) == _scheme(b)) & (a[5] == b[5]) & (_effective_port(a) == _effective_port(b)) & _port_valid(a) & _port_valid(b)


def within_root(candidate: Column | str, root: Column | str, include_root: bool = False) -> Column:
    """Same scheme, host and port, and the path below the root's at a segment boundary."""

    def within(a: Column, b: Column) -> Column:
        own, top = F.rtrim(a[2], F.lit("/")), F.rtrim(b[2], F.lit("/"))
        below = F.when(own == top, F.lit(include_root)).otherwise(F.when(top == "", own.startswith("/")).otherwise(own.startswith(F.concat(top, F.lit("/")))))
        return _same_origin(a, b) & below

    return _both(candidate, root, within)


def same_origin(candidate: Column | str, other: Column | str) -> Column:
    return _both(candidate, other, _same_origin)


def origin(url: Column | str) -> Column:
    return let(parts(url), lambda p: F.concat(p[0], F.lit("://"), p[1]))


def shape_fault(url: Column | str) -> Column:
    """Why a URL may not be crawled, or null: scheme_or_host, credentials, localhost."""

    def fault(p: Column) -> Column:
        return (
            F.when(p.isNull() | ~_scheme(p).isin("http", "https") | (p[5] == ""), F.lit("scheme_or_host"))
            .when(_has_credentials(p), F.lit("credentials"))
            .when((p[5] == "localhost") | p[5].endswith(".localhost"), F.lit("localhost"))
        )

    return let(parts(url), fault)


def url_hash(url: Column | str) -> Column:
    return F.sha2(_col(url), 256)
