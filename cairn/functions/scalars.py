"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[㐀-䶿一-鿿぀-ヿ가-힯]"


def tokens_simple(text: Column) -> Column:
    """0 for an empty text, else max(1, length / 4)."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def tokens_mixed(text: Column) -> Column:
    """Four characters a token, 1.6 for CJK ones, rounded up."""
    n, cjk = F.char_length(F.coalesce(text, F.lit(""))), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(CJK))
    return F.when(n == 0, 0).otherwise(F.floor((n - cjk) / 4.0 + cjk / 1.6 + 0.999999)).cast("long")


def plain(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def file_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def set_hash(lines: Column) -> Column:
    """Hash of lines in sorted order, each ended by a line feed: the order of collection doesn't matter."""
    return F.sha2(F.concat(F.array_join(F.array_sort(lines), "\n"), F.lit("\n")).cast("binary"), 256)


def module_of(path: Column, suffixes: str = "py|pyi|ts|tsx|js|jsx|go|rs|java|ps1") -> Column:
    """Dotted module of a path: without any ``src`` part and without a known suffix."""
    parts = F.filter(F.split(F.regexp_replace(path, rf"\.({suffixes})$", ""), "/"), lambda p: (p != "src") & (p != ""))
    return F.array_join(parts, ".")


def last_part(name: Column, mark: str) -> Column:
    return F.substring_index(name, mark, -1)


def snippet(text: Column, line_start: Column, line_end: Column, around: int = 3, most: int = 1200) -> Column:
    """Lines around a symbol, stripped and cut to ``most`` characters."""
    first = F.greatest(F.lit(0), line_start - 1 - around)
    last = F.least(F.size(F.split(text, "\n")), line_end + around)
    joined = F.btrim(F.array_join(F.slice(F.split(text, "\n"), first + 1, F.greatest(F.lit(0), last - first)), "\n"), F.lit(" \n\t\r"))
    return F.when(F.char_length(joined) > most, F.concat(F.substring(joined, 1, most - 3), F.lit("..."))).otherwise(joined)


def tags(values: Column) -> Column:
    """Trimmed, without empty ones, the first of equals."""
    return F.array_distinct(F.filter(F.transform(values, lambda t: F.trim(t)), lambda t: t != ""))


def safe_url(url: Column) -> Column:
    """http(s) without user, query and fragment; null for other schemes."""
    return F.when(url.rlike("^https?://"), F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(https?://)[^/@]*@", "$1"))


def identifiers(expression: Column, keywords: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(expression, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))), F.array(*map(F.lit, keywords))))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, by a fold."""
    hexed = F.hex(text.cast("binary"))
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(0x811C9DC5).cast("long")
    return F.when(F.octet_length(text) == 0, start).otherwise(F.aggregate(codes, start, lambda h, b: (h.bitwiseXOR(b) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))))


def widened(old: Column, new: Column) -> Column:
    """Whether the new scope is an ancestor of the old one."""
    return F.startswith(old, F.concat(new, F.lit("/")))


def embedding_text(project: Column, event: Column, title: Column, status: Column, summary: Column, body: Column, labels: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("Project: "), project), F.concat(F.lit("Event: "), event), F.concat(F.lit("Title: "), title),
                       part("Status", status), part("Summary", summary), part("Body", body), part("Tags", F.array_join(labels, ", ")))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def matches(text: Column, query: str) -> Column:
    """Whether a text has every word of a web-style query and none of those after a minus sign."""
    words = words_of(text)
    out = F.lit(True)
    for term in query.lower().split():
        found = F.array_contains(words, term.lstrip("-"))
        out = out & (~found if term.startswith("-") else found)
    return out


def guid(text: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, "([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1), F.lit("")))


#: What only one of two languages has.
OBJECTIVE = r"(?m)^\s*(#\s*import\b|@(interface|implementation|protocol|class)\b)"
PLUS_PLUS = r"\b(class|namespace|template|typename|constexpr|consteval|constinit|noexcept|nullptr|decltype)\b|::|\b(public|private|protected)\s*:"


def dialect(extension: Column, text: Column) -> Column:
    """Language of files whose suffix two languages share, from their first 8192 characters."""
    head = F.substring(text, 1, 8192)
    bare = F.regexp_replace(head, r"(?s)/\*.*?\*/|//[^\r\n]*", "")
    return (F.when((extension == ".m") & head.rlike(OBJECTIVE), "objc").when(extension == ".m", "matlab")
            .when((extension == ".h") & bare.rlike(PLUS_PLUS), "cpp").when(extension == ".h", "c"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID of version 5, by SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def improvement(full: Column, part: Column) -> Column:
    """How many times faster the second is, rounded to 2; null where it took no time."""
    return F.when(part > 0, F.round(full / part, 2))
