"""URL functions and link predicates on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of links that page through an index, and signs of a challenge page.
PAGE_WORDS = ("next", "siguiente", "suivant", "continue", "older", "more", "page", "pages", ">>", "›", "»")
CHALLENGE = ("challenge", "cloudflare", "checking your browser", "ddos-guard", "just a moment", "cf-challenge", "attention required", "ray id", "security check")
PLACEHOLDER = "paywalled"
_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 1)


def authority(url: Column) -> Column:
    """Host with its port."""
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 5)


def canonical(url: Column) -> Column:
    """Without slashes at the path's end; an empty path becomes a slash. Query and fragment stay."""
    bare = F.regexp_replace(path(url), "/+$", "")
    head = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(authority(url) != "", F.concat(F.lit("//"), authority(url))).otherwise(""))
    return F.concat(head, F.when(bare == "", "/").otherwise(bare), query(url), fragment(url))


def without_dots(path: Column) -> Column:
    """A path without . and .. segments; .. at the top goes nowhere."""
    parts = F.split(path, "/", -1)
    step = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)).when(p == ".", acc).otherwise(F.array_append(acc, p))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(path.rlike(r"(^|/)\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def resolve(href: Column, base: Column) -> Column:
    """An absolute form of href: scheme-relative, host-relative, absolute if it begins with http, else joined to the base by the URL standard."""
    href = F.trim(href)
    site = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    joined = F.concat(site, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), F.regexp_extract(href, r"^[^?#]*(.*)$", 1))
    beside = F.when(href.startswith("?"), F.concat(site, path(base), href)).when(href.startswith("#"), F.concat(site, path(base), query(base), href)).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).otherwise(joined)
    return F.when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(site, href)).when(href.startswith("http"), href).otherwise(beside)


def is_followable(href: Column) -> Column:
    href = F.trim(href)
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def is_pagination(url: Column, label: Column) -> Column:
    label = F.lower(F.trim(label))
    word = F.lit(False)
    for w in PAGE_WORDS:
        word = word | F.contains(label, F.lit(w))
    return word | F.lower(url).rlike(r"[?&](page|p)=\d+") | F.lower(path(url)).rlike(r"/(page|p)/\d+") | label.rlike(r"^\d{1,4}$")


def is_chapter(url: Column, index_path: Column) -> Column:
    low = F.lower(path(url))
    numbered = low.rlike(r"/\d+/?$") & F.startswith(low, index_path) & (low != F.concat(index_path, F.lit("/")))
    return F.contains(low, F.lit("chapter")) | numbered


def link_kind(url: Column, label: Column, index_path: Column) -> Column:
    """pagination, chapter or other; pagination wins."""
    return F.when(is_pagination(url, label), "pagination").when(is_chapter(url, index_path), "chapter").otherwise("other")


def index_is_chapter(url: Column) -> Column:
    return F.contains(F.lower(path(url)), F.lit("chapter")) & ((F.length(query(url)) > 1) | path(url).rlike(r"/\d+/?$"))


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(F.lower(F.regexp_replace(authority(url), ":.*$", "")), r"\.")
    return F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".")


def is_challenge(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for sign in CHALLENGE:
        out = out | F.contains(low, F.lit(sign))
    return out
