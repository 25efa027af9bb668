"""Names, slugs, hosts and mark-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell products apart.
QUALIFIERS = ("fresh", "dried", "ground", "chopped", "sliced", "grated", "whole", "ripe", "free", "range", "extra", "virgin")
# Entities and the characters they stand for; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def normalise(name: Column) -> Column:
    """Lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def tokens(name: Column, dropped: tuple[str, ...] = QUALIFIERS) -> Column:
    """The distinct words of a name that tell products apart."""
    words = F.array_distinct(F.split(normalise(name), " "))
    return F.array_except(words, F.array(*[F.lit(w) for w in (*dropped, "")]))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalise(name: Column) -> Column:
    """The first character upper case; the rest stays."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**31 - 1))


def host(url: Column) -> Column:
    """Host of a URL without a leading www.; null for what isn't a URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def is_product_page(url: Column) -> Column:
    """A path of two characters or more, and no search segment."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (F.length(path) >= 2) & ~F.lower(path).rlike("/(search|s|find|results)(/|$)")


def strip_tags(html: Column) -> Column:
    """Text of mark-up: scripts, styles and tags go, entities are read, white space is squeezed."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def og_image(html: Column) -> Column:
    """Address of a page's image, empty without one."""
    return F.regexp_extract(html, "(?is)<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)[\"']", 1)


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page, one below the other."""
    return F.array_join(F.regexp_extract_all(html, F.lit("(?is)<script[^>]+application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1)), "\n")


def encode_component(text: Column) -> Column:
    """Percent-encoding with %20 for blanks, and !'()* left as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for written, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return out
