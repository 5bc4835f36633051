"""Scalar functions over texts, colours, urls and tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_whitespace(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(x), r"(?U)\s+", " "))


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "<[^>]+>", "")


def clip_bytes(x: Column | str, limit: int) -> Column:
    """The longest beginning of at most ``limit`` bytes that ends at a character."""
    text = c(x)
    raw = F.encode(text, "UTF-8")
    # A character goes on at a byte from 80 to BF.
    goes_on = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    end = F.when(~goes_on(limit + 1), limit).when(~goes_on(limit), limit - 1).when(~goes_on(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def epoch_s(ts: Column | str) -> Column:
    """A timestamp as seconds, with microseconds."""
    return F.unix_micros(c(ts).cast("timestamp")) / F.lit(1_000_000.0)


def ellipsis(x: Column | str, most: int, keep: int) -> Column:
    """Cut to ``keep`` bytes and three dots if longer than ``most`` bytes."""
    return F.when(F.octet_length(c(x)) > most, F.concat(clip_bytes(x, keep), F.lit("..."))).otherwise(c(x))


def slug(x: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c(x)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def host(url: Column | str) -> Column:
    return F.regexp_extract(c(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def without_query(url: Column | str) -> Column:
    return F.substring_index(c(url), "?", 1)


def price(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "[$,]", "").try_cast("double")


def half_steps(x: Column | str) -> Column:
    return F.round(c(x) * 2) / 2


def first_number(x: Column | str) -> Column:
    return F.regexp_extract(c(x), r"(\d+\.?\d*)", 1).try_cast("double")


def fingerprint(*fields: Column | str) -> Column:
    """Digest of the fields' normal forms: texts trimmed, in lower case; numbers
    to two places."""
    return F.md5(F.concat_ws("|", *[c(f) for f in fields]).cast("binary"))


# Token estimates ----------------------------------------------------------

def tokens_chars4(x: Column | str) -> Column:
    return F.floor(F.char_length(c(x)) / 4).cast("long") + 1


def tokens_bytes4(x: Column | str) -> Column:
    return F.ceil(F.octet_length(c(x)) / F.lit(4.0)).cast("long")


def _classes(x: Column | str) -> tuple[Column, Column, Column]:
    """Characters in all, white space, and what is neither that nor a letter or
    digit."""
    text = c(x)
    white = F.char_length(text) - F.char_length(F.regexp_replace(text, r"(?U)\s", ""))
    special = F.char_length(F.regexp_replace(text, r"(?U)[\s\p{L}\p{N}]", ""))
    return F.char_length(text), white, special


def tokens_anthropic(x: Column | str) -> Column:
    n, white, special = _classes(x)
    return F.floor(F.lit(1.1) * (F.floor((n - white - special) / 4) + white + 2 * special)).cast("long")


def tokens_openai(x: Column | str) -> Column:
    n, white, special = _classes(x)
    return F.floor(F.lit(1.05) * (F.floor((n - white - special) / 4) + white + special)).cast("long")


TOKEN_COUNTERS = {"chars4": tokens_chars4, "bytes4": tokens_bytes4, "anthropic": tokens_anthropic, "openai": tokens_openai}


# Colours ------------------------------------------------------------------

def style_value(style: Column | str, prop: str) -> Column:
    """The declaration's value, of exactly this property; null if there is none."""
    found = F.trim(F.regexp_extract(c(style), rf"(?i)(?:^|;)\s*{prop}\s*:\s*([^;]*)", 1))
    return F.when(found != "", found)


def rgb(colour: Column | str) -> Column:
    """struct(r, g, b) from 0 to 255, null for what isn't understood."""
    text = c(colour)
    digits = F.substring(text, 2, 8)
    wide = F.when(F.char_length(text) == 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    part = lambda k: F.conv(F.substring(wide, k, 2), 16, 10).cast("int")
    triple = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    number = lambda k: F.regexp_extract(text, r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,[^)]*)?\)$", k).try_cast("int")
    level = lambda n: triple(F.lit(n), F.lit(n), F.lit(n))
    return (
        F.when(text.rlike("^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), triple(part(1), part(3), part(5)))
        .when(number(1).between(0, 255) & number(2).between(0, 255) & number(3).between(0, 255), triple(number(1), number(2), number(3)))
        .when(text.isin("transparent", "black"), level(0)).when(text == "white", level(255)))


def luminance(colour: Column) -> Column:
    def part(name: str) -> Column:
        x = colour[name] / F.lit(255.0)
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part("r") + 0.7152 * part("g") + 0.0722 * part("b")


def contrast(fg: Column, bg: Column) -> Column:
    a, b = luminance(fg), luminance(bg)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def is_large_text(style: Column | str, tag: Column | str) -> Column:
    size = style_value(style, "font-size")
    number = lambda unit: F.regexp_replace(size, f"{unit}$", "").try_cast("double")
    by_tag = c(tag).isin("h1", "h2")
    by_unit = (
        F.when(size.contains("pt"), number("pt") >= 18).when(size.contains("px"), number("px") >= 24)
        .when(size.contains("em"), number("em") >= 1.5).when(size.contains("%"), number("%") >= 150)
        .when(size.isin("large", "x-large", "xx-large"), F.lit(True)))
    return F.coalesce(by_unit, by_tag)
