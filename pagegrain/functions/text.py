"""Text functions: all are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"  # fixed values: white space as ECMAScript has it

_BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # the same, one by one


def trim(text: Column) -> Column:
    """Strip Unicode white space and byte-order marks from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return text.isNull() | ~text.rlike(f"(?!{BLANK})[\\s\\S]")


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, ASCII letters, digits and spaces alone, trimmed; null for null.

    Single characters are mapped first (white space to spaces), so that one short rule is left for runs and one for the rest.
    """
    spaced = F.regexp_replace(F.translate(F.lower(text), _BLANKS, " " * len(_BLANKS)), "  +", " ")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9 ]+", ""))


def words(normalized: Column) -> Column:
    """The non-empty words of a normalized text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def words_included(hay: Column, needle: Column) -> Column:
    """Whether every needle word is a hay word (arrays of words)."""
    return F.forall(needle, lambda w: F.array_contains(hay, w))


def is_all_caps(text: Column) -> Column:
    """At least two ASCII letters, all upper case."""
    letters = F.regexp_replace(text, "[^a-zA-Z]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters))


def is_heading(role: Column, text: Column) -> Column:
    """A text with a heading role, in capitals up to 80 characters, or up to 60 that start with a capital. False for null or empty.

    The text is trimmed once; only short ones are looked at.
    """
    t = F.btrim(text, F.lit(_BLANKS))
    looks = F.get(F.transform(F.array(t), lambda x: (F.length(x) <= 80) & (((F.length(x) <= 60) & x.rlike("^[A-Z]")) | is_all_caps(x))), 0)
    return F.coalesce((text != "") & (F.lower(role).contains("heading") | looks), F.lit(False))


def snippet(text: Column, limit: int = 200) -> Column:
    """Texts over ``limit`` characters end in an ellipsis after limit - 3; null stays null."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("…"))).otherwise(text)


def ui_snippet(text: Column) -> Column:
    """A snippet of 150, or a placeholder for null and empty texts."""
    return F.when(text.isNull() | (text == ""), F.lit("(no text)")).otherwise(snippet(text, 150))


def title_of(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot; empty if there is none. A leading dot starts none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def slug(frame_slug: Column, name: Column) -> Column:
    return F.concat(frame_slug, F.lit("-"), F.regexp_replace(F.lower(name), r"\s+", "-"))


def parse_int(text: Column) -> Column:
    """Leading digits with a sign, as parseInt; null if there are none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def strict_int(text: Column) -> Column:
    """The whole text as a whole number; null otherwise."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint"))


def null_if_zero(number: Column) -> Column:
    return F.nullif(number, F.lit(0))


def query_param(url: Column, name: str) -> Column:
    """A decoded URL query parameter."""
    return F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(name)))


def js_round(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5)


def number_text(x: Column) -> Column:
    """A number as JSON prints it: whole numbers without a point."""
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("bigint"))).otherwise(x.cast("string"))


def percent(share: Column, digits: int = 0) -> Column:
    """A share as a percentage, halves going up."""
    scaled = F.floor(share * 100 * 10**digits + 0.5) / 10**digits
    return F.concat(F.format_string(f"%.{digits}f", scaled), F.lit("%"))


def uri_encoded(text: Column) -> Column:
    """A URI component: ASCII letters, digits and -_.!~*'() as they are, other bytes in hex."""
    out = F.url_encode(text)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def iso_time(t: Column) -> Column:
    """A UTC time to the millisecond, as 2024-05-06T07:08:09.010Z."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; null without either."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
