"""Text functions as columns: tokens, keys, identifiers, sentences, record fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

SENTENCE_END = "[.!?\\n\\r]"


def normalize_token(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "[^A-Za-z0-9]", ""))


def padded(text: Column) -> Column:
    """The tokens of a text as one string, a space on each side of each: ` a  b  a `; only spaces if there is none.

    Counting and finding tokens in it are plain string functions inside whole-stage code generation, where
    arrays with lambdas are interpreted element by element.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "(?U)[^A-Za-z0-9\\s]+", ""), "(?U)\\s+", "  ")
    return F.concat(F.lit(" "), F.lower(F.trim(bare)), F.lit(" "))


def count_tokens(pad: Column) -> Column:
    return F.when(pad == "  ", 0).otherwise(F.octet_length(pad) - F.octet_length(F.replace(pad, F.lit("  "), F.lit(" "))) + 1)


def count_token(pad: Column, token: str) -> Column:
    """How often a token stands in the padded text."""
    return ((F.octet_length(pad) - F.octet_length(F.replace(pad, F.lit(f" {token} "), F.lit("")))) / F.lit(len(token) + 2)).cast("long")


def has_token(pad: Column, token: str) -> Column:
    return pad.contains(f" {token} ")


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words and digits, in order, with repeats."""
    bare = F.trim(padded(text))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "  "))


def tokenize_text(text: str) -> list[str]:
    """The same for a Python string, such as a query."""
    words = (re.sub(r"[^A-Za-z0-9]", "", w).lower() for w in text.split())
    return [w for w in words if w]


def index_key(value: Column) -> Column:
    """Without white space at the ends, ASCII letters in lower case."""
    bare = F.regexp_replace(F.regexp_replace(value, "(?U)^\\s+", ""), "(?U)\\s+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What trimming takes away at the ends.
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def normalize_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "(?U)\\s+", " "))


def sanitize_id(value: Column, most: int) -> Column:
    """Letters, digits, `-`, `_`, `:` kept in lower case, all else a hyphen; cut, hyphens at the ends off; `raw` if empty."""
    kept = F.lower(F.regexp_replace(value, "[^A-Za-z0-9\\-_:]", "-"))
    bare = F.regexp_replace(F.substring(kept, 1, most), "^-+|-+$", "")
    return F.when(F.length(bare) > 0, bare).otherwise("raw")


def sanitize_path(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9\\-_]", "_")


def escape_field(value: Column, returns: bool = False) -> Column:
    """Backslash, tab and line feed as two characters; `returns`: carriage returns too, as segment files have them."""
    out = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\r"), F.lit("\\r")) if returns else out


def unescape_field(value: Column) -> Column:
    """Undo escape_field, with or without carriage returns: what lies between escaped backslashes is decoded apart."""
    parts = F.split(value, r"\\\\", -1)
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(parts, plain), "\\")


def url_decode(value: Column) -> Column:
    """Plus signs to spaces, percent escapes to the bytes of UTF-8 text; null where an escape is broken."""
    broken = value.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~broken, F.try_url_decode(value))


def query_parameters(target: Column) -> Column:
    """A map of the parameters of `path?a=b&c=d`, decoded; the last of equal names counts, a name alone has an empty value."""
    raw = F.split_part(target, F.lit("?"), F.lit(2))
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    entry = lambda p: F.struct(url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def pack_strings(values: Column) -> Column:
    """Byte length, colon, value, for each string."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)), "")


def pack_floats(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def unpack_floats(value: Column) -> Column:
    return F.when(value == "", F.array().cast("array<float>")).otherwise(F.transform(F.split(value, ","), lambda v: v.cast("float")))


def decode_base64(value: Column) -> Column:
    """Both alphabets, white space ignored, padding optional."""
    plain = F.translate(F.regexp_replace(value, "(?U)[\\s=]+", ""), "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def usage_tokens(value: Column) -> Column:
    return F.size(F.filter(F.split(value, "(?U)\\s+"), lambda t: t != ""))
