"""Filters of extracted candidates, as expressions: the cleaned candidate, or null if it is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls, values
from .dialect import any_of

SCRIPT_ENDS = (".js", ".mjs", ".cjs")
#: Limits on a path: segments, bytes of a segment, letters that one segment must have.
MAX_SEGMENTS, MAX_SEGMENT_BYTES, LETTERS = 8, 80, 2
CLASS_NAME_BYTES = 30


def let(value: Column, function) -> Column:
    """function(value), where value is computed once however often function uses it; plain nesting would write it out each time."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def lit_replace(s: Column, what: str, by: str = "") -> Column:
    return F.replace(s, F.lit(what), F.lit(by))


def stripped(s: Column) -> Column:
    """Without white space around, then quotes around, then slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", ""), "^[\"']+|[\"']+$", ""), "/+$", "")


def unescaped(s: Column) -> Column:
    for what, by in (("%3A", ":"), ("%2F", "/"), ("\\\\", "")):
        s = lit_replace(s, what, by)
    return F.regexp_replace(F.regexp_replace(s, r"\\+$", ""), "^=+", "")


def blacklisted(s: Column) -> Column:
    return s.rlike(any_of(values.DOMAIN_BLACKLIST))


def script(s: Column) -> Column:
    for what, by in (("\\/", "/"), (" ", ""), ('"', ""), ("'", ""), ("./", "/")):
        s = lit_replace(s, what, by)
    return let(unescaped(s), lambda v: F.when(~blacklisted(v) & (v != ""), v))


def static(s: Column) -> Column:
    def judged(v):
        bad = (F.octet_length(v) < 3) | v.rlike(r"\.[mc]?js\z") | F.lower(v).rlike(any_of(values.STATIC_FILE_PARTS)) | blacklisted(v)
        return F.when(~bad, v)

    return let(stripped(s), judged)


def media_type(s: Column) -> Column:
    """Whether a media type is anywhere in it."""
    return s.rlike(any_of(values.MEDIA_TYPES))


def class_name(s: Column) -> Column:
    return (F.octet_length(s) < CLASS_NAME_BYTES) & s.rlike(r"\A[a-z][a-z0-9-]*\z")


def message_key(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z]+(?:\.[A-Za-z]+){2,}\z")


def bundler_symbol(s: Column) -> Column:
    return s.contains("__webpack_") | (s.rlike(r"\A_+[A-Za-z0-9]*\z") & (F.octet_length(s) >= 2))


def sane_segments(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?s)\?.*$", "")
    segments = F.split(F.regexp_replace(bare, "^/+|/+$", ""), "/")
    long = F.exists(segments, lambda x: F.octet_length(x) > MAX_SEGMENT_BYTES)
    lettered = F.exists(segments, lambda x: F.length(F.regexp_replace(x, "[^a-zA-Z]", "")) >= LETTERS)
    return (bare != "") & (F.size(segments) <= MAX_SEGMENTS) & ~long & lettered


def api_cleaned(s: Column) -> Column:
    """First half of `api`: early refusals and replacements."""
    root = F.regexp_replace(F.regexp_replace(s, "^[\"']+|[\"']+$", ""), "^/+", "").rlike("^(?:" + any_of(values.API_ROOTS) + ")")
    clean = s
    for what, by in ((" ", ""), ("\\/", "/"), ('"', ""), ("'", "")):
        clean = lit_replace(clean, what, by)
    clean = F.regexp_replace(unescaped(clean), "^href=", "")
    return let(clean, lambda v: F.when((s != "") & ~media_type(s) & ~root & ~v.isin("href", ""), v))


def api_path(clean: Column) -> Column:
    """Second half: refusals of the cleaned candidate, and the path of an absolute URL."""
    bad = clean.rlike(any_of(values.URL_SUBSTRINGS)) | F.lower(F.regexp_replace(clean, r"(?s)\?.*$", "")).rlike("(?:" + any_of(values.API_FILE_ENDS) + r")\z")
    query = urls.query(clean)
    path = F.when(clean.contains("://") & urls.valid(clean), F.concat(urls.path(clean), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(clean)
    return F.when(~bad, path)


def sane_path(path: Column) -> Column:
    return F.when((path != "") & ~class_name(path) & ~message_key(path) & ~bundler_symbol(path) & sane_segments(path), path)


def api(s: Column) -> Column:
    return let(let(let(s, api_cleaned), api_path), sane_path)
