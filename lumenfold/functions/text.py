"""Text rules as column expressions. Lower-casing is Unicode's on both sides, not the bytes' of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(s, r"\s+", " ")))


def split_words(s: Column) -> Column:
    """Parts between single spaces; no empty part at the end."""
    parts = F.split(s, " ")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def word_index(s: Column, at: Column) -> Column:
    """Spaces before character ``at`` (from 0): the index of the word there."""
    head = F.substring(s, F.lit(1), at)
    return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))


def strip_punctuation(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"\p{Punct}", ""))


def tokens(s: Column) -> Column:
    """Words without ASCII punctuation; words of nothing else are kept as empty, so indexes agree."""
    return F.transform(split_words(normalize(s)), strip_punctuation)


def find_tokens(words: Column, wanted: Column) -> Column:
    """First index of ``wanted`` as a window of ``words``, or -1. Arrays of strings."""
    joined = F.concat(F.lit("\n"), F.array_join(words, "\n"), F.lit("\n"))
    needle = F.concat(F.lit("\n"), F.array_join(wanted, "\n"), F.lit("\n"))
    at = F.instr(joined, needle)
    head = F.substring(joined, F.lit(1), at)
    return F.when((F.size(wanted) == 0) | (at == 0), -1).otherwise(F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) - 1)


def assertion(text: Column) -> Column:
    """absent if the text is negative (or says no), else present if positive or present; null otherwise."""
    t = F.lower(text)
    return F.when(t.contains("negative") | t.contains("no "), "absent").when(t.contains("positive") | t.contains("present"), "present")


def concept_type(text: Column, given: Column) -> Column:
    """A text that names a Gleason grade is one, whatever it was called."""
    return F.when(F.lower(text).contains("gleason"), "gleason_grade").otherwise(given)


def mark_extraprostatic(text: Column, assertion_: Column) -> Column:
    return F.when(F.lower(text).contains("extraprostatic"), "present").otherwise(assertion_)


def is_global_on_create(kind: Column) -> Column:
    return kind == "gleason_grade"


def is_global_on_load(kind: Column, assertion_: Column) -> Column:
    return (kind == "gleason_grade") | (assertion_ == "absent")


def frame_range(name: Column) -> tuple[Column, Column]:
    """First and last frame of a name written as two numbers."""
    part = lambda i: F.regexp_extract(name, r"^\s*(\d+)\s+(\d+)\s*$", i).try_cast("long")
    return part(1), part(2)


def annotation_kind(kind: Column, merge_voice: bool = False) -> Column:
    """Kind as stored; with ``merge_voice`` voice polygons read as plain ones, as older files have them."""
    return F.when(kind == "voice_poly", "poly").otherwise(kind) if merge_voice else kind
