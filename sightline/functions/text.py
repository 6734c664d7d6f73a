"""Subtitle times, identity names, line wrapping and the tags of tool calls, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest line for text with and without CJK characters.
CJK_WIDTH, LATIN_WIDTH = 16, 24
CJK = r"[一-鿿]"


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    whole = F.floor(seconds)
    ms = F.floor((seconds - whole) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), ms)


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc; hundredths are rounded on their own, so 1.999 gives .100 as in the format's usual writers."""
    whole = F.floor(seconds)
    cs = F.rint((seconds - whole) * 100).cast("int")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), cs)


def duration(seconds: Column) -> Column:
    """DD hours and so on, as 00d 00h 00m."""
    s = F.floor(seconds)
    return F.format_string("%02dd %02dh %02dm", F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))


def person_name(identity: Column) -> Column:
    return F.regexp_replace(identity, "^VID_", "Person_")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def join_tokens(tokens: Column) -> Column:
    """Tokens with spaces between, or without where any is CJK."""
    return F.when(F.exists(tokens, has_cjk), F.array_join(tokens, "")).otherwise(F.array_join(tokens, " "))


def wrap(text: Column, width: Column | int) -> Column:
    """Lines of whole words no longer than width where words allow it."""
    w = F.lit(width) if isinstance(width, int) else width
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        fits = (F.length(acc["line"]) == 0) | (F.length(acc["line"]) + 1 + F.length(word) <= w)
        grown = F.when(F.length(acc["line"]) == 0, word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, grown).otherwise(word).alias("line"))

    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.aggregate(words, empty, step, lambda acc: F.when(F.length(acc["line"]) > 0, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]))


def wrap_subtitle(text: Column) -> Column:
    return wrap(text, F.when(has_cjk(text), CJK_WIDTH).otherwise(LATIN_WIDTH))


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))


def tool_call(text: Column) -> Column:
    """The JSON between tool tags, with a surplus closing brace dropped; empty where there is none."""
    return F.replace(F.trim(F.regexp_extract(text, r"(?s)<tool>(.*?)</tool>", 1)), F.lit("}}}"), F.lit("}}"))


def verdict(text: Column) -> Column:
    """Accept or Reject inside verdict tags, null otherwise."""
    found = F.regexp_extract(text, r"(?s)<verdict>\s*(Accept|Reject)\s*</verdict>", 1)
    return F.when(found != "", found)
