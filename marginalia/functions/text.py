"""Text forms: for display, for comparison, for files."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"<[^<>]{1,200}>")
SPACES = re.compile(r"[\s ​﻿]+")
JUNK = " \t\n\r.,;:-_*\"'`|/\\"
PAIRS = {"(": ")", "[": "]", "{": "}"}


def balanced(text: str) -> str:
    """Without brackets at the ends that enclose all or have no partner."""
    while text:
        for a, b in PAIRS.items():
            if text[0] == a and text[-1] == b and text.find(b) == len(text) - 1 and text.rfind(a) == 0:
                text = text[1:-1].strip()
                break
            if text[:1] == a and text.count(a) > text.count(b):
                text = text[1:].strip()
                break
            if text[-1:] == b and text.count(b) > text.count(a):
                text = text[:-1].strip()
                break
        else:
            return text
    return text


def clean_display(text: str) -> str:
    """Entities, tags, odd spaces, junk at the ends and stray brackets removed, until nothing changes."""
    while True:
        new = balanced(SPACES.sub(" ", TAG.sub(" ", html.unescape(text))).strip(JUNK))
        if new == text:
            return new
        text = new


def normalize(text: str) -> str:
    """For comparison: lower case, no accents, letters and digits apart from single spaces."""
    flat = unicodedata.normalize("NFD", clean_display(text).lower())
    return " ".join(re.sub(r"[^\w]|_", " ", "".join(c for c in flat if not unicodedata.combining(c))).split())


def cut_bytes(text: str, limit: int) -> str:
    """At most so many bytes of UTF-8, whole characters only."""
    return text.encode()[:limit].decode("utf-8", "ignore")


def looks_like_author(text: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d_][\w'’-]+,\s*(?:[^\W\d_]\.\s*-?){1,4}", text.strip()))


def _mapped(f: Callable[[str], str]) -> Callable[[str], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return lambda column: F.pandas_udf(run, "string")(F.col(column))


clean_display_udf, normalize_udf = _mapped(clean_display), _mapped(normalize)


def entities(c: Column) -> Column:
    """With HTML entities decoded."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return F.pandas_udf(run, "string")(c)


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "</?[A-Za-z!][^<>]*>", "")


def safe_url(c: Column) -> Column:
    """Addresses of the web only."""
    return F.when(c.rlike("(?i)^https?://"), c)


def safe_cell(c: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula: ' goes before = + - @ tab and CR unless it is a number."""
    return F.when(c.rlike(r"\A[=+\-@\t\r]") & ~c.rlike(r"\A[+-]?\d+([.,]\d+)?\z"), F.concat(F.lit("'"), c)).otherwise(c)


def plain_cell(c: Column) -> Column:
    """The inverse of safe_cell."""
    return F.when(c.rlike(r"\A'[=+\-@\t\r]"), F.substring(c, 2, 2**31 - 1)).otherwise(c)


def first_issn(c: Column) -> Column:
    found = F.regexp_extract(F.upper(c), r"(?:^|[^0-9])([0-9]{4})-?([0-9]{3}[0-9X])(?![0-9])", 0)
    digits = F.regexp_replace(found, "[^0-9X]", "")
    return F.when(digits != "", F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4)))


def doi_of(c: Column) -> Column:
    found = F.rtrim(F.regexp_extract(F.lower(c), r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1))
    return F.when(found != "", F.regexp_replace(found, r"[.,;]+$", ""))


def year_of(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?:^|[^0-9])((?:1[0-9]|20|21)[0-9]{2})(?![0-9])", 1)
    return F.when(found != "", found.cast("int"))
