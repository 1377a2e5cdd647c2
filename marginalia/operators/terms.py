"""Terms in texts: all terms in one automaton, each text read once."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the terms of one automaton, which every Python worker holds (about 60 bytes a letter); more terms are searched in blocks.
MAX_LETTERS = 4_000_000

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, terms: list[str], first: int) -> ahocorasick.Automaton:
    """Built once in a Python worker, which keeps one alone."""
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms, first):
            made.add_word(term, (i, len(term)))
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _part_of_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def hits_in(text: str, automaton: ahocorasick.Automaton, words: bool) -> list[int]:
    """Numbers of the terms that a text holds, ascending; with words: between characters that are no letters or digits."""
    found: set[int] = set()
    for end, (i, size) in automaton.iter(text):
        if i in found:
            continue
        if words:
            begin = end - size + 1
            if (begin > 0 and _part_of_word(text[begin - 1])) or (end + 1 < len(text) and _part_of_word(text[end + 1])):
                continue
        found.add(i)
        if len(found) == len(automaton):
            break
    return sorted(found)


class TermIndex:
    """Distinct non-empty terms with numbers, in blocks of bounded size."""

    def __init__(self, terms: DataFrame, column: str = "term", max_letters: int = MAX_LETTERS):
        self.spark, self.column, self.blocks = terms.sparkSession, column, []
        every, block, letters = terms.select(column).where(F.col(column) != "").distinct().orderBy(column), [], 0
        first = 0
        for (term,) in every.toLocalIterator():  # configuration, a partition at a time
            if block and letters + len(term) > max_letters:
                self.blocks.append((first, block))
                first, block, letters = first + len(block), [], 0
            block.append(term)
            letters += len(term)
        if block:
            self.blocks.append((first, block))

    def numbers(self) -> DataFrame:
        """(term, number)."""
        rows = None
        for first, block in self.blocks:
            part = self.spark.createDataFrame(pd.DataFrame({self.column: block, "number": range(first, first + len(block))}), f"{self.column} string, number int")
            rows = part if rows is None else rows.unionByName(part)
        return self.spark.createDataFrame([], f"{self.column} string, number int") if rows is None else rows

    def search(self, docs: DataFrame, text: Column, words: bool = False) -> DataFrame:
        """docs with a row and its `number` for each term that the text holds. Only the text goes through Python."""
        out = None
        for first, block in self.blocks:
            part = docs.withColumn("number", F.explode(_search(self.spark.sparkContext.broadcast(block), first, words)(text)))
            out = part if out is None else out.unionByName(part)
        return docs.withColumn("number", F.lit(None).cast("int")).where(F.lit(False)) if out is None else out


def _search(terms: Broadcast, first: int, words: bool) -> Callable[[Column], Column]:
    key = uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        automaton = _automaton(key, terms.value, first)
        return pd.Series([hits_in(t, automaton, words) if t else [] for t in texts])

    return hits
