"""Helpers shared by the training-data operators: scratch tables, text columns and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import components as connected
from graphloom.plans.durable import durable, release, scratch_dir

__all__ = ["SPACES", "WORD", "components", "durable", "n_words", "release", "scratch_dir", "squeezed", "text_or_empty"]

#: The six ASCII white-space characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: A word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column | str) -> Column:
    """The text without any white space, the form in which exact copies are compared; null counts as empty."""
    return F.translate(text_or_empty(text), SPACES, "")


def n_words(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text_or_empty(text), F.lit(WORD)), F.lit(0)).cast("long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b), component being the smallest id reachable."""
    return connected(links, "a", "b")
