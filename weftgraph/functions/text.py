"""Tokens, summaries and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits.
_RUN = r"[\p{L}\p{Nd}]+"


def camel_split(text: Column) -> Column:
    """A space at every change from a lower-case to an upper-case letter."""
    return F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")


def query_tokens(text: Column) -> Column:
    """Distinct lower-case words of a search text, split at camel case, of two or more characters.

    Where that leaves none, the whole trimmed text in lower case, if any.
    """
    words = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(camel_split(text), F.lit(_RUN), F.lit(0)), F.lower), lambda w: F.length(w) > 1))
    whole = F.lower(F.trim(text))
    return F.when(F.size(words) > 0, words).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))


def doc_summary(comment: Column, longest: int = 400) -> Column:
    """The text of the first summary element: tags and comment marks off, white space folded, cut to a length."""
    inner = F.regexp_extract(comment, r"(?s)<summary>(.*?)</summary>", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"(?m)^\s*///?", " ")
    return F.left(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(longest))


def embed_text(*parts: Column) -> Column:
    """The parts that aren't blank, joined by ``. ``."""
    return F.concat_ws(". ", *(F.when(F.trim(p) != "", p) for p in parts))


def head_word(name: Column) -> Column:
    """The first camel-case word of a name."""
    return F.regexp_extract(name, r"(?s)^.[^\p{Lu}]*", 0)


def file_stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
