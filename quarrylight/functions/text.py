"""Text functions on columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_CJK = "㐀-鿿豈-﫿぀-ヿ가-힯"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; [] for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bigram_tokens(text: Column) -> Column:
    """As tokens, with pairs of neighbours for runs of CJK characters (the character, if alone)."""
    parts = F.flatten(F.transform(tokens(text), lambda t: F.split(F.trim(F.regexp_replace(t, f"([{_CJK}]+)", " $1 ")), " +")))
    pairs = lambda t: F.when(
        t.rlike(f"^[{_CJK}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    ).otherwise(F.array(t))
    return F.filter(F.flatten(F.transform(parts, pairs)), lambda t: t != "")


TOKENIZERS = {"default": tokens, "cjk_bigram": bigram_tokens}


def _split_bigrams(word: str) -> list[str]:
    parts = re.split(f"([{_CJK}]+)", word.lower())
    return [x for p in parts if p for x in ([p[i : i + 2] for i in range(len(p) - 1)] if len(p) > 1 and re.match(f"[{_CJK}]", p) else [p])]


#: The same on the driver, for one word of a query.
SPLITTERS = {"default": lambda w: [w], "cjk_bigram": _split_bigrams}


def words_of(query: str) -> list[str]:
    """The distinct tokens of a query, on the driver, in order."""
    return list(dict.fromkeys(_WORD.findall(query.lower())))


def similar_query(text: str, most: int = 20) -> str:
    """A text as a query for texts like it: its first words without punctuation."""
    return " ".join(re.sub(r"[\W_]+", " ", text).split()[:most])


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def highlight(text: Column, terms: list[str], width: int = 160) -> Column:
    """A stretch around the first hit, HTML-escaped, hits in <b>; null without a hit."""
    if not terms:
        return F.lit(None).cast("string")
    hit = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")(?![\\p{L}\\p{N}])"
    at = F.greatest(F.regexp_instr(text, F.lit(hit)) - width // 3, F.lit(1))
    cut = F.substring(text, at, F.lit(width))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        cut = F.replace(cut, F.lit(plain), F.lit(escaped))
    return F.when(text.rlike(hit), F.regexp_replace(cut, hit, "<b>$1</b>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)
