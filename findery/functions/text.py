"""Text rules as column expressions.

Patterns carry ``(?U)`` so that word and space classes follow Unicode, not ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)[\s\x1c-\x1f]+"

# Characters the punctuation rule deletes, maps or expands.
CONTROLS = (
    "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011"
    "\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
)
SOFT_HYPHEN = "­"
SPACE_LIKE = "\u000b\u000c\u0085"
HYPHEN_LIKE = "‐‑‒–—―⁃⁻−－"
DOUBLE_QUOTE_LIKE = "“”„‟"
SINGLE_QUOTE_LIKE = "`´՚‘’‚‛Ꞌꞌ＇"
PRIMES = {
    "′": 1, "″": 2, "‴": 3,
    "‵": 1, "‶": 2, "‷": 3,
    "⁗": 4,
}
ELLIPSIS = "…"
SLASH_LIKE = "⁄∕"

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?U)\b(a|an|the)\b"
GENERIC_WORDS = (
    "tell", "me", "more", "about", "what", "is", "are", "the", "a", "an", "explain", "does", "how",
)
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_min_words(c: Column, least: Column) -> Column:
    """True when the text has enough words; no bound when ``least`` is null or not positive."""
    return least.isNull() | (least <= 0) | F.coalesce(word_count(c) >= least, F.lit(False))


def normalize_query(c: Column) -> Column:
    """Lower case, white space squeezed; null becomes empty."""
    return F.coalesce(squeeze(F.lower(c)), F.lit(""))


def query_hash(c: Column) -> Column:
    return F.sha1(F.encode(normalize_query(c), "UTF-8"))


def normalize_punctuation(c: Column) -> Column:
    """Typographic hyphens, quotes, primes, ellipses and slashes in their ASCII form."""
    one_to_one = SPACE_LIKE + HYPHEN_LIKE + DOUBLE_QUOTE_LIKE + SINGLE_QUOTE_LIKE
    target = (
        " " * len(SPACE_LIKE) + "-" * len(HYPHEN_LIKE)
        + '"' * len(DOUBLE_QUOTE_LIKE) + "'" * len(SINGLE_QUOTE_LIKE)
    )
    out = F.translate(c, one_to_one + CONTROLS + SOFT_HYPHEN, target)
    for prime, count in PRIMES.items():
        out = F.replace(out, F.lit(prime), F.lit("'" * count))
    out = F.replace(out, F.lit(ELLIPSIS), F.lit("..."))
    out = F.replace(out, F.lit(" . . . "), F.lit(" ... "))
    return F.translate(out, SLASH_LIKE, "/" * len(SLASH_LIKE))


def drop_articles(c: Column) -> Column:
    """Lower case, articles out, white space squeezed; punctuation stays."""
    return squeeze(F.regexp_replace(F.lower(c), ARTICLES, " "))


def normalize_answer(c: Column) -> Column:
    """Lower case without ASCII punctuation or articles."""
    bare = F.translate(F.lower(c), ASCII_PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, ARTICLES, " "))


def extract_keywords(c: Column) -> Column:
    """Words in order, repeats kept, without punctuation (hyphens stay) and generic words."""
    kept = F.lower(F.regexp_replace(c, r"(?U)[^\w\s\-]", ""))
    return F.filter(words(kept), lambda w: ~w.isin(*GENERIC_WORDS))


def tokens(c: Column, uncased: bool = False) -> Column:
    """Runs of letters, digits and marks, or single visible characters."""
    found = F.regexp_extract_all(c, F.lit(TOKEN), 0)
    return F.transform(found, lambda t: F.lower(t)) if uncased else found


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


def nfd(text: Column | str) -> Column:
    """Canonical decomposition; Spark has no built-in for it. Only texts beyond ASCII travel to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_nfd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def title_text(title: Column, text: Column) -> Column:
    """``title text`` when there is a title, else the text alone."""
    return F.when(F.length(title) > 0, F.concat_ws(" ", title, text)).otherwise(text)


def source_label(filename: Column, strict: bool = False) -> Column:
    """What stands before ``--`` in a file name; strict mode says ``unknown`` when there is none."""
    head = F.split_part(filename, F.lit("--"), F.lit(1))
    return F.when(F.instr(filename, "--") == 0, F.lit("unknown")).otherwise(head) if strict else head


def normalize_id(df: DataFrame, id_col: str) -> Column:
    """Integer ids stay integers; any other type becomes text."""
    c = F.col(id_col)
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    return c.cast("long") if whole else c.cast("string")
