"""SQL spellings of the text rules, shared by the oracle statements."""

from __future__ import annotations

import unicodedata

from findery.functions import text as T

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
WORD_RUN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE}'), lambda w: w <> '')"


def query_norm(c: str) -> str:
    return f"coalesce({squeeze(f'lower({c})')}, '')"


def _without_articles(c: str) -> str:
    runs = f"regexp_extract_all({c}, '{WORD_RUN}')"
    kept = f"list_transform({runs}, lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END)"
    return squeeze(f"array_to_string({kept}, '')")


def drop_articles(c: str) -> str:
    return _without_articles(f"lower({c})")


def normalize_answer(c: str) -> str:
    return _without_articles(f"translate(lower({c}), {lit(T.ASCII_PUNCTUATION)}, '')")


def normalize_punctuation(c: str) -> str:
    gone = T.CONTROLS + T.SOFT_HYPHEN
    out = f"regexp_replace({c}, '[{''.join(f'\\x{{{ord(x):x}}}' for x in gone)}]', '', 'g')"
    for source, target in ((T.SPACE_LIKE, " "), (T.HYPHEN_LIKE, "-"), (T.DOUBLE_QUOTE_LIKE, '"'),
                           (T.SINGLE_QUOTE_LIKE, "'")):
        pattern = "".join(f"\\x{{{ord(x):x}}}" for x in source)
        out = f"regexp_replace({out}, '[{pattern}]', {lit(target)}, 'g')"
    for prime, count in T.PRIMES.items():
        out = f"replace({out}, {lit(prime)}, {lit(chr(39) * count)})"
    out = f"replace(replace({out}, {lit(T.ELLIPSIS)}, '...'), ' . . . ', ' ... ')"
    return f"translate({out}, {lit(T.SLASH_LIKE)}, '{'/' * len(T.SLASH_LIKE)}')"


def keywords(c: str) -> str:
    bare = f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\-]', '', 'g'))"
    generic = ", ".join(lit(w) for w in T.GENERIC_WORDS)
    return f"list_filter({words(bare)}, lambda w: w NOT IN ({generic}))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{T.TOKEN}')"


def token_line(c: str) -> str:
    line = f"array_to_string({tokens(f'lower({c})')}, chr(1))"
    return f"CASE WHEN {line} = '' THEN chr(1) ELSE chr(1) || {line} || chr(1) END"


def nfd(c: str) -> str:
    """Replacement chain over the Latin letters that decompose."""
    out = c
    for code in range(0xC0, 0x180):
        split = unicodedata.normalize("NFD", chr(code))
        if split != chr(code):
            out = f"replace({out}, {lit(chr(code))}, {lit(split)})"
    return out


def hash32(c: str) -> str:
    return f"(('0x' || substr(md5({c}), 1, 8))::BIGINT)"
