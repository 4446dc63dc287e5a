"""Column functions on post text. Every function maps Columns to a Column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from finchlab.functions import patterns as P


def _group_of(pattern: str) -> int:
    """1 when the pattern has a capture group, else 0 (the whole match)."""
    escaped = False
    in_class = False
    for i, ch in enumerate(pattern):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(" and pattern[i + 1 : i + 2] != "?":
            return 1
    return 0


def quick(pattern: str) -> str:
    """The faster form of a pattern if there is one."""
    return P.QUICK.get(pattern, pattern)


def matches(text: Column, pattern: str) -> Column:
    """All matches of `pattern` as a list; the group when the pattern has one."""
    return F.regexp_extract_all(text, F.lit(quick(pattern)), F.lit(_group_of(pattern)))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, quick(pattern), "")


def count_of(items: Column) -> Column:
    return F.size(items).cast("int")


def may_match(text: Column, pattern: str) -> Column | None:
    """A cheap test that is true for every text the pattern matches; None if there is none."""
    if pattern == P.EMOJI:
        return F.octet_length(text) > F.length(text)
    needles = P.NEEDLES.get(pattern)
    return reduce(or_, [text.contains(n) for n in needles]) if needles else None


def match_count(text: Column, pattern: str) -> Column:
    """Number of matches; `text` should be a plain column, it is read more than once."""
    number = count_of(matches(text, pattern))
    possible = may_match(text, pattern)
    return number if possible is None else F.when(possible, number).otherwise(0)


def character_count(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("int")


def urls(text: Column) -> Column:
    return matches(text, P.URL)


def mentions(text: Column) -> Column:
    return matches(text, P.MENTION)


def hashtags(text: Column) -> Column:
    return matches(text, P.HASHTAG)


def reserved_words(text: Column) -> Column:
    return matches(text, P.RESERVED)


def emojis(text: Column) -> Column:
    return matches(text, P.EMOJI)


def smileys(text: Column) -> Column:
    """Emoticons outside URLs (`://` would otherwise count as one)."""
    return matches(without(text, P.URL), P.SMILEY)


def numbers(text: Column) -> Column:
    return matches(text, P.NUMBER)


def pictures(text: Column) -> Column:
    return matches(text, P.PICTURE)


def strip_entities(text: Column) -> Column:
    """Remove URLs, pictures, mentions, hashtags, reserved words, emojis, smileys, numbers."""
    for pattern in P.CLEANING_ORDER:
        text = without(text, pattern)
    return text


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACE_CHARACTERS))


def remove_punctuation(text: Column) -> Column:
    return strip_space(without(text, P.PUNCTUATION))


def clean(text: Column) -> Column:
    return remove_punctuation(strip_entities(text))


def pct_upper(text: Column) -> Column:
    """Upper-case characters per non-space character, 0 for an empty text."""
    upper = F.length(text) - F.length(without(text, rf"[{P.UPPER}]"))
    total = F.length(without(text, rf"[{P.SPACE}]+"))
    return F.coalesce(F.try_divide(upper.cast("double"), total), F.lit(0.0))


def split_contractions(text: Column) -> Column:
    """`cannot` -> `can not`, `gonna` -> `gon na`, ... on whole words only."""
    heads = "|".join(f"{head}(?={tail})" for head, tail in P.CONTRACTIONS)
    tails = "|".join(dict.fromkeys(tail for _, tail in P.CONTRACTIONS))
    pattern = rf"(?i)(?<![{P.WORD}])({heads})({tails})(?![{P.WORD}])"
    # most texts have none of these words: a plain search is cheaper than the regex
    lower = F.lower(text)
    present = reduce(or_, [lower.contains(head + tail) for head, tail in P.CONTRACTIONS])
    return F.when(present, F.regexp_replace(text, pattern, "$1 $2")).otherwise(text)


def tokens(clean_text: Column) -> Column:
    """White-space tokens of a clean text, after splitting contractions."""
    words = F.split(split_contractions(clean_text), quick(rf"[{P.SPACE}]+"))
    return F.array_remove(words, "")


def drop_words(words: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def content_tokens(clean_text: Column) -> Column:
    """Lower-case tokens without English function words."""
    return drop_words(tokens(F.lower(clean_text)), P.ENGLISH_STOP_WORDS)


def word_count(clean_text: Column) -> Column:
    return count_of(tokens(clean_text))


def joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, " "), F.lit(""))


def word_terms(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case runs of two or more word characters, minus `stop_words`."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[{P.WORD}]{{2,}}"), F.lit(0))
    return drop_words(words, stop_words) if stop_words else words


def space_terms(text: Column) -> Column:
    """Lower-case white-space separated terms."""
    return F.array_remove(F.split(F.lower(text), quick(rf"[{P.SPACE}]+")), "")


def longer_grams(words: Column, grams: Column, n: int) -> Column:
    """n-grams from the (n-1)-grams of the same list, one pass over the list.

    A null word makes every n-gram over it null.
    """
    shifted = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
    return F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))


def emoticon_count(text: Column, emoticons: Sequence[str]) -> Column:
    """White-space separated words that are one of `emoticons`."""
    words = F.split(text, rf"[{P.SPACE}]+")
    return count_of(F.filter(words, lambda w: w.isin(list(emoticons))))


def wordnet_pos(tag: Column) -> Column:
    """Treebank tag -> adjective, verb, noun, adverb letter; null for the rest."""
    first = F.substring(tag, 1, 1)
    return (
        F.when(first == "J", "a")
        .when(first == "V", "v")
        .when(first == "N", "n")
        .when(first == "R", "r")
    )


def at_name(author: Column) -> Column:
    return F.concat(F.lit("@"), author)


def zero_else(value: Column, zero: str, other: str) -> Column:
    """`zero` for 0, `other` for anything else, null included."""
    return F.when(value == 0, zero).otherwise(other)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Decimal text with `digits` places, rounded half up from the shortest decimal of the double.

    Infinite values are `Infinity` and `-Infinity`, no number is `NaN`.
    """
    return F.format_string(f"%.{digits}f", value)


def timestamp_of(date: Column, time: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(F.concat_ws(" ", date, time), F.lit(fmt))


def parse_timestamp(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(text, F.lit(fmt))
