"""SQL fragments for the oracle queries."""

from __future__ import annotations

from finchlab.functions import patterns as P
from registry.posts import DUCK_POSTS

# the second engine's regex has no look-around; on plain texts \b is the same
RESERVED = r"\b(?:RT|FAV)\b"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def without(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, '', 'g')"


def count(items: str) -> str:
    return f"cast(len({items}) as int)"


def joined(items: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({items}, {q(sep)}), '')"


def clean(text: str) -> str:
    for pattern in P.CLEANING_ORDER:
        text = without(text, RESERVED if pattern == P.RESERVED else pattern)
    return without(without(text, P.PUNCTUATION), rf"^[{P.SPACE}]+|[{P.SPACE}]+$")


def tokens(text: str) -> str:
    cases = " ".join(
        f"when lower(t) = {q(h + t)} then [t[1:{len(h)}], t[{len(h) + 1}:]]"
        for h, t in P.CONTRACTIONS
    )
    pieces = f"string_split_regex({text}, {q(f'[{P.SPACE}]+')})"
    split = f"flatten(list_transform({pieces}, lambda t: case {cases} else [t] end))"
    return f"list_filter({split}, lambda t: t <> '')"


def word_list(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def drop_words(items: str, words: list[str]) -> str:
    return f"list_filter({items}, lambda w: w not in {word_list(words)})"


def pct_upper(text: str) -> str:
    upper = f"length({without(text, f'[^{P.UPPER}]')})"
    total = f"length({without(text, f'[{P.SPACE}]+')})"
    return f"case when {total} = 0 then 0.0 else cast({upper} as double) / {total} end"


def hash_order(key: str, seed: int = 123) -> str:
    return f"md5(concat(cast({key} as varchar), '|{seed}'))"


def ngrams(items: str, longest: int) -> str:
    parts = [
        f"list_transform(range(1, cast(len({items}) as bigint) - {n - 2}), "
        f"lambda i: array_to_string({items}[i:i + {n - 1}], ' '))"
        for n in range(1, longest + 1)
    ]
    return parts[0] if longest == 1 else "list_concat(" + ", ".join(parts) + ")"


# noun endings and what replaces them; the first that leaves a known word counts
ENDINGS = [("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ies", "y"), ("men", "man"), ("s", "")]


def lemmas(source: str) -> str:
    """CTEs up to `lemmatised(post_id, lemmas)` over a relation (post_id, w): words reduced by the corpus dictionary."""
    guesses = " union all ".join(
        f"select token, {i} as rule, concat(left(token, cast(length(token) - {len(old)} as int)), '{new}') as lemma "
        f"from known where suffix(token, '{old}') and length(token) > {len(old)}"
        for i, (old, new) in enumerate(ENDINGS)
    )
    return f"""
known as (select distinct unnest(w) as token from {source}),
guesses as ({guesses}),
dictionary as (select token, arg_min(lemma, rule) as lemma from guesses
 where lemma in (select token from known) group by token),
placed as (select post_id, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from {source}),
lemmatised as (select post_id, string_agg(coalesce(lemma, placed.token), ' ' order by i) as lemmas
 from placed left join dictionary on placed.token = dictionary.token group by post_id)"""


POSTS = f"posts as ({DUCK_POSTS})"
LABELLED = (
    f"{POSTS}, labelled as (select *, case when account_category = 'RightTroll' "
    "then 1 else 0 end as target from posts)"
)

_FEATURES = f"""
{LABELLED},
parsed as (
 select post_id, author, publish_date, target, content as raw, {clean('content')} as clean,
  {found('content', P.EMOJI)} as emojis, {found('content', P.HASHTAG)} as hashtags
 from labelled),
tokenised as (select *, {tokens('lower(clean)')} as toks from parsed),
contents as (select post_id, {drop_words('toks', P.ENGLISH_STOP_WORDS)} as w from tokenised),
{lemmas('contents')},
features as (
 select post_id, author, {without('raw', P.PICTURE)} as content, publish_date, target,
  {count(found('raw', P.URL))} as urls_count,
  {count(found('raw', P.MENTION))} as mentions_count,
  {count('hashtags')} as hashtags_count,
  {count(found('raw', RESERVED))} as reserved_words_count,
  {count('emojis')} as emojis_count,
  {count('toks')} as word_count,
  {pct_upper('clean')} as pct_upper,
  {count(found('raw', '!'))} as exclams_count,
  {count(found('raw', '[?]'))} as ques_marks_count,
  {count(found('raw', '[$]'))} as dollar_marks_count,
  {count(found('raw', P.PICTURE))} as pics_count,
  coalesce(lemmatised.lemmas, '') as content_tokenized_lemma_joined,
  {joined('emojis')} as emojis_joined,
  {joined('hashtags')} as hashtags_joined
 from tokenised left join lemmatised using (post_id))"""
FEATURES = _FEATURES


def _space_terms(column: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({column}), {q(f'[{P.SPACE}]+')}), "
        "lambda t: t <> '')"
    )


def _word_terms(column: str, stop_words: list[str]) -> str:
    return drop_words(found(f"lower({column})", f"[{P.WORD}]{{2,}}"), stop_words)


def terms(blocks: list) -> str:
    """CTE `occurrences(post_id, block, term)` for vocabulary blocks, from `features`."""
    parts = []
    for b in blocks:
        words = _word_terms(b.column, b.stop_words) if b.words else _space_terms(b.column)
        parts.append(
            f"select post_id, '{b.name}' as block, unnest({ngrams('w', b.longest)}) as term "
            f"from (select post_id, {words} as w from features)"
        )
    return "occurrences as (" + " union all ".join(parts) + ")"


def vocabulary(blocks: list) -> str:
    """CTEs `tf`, `counts` and `vocab` on top of `occurrences`."""
    sizes = " ".join(f"when '{b.name}' then {b.size}" for b in blocks)
    return f"""
tf as (select post_id, block, term, count(*) as tf from occurrences group by all),
counts as (select block, term, cast(sum(tf) as bigint) as cf, count(*) as df from tf group by all),
ranked as (select *, row_number() over (partition by block order by cf desc, term) as r from counts),
vocab as (
 select block, cast(row_number() over (partition by block order by term) - 1 as int) as idx, term, cf, df
 from ranked where r <= case block {sizes} end)"""


TFIDF = """
weighted as (
 select post_id, block, term,
  tf * (ln((1.0 + (select count(*) from features)) / (1.0 + df)) + 1.0) as w
 from tf join vocab using (block, term)),
tfidf as (
 select post_id, block, term, w / sqrt(sum(w * w) over (partition by post_id, block)) as weight
 from weighted)"""
