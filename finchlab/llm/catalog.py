"""Registered queries of the text pipeline, with oracle SQL where SQL can express them.

Each query runs its operator with production parameters over the whole table and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.llm import (
    exact_dedup,
    language_id,
    lm_scoring,
    merkle,
    mixing,
    near_dedup,
    packing,
    quality,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
)
from finchlab.llm.common import table
from finchlab.llm.substring_dedup import trim_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": F.sha2("_norm", 256)}
    rows = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), carry=digest)
    return rows.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("doc").alias("doc_id"),
        "n_shingles",
        "component_id",
        (F.col("doc") == F.col("component_id")).alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder).withColumnRenamed("doc", "doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.round("log_score", 3).alias("log_score"),
        F.round("mean_log_score", 5).alias("mean_log_score"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~out))
    return language_id.predict(docs, model).select(
        F.col("doc").alias("doc_id"), language_id.held_out(F.col("doc")).alias("held_out"), "lang_pred", "score"
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicated(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.scored(docs, lexicon).select(
        F.col("doc").alias("doc_id"),
        toxicity.held_out(F.col("doc")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trim_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumnRenamed("doc", "doc_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.trim_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    every = (
        op1_exact_dedup,
        op2_minhash_near_dedup,
        op3_quality_rules,
        op4_token_files,
        op5_lm_scoring,
        op6_language_id,
        op7_source_mixing,
        op8_toxicity,
        op9_substring_dedup,
        op10_packing,
        op11_suffix_dedup,
        op12_spelling_variants,
        op13_merkle_manifest,
        pipeline,
    )
    return {f.__name__: f for f in every}


SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

OP1_SQL = f"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d
"""

# Shingles as texts; pairs that share one; components by a recursive query.
OP2_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as t from p),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.t = b.t and a.doc_id < b.doc_id
  group by all),
l as materialized (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * k >= {near_dedup.PERCENT} * (a.n + b.n - k)),
e as materialized (select x, y from l union all select y, x from l),
r as (select x as doc_id, x as seen from e union select r.doc_id, e.y from r join e on e.x = r.seen),
m as (select doc_id, min(seen) as least from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least, d.doc_id) as component_id,
  coalesce(least, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join m using (doc_id)
"""

# One row per word and per pair; counts over all rows less those of the row's own document.
OP5_SQL = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
p as (select doc_id, w[i] as b, case when i > 1 then w[i - 1] end as a, len(w) as n
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
u as materialized (select b as g, count(*) as c from p group by b),
uo as materialized (select doc_id, b as g, count(*) as c from p group by doc_id, b),
v as materialized (select a, b, count(*) as c from p where a is not null group by a, b),
vo as materialized (select doc_id, a, b, count(*) as c from p where a is not null group by doc_id, a, b),
t as (select count(*) as words from p),
s as (select p.doc_id, n, p.a, words, u.c - uo.c as one, coalesce(v.c - vo.c, 0) as two, x.c - xo.c as context
  from p cross join t join u on u.g = p.b join uo on uo.doc_id = p.doc_id and uo.g = p.b
  left join v on v.a = p.a and v.b = p.b left join vo on vo.doc_id = p.doc_id and vo.a = p.a and vo.b = p.b
  left join u x on x.g = p.a left join uo xo on xo.doc_id = p.doc_id and xo.g = p.a),
l as (select doc_id, sum(case when two > 0 then ln(two / context)
  else case when a is not null then ln({lm_scoring.BACKOFF}) else 0 end
    + case when one > 0 then ln(one / (words - n)) else ln({lm_scoring.BACKOFF} / words) end end) as score
  from s group by doc_id)
select doc_id, len(w)::bigint as n_words, round(coalesce(score, 0), 3) as log_score,
  round(score / len(w), 5) as mean_log_score from d left join l using (doc_id)
"""

# Rates from source sizes, Poisson probabilities by their closed form, one row per copy.
OP7_SQL = f"""
with s as (select source, count(*)::double as n from documents group by source),
r as (select source, pow(n, {mixing.TEMPERATURE}) / sum(pow(n, {mixing.TEMPERATURE})) over ()
  * sum(n) over () / n as rate from s),
k as (select source, rate, unnest(range(0, 200)) as k from r),
c as (select source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as c from k),
u as (select *, (('0x' || substr(md5(doc_id || '#1|count|{mixing.SEED}'), 1, 13))::bigint + 0.5) / pow(2, 52) as u
  from documents),
n as (select u.*, (select count(*) from c where c.source is not distinct from u.source and c.c <= u.u) as copies from u),
e as (select doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::int as copy from n)
select *, md5(doc_id || '|' || copy || '|mix|{mixing.SEED}') as mix_key from e
"""

# Windows as texts; the first document of each window, then the words it covers elsewhere.
OP9_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as t from p),
f as (select t, min(doc_id) as first_doc from k group by t),
r as (select doc_id, unnest(range(i, i + 50)) as j from k join f using (t) where first_doc < doc_id),
g as (select doc_id, list(distinct j) as gone from r group by doc_id),
o as (select d.doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id)),
z as (select doc_id, w, gone,
  list_transform(list_filter(range(1, len(w) + 1), lambda x: not list_contains(gone, x)), lambda x: w[x]) as kept from o)
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from z
"""
# Every string of 100 bytes by its digest; the first place of each, then the bytes the others cover.
OP11_SQL = f"""
with d as materialized (select doc_id, hex(coalesce(text, '')) as x, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, x, unnest(range(1, n - {suffix_dedup.WINDOW - 2})) as i from d where n >= {suffix_dedup.WINDOW}),
k as materialized (select doc_id, i, md5(substr(x, 2 * i - 1, {2 * suffix_dedup.WINDOW})) as t from p),
f as (select t, min((doc_id, i)) as first from k group by t having count(*) > 1),
w as (select doc_id, i from k join f using (t) where (doc_id, i) <> first),
r as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -{suffix_dedup.WINDOW}) as step from w),
g as (select doc_id, i, sum((step > {suffix_dedup.WINDOW})::int) over (partition by doc_id order by i) as run from r),
s as (select doc_id, run, min(i) as a, max(i) + {suffix_dedup.WINDOW} as b from g group by doc_id, run),
o as (select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, max(b) as last,
  list((a, b) order by a) as spans from s group by doc_id),
q as (select s.doc_id, a, b, lag(b, 1, 1) over (partition by s.doc_id order by a) as prev from s),
h as (select doc_id, string_agg(substr(x, 2 * prev - 1, 2 * (a - prev)), '' order by a) as kept
  from q join d using (doc_id) group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when last is null then x else kept || substr(x, 2 * last - 1) end)) as kept_sha256
from d left join o using (doc_id) left join h using (doc_id)
"""


def _crc32(text: str) -> str:
    """DuckDB expression: crc32 of the UTF-8 bytes of a text, bit by bit."""
    data = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::bigint)"
    bits = "list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce({data}, lambda c, b: {bits}, 4294967295::bigint), 4294967295)"


def _field(name: str, value: str | None = None) -> str:
    text = f"({value or name})::varchar"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


# Equal lengths: one place left out on both sides; others: one letter left out of the longer word.
OP12_SQL = f"""
with recursive d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as w from documents),
g as materialized (select doc_id || ':' || w as t, w, count(*) as n from d group by doc_id, w),
h as materialized (select w, n, {_crc32("t")} as h from g),
v as materialized (select case when h % {spelling.EVERY} = 0
    then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, sum(n)::bigint as n from h
  group by 1 having length(word) >= {spelling.SHORTEST} and sum(n) >= {spelling.LEAST}),
i as materialized (select word, n, i, substr(word, 1, i - 1) as l, substr(word, i + 1) as r
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
e as (select distinct i.word as x, v.word as y from i join v on v.word = l || r),
p as materialized (select a.word as word, b.word as near from i a join i b
    on a.i = b.i and a.l = b.l and a.r = b.r and a.word <> b.word
  union all select x, y from e union all select y, x from e),
b as (select p.word, count(*) as n_near, max(v.n) as most, list(near order by v.n desc, near)[1] as best
  from p join v on v.word = p.near group by p.word),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near,
  case when most >= {spelling.RATIO} * v.n then best end as form,
  case when most >= {spelling.RATIO} * v.n then most end as form_n from v left join b using (word)),
c as (select word, form as root, 1 as k from f where form is not null
  union all select c.word, f.form, k + 1 from c join f on f.word = c.root where f.form is not null),
t as (select word, arg_max(root, k) as root from c group by word)
select f.word, form, coalesce(t.root, f.word) as root, n, n_near, form_n from f left join t using (word)
"""

_HEAD = " || ".join(_field(c) for c in merkle.FIELDS[:-1])

# Levels by recursion, up to the sources and then over them; steps of each leaf, and the way back up.
OP13_SQL = f"""
with recursive d as materialized (select doc_id, source, text, {_HEAD} as head from documents),
f as materialized (select doc_id, source, sha256(head || {_field("text")}) as leaf,
  case when ({_crc32("doc_id::varchar")}) % 2 = 0 then sha256(head || {_field("t", "replace(text, chr(10), '')")}) end as changed,
  row_number() over (partition by source order by doc_id) - 1 as pos, count(*) over (partition by source) as n from d),
v as (select 0 as lev, source, pos, n, leaf as h from f
  union all select lev + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos))
  from v where n > 1 group by lev, source, pos // 3, n),
w as materialized (select * from v),
s as materialized (select source, h as subroot, row_number() over (order by source nulls first) - 1 as pos,
  count(*) over () as n from w where n = 1),
z as (select 100 as lev, pos, n, subroot as h from s
  union all select lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos))
  from z where n > 1 group by lev, pos // 3, n),
y as materialized (select * from z),
a as (select lev, source, pos // 3 as parent, list(h order by pos) as hs from w where n > 1 group by all),
b as (select lev, pos // 3 as parent, list(h order by pos) as hs from y where n > 1 group by all),
t as (select doc_id, lev, hs, f.pos // (3 ** lev)::bigint % 3 as slot from f join a on a.source is not distinct from f.source
    and parent = f.pos // (3 ** (lev + 1))::bigint
  union all select doc_id, lev, hs, s.pos // (3 ** (lev - 100))::bigint % 3 as slot
  from f join s on s.source is not distinct from f.source join b on parent = s.pos // (3 ** (lev - 99))::bigint),
p as materialized (select doc_id, row_number() over (partition by doc_id order by lev) as k,
  array_to_string(hs[:slot], '') as l, array_to_string(hs[slot + 2:], '') as r from t),
g as (select doc_id, 0 as k, coalesce(changed, leaf) as h from f
  union all select g.doc_id, g.k + 1, sha256(l || h || r) from g join p on p.doc_id = g.doc_id and p.k = g.k + 1),
e as (select doc_id, arg_max(h, k) as folded_root from g group by doc_id),
q as (select doc_id, sha256(string_agg(l || r, '' order by k)) as proof_sha256 from p group by doc_id)
select f.doc_id, leaf, subroot, (select h from y where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
  folded_root, folded_root = (select h from y where n = 1) as verified
from f join s on s.source is not distinct from f.source join e using (doc_id) left join q using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_minhash_near_dedup": OP2_SQL,
        "op5_lm_scoring": OP5_SQL,
        "op7_source_mixing": OP7_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_suffix_dedup": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
