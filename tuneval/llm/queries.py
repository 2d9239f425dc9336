"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies one operator with production parameters to its whole
table and derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, hard_negatives, importance, language, line_dedup, mixing, quality_rules, ranked_search,
               recurrent_lm, simhash, surrogates, token_counts, token_files)
from .common import configure, read, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def register(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@register
def op1_language_id(spark, sf_dir):
    """Language of every document by bit-sliced Bloom filters."""
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@register
def op2_quality_rules(spark, sf_dir):
    """Base counts and the calibrated classifier's verdict for every document."""
    docs = read(spark, sf_dir, "documents")
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model)


@register
def op3_pii_surrogates(spark, sf_dir):
    """Every document with its PII replaced by keyed surrogates."""
    return surrogates.replace_pii(read(spark, sf_dir, "documents"))


@register
def op4_simhash_near_dedup(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@register
def op5_token_counts(spark, sf_dir):
    """Bytes and tokens of every document, and whether it exceeds 1024 tokens."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@register
def op6_token_files(spark, sf_dir):
    """Every document's token ids written as Parquet and digested from the files."""
    out = scratch_path(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), out, tokenizer("word_bpe_49k.json"))
    return token_files.digests(token_files.read_tokens(spark, out))


@register
def op7_decontaminate(spark, sf_dir):
    """Every (document, benchmark item) pair whose passage the document holds."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op8_mix_sources(spark, sf_dir):
    """Target words of every source and the words taken of every document."""
    return mixing.mix_plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register
def op9_importance_resampling(spark, sf_dir):
    """Log weight of every document and whether the resampled corpus keeps it."""
    docs = read(spark, sf_dir, "documents")
    target, share = importance.target_documents(docs, read(spark, sf_dir, "labels"))
    return importance.resample(docs, importance.log_ratio(docs, target, stratum_col="lang"), share)


@register
def op10_line_dedup(spark, sf_dir):
    """Lines, cross-site boilerplate lines and what is left of every document."""
    clean = line_dedup.remove_boilerplate(read(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
                        F.md5("text").alias("text_md5"))


@register
def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op12_lm_scores(spark, sf_dir):
    """Unigram and recurrent log10 probability of every document."""
    return recurrent_lm.score(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


@register
def op13_hard_negatives(spark, sf_dir):
    """Three hard negatives for every anchor and positive."""
    rows = read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLES["op13_hard_negatives"] = """
with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
c as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as k from e),
p as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, sum(a.x * b.x)::bigint as score
      from c a join c b using (k) where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id group by all),
q as (select anchor_id, id as positive_id, score as positive_score from p where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select q.*, p.id as negative_id, p.score as negative_score,
             row_number() over (partition by q.anchor_id, positive_id order by p.score desc, p.id)::int as rank
      from q join p on p.anchor_id = q.anchor_id and not p.same
                   and 50 * positive_score <= 100 * p.score and 100 * p.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3"""


ORACLES["op11_ranked_search"] = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
t as (select doc_id, word, count(*)::bigint as tf from (select doc_id, unnest(words) as word from d) x group by all),
s as (select count(*)::bigint as nd, sum(len(words))::bigint as nt from d where len(words) > 0),
m as (select doc_id, 25 + (75 * len(words)::bigint * nd) // nt as m from d, s where len(words) > 0),
f as (select word, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)))::bigint as w
      from t, s group by word),
q as (select item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word from benchmark),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join t using (word) join f using (word) join m using (doc_id) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from r where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""

ORACLES["op10_line_dedup"] = """
with l as (select doc_id, source, n, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t
           from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
                        generate_subscripts(string_split(text, chr(10)), 1) as n
                 from documents where text is not null) x),
b as (select t from l where t <> '' group by t having count(distinct source) >= 10),
k as (select doc_id, count(*) filter (where t <> '')::bigint as n_lines,
             count(*) filter (where t in (select t from b))::bigint as n_removed,
             coalesce(string_agg(line, chr(10) order by n) filter (where t not in (select t from b)), '') as text
      from l group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       length(k.text)::bigint as n_chars_left, md5(k.text) as text_md5
from documents d left join k using (doc_id)"""


ORACLES["op8_mix_sources"] = """
with d as (select doc_id, text, source,
                  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
           from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 2 * source_size as lim,
             ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from s),
f as (select *, (1.5::double * (sum(source_size) over ())::double
                 - coalesce(sum(lim) over (order by lim / w, source nulls last
                            rows between unbounded preceding and 1 preceding), 0)::double)
                / sum(w) over (order by lim / w, source nulls last
                               rows between current row and unbounded following) as level,
             row_number() over (order by lim / w, source nulls last) as k from w),
l as (select level from f where lim >= w * level order by k limit 1),
t as (select source, source_size, least(lim::double, w * (select level from l)) as target from f),
r as (select d.doc_id, d.size, t.source_size, t.target,
             case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
             ('0x' || substr(md5('42:' || coalesce(d.doc_id::varchar, 'null') || ':'
                             || coalesce(md5(d.text), 'null')), 1, 13))::bigint::double
               / 4503599627370496.0::double as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(rate)::bigint + (u < rate - floor(rate))::bigint) * size)::bigint as taken
from r"""
