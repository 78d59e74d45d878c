"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _codec():
    import public_tokenizers

    from tidemark.llm import bpe

    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As large a sample of `documents` as the share of rows of quality 1 among the labelled."""
    from pyspark.sql import functions as F

    from tidemark.llm import importance

    labels = _table(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double")).alias("x")).first().x
    return importance.resample(_table(spark, sf_dir, "documents"), labels.filter("quality = 1"), 1.0 if share is None else share)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import setjoin

    found = setjoin.link(_table(spark, sf_dir, "documents"), shingle=3, share=setjoin.Share(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import chat

    codec = _codec()
    return chat.read_back(chat.format_conversations(chat.with_probe(_table(spark, sf_dir, "conversations")), codec), codec)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontam

    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import ring

    return ring.shard(_table(spark, sf_dir, "documents"), shards=40)


def op7_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import flatgraph

    return flatgraph.link(_table(spark, sf_dir, "embeddings"))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import gru

    return gru.score(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import substrings

    return substrings.digests(_table(spark, sf_dir, "documents"), length=35)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import bpe

    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), _codec())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op6_bounded_ring": op6_bounded_ring,
    "op7_flat_graph": op7_flat_graph,
    "op8_recurrent_lm": op8_recurrent_lm,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_byte_bpe": op10_byte_bpe,
}

#: Words of a text: runs of anything but x20 and x09 to x0D.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach as (select a as node, a as other from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
least as (select node, min(other) as component_id from reach group by node)"""

_OP2 = f"""with recursive w as (select doc_id, {_WORDS.format(_ASCII_LOWER.format("text"))} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all),
edges as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)),
{_REACH}
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(l.component_id, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join least l on l.node = d.doc_id"""

_ESCAPED = r"regexp_replace(regexp_replace({0}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
_OP4 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
cast(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 7 + case when role = 'assistant' then 7 else 6 end) as bigint) as formatted_chars
from t group by conv_id"""

_OP7 = f"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}
select m.vec_id, (select count(*) from edges where a = m.vec_id) as n_links, least(m.vec_id, coalesce(l.component_id, m.vec_id)) as component_id,
least(m.vec_id, coalesce(l.component_id, m.vec_id)) = m.vec_id as kept from embeddings m left join least l on l.node = m.vec_id"""

_OP9 = f"""with w as (select doc_id, {_WORDS.format("text")} as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) as h from (select doc_id, ws, unnest(generate_series(1, len(ws) - 34)) as i from w where len(ws) >= 35)),
hit as (select doc_id, i from win where h in (select h from win group by h having count(*) > 1)),
gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) as p from hit),
word as (select doc_id, unnest(ws) as x, unnest(generate_series(1, len(ws))) as p from w where len(ws) > 0),
left_ as (select doc_id, p, x from word anti join gone using (doc_id, p)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t from left_ group by doc_id),
gones as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(gones.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id) left join gones using (doc_id)"""

#: Operators whose whole result SQL can restate; the others are tested against plain versions.
ORACLES: dict[str, str] = {"op2_jaccard_join": _OP2, "op4_chat_format": _OP4, "op7_flat_graph": _OP7, "op9_repeated_passages": _OP9}
