"""The queries of this subpackage, by name: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import crc_mod, table


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs, rest = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4)
    model = langid.train(docs, rest != 2)
    return langid.predict(docs.select("doc_id", "text", (rest == 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, rest = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), rest != 0)
    scored = toxicity.score(docs.select("doc_id", "text", (rest == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted", F.col("evidence.doc_id").alias("evidence_ids"), F.col("evidence.cosine").alias("evidence_cosines"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import nearjoin

    return nearjoin.near_join(table(spark, sf_dir, "documents")).drop("key")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("bits").withColumn("similarity", F.round("similarity", 6))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprint

    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import tokencount

    return tokencount.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    rest = crc_mod(F.col("doc_id"), 5)
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rest != 0)
    return scored.withColumn("held_out", rest == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.format_messages(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_byte_bpe, op3_html_extraction, op4_ngram_join, op5_fingerprints, op6_language_id, op7_decontamination, op8_token_counts, op9_quality, op10_chat_format)
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: op7: benchmark items of five words or more, as all of these tables are; op10: tables without tool calls, as these are.
#: The other operators have no SQL form; each is tested against brute force, a round trip or held-out labels.
ORACLES: dict[str, str] = {
    "op4_ngram_join": f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i+4], ' ') else array_to_string(w, ' ') end as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
k as (select w.doc_id, coalesce(md5(string_agg(s, '|' order by s)), '') as key, count(s) as n from w left join s using (doc_id) group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join k ka on a = ka.doc_id join k kb on b = kb.doc_id where c >= 0.8 * (ka.n + kb.n - c) - 1e-9 union select x.doc_id, y.doc_id from k x join k y using (key) where x.doc_id <> y.doc_id),
reach as (select doc_id, doc_id as root from k union select l.b, r.root from reach r join links l on l.a = r.doc_id),
class as (select doc_id, min(root) as class_id from reach group by 1), copies as (select key, min(doc_id) as copy_id, count(*) - 1 as n_copies from k group by 1), near as (select a as doc_id, count(*) as n_links from links group by 1)
select doc_id, copy_id, class_id, n_copies, coalesce(n_links, 0) as n_links from k join copies using (key) join class using (doc_id) left join near using (doc_id)""",
    "op7_decontamination": f"""
with b as (select item_id, {_WORDS} as w from (select distinct item_id, text from benchmark where text is not null and item_id is not null)),
d as (select doc_id, {_WORDS} as w from documents),
bs as (select distinct item_id, len(w) as n, array_to_string(w[i:i+4], ' ') as s from (select item_id, w, unnest(generate_series(1, len(w) - 4)) as i from b where len(w) >= 5)),
weight as (select s, 1 + ln((select count(*) from b) / count(*)) as x from bs group by 1), total as (select item_id, n, sum(x) as t from bs join weight using (s) group by 1, 2),
ds as (select doc_id, i, len(w) as m, array_to_string(w[i:i+4], ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from d where len(w) >= 5)),
hits as (select doc_id, item_id, n, m, i from ds join bs using (s)),
starts as (select distinct doc_id, item_id, n, unnest(generate_series(greatest(1, i - n + 5), least(i, m - n + 1))) as a from hits where m >= n),
sets as (select distinct z.doc_id, z.item_id, z.n, z.a, ds.s from starts z join ds on ds.doc_id = z.doc_id and ds.i between z.a and z.a + z.n - 5),
sums as (select sets.doc_id, sets.item_id, sets.n, a, sum(coalesce(x, 1 + ln((select count(*) from b)))) as own, coalesce(sum(x) filter (bs.s is not null), 0) as common from sets left join weight using (s) left join bs on bs.item_id = sets.item_id and bs.s = sets.s group by 1, 2, 3, 4),
sims as (select doc_id, item_id, n, a, common / (own + t - common) as v from sums join total using (item_id, n) where common / (own + t - common) >= 0.8 - 1e-9)
select doc_id, item_id, round(least(max(v), 1), 6) as similarity, arg_min(a, struct_pack(v := -round(v, 9), a := a)) - 1 as first_word, cast(n as bigint) as n_words from sims group by doc_id, item_id, n""",
    "op10_chat_format": """
select conv_id, turn, turn as order_turn, 0 as order_rank, 'plain' as status, 0 as n_calls, 0 as n_open, 0 as n_invalid, cast(to_json({'content': text, 'role': role}) as varchar) as json from conversations""",
}
