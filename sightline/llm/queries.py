"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import ann, chat, langid, licences, mixing, near, pieces, quality, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The vocabulary of op2 and of the pipeline's last stage.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL, check=True)
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids", "nbest", "swaps", "round_trip")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licences").alias("n_licences"), "licences")


#: Target shares of clean, low-quality and toxic tokens.
TARGETS = [0.90, 0.07, 0.03]


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.domains_of(_table(spark, sf_dir, "labels"))
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), labels, TARGETS)
    return mixed.select("doc_id", "n_tokens", "posterior", "rate", "n_copies")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(langid.held_out(), F.lit(False)))
    model = langid.train(docs.filter("not held_out"))
    labelled = langid.label(docs.select("doc_id", "held_out", "text"), model)
    return labelled.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.pair_neighbours(chat.gather(_table(spark, sf_dir, "conversations")))
    formatted = chat.format_pairs(pairs)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ").alias(c)
    return formatted.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return quality.assess(docs.select("doc_id", "text"), model).select(columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_main_text": op1_main_text, "op2_pieces": op2_pieces, "op3_licences": op3_licences, "op4_mixing": op4_mixing, "op5_language": op5_language, "op6_preferences": op6_preferences, "op7_quality": op7_quality, "op8_near_duplicates": op8_near_duplicates, "op9_warc": op9_warc, "op10_nearest": op10_nearest}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_preferences": """
            with t as (select conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, 'user') as role, coalesce(text, '') as text,
                              row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as pos
                       from conversations where conv_id is not null),
                 r as (select *, '<|im_start|>' || role || chr(10) as head, replace(text, '<|', '<\\|') || '<|im_end|>' as body, head || body || chr(10) as shown from t),
                 m as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.pos, b.pos) as pos,
                              a.role is not distinct from b.role and a.text is not distinct from b.text as same
                       from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.pos = b.pos),
                 p as (select pair_id, coalesce(min(pos) filter (not same) - 1, count(*)) as prompt_turns from m group by pair_id),
                 s as (select r.*, prompt_turns, coalesce(sum(length(shown)) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) + length(head) as a
                       from r join p on r.pair_id = p.pair_id where pos > prompt_turns),
                 l as (select pair_id, string_agg(concat(cast(a as bigint), '-', cast(a + length(body) as bigint)), ' ' order by pos) filter (side = 0) as chosen_spans,
                              string_agg(concat(cast(a as bigint), '-', cast(a + length(body) as bigint)), ' ' order by pos) filter (side = 1) as rejected_spans from s where role = 'assistant' group by pair_id)
            select p.pair_id, cast(p.prompt_turns as int) as prompt_turns,
                   coalesce(string_agg(shown, '' order by pos) filter (side = 0 and pos <= prompt_turns), '') as prompt,
                   coalesce(string_agg(shown, '' order by pos) filter (side = 0 and pos > prompt_turns), '') as chosen,
                   coalesce(string_agg(shown, '' order by pos) filter (side = 1 and pos > prompt_turns), '') as rejected,
                   coalesce(any_value(chosen_spans), '') as chosen_spans, coalesce(any_value(rejected_spans), '') as rejected_spans
            from p join r on p.pair_id = r.pair_id left join l on l.pair_id = p.pair_id group by p.pair_id, p.prompt_turns""",
        "op9_warc": """
            with p as (select page_id, url, coalesce(html, '') as body from pages),
                 q as (select page_id, url, strlen(body) as payload_bytes, sha1(body) as payload_digest from p),
                 r as (select *, max(page_id) over (partition by payload_digest) as top from q)
            select page_id, url, payload_bytes, payload_digest,
                   case when payload_bytes >= 1000 and top <> page_id then 'revisit' else 'response' end as record_type,
                   case when payload_bytes >= 1000 and top <> page_id then top end as refers_to
            from r"""
    }
