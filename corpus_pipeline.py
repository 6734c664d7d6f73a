"""The corpus pipeline: rules for quality, language, near-duplicates, mixing and encoding, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next stage's docs. All
but the last return the columns of documents, so a stage sees every row that its predecessor kept and nothing else.

Defined cases, of every stage: an empty table gives an empty one; columns besides those of documents are left behind, whatever
their names; nulls in lang, source and n_chars are values like others; very long texts are worked on whole. The rest is said
with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import langid, mixing, near, pieces, quality
from sightline.runtime import materialize, unused

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Languages that stay, and the least share of a text's words that has to be in its language.
LANGUAGES, MIN_SHARE = ("en", "de", "es", "fr"), 0.5
#: Target shares of clean, low-quality and toxic tokens. Rates are at most 1 and the target total is the corpus's own, so
#: that clean documents, whose share falls short of its target, stay in full and only the rest is thinned out.
TARGETS, MAX_RATE = [0.985, 0.010, 0.005], 1.0
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or the classifier.

    A null or empty text fails. Rows with a null id are judged by their text; repeated rows stay or go together.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, model).filter("kept").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language of LANGUAGES by MIN_SHARE of its words; learns from the fold that isn't held out.

    A text that is null or has no letter goes. Rows with a null id are judged by their text; repeated rows stay or go together; of
    languages with equally many words the alphabetically first counts.
    """
    model = langid.train(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    labelled = langid.label(docs, model, spans=False)
    return labelled.filter(F.col("lang_pred").isin(*LANGUAGES) & (F.col("score") >= MIN_SHARE)).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of the smallest id.

    Rows whose id or text is null, or whose text has no word, all stay, but for repeated ids: those are one document, of which
    one row stays.
    """
    return near.deduplicate(docs).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents at the rates that bring the domains' tokens to their targets.

    Rows with a null id stay; rows of one id have one draw, and go only if all go (their texts may differ). A null or empty text
    weighs nothing and has the rate of its posteriors.
    """
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone, last = unused(docs.columns, "gone"), F.max("n_copies").alias("last")
    mixed = mixing.mix(docs.filter("doc_id is not null"), labels, TARGETS, limit=MAX_RATE)
    lost = mixed.groupBy("doc_id").agg(last).filter("last = 0").select(F.col("doc_id").alias(gone))
    return docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti").select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and checks that it decodes to itself; every row stays, a null text has null ids and no pieces."""
    encoded = pieces.encode(docs, PIECE_MODEL, keep=("doc_id", "lang", "text"), check=True)
    return encoded.select("doc_id", "lang", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), F.element_at("nbest", 1).alias("score"), "round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: The classifiers and the piece lattice have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
