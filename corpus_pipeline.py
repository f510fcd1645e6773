"""A corpus pipeline: language, near copies, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; it is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``,
whatever they are: helper columns take names that are free.

Edge cases.  An empty table passes all stages and ends as an empty index.  A null or empty text, or one without a
letter, has no language and is rejected by the first stage, so that later ones see it only when called alone: then it
is no copy of anything, contains no item and is one end id in the files.  Very long texts are handled whole.  Rows
that repeat a doc_id count as one document: the second stage keeps one row of them (the least text), the others keep
or drop them together.  Rows without a doc_id are kept by the second stage and share one rate in the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import decontam, langid, mixing, near_copies, queries, store, tokens
from spanweave.session import ship

#: Predictions below this score are rejected, like texts without letters.
LEAST_LANGUAGE_SCORE = 0.5


def _begin(spark: SparkSession) -> None:
    """What each stage needs.  All share executors that keep what earlier ones grew, so batches are small in all of them."""
    ship(spark)
    store.small_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is predicted with enough certainty."""
    _begin(spark)
    model = langid.train(docs.where(~langid.held_out()))
    lang, score = (store.free_name(name, docs) for name in ("_lang_pred", "_lang_score"))
    found = langid.identify(docs, model, lang_as=lang, score_as=score)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_copy_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, a similarity of 0.8): that with the smallest doc_id."""
    _begin(spark)
    found = near_copies.near_copies(docs, n=5, num=80).where("doc_id is not null")
    nodes = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    nodes = store.saved(nodes.where("component_id != doc_id or n > 1"), "others")
    kept = docs.join(nodes.where("component_id != doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    repeated = nodes.where("component_id = doc_id").select("doc_id")
    if repeated.isEmpty():
        return kept
    order = F.struct("text", F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select("row.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark item."""
    _begin(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn at the rates that bring the domains' tokens to their target shares without repetition."""
    _begin(spark)
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.sample(docs, labelled).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files, read back from them."""
    _begin(spark)
    path = store.new_path(spark, "token-files")
    tokens.write_ids(docs, path, queries.tokenizer_json())
    return tokens.read_ids(spark, path)


STAGES = [
    ("language", language),
    ("near_copies", near_copy_groups),
    ("decontamination", leaks),
    ("mixing", mixture),
    ("token_files", token_files),
]
#: Trained models, components and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.saved(docs, name)
    return docs
