"""A corpus pipeline of five stages, each one of the numbered operators over all that its predecessor kept.

run() applies them to documents; every stage is written as Parquet in the shared folder and read again as the next one's input. Stages
take and return the columns of documents; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, language_id, mixing, near_dedup, toxicity
from marlstone.llm.common import free_names, id_remainder, new_path, table
from marlstone.llm.queries import tokenizer_path, training_labels

#: A text of n characters is rejected if its cosine with every language is below LIKENESS * n / (n + HALF): the more of it there is, the more it must show.
LIKENESS, HALF = 0.2, 100


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language.

    Rejected are null and empty texts, texts without letters and texts that are too little like every language for what they show; one bound that grows with the
    text holds for all. Repeated rows are decided alike. An empty table gives an empty table. Columns beside doc_id, text and lang pass as they are, whatever their names.
    """
    model = language_id.fit_profiles(docs.where(id_remainder(F.col("doc_id"), 4) != 2))
    found = language_id.language(model, F.col("text"))
    (name,) = free_names(docs, "language")
    known = (F.col(f"{name}.lang") != language_id.UNDETERMINED) & (F.col(f"{name}.score") >= LIKENESS * F.length("text") / (F.length("text") + HALF))
    return docs.withColumn(name, found).where(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts get the score of a text without features. Texts are read whole, however long; repeated rows are decided alike. An empty table gives an
    empty table, and without labels of both kinds the model answers the kind there is. Columns beside doc_id and text pass as they are, whatever their names.
    """
    model = toxicity.fit_toxicity(docs, training_labels(spark, sf_dir))
    (name,) = free_names(docs, "toxicity")
    scored = docs.withColumn(name, toxicity.toxicity(model, F.col("text")))
    return scored.where(F.col(f"{name}.predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least doc_id (a null one first), of rows that repeat id and text one.

    Null texts and texts without words are one class. Texts are read whole. An empty table gives an empty table. Other columns pass as they are, whatever their names.
    """
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a row for each copy).

    Null ids, texts and sources count; texts without words are taken with whole passes only. Repeated rows are rows of their own, and which of them is taken does
    not matter. An empty table gives an empty table. Other columns pass as they are, whatever their names.
    """
    th, i, h, c, n, nth = free_names(docs, "text_hash", "taken_id", "taken_hash", "copies", "times", "nth")
    hashed = docs.withColumn(th, F.xxhash64("text"))
    mixed = mixing.mix(hashed.select("doc_id", "text", "source", F.col(th).alias("text_hash")), carry=("text_hash",))
    taken = mixed.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.sum("copies").alias(c), F.count("*").alias(n)).where(F.col(c) > 0)
    joined = hashed.join(taken, hashed["doc_id"].eqNullSafe(F.col(i)) & (F.col(th) == F.col(h)))
    # rows that repeat id and text are alike: one of them stands for all their copies
    rows = joined.where(F.col(n) == 1).unionByName(joined.where(F.col(n) > 1).dropDuplicates([i, h]))
    own = [F.col(f"`{x}`") for x in docs.columns]
    return rows.select(*own, F.explode(F.sequence(F.lit(1), F.col(c).cast("int"))).alias(nth)).select(*own)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text: no tokens for null and empty ones. A row for each row, repeated ones included; an empty table gives an empty table."""
    return docs.select("doc_id", bpe.encode(spark, tokenizer_path(), F.col("text")).alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mix_budget", mix_sources),
    ("bpe", encode_tokens),
]

#: Fitted models and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
