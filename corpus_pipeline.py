"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of documents, whatever further columns there are
and however they are named.  Defined results of every stage: an empty table gives no
rows, and repeated rows are handled like others unless a stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import jaccard, langid, packing, substring, toxicity
from gridloom.llm.common import crc_mod, staged, table

#: A document whose likeliest language is below this probability is in none of them.
LEAST_LANGUAGE_SCORE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with columns c0, c1, ..., which clash with nothing, and those of the id and the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too) and those of no known language.

    If there is nothing to learn from, no language is known.
    """
    net = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    plain, _, text = _plain(docs)
    told = langid.identify(plain, net, text, keep=tuple(plain.columns))
    return _restored(told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted to be toxic; null and empty texts are scored as one empty window."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    plain, _, text = _plain(docs)
    return _restored(toxicity.score_documents(plain, model, text, keep=tuple(plain.columns)).where("predicted = 0"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar ones.

    Rows with one id are one document to the links: each different text of an id that
    stays is kept, a repeated row of id and text once.  Rows without an id, and null and
    empty texts, are like no other document and stay.
    """
    plain, key, text = _plain(docs)
    group = jaccard.similar_components(plain.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    stay = group.where("doc_id = component_id").select(F.col("doc_id").alias("stay")).distinct()
    kept = plain.join(stay, F.col(key) == F.col("stay"), "left_semi")
    again = Window.partitionBy(key, "digest").orderBy(*[c for c in plain.columns if c != text])
    kept = kept.withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256)).withColumn("nth", F.row_number().over(again)).where("nth = 1")
    return _restored(kept, docs).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that documents before already hold.

    A document of which nothing is left stays with an empty text; rows without an id
    and null texts stay as they are.
    """
    plain, key, text = _plain(docs)
    rest = [c for c in plain.columns if c not in (key, text)]
    cut = substring.remove_repeats(plain, key, text, keep=tuple(rest)).withColumn(text, F.col("kept"))
    out = _restored(cut, docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all that is left in bins of fixed capacity; an empty text is a piece of no words."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
