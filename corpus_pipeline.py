"""A corpus from raw documents to token ids, in stages that are each written and read again.

1 quality: documents that the classifier rejects go. 2 line dedup: boilerplate lines go, but for their first occurrence;
a document that loses all its lines so goes too, as every line of it stands elsewhere. 3 near duplicates: one document
of each class stays. 4 decontamination: documents with an exact benchmark passage go. 5 encoding: token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, jaccard, linededup, quality
from tessella.llm._common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter(F.col("score") >= 0.5).select("row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.remove_boilerplate(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.trim("clean") != ""))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.match_documents(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("found.hits") == 0).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text and their digests."""
    out = bpe.encode(docs.select("doc_id", "text"), *bpe.vocabulary())
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality classifier", good),
    ("line dedup", without_boilerplate),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("byte-level BPE", encoded),
]
#: The classifier and the encoding are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
