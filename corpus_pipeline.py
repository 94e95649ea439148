"""A training-data pipeline over the documents; each stage applies one operator of epistrand.llm.

A stage takes (spark, docs, sf_dir), where docs are what the stage before it kept, and
returns a DataFrame that is stored before the next stage reads it. All stages but the last
return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.llm import linededup, minhash, mixing, packing, toxicity
from epistrand.sources.store import checkpoint_folder


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in ``row``, so that no name clashes and texts pass once."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("_null"), *others).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Their labels are in the table ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    kept = model.score(_apart(docs).drop("doc_id"), keep_text=True).filter("predicted = 0")
    return kept.select(*["text" if c == "text" else f"row.{c}" for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller doc_id holds.

    A text that loses no line stays as it is, also a NULL or empty one. A document that
    loses all its lines stays with an empty text; n_chars follows the text.
    """
    left = linededup.dedup_lines(_apart(docs))
    row = F.col("doc.row")
    columns = {c: row[c] for c in docs.columns if c != "text"}
    columns["text"] = F.when(~row["_null"], F.col("kept"))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(kind)).otherwise(row["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    groups = minhash.near_duplicates(docs)
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack(packing.tokenized_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
# Models, tokens and packing are beyond SQL; tests/llm compares the pipeline with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
