"""Documents made ready for training, stage by stage.

Every stage but the last returns the columns of documents. Nulls, repeated rows and empty tables are handled as the operators say: a
null text is never toxic, near another or contaminated, and is packed as an end id alone.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.llm import decontamination, minhash, packing, substrings, toxicity
from spoolsift.llm.queries import TOXIC_FROM, vocabulary
from spoolsift.llm.tables import kept, text_key

# Two documents are near from this share of common shingles on, in percent.
NEAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    return toxicity.toxicity(docs, model).where(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near ones, that with the smallest doc_id; of several texts under that id the one with the
    smallest hash, and of rows equal in id and text one."""
    found = minhash.near_duplicates(docs, percent=NEAR)
    return _without(docs, found.where(~F.col("first"))).dropDuplicates(["id", "hash"]).select("row.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id has; n_chars follows the text."""
    cut = substrings.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return _without(docs, bad).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place for every document in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` (id, hash of the text, and the row as a struct, whatever its columns) less those that ``gone`` names."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("_key").alias("gone_key")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("hash"), F.struct("*").alias("row"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_key")), "left_anti")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Tokenizers and learnt weights are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
