"""The registered queries of the operators: each over its whole table, with the results that are agreed on."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.llm import chat, counts, decontamination, licenses, minhash, packing, quality, repair, substrings, tokenfiles, toxicity, vectors, warc
from spoolsift.llm.tables import kept


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(_documents(spark, sf_dir))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        *("doc_id", "n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(_documents(spark, sf_dir), items)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        *("doc_id", "n_words", "n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_token_files(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)
    read = tokenfiles.read_token_files(files)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_documents(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.repetition(_documents(spark, sf_dir).select("doc_id", "text"))
    judged = judged.select("doc_id", "kept", "repetition.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        *("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        *(name for name in quality.RUNS),
    )


# From this score on a document counts as toxic.
TOXIC_FROM = 0.3


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        "doc_id",
        (~toxicity.training_rows(F.col("doc_id"))).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    counted = counts.token_counts(docs, vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    read = warc.read_archives(warc.normalise_archives(archives))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    windows = chat.chat_windows(turns.unionByName(control), vocabulary("byte_bpe_50k.json"), budget=4096, history=512)
    return chat.digests(kept(windows, "windows"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_substring_dedup,
        op4_token_files,
        op5_minhash_dedup,
        op6_quality_rules,
        op7_toxicity,
        op8_token_counts,
        op9_packing,
        op10_warc,
        op11_chat_windows,
        op12_conversation_repair,
        op13_vector_codes,
    )
}

def _license_sql() -> str:
    """The same places without an index: every place of every phrase."""
    rows = ",\n".join(
        f"('{t.label}', {str(t.base).upper()}, string_split('{t.text}', ' '), string_split('{t.phrase}', ' '), {t.text.split().index(t.phrase.split()[0]) if t.text.startswith(t.phrase) else len(t.text[: t.text.index(t.phrase)].split())})"
        for t in licenses.TEMPLATES
    )
    return rf"""
WITH template(label, base, tpl, phrase, offset_) AS (VALUES {rows}),
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), candidate AS (
  SELECT doc_id, w, label, base, tpl, phrase, offset_, unnest(range(len(w) - len(phrase) + 1)) AS s
  FROM split JOIN template ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(phrase, ' ') || ' ')
), verified AS (SELECT * FROM candidate WHERE w[s + 1 : s + len(phrase)] = phrase),
words_in_place AS (
  SELECT doc_id, label, base, s, len(tpl) AS n, unnest(tpl) AS t, unnest(range(len(tpl))) + s - offset_ AS p, w FROM verified
), place AS (
  SELECT doc_id, label, base, s, CASE WHEN base THEN 1.0 ELSE
    CAST(sum(CASE WHEN p >= 0 AND p < len(w) AND w[p + 1] = t THEN 1 ELSE 0 END) AS DOUBLE) / max(n) END AS share
  FROM words_in_place GROUP BY doc_id, label, base, s, n
), accepted AS (SELECT * FROM place WHERE base OR share >= {licenses.LEAST_SHARE}),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM accepted GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM split LEFT JOIN found USING (doc_id)
"""


ORACLES: dict[str, str] = {"op1_license_scan": _license_sql()}
