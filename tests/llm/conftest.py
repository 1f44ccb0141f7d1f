import pytest
from pyspark.sql import functions as F

from spoolsift.llm.queries import vocabulary

PASSAGE = " ".join(f"word{i} of the passage" for i in range(25))
OTHER = " ".join(f"clean{i} text{i}" for i in range(60))

# Nulls in any column, empty and blank texts, ties and repeated rows, long texts, letters beyond ASCII.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "One. Two, THREE!"),
    (5, PASSAGE),
    (6, f"{OTHER}\n{PASSAGE}"),
    (7, PASSAGE.replace(" ", "\n")),
    (7, PASSAGE.replace(" ", "\n")),
    (8, OTHER),
    (None, PASSAGE),
    (None, None),
    (9, "Größe naïve 世界 \U0001f600 <|endoftext|> <s> а é " + "x" * 300),
    (10, "the MIT License and the Apache license, GNU General Public License"),
    (11, ("lorem ipsum dolor " * 9000) + PASSAGE),
    (12, "same " * 500),
    (13, "same " * 500),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows, with other columns whose names operators use themselves."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    extra = ("row", "id", "hash", "spans", "kept", "_key", "_row", "node", "words", "n_words", "cut_id", "whole", "toxicity", "n_tokens")
    return docs.withColumns({name: F.lit(f"own {name}") for name in extra})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def vocabularies():
    return {name: vocabulary(name) for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}
