"""A corpus pipeline over documents: toxicity, near copies, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, mixing, ngram_join, pii, toxicity
from parlance.llm.common import freed, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose whole text scores below one half, each judged by itself.

    Null and empty texts have the score of no hits; equal texts stay or go together, whatever their ids;
    repeated rows stay repeated; an empty table gives an empty one. Other columns are kept as they are.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that the Jaccard join links (5-word shingles, 0.8): that with the smallest id.

    Decisions are made for rows, not ids: rows of one id whose texts are no near copies all stay, and of
    near copies without an id one stays; a row with an id goes before those without. Texts without words
    link with nothing, so such rows all stay. An empty table gives an empty one; other columns are kept as
    they are, whatever their names.
    """
    # Rows get their numbers once: a table that is read again has the same.
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "pipeline-rows")
    found = written(ngram_join.ngram_join(rows.select("number", F.col("row.text").alias("text")), k=5, percent=80, doc_id="number"), "pipeline-groups")
    linked = found.filter("n_shingles > 0").select(F.col("doc_id").alias("number"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("text"), "number")
    first = linked.join(rows.select("number", order.alias("order")), "number").groupBy("component_id").agg(F.min("order").alias("first")).select("first.number")
    gone = written(linked.select("number").join(first, "number", "left_anti"), "pipeline-gone")
    return rows.join(gone, "number", "left_anti").select("row.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars counts anew.

    Null and empty texts stay as they are, with n_chars null and 0; repeated rows stay repeated and are
    changed alike; an empty table gives an empty one. Other columns are kept as they are.
    """
    new = pii.replaced(docs)
    columns = [F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return new.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it: none, or up to three, whatever its size.

    Null texts have size 0 and go with their place; repeated rows and rows of one id stay or go together;
    an empty table gives an empty one.
    """
    return mixing.taken(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of them and of the text decoded from them.

    Null and empty texts have no ids; repeated rows give equal rows; an empty table gives an empty one.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can express neither the scores nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents. What a stage has written for itself is freed once its result is."""
    docs, last = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with freed(spark) as tables:
            after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            # The result stays for the next stage; what that stage read goes with this one's own tables.
            mine = tables.pop()
            tables += last
            docs, last = after, [mine]
    return STAGES[-1][1](spark, docs, sf_dir)
