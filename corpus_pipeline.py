"""A training-data pipeline over ``documents``: drop toxic documents, keep one of each group of near
copies, mix the sources to target weights along a curriculum, pack the mix into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` chains them; a driver may as well write each stage and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, n_words
from lumenfold.llm.minhash import near_duplicates
from lumenfold.llm.mixing import mix_sources
from lumenfold.llm.packing import pack
from lumenfold.llm.toxicity import score_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5, rows as they were, in any columns.

    Null and empty texts match nothing and stay; rows without an id are scored like any other; repeated rows
    are each kept or dropped. With no labels the starting lexicon decides.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_rows(docs, labels).filter("score < 0.5").select("row.*")


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, digest): rows whole as one column, so that no name of theirs meets one of ours."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Rows that repeat both id and text are one document; rows that share an id but not a text are judged each.
    Texts without words are kept, and so are rows without an id.
    """
    kept = near_duplicates(docs).filter("doc_id is not null and kept").groupBy(F.col("doc_id").alias("id"), "digest").agg(F.count("*").alias("n"))
    # a hash join on the narrow side: the texts are neither sorted nor aggregated
    named = _packed(docs).join(kept.hint("shuffle_hash"), ["id", "digest"])
    return _once(named, "row", "id", "digest").select("row.*").union(docs.filter("doc_id is null"))


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of which ``n``, the number with the same id and text, is one as they are; of the others one each."""
    return rows.filter("n = 1").select(*columns).union(rows.filter("n > 1").dropDuplicates(["id", "digest"]).select(*columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, in order of training position.

    Rows that repeat both id and text are one document, of the first of their sources by code point. Texts
    without words weigh nothing: they come once a whole pass of their source. A null source is a source of
    its own. Rows without an id are mixed by their text. No rows give no rows.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    packed = docs.select(F.struct("*").alias("row"), named, F.xxhash64("text").alias("digest"))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    small = small.groupBy("doc_id", "digest").agg(F.min("source").alias("source"), F.min("size").alias("size"), F.count("*").alias("n"))
    taken = mix_sources(small, size_col="size", tie=F.col("digest"), keep=["digest", "n"]).filter(F.size("positions") > 0)
    taken = taken.select(named, "digest", "n", "positions")
    rows = _once(packed.join(taken.hint("shuffle_hash"), ["id", "digest"]), "row", "id", "digest", "positions")
    rows = rows.select("row", "id", F.explode("positions").alias("position"))
    return rows.repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row of the mix, in sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("mixing", mix), ("packing", pack_sequences)]

#: No stage's rule is plain SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))  # each stage is computed once, however often the next one reads it
    return STAGES[-1][1](spark, docs, sf_dir)
