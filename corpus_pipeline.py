"""The corpus pipeline: toxicity, near-duplicates by shingles, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of ``documents``, whatever their order, and further ones are
passed on. The stages before the last return the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelode.llm import op02_packing, op04_jaccard, op06_chains, op07_toxicity
from namelode.llm.common import forget, tidy, written

THRESHOLD = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is THRESHOLD or more go; the rest stay as they are."""
    pairs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    model = spark.sparkContext.broadcast(op07_toxicity.fit(pairs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([own.score(own.total(t.as_py() or "")[0]) < THRESHOLD for t in texts], pa.bool_()))
        own.memo.clear()

    return docs.mapInArrow(tidy(run), docs.schema)


def told_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with a doc_id for every row that has one, in the order of ids, and what gives the rows their own ids back.

    Where no id repeats that is docs as it is. Rows that share an id are documents of their own: only their texts say whether one is
    a copy of the other.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        return docs, lambda rows: rows
    own = "own_id"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = written(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn(own, F.col("doc_id")).withColumn("doc_id", number), "numbered")
    return rows, lambda found: found.withColumn("doc_id", F.col(own)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 on five-word shingles the smallest id stays.

    Rows without an id stay; rows that share an id are copies only if their texts are linked.
    """
    rows, back = told_apart(docs)
    classes = op04_jaccard.jaccard_classes(rows, width=5, num=80, den=100)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return back(rows.join(gone, "doc_id", "left_anti").select(rows.columns))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the later ones; documents of nothing else go."""
    rows, back = told_apart(docs)
    cut = op06_chains.without_passages(rows, op06_chains.repeated_passages(rows))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(cut).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    return op02_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("substring_dedup", cut_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each stage's rows are written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = written(made, name)
            forget(docs)
        docs = made
    return docs
