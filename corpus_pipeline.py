"""From documents to training sequences: five stages, each one of the operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame.  All but the last return the columns of documents.  ``run`` writes what each
stage returns as Parquet in the shared folder and gives it, read again, to the next; then it deletes the
tables that the stage had written for itself, and the result before.  Who calls stages one by one
can do the same with ``common.tracking``; a stage keeps no state.

- quality: documents that fail the base rule or whose posterior quality is under one half go.
- near_dedup: one document of each near-duplicate group stays (similarity 0.8 or more on
  five-word shingles).
- secrets: spans are replaced in the text; no document goes.
- mixing: documents stay as often as the mix takes them (0, 1 or 2 times).
- packing: power-of-two pieces, each a sequence.

Defined results: empty tables pass through all stages; extra columns, of any name, up to the last one.  A null text has
no words, so quality drops it like an empty one; a null id, source or language is a value of its own.  Of rows that repeat,
near_dedup keeps one.  Ties go by id and then by row, so reruns agree.  A very long text is read whole by one task in each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common, mixing, neardup, packing, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

NEAR_PERCENT = 80
MAX_LENGTH = 2048

#: SQL can't express the tokenizer of the last stage, nor the models of the third.
ORACLE_SQL = None


def _bundled(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct, so that names can't clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    # A struct needs a field, of a name that no column has.
    return docs.select(*used, F.struct(*rest, F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))).alias("_rest"))


def _unbundled(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return df.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text")
    judged = quality.judge(_bundled(docs, *used), keep=(*used, "_rest"))
    return _unbundled(judged.where("kept"), docs, *used)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text")
    grouped = neardup.group(_bundled(docs, *used), percent=NEAR_PERCENT, width=5, keep=("text", "_rest"))
    return _unbundled(grouped.where("kept_row"), docs, *used)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("text", "n_chars")
    found = secrets.scan(_bundled(docs, *used), secrets.trained_pair(docs), keep=(*used, "_rest"), mark="<secret>")
    clean = found.withColumn("text", F.col("redacted"))
    return _unbundled(clean.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text"))), docs, *used)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text", "source")
    mixed = mixing.take(_bundled(docs, *used), keep=("text", "_rest"))
    taken = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _unbundled(taken, docs, *used)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_length=MAX_LENGTH)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with common.tracking() as paths:
            docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The last path is the result; the stage's own tables and the result before have been read.
        common.delete(spark, [*paths[:-1], *before])
        before = paths[-1:]
    return docs
