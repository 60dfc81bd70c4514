"""Substring search with an index: trigrams to the folders of rows that hold them.

A table is written with folded copies of its texts, in folders of rows that lie near each other, and with a table of postings: each trigram of the
folded texts and the folders where it occurs, in the order of trigrams, so a look-up reads few of its pages.  A search takes the folders
that hold all trigrams of its text, reads only those, and confirms each row with ``contains``.  Texts of
fewer than three characters have no trigram and read everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import fold, fold_column

#: The column that names a row's folder.
FOLDER = "index_folder"


def _folded(name: str) -> str:
    return f"{name}_folded"


def _grams(text: Column) -> Column:
    """The different trigrams of a text."""
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(3))))


def build(df: DataFrame, path: str, fields: Sequence[str], folders: int = 64) -> None:
    """Write the rows and their postings under a path; a posting lists ``folders`` numbers at most."""
    folded = df.withColumns({_folded(f): fold_column(F.coalesce(F.col(f), F.lit(""))) for f in fields})
    dealt = folded.repartitionByRange(folders, *map(_folded, fields), F.xxhash64(*df.columns)).withColumn(FOLDER, F.spark_partition_id())
    dealt.write.partitionBy(FOLDER).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    grams = rows.select(FOLDER, F.explode(F.flatten(F.array(*[_grams(F.col(_folded(f))) for f in fields]))).alias("gram"))
    postings = grams.groupBy("gram").agg(F.sort_array(F.collect_set(FOLDER)).alias("folders"))
    postings.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/postings")


def folders_with(spark: SparkSession, path: str, query: str) -> list[int] | None:
    """The folders that hold all trigrams of a text; None where the text has none."""
    text = fold(query)
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    if not grams:
        return None
    # At most one row for each trigram of the query.
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(sorted(grams))).collect()
    if len(found) < len(grams):
        return []
    return sorted(reduce(set.intersection, (set(r["folders"]) for r in found)))


def search(spark: SparkSession, path: str, fields: Sequence[str], query: str) -> DataFrame:
    """Rows of which a field contains the text, by folded letters."""
    rows = spark.read.parquet(f"{path}/rows")
    folders = folders_with(spark, path, query)
    if folders is not None:
        rows = rows.where(F.col(FOLDER).isin(folders)) if folders else rows.where(F.lit(False))
    hit = reduce(Column.__or__, [F.contains(F.col(_folded(f)), F.lit(fold(query))) for f in fields])
    # A null text contains nothing, not even an empty one.
    known = reduce(Column.__or__, [F.col(f).isNotNull() for f in fields])
    return rows.where(hit & known).drop(FOLDER, *map(_folded, fields))
