"""Structure of JSON columns over whole tables: which paths there are, of which kinds, and how two tables differ.

One pass over the table replaces the values of each text by marks and counts equal outlines.  Only these are parsed and brought
to shapes, in which every number is 0, every string empty and every boolean true.  Shapes are walked level by level: a
level's objects and arrays are exploded, equal parts of a path counted again and stored, so no level is computed twice, every
row counts and no value comes to the driver.  Array elements share a path (``[]``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.session import shared_folder

#: A shape's first character and the kind that it counts as.
KINDS = {"{": "object", "[": "array", '"': "string", "t": "bool", "n": "null", "0": "number"}
CONTAINERS = ("object", "array")
#: Possessive, so long strings need neither stack nor backtracking.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
#: Strings and numbers that are valid for certain; longer numbers may pass the parser's limits.
_STRICT = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
_NUMBER = r"-?+(?:0|[1-9][0-9]{0,99}+)(?:\.[0-9]{1,99}+)?+(?:[eE][-+]?+[0-9]{1,9}+)?+(?![-+.eE0-9])"
#: What stands before a value, and the value; each match begins where the last one ended, so none begins inside a string.
_VALUE = rf'\G((?:[\[\]{{}},: \t\r\n]++|"{_STRICT}"[ \t\r\n]*+:|null)*+)(?:(")(?:{_STRICT})"|{_NUMBER}|(?:tru|fals)(e)|(\x03)\z)'
#: Bytes up to which no text passes the parser's limits for strings and variants.
SHORT = 1 << 20


def outlines(df: DataFrame, json: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, shape, n): equal texts without their values, counted; null for some texts that aren't JSON.

    One replacement finds an outline and parses nothing but texts whose end the pattern doesn't reach, and very long
    ones.  ``text_of`` turns it into a text that is valid if and only if the whole one is, and of the same shape.
    """
    texts = df.select(*by, F.col(json).alias("shape"))
    ended = F.concat(F.replace("shape", F.lit("\x01"), F.lit("\x02")), F.lit("\x03"))
    # Two steps, or Spark finds the outline twice.
    marked = texts.withColumn("path", F.regexp_replace(ended, F.lit(_VALUE), F.lit("$1$2$3$4\x01")))
    plain = F.endswith("path", F.lit("\x03\x01")) & (F.octet_length("shape") <= SHORT)
    return marked.select(*by, F.when(plain | F.try_parse_json("shape").isNotNull(), F.col("path")).alias("shape")).groupBy(*by, "shape").agg(F.count(F.lit(1)).alias("n"))


def text_of(outline: Column) -> Column:
    """A JSON text for an outline."""
    for mark, value in (("\x03\x01", ""), ("\x03", " "), ('"\x01', '""'), ("e\x01", "true"), ("\x01", "0")):
        outline = F.replace(outline, F.lit(mark), F.lit(value))
    return outline


def shape_of(json: Column) -> Column:
    """A valid JSON text without space between its parts and without its values: fields keep their names, values their kinds.

    Control characters can't occur in a valid text but as space, so one of them can mark the ends of values.
    """
    bare = F.regexp_replace(json, F.lit(rf'("{_INSIDE}")[ \t\r\n]*+(:)|("){_INSIDE}(")|[ \t\r\n]++'), F.lit("$1$2$3$4"))
    marked = F.regexp_replace(bare, F.lit(rf'("{_INSIDE}"|null)|(?:tru|fals)(e)|[-0-9][-+.eE0-9]*+'), F.lit("$1$2\x01"))
    for end, value in (('"', '"'), ("l", "l"), ("e", "true"), ("", "0")):
        marked = F.replace(marked, F.lit(f"{end}\x01"), F.lit(value))
    return marked


def kind_of(shape: Column) -> Column:
    """object, array, string, bool, null or number."""
    first = F.substring(shape, 1, 1)
    out = F.lit(None)
    for begins, kind in KINDS.items():
        out = F.when(first == begins, kind).otherwise(out)
    return out


def paths(df: DataFrame, json: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, path, kind, n): how often each kind of value stands at each path of a column of JSON texts.

    Null texts, and texts that aren't JSON, have no structure.  The walk ends with the deepest value; a level is one job.
    """
    spark, root = df.sparkSession, shared_folder(df.sparkSession, "shapes")
    text = text_of(F.col("shape"))
    level = outlines(df, json, by).select(*by, F.lit("$").alias("path"), F.when(F.try_parse_json(text).isNotNull(), shape_of(text)).alias("shape"), "n")
    found: DataFrame | None = None
    depth = 0
    while True:
        counted = level.groupBy(*by, "path", "shape").agg(F.sum("n").alias("n")).withColumn("kind", kind_of(F.col("shape")))
        counted.write.parquet(f"{root}/{depth}")
        # Not before: Spark would move the condition below the counts, to every row.
        stored = spark.read.schema(counted.schema).parquet(f"{root}/{depth}").where("shape IS NOT NULL")
        here = stored.groupBy(*by, "path", "kind").agg(F.sum("n").alias("n"))
        found = here if found is None else found.unionByName(here)
        inner = stored.where(F.col("kind").isin(*CONTAINERS))
        if inner.isEmpty():
            return found
        inside = F.when(F.col("kind") == "array", F.lit("[]")).otherwise(F.concat(F.lit("."), F.col("key")))
        exploded = inner.withColumn("v", F.parse_json("shape")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = exploded.select(*by, F.concat("path", inside).alias("path"), F.to_json("value").alias("shape"), "n")
        depth += 1


def compare_paths(reference: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, kind) where two tables of ``paths`` differ: ``missing_field``, ``extra_field`` or ``type_mismatch``.

    Nulls fit everything.  Of a field that one side lacks only the field is named, not what lies in it, and below
    unlike types nothing is compared, nor in arrays that have no elements on one side.
    """

    def sided(df: DataFrame, name: str) -> DataFrame:
        kinds = F.array_sort(F.array_remove(F.collect_set("kind"), "null"))
        return df.groupBy("path").agg(kinds.alias(name))

    both = sided(reference, "a").join(sided(actual, "b"), "path", "full_outer")
    unlike = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")
    what = F.when(F.col("b").isNull(), "missing_field").when(F.col("a").isNull(), "extra_field").when(unlike, "type_mismatch")
    marked = both.select("path", what.alias("kind"), F.regexp_replace("path", r"(\[\]|\.[^.\[\]]*)$", "").alias("above"), (F.size("a") > 0).alias("in_a"), (F.size("b") > 0).alias("in_b"))
    # A field counts only if what holds it is alike on both sides.
    shared = both.where(F.arrays_overlap("a", "b")).select(F.col("path").alias("above"))
    found = marked.where("kind IS NOT NULL").join(shared, "above", "left_semi").where((F.col("kind") == "type_mismatch") | ~F.endswith("path", F.lit("[]")))
    tops = marked.where("path = '$' AND kind = 'type_mismatch'")
    return found.select("path", "kind").union(tops.select("path", "kind"))
