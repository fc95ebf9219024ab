"""JSON arrays of objects, read in many tasks however large a file is.

Spark's text reader cuts a file at ``}`` and splits it between tasks like any text. Which braces
close an element follows from what came before: whether a string is open and how many braces
are. Both are running sums over the pieces of a file, and so is the number of the element a
piece belongs to. The pieces of an element are then put together and parsed by themselves.
"""

from pyspark.sql import functions as F

from threadloom.operators.skew import PIECE_ROWS, in_pieces, scan_pieces

ORDER = ["start", "number"]


def _count(text, character):
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _running(rows, name, column, before):
    """``name``: sum of ``column`` over a file's pieces up to this one, or before this one."""
    total = (column, F.sum)
    scanned = scan_pieces(rows, ["file"], ORDER, {"_here": total}, {"_before": total})
    found = F.col("_here") + F.coalesce("_before", F.lit(0)) - (column if before else F.lit(0))
    return scanned.withColumn(name, found).drop("_here", "_before")


def elements(spark, path, size=PIECE_ROWS):
    """(file, element, text): the objects of the arrays in the files of ``path``, in order.

    Several arrays in a file count as one. Braces, quotes and escapes inside strings are text.
    What is not an object is left out. An element must fit into one row, a file need not.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("number"),
        "value",
    )
    # escaped characters neither open nor close anything
    plain = F.regexp_replace("value", r"(?s)\\.", "__")
    quoted = read.withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    pieces = in_pieces(quoted, ["file"], ORDER, size)
    marked = _running(pieces, "quotesBefore", F.col("quotes"), True)
    # without its strings: one that is open already, whole ones, one that stays open
    begins_inside = F.col("quotesBefore") % 2 == 1
    outside = F.when(begins_inside, F.regexp_replace("plain", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("plain"))
    outside = F.regexp_replace(F.regexp_replace(outside, r'(?s)"[^"]*"', ""), r'(?s)"[^"]*$', "")
    closes = ((F.col("quotesBefore") + F.col("quotes")) % 2 == 0).cast("int")
    opened = marked.withColumns({"opens": _count(outside, "{"), "closes": closes}).drop("plain")
    deep = _running(opened, "depth", F.col("opens") - F.col("closes"), False)
    ended = deep.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") == 0)).cast("int"))
    numbered = _running(ended, "element", F.col("ends"), True)
    whole = numbered.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct(*ORDER, "value"))).alias("parts"),
        F.max("ends").alias("ends"),
        F.sum("opens").alias("opens"),
    )
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    kept = whole.filter("ends = 1 and opens > 0")
    # what lies before the object: separators, numbers, strings
    before = r'(?s)^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'
    return kept.select("file", "element", F.regexp_replace(text, before, "").alias("text"))


def read_array(spark, path, schema, size=PIECE_ROWS):
    """Rows of ``schema`` out of JSON arrays; elements that are not JSON give nulls."""
    return elements(spark, path, size).select(F.from_json("text", schema).alias("row")).select("row.*")
