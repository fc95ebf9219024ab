"""Helpers shared by the operators: tables, Arrow columns, tokens and bounded samples."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows handed to numpy at once; an Arrow batch holds up to 10,000.
SLICE_ROWS = 256


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(key, modulus):
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def word_table(keep):
    """Byte table that keeps the bytes ``keep`` accepts, lower-cases A-Z, blanks the rest."""
    out = bytearray(256)
    for byte in range(256):
        low = byte + 32 if 65 <= byte <= 90 else byte
        out[byte] = low if keep(low) else 32
    return bytes(out)


# [0-9a-z] and everything beyond ASCII are word characters.
ALNUM = word_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)


def rows_of(batches, size=SLICE_ROWS):
    """Arrow batches cut into slices of at most ``size`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def arrow_schema(frame_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame_schema)


def map_rows(frame, function, added, without=()):
    """``frame`` with the columns ``added`` (DDL), given by ``function(columns) -> arrays``.

    ``function`` gets a dictionary of Arrow arrays of at most SLICE_ROWS rows and returns the
    added columns in order. Columns of ``frame`` are returned as they are; those named in
    ``without`` are read only and do not travel back.
    """
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(added)
    own = [i for i, name in enumerate(frame.columns) if name not in without]
    schema = StructType([frame.schema.fields[i] for i in own] + extra.fields)
    arrow = arrow_schema(extra)

    def run(batches):
        for batch in rows_of(batches):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            new = [
                pa.array(values, type=field.type)
                for values, field in zip(function(columns), arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in own] + new, names=schema.names)

    return frame.mapInArrow(run, schema)


def encoded(texts):
    """Texts of an Arrow array as bytes, null as empty."""
    return [raw or b"" for raw in texts.cast(pa.binary()).to_pylist()]


def bounded_labels(documents, labels, label, most):
    """Ids that may be learned from, at most ``most`` of each label value: (sizes, ids).

    ``sizes`` has the number of all such ids by label, ``ids`` is a frame (doc_id, label) of
    bounded size. Left out are ids whose crc32, written as text, is divisible by 5, ids without
    a document, and labels other than 0 and 1. Repeated label rows count once; the smallest
    label wins. Ids are chosen by hash.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (crc_remainder(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .join(documents.select("doc_id"), "doc_id", "left_semi")
    )
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("label") == value).orderBy(*order).limit(most) for value in (0, 1)]
    return sizes, chosen[0].union(chosen[1]).select("doc_id", "label")


def gathered(frame):
    """A frame of proven bounded size, as a pyarrow table on the driver."""
    return frame.toArrow()


LETTER = re.compile(r"[^\W\d_]")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def unused(frame, name):
    """``name``, lengthened until no column of ``frame`` has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
