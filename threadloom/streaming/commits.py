"""Commit records of micro-batches.

A batch number says nothing about its input: another checkpoint counts from 0 again. A batch is
therefore named by the stream's identity, which Spark keeps in the checkpoint, its number and a
fingerprint of its input. What it writes goes to folders of that name; a record written last
makes them count. Readers take folders with a record only, so a broken attempt is never read, a
repeated batch finds itself done, and another stream writes beside it, not over it.
"""

from pyspark.sql import functions as F

from threadloom.session import is_written, path_exists

PLACE = "query string, batch_id bigint, input string"
KEYS = ["query", "batch_id", "input"]
COUNTS = "messages bigint, rejected bigint, stored bigint"


def query_id(spark, checkpoint):
    """Identity of the stream that writes to ``checkpoint``."""
    stored = spark.read.text(f"{checkpoint}/metadata", wholetext=True)
    return stored.select(F.get_json_object("value", "$.id")).first()[0]


def fingerprint(rows, columns):
    """(rows, mark): the mark tells inputs of different rows apart, whatever their order."""
    hashes = [F.xxhash64(F.lit(i), *columns) for i in range(2)]
    count, mixed, total = rows.agg(
        F.count("*"), F.bit_xor(hashes[0]), F.sum(F.shiftright(hashes[1], 32))
    ).first()
    return count, f"{count}-{(mixed or 0) & (2**64 - 1):016x}-{(total or 0) & (2**64 - 1):016x}"


class Batch:
    """Folders and record of one micro-batch under ``out``."""

    def __init__(self, spark, out, query, batch_id, mark):
        self.spark, self.out, self.batch_id = spark, out, batch_id
        self.place = place({"query": query, "batch_id": batch_id, "input": mark})

    def folder(self, name):
        return f"{self.out}/{name}/{self.place}"

    def is_committed(self):
        return is_written(self.spark, self.folder("commits"))

    def commit(self, messages, rejected, stored):
        """Make what the batch has written count, with the numbers of its rows."""
        counts = {"messages": messages, "rejected": rejected, "stored": stored}
        record = self.spark.range(0, 1, 1, 1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])
        record.write.mode("overwrite").json(self.folder("commits"))


def place(record):
    """Folder of a batch, by its record."""
    return f"query={record['query']}/batch_id={record['batch_id']}/input={record['input']}"


def _records(spark, path):
    schema = f"{COUNTS}, {PLACE}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    names = ["messages", "rejected", "stored", *KEYS]
    return spark.read.schema(schema).json(path).select(*names)


def open_records(spark, out):
    """Records of batches whose folders are still there: those not put into the history yet."""
    return _records(spark, f"{out}/commits").join(_records(spark, f"{out}/history"), KEYS, "left_anti")


def committed(spark, out):
    """All records: query, batch_id, input, messages, rejected, stored."""
    return open_records(spark, out).unionByName(_records(spark, f"{out}/history"))


def committed_rows(spark, out, name, schema, records=None):
    """Rows that committed batches wrote under ``name``, as JSON lines.

    Folders are joined by name, so Spark prunes those without a record before it reads.
    """
    kinds = schema if isinstance(schema, str) else schema.toDDL()
    if not path_exists(spark, f"{out}/{name}"):
        return spark.createDataFrame([], kinds)
    rows = spark.read.schema(f"{kinds}, {PLACE}").json(f"{out}/{name}")
    records = open_records(spark, out) if records is None else records
    return rows.join(records.select(*KEYS), KEYS, "left_semi").drop(*KEYS)
