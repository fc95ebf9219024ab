"""Conversation structure repair by Knuth's lightest derivation.

Items say "the first i rows give role initials that bring the pattern to state q". Two items
make a third: a prefix and an edit of the next row (or an insert), and, for runs of rows, a
prefix and the span of a run. An item's value is its (cost, audit); appending an edit never
makes it smaller and keeps the order of two values of one item, since neither audit of equal
cost can begin with the other (the longer one would hold paid inserts). So the agenda may pop
items in the order of their values, and each is final when popped.

A conversation of any length is cut into runs of rows. The spans of a run, from each state to
each, are derived by themselves in the task that holds the run; then the runs of a conversation
are put together in order. Texts take no part in that: rows are told apart by digests. Only the
digest of the repaired conversation reads texts, as a stream, one Arrow batch at a time.
"""

import hashlib
import heapq
import itertools

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.llm.common import arrow_schema, crc_remainder

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
# Initials of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES, ACCEPTED = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}  # what a rerole or insert gives
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
RUN_ROWS = 128  # rows of which a task derives the spans at once

SPACE = r"[\x20\x09-\x0D]"
RUN = (
    "piece int, place bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_initial string, last_initial string, first_turn bigint, "
    "last_turn bigint, turns bigint, from_start boolean, costs array<bigint>, audits array<string>"
)
REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string"
)


def damage(conversations):
    """(conv_id, turn, role, text) with faults planted by ``crc32(conv_id:turn) % 20``.

    0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 sets the
    role user. Nulls count as one space, in the hashed key too; a null turn stays null.
    """
    blank = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = crc_remainder(F.concat(name("conv_id"), F.lit(":"), name("turn")), 20)
    text, role = name("text"), name("role")
    damaged = conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
        kind.alias("kind"),
    ).filter("kind <> 0")
    copied = F.sequence(F.lit(1), "copies")
    return damaged.select("conv_id", "turn", "role", "text", F.explode(copied).alias("copy")).drop("copy")


def marked(rows):
    """The order of a conversation is (turn, role, mark): 128 bits of the text's SHA-256.

    Null roles and texts count as one space.
    """
    filled = rows.fillna(" ", subset=["role", "text"])
    return filled.withColumn("mark", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def faults(rows):
    """Light rows, one for all equal rows of a turn: copies, initial, mark and first fault.

    ``fault`` is that of the first of the copies; the others are blank too, or duplicates.
    """
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){SPACE}*\z", 1)
    light = marked(rows).select(
        "conv_id", "turn", "role", "mark",
        (last == "").alias("blank"), last.isin(".", "!", "?").alias("closed"),
    )
    equal = light.groupBy("conv_id", "turn", "role", "mark").agg(
        F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("closed").alias("closed")
    )
    same = Window.partitionBy("conv_id", "role", "mark").orderBy(F.col("turn").asc_nulls_first())
    seen = F.row_number().over(same) > 1
    return equal.select(
        "conv_id", "turn", "role", "mark", "copies",
        F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(~F.col("closed"), TRUNCATED)
        .otherwise(SOUND).alias("fault"),
    )


def edits(initial, fault, state):
    """(edit, cost, state after) of one row, by the state before it."""
    yield DELETE, DELETE_COST, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    kept = STEP.get((state, initial))
    if kept is not None:
        yield KEEP, more, kept
    yield REROLE, REROLE_COST + more, MADE[state][1]


def spans(rows, start):
    """Value (cost, audit) of each state after ``rows`` [(initial, fault)], entered in ``start``.

    The agenda pops items by (cost, audit) until all goals, the states after the last row, are
    final.
    """
    goal, agenda, final = len(rows), [(0, "", 0, start)], {}
    left = STATES
    while left:
        if not agenda:
            break
        cost, audit, place, state = heapq.heappop(agenda)
        if (place, state) in final:
            continue
        final[place, state] = cost, audit
        if place == goal:
            left -= 1
        else:
            for edit, paid, after in edits(*rows[place], state):
                if (place + 1, after) not in final:
                    heapq.heappush(agenda, (cost + paid, audit + edit, place + 1, after))
        after = MADE[state][1]
        if (place, after) not in final:
            heapq.heappush(agenda, (cost + INSERT_COST, audit + INSERT, place, after))
    return [final.get((goal, state)) for state in range(STATES)]


def joined(prefix, span):
    """Prefix items after a run: each made of a prefix item and a span of the run."""
    out = []
    for after in range(STATES):
        made = [
            (before[0] + run[after][0], before[1] + run[after][1])
            for before, run in zip(prefix, span, strict=True)
            if before is not None and run is not None and run[after] is not None
        ]
        out.append(min(made, default=None))
    return out


def count_illegal(initials, before=None):
    found = 0
    for initial in initials:
        found += before is not None and before + initial not in LEGAL
        before = initial
    return found


class _Run:
    """Rows of one conversation, as they come in order."""

    def __init__(self, conversation, first):
        self.conversation, self.first = conversation, first
        self.start()

    def start(self):
        self.rows, self.turns, self.distinct = [], [], 0

    def add(self, turn, initial, fault, copies):
        for copy in range(copies):
            again = fault if copy == 0 or fault == BLANK else DUPLICATE
            if not self.turns or self.turns[-1] != turn:
                self.distinct += turn is not None
            self.rows.append((initial, again))
            self.turns.append(turn)

    def out(self, piece, place):
        """One row of RUN; a conversation that begins here is entered in state 0 only."""
        entered = [spans(self.rows, s) if s == 0 or not self.first else [None] * STATES for s in range(STATES)]
        values = [v if v is not None else (None, None) for run in entered for v in run]
        kinds = [fault for _, fault in self.rows]
        initials = [initial for initial, _ in self.rows]
        known = [t for t in self.turns if t is not None]
        return (
            self.conversation, piece, place, len(self.rows),
            kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED),
            count_illegal(initials), initials[0], initials[-1],
            known[0] if known else None, known[-1] if known else None, self.distinct, self.first,
            [c for c, _ in values], [a for _, a in values],
        )


def _as_batches(rows, schema, size=2000):
    """Arrow batches of ``rows`` (tuples in the order of ``schema``)."""
    held = []

    def batch():
        columns = zip(*held, strict=True)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _tuples(batches):
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def runs(light, run_rows=RUN_ROWS):
    """Spans and counts of runs of at most ``run_rows`` rows, in order by (piece, place).

    Rows are dealt by ranges of (conversation, turn, ...), so a conversation of any length is
    spread over as many tasks as it has shares of all rows.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "mark")]
    first = light.select(
        "conv_id", "turn", "role", "mark", F.substring("role", 1, 1).alias("initial"), "fault", "copies",
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = first.select(
        F.spark_partition_id().alias("piece"), "conv_id", "turn", "initial", "fault", "copies"
    )
    kind = light.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, {RUN}")
    arrow = arrow_schema(schema)

    def derive(batches):
        def found():
            run, place, piece = None, 0, 0
            for piece, conversation, turn, initial, fault, copies in _tuples(batches):
                if run is None or run.conversation != conversation:
                    if run is not None and run.rows:
                        yield run.out(piece, place)
                    # the first one here may have begun in another task
                    run, place = _Run(conversation, run is not None), 0
                while copies:
                    taken = min(copies, run_rows - len(run.rows))
                    run.add(turn, initial, fault, taken)
                    copies -= taken
                    fault = fault if fault == BLANK else DUPLICATE
                    if len(run.rows) == run_rows:
                        yield run.out(piece, place)
                        run.first, place = False, place + 1
                        run.start()
            if run is not None and run.rows:
                yield run.out(piece, place)

        return _as_batches(found(), arrow)

    return rows.mapInArrow(derive, schema)


class _Whole:
    """A conversation, put together of its runs."""

    def __init__(self):
        self.prefix = [(0, "")] + [None] * (STATES - 1)
        self.counts, self.initial = [0, 0, 0, 0], None
        self.least = self.most = None
        self.turns = 0

    def add(self, row):
        (piece, place, rows, blank, duplicate, truncated, illegal, first, last, low, high, turns,
         _, costs, audits) = row
        values = [(c, a) if c is not None else None for c, a in zip(costs, audits, strict=True)]
        span = [values[s * STATES : (s + 1) * STATES] for s in range(STATES)]
        self.prefix = joined(self.prefix, span)
        illegal += count_illegal([first], self.initial)
        self.counts = [a + b for a, b in zip(self.counts, (blank, duplicate, truncated, illegal), strict=True)]
        self.initial = last
        if low is not None:
            self.turns += turns - (self.most == low)
            self.least = low if self.least is None else self.least
            self.most = high

    def out(self):
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        cost, audit = min(v for s, v in enumerate(self.prefix) if s in ACCEPTED and v is not None)
        return (gaps, *self.counts, cost, audit)


def report(conversations, run_rows=RUN_ROWS):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of damaged rows.

    One row for each conversation of the frame, with zeros and an empty audit where no row is.
    Rows are those of ``conversations`` as they are; see ``damage``.
    """
    light = faults(conversations)
    schema = StructType.fromDDL(f"conv_id {light.schema['conv_id'].dataType.simpleString()}, {REPORT}")
    arrow = arrow_schema(schema)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "piece", "place")]
    dealt = runs(light, run_rows).repartition("conv_id").sortWithinPartitions(*order)

    def combine(batches):
        def found():
            held, whole = None, None
            for conversation, *row in _tuples(batches):
                if whole is None or held != conversation:
                    if whole is not None:
                        yield (held, *whole.out())
                    held, whole = conversation, _Whole()
                whole.add(row)
            if whole is not None:
                yield (held, *whole.out())

        return _as_batches(found(), arrow)

    return dealt.mapInArrow(combine, schema)


def _lines(audit, rows):
    """(role, text) of the repaired rows, as they come; ``rows`` yields (role, text)."""
    state = 0
    rows = iter(rows)
    for edit in audit:
        made, after = MADE[state]
        if edit == INSERT:
            yield NAMES[made], ""
        else:
            role, text = next(rows)
            if edit == DELETE:
                continue
            if edit == KEEP:
                after = STEP[state, role[:1]]
                yield role, text
            else:
                yield NAMES[made], text
        state = after


def _conversations(records):
    """(first record, the others) of each conversation; the others are read as they are used."""
    for _, group in itertools.groupby(records, key=lambda r: r[0]):
        yield next(group), group


def _with_rows(reports, rows, function, added):
    """``function(audit, rows)`` of each conversation: rows of the columns ``added`` (DDL).

    A conversation's report and its rows are dealt by conv_id and read as one stream, the
    report first, so no conversation is held whole.
    """
    kept = [c for c in reports.columns if c != "conv_id"]
    schema = StructType(reports.schema.fields + StructType.fromDDL(added).fields)
    arrow = arrow_schema(schema)
    lines = marked(rows).withColumns({"kind": F.lit(1), "report": F.lit(None).cast(
        reports.select(F.struct(*kept).alias("r")).schema["r"].dataType)})
    heads = reports.select("conv_id", F.struct(*kept).alias("report"), F.lit(0).alias("kind"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "mark")]
    dealt = heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id")
    dealt = dealt.sortWithinPartitions(*order).select("conv_id", "report", "role", "text")

    def run(batches):
        def found():
            for (conversation, head, _, _), others in _conversations(_tuples(batches)):
                values = [head[name] for name in kept]
                pairs = ((role, text) for _, _, role, text in others)
                for row in function(head["audit"], pairs):
                    yield (conversation, *values, *row)

        return _as_batches(found(), arrow)

    return dealt.mapInArrow(run, schema)


def repaired(reports, rows):
    """The repaired conversations: ``reports`` with position (from 1), new_role and new_text."""

    def lines(audit, pairs):
        for position, (role, text) in enumerate(_lines(audit, pairs), 1):
            yield position, role, text

    return _with_rows(reports, rows, lines, "position bigint, new_role string, new_text string")


def digested(reports, rows):
    """``reports`` with ``repaired_sha256``: of the lines ``role:text``, joined by newlines."""

    def digest(audit, pairs):
        hashed, first = hashlib.sha256(), True
        for role, text in _lines(audit, pairs):
            hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
        yield (hashed.hexdigest(),)

    return _with_rows(reports, rows, digest, "repaired_sha256 string")


def repair(conversations):
    """Damage, report and digest of every original conv_id, a null one included.

    Conversations without rows after damage have zeros, an empty audit and the digest of an
    empty string. Nulls count as one space, null turns come first. Rows of one turn are ordered
    by role, then text's digest; repeated rows are duplicates. A role's first character is its
    initial; an empty role has none and cannot be kept. Other columns are ignored.
    """
    rows = damage(conversations)
    nothing = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), F.lit(0))
    nothing["audit"] = F.lit("")
    found = report(rows)
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    every = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(name, value.cast(found.schema[name].dataType)).alias(name) for name, value in nothing.items()],
    )
    return digested(every, rows)
