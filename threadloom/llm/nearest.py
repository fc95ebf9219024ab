"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes nearest point: vectors are divided by the longest one and get one
more coordinate, which makes them unit vectors. A bounded sample is halved again and again at
the median between two means, so lists are balanced; their centroids are in the order of the
halving, and a run of neighbouring lists is a group. A graph over the centroids, held in each
task, finds the nearest ones. A vector goes to its nearest list and, if it lies near a boundary,
to further ones; a query reads the lists whose centroid is at most a ratio farther than the
nearest one. Scores are inner products of the original vectors in double precision.
"""

from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

LIST_ROWS = 256  # rows of a list, while there are fewer than MOST_LISTS
MOST_LISTS = 4096  # centroids every task holds
SAMPLE_LIST_ROWS = 32  # sampled rows of a list
SAMPLE_VALUES = 1 << 24  # components of all sampled rows
BLOCK_VALUES = 1 << 18  # components of the rows that a task compares at once
NEIGHBOURS = 24  # of a centroid in the graph
BEAM = 8  # nearest centroids that are always followed
REPLICA_RATIO, MOST_REPLICAS = 1.01, 4  # lists of a vector near a boundary
READ_RATIO = 1.15  # lists a query reads, by distance of the centroid
MEANS_STEPS = 6
SLICE_ROWS = 256


def usable(vectors):
    """Rows with an id and a vector that is not null, not zero, and all of finite numbers."""
    item = F.col("embedding")
    finite = F.forall(item, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    some = F.exists(item, lambda x: x != 0)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"  # half the bytes to shuffle
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")
    ).filter(F.coalesce(F.col("vec_id").isNotNull() & finite & some, F.lit(False)))


# --- centroids and their graph --------------------------------------------------


def halved(points, leaves):
    """Rows of ``points`` in ``leaves`` (a power of 2) parts whose sizes differ by 1 at most."""
    parts = [np.arange(len(points))]
    while len(parts) < leaves:
        parts = [half for part in parts for half in _halves(points, part)]
    return parts


def _halves(points, part):
    rows = points[part]
    # from two far points to two means
    far = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    ends = np.stack([far, rows[((rows - far) ** 2).sum(axis=1).argmax()]])
    middle = len(part) // 2
    for _ in range(MEANS_STEPS):
        side = rows @ (ends[1] - ends[0])
        order = np.argsort(side, kind="stable")
        ends = np.stack([rows[order[:middle]].mean(axis=0), rows[order[middle:]].mean(axis=0)])
    return part[order[:middle]], part[order[middle:]]


def squared(a, b):
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


class Centroids:
    """Centroids of the lists with a graph of near ones, searched in memory."""

    def __init__(self, points, neighbours=NEIGHBOURS):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = (self.points**2).sum(axis=1)
        size = len(points)
        degree = min(neighbours, size - 1)
        self.links = np.zeros((size, max(degree, 1)), np.int32)
        for at in range(0, size, SLICE_ROWS):
            apart = squared(self.points[at : at + SLICE_ROWS], self.points)
            apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
            if degree:
                self.links[at : at + len(apart)] = np.argpartition(apart, degree - 1, axis=1)[:, :degree]
        # lists are in the order of the halving: evenly spaced ones lie everywhere
        self.entries = np.unique(np.linspace(0, size - 1, max(1, min(size, 2 * isqrt(size)))).astype(int))

    def search(self, queries, ratio):
        """Distances (inf where not visited) of each query to the centroids, best first.

        Follows the links of every centroid found that is among the BEAM nearest or at most
        ``ratio`` times as far as the nearest, until none is left: however many these are.
        """
        queries = np.asarray(queries, np.float32)
        found = np.full((len(queries), len(self.points)), np.inf, np.float32)
        own = (queries**2).sum(axis=1)
        found[:, self.entries] = squared(queries, self.points[self.entries])
        followed = np.zeros(found.shape, bool)
        beam = min(BEAM, found.shape[1]) - 1
        while True:
            limit = np.maximum(found.min(axis=1) * ratio**2, np.partition(found, beam, axis=1)[:, beam])
            rows, nodes = np.nonzero((found <= limit[:, None]) & ~followed & np.isfinite(found))
            if not len(rows):
                return found
            followed[rows, nodes] = True
            new = np.zeros(found.shape, bool)
            new[np.repeat(rows, self.links.shape[1]), self.links[nodes].ravel()] = True
            rows, nodes = np.nonzero(new & np.isinf(found))
            for at in range(0, len(rows), 1 << 16):
                r, c = rows[at : at + (1 << 16)], nodes[at : at + (1 << 16)]
                dots = np.einsum("ij,ij->i", queries[r], self.points[c])
                found[r, c] = np.maximum(own[r] + self.norms[c] - 2 * dots, 0)

    def read(self, queries, ratio=READ_RATIO, known=None, least=0):
        """Which lists each query reads: the nearest and all at most ``ratio`` times as far.

        ``known`` has a number of rows that each list has for certain; further lists are read,
        the nearest first, until those read have ``least`` of them, in the end all lists.
        """
        found = self.search(queries, ratio)
        limit = found.min(axis=1, keepdims=True) * ratio**2
        if least:
            order = np.argsort(found, axis=1, kind="stable")
            rows = np.cumsum(known[order], axis=1)
            enough = np.where(rows[:, -1] >= least, (rows >= least).argmax(axis=1), found.shape[1] - 1)
            last = order[np.arange(len(found)), enough]
            limit = np.maximum(limit, found[np.arange(len(found)), last][:, None])
        return found <= limit

    def stored(self, points, ratio=REPLICA_RATIO, most=MOST_REPLICAS):
        """Which lists each point is stored in: the nearest one and, of those at most ``ratio``
        times as far, the ``most`` - 1 nearest, which makes up for a query that reads only one
        side of a boundary."""
        found = self.search(points, ratio)
        limit = found.min(axis=1, keepdims=True) * ratio**2
        if found.shape[1] > most:
            limit = np.minimum(limit, np.partition(found, most - 1, axis=1)[:, most - 1 : most])
        return found <= limit


class Index:
    """What tasks need: centroids, scale, and how lists are grouped and groups cut in blocks."""

    def __init__(self, sample, rows, longest, dim):
        self.dim, self.longest = dim, longest
        points = np.unique(self.lifted(sample), axis=0)
        wanted = min(MOST_LISTS, max(1, rows // LIST_ROWS), max(1, len(points) // 2))
        leaves = 1 << (wanted.bit_length() - 1)
        parts = halved(points, leaves)
        self.centroids = Centroids(np.stack([points[part].mean(axis=0) for part in parts]))
        # sampled rows are rows of the lists: what these have at least
        self.known = np.zeros(leaves, np.int64)
        for at in range(0, len(points), SLICE_ROWS):
            self.known += self.centroids.stored(points[at : at + SLICE_ROWS]).sum(axis=0)
        block_rows = max(1, BLOCK_VALUES // dim)
        self.group_lists = max(1, int(block_rows * leaves / max(1, rows)))
        share = np.bincount(np.arange(leaves) // self.group_lists, minlength=1) / leaves
        # parts of the sample are equal, so are the lists but for chance
        self.blocks = [max(1, ceil(s * rows / block_rows)) for s in share]

    def lifted(self, vectors):
        """Unit vectors of one more dimension, for which nearest means largest product."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)

    def pointed(self, vectors):
        """Queries: their length is of no matter, the added coordinate is 0."""
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / largest
        scaled /= np.sqrt((scaled**2).sum(axis=1, keepdims=True))
        return np.concatenate([scaled, np.zeros((len(scaled), 1))], axis=1).astype(np.float32)


def fit(vectors):
    """The index of ``vectors`` (see ``usable``), or None if there is none.

    One pass counts rows and finds the commonest dimension (rows of another one take no part)
    and the longest vector; a second one gathers a sample chosen by hash of the id, of
    SAMPLE_LIST_ROWS rows a list, SAMPLE_VALUES components at most.
    """
    square = lambda x: x.cast("double") * x.cast("double")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + square(x)))
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(
        F.count("*").alias("rows"), F.max(length).alias("longest")
    )
    best = sizes.orderBy(F.desc("rows"), "dim").first()
    if best is None:
        return None
    dim, rows = best["dim"], best["rows"]
    wanted = min(SAMPLE_VALUES // dim, SAMPLE_LIST_ROWS * MOST_LISTS, rows)
    share = int(min(1.0, wanted / rows) * (1 << 32))
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < share
    picked = vectors.filter((F.size("embedding") == dim) & chosen).select("embedding").toArrow()
    if not picked.num_rows:  # a few rows, none of them picked
        picked = vectors.filter(F.size("embedding") == dim).select("embedding").limit(1).toArrow()
    return Index(_matrix(picked["embedding"], dim), rows, best["longest"], dim)


def _matrix(column, dim):
    """An Arrow column of lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


# --- lists ----------------------------------------------------------------------


def placed(rows, index, k=None):
    """``rows`` (id, embedding), one for each group they have a list in, with these lists.

    Candidates go to one block of a group, by their id. Queries, which are told by the ``k`` rows
    they want, go to all blocks, and to lists that have twice ``k`` different vectors, so they
    never find fewer than there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(index)
    everywhere = k is not None

    def place(batches):
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                vectors = _matrix(part.column("embedding"), index.dim)
                if everywhere:
                    points = index.pointed(vectors)
                    row, found = np.nonzero(index.centroids.read(points, known=index.known, least=2 * k))
                else:
                    row, found = np.nonzero(index.centroids.stored(index.lifted(vectors)))
                group = found // index.group_lists
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
                ends = np.r_[first[1:], len(row)]
                out_row, out_group, out_block, lists = [], [], [], []
                ids = part.column("id").to_numpy()
                for start, end in zip(first.tolist(), ends.tolist(), strict=True):
                    blocks = index.blocks[group[start]]
                    own = range(blocks) if everywhere else [int(ids[row[start]] % blocks)]
                    for block in own:
                        out_row.append(row[start])
                        out_group.append(group[start])
                        out_block.append(block)
                        lists.append(found[start:end])
                taken = pa.array(out_row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out_group, pa.int32()),
                        pa.array(out_block, pa.int32()),
                        part.column("id").take(taken),
                        part.column("embedding").take(taken),
                        pa.array(lists, pa.list_(pa.int32())),
                    ],
                    names=["grp", "block", "id", "embedding", "lists"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(place, f"grp int, block int, id bigint, embedding {kind}, lists array<int>")


def _by_list(column):
    """Rows of each list: {list: positions}."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    order = np.argsort(lists, kind="stable")
    names, starts = np.unique(lists[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], starts[1:]), strict=True))


def nearest_in_block(candidates, queries, dim, k):
    """(query, vec_id, score) of the ``k`` best candidates of each query in shared lists.

    Products of whole lists choose; chosen scores are summed anew, each in the same order, so
    equal vectors have equal scores, and ties go to the smaller id.
    """
    vectors, ids = _matrix(candidates["embedding"], dim), candidates["id"].to_numpy()
    points, names = _matrix(queries["embedding"], dim), queries["id"].to_numpy()
    stored, read = _by_list(candidates["lists"]), _by_list(queries["lists"])
    lengths = np.sqrt((vectors**2).sum(axis=1)).max() * np.sqrt((points**2).sum(axis=1))
    out = [[], [], []]
    for at in range(0, len(names), SLICE_ROWS):
        part = slice(at, min(at + SLICE_ROWS, len(names)))
        scores = np.full((part.stop - at, len(ids)), -np.inf)
        for name, rows in read.items():
            own = rows[(rows >= at) & (rows < part.stop)] - at
            others = stored.get(name)
            if others is not None and len(own):
                scores[np.ix_(own, others)] = points[own + at] @ vectors[others].T
        if len(ids) > k:
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(scores), -np.inf)
        # what rounding may have put behind is looked at too
        least = least - 1e-12 * lengths[part]
        rows, found = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        exact = (points[rows + at] * vectors[found]).sum(axis=1)
        order = np.lexsort((ids[found], -exact, rows))
        rows, found, exact = rows[order], found[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        out[0].append(names[rows[keep] + at])
        out[1].append(ids[found[keep]])
        out[2].append(exact[keep])
    return [np.concatenate(column) for column in out]


def search(candidates, queries, k, index=None):
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``.

    Both frames have (vec_id, embedding); a query's own id is no candidate. Rows without an
    id, and vectors that are null, zero, hold a null or non-finite component or have another
    dimension than most candidates, take no part. Equal vectors are compared once: of each the
    ``k`` + 1 smallest ids are kept, which no tie can go beyond. Repeated rows count once; of an
    id with several vectors the nearest counts. Ties go to the smaller id. Other columns are
    ignored. ``index`` is fitted on the candidates unless given.
    """
    candidates, queries = usable(candidates), usable(queries)
    index = index or fit(candidates)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return candidates.sparkSession.createDataFrame([], schema)
    dim, more = index.dim, k + 1
    candidates = candidates.filter(F.size("embedding") == dim)
    queries = queries.filter(F.size("embedding") == dim)
    few = _first(candidates, "embedding", ["vec_id"], more)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    asked = queries.select(
        "vec_id", "embedding", F.first("vec_id").over(same).alias("id"), F.row_number().over(same).alias("place")
    )
    classes = asked.filter("place = 1").select("id", "embedding")
    found = (
        placed(few.select(F.col("vec_id").alias("id"), "embedding"), index)
        .groupBy("grp", "block")
        .cogroup(placed(classes, index, more).groupBy("grp", "block"))
        .applyInArrow(_compared(dim, more), "query bigint, vec_id bigint, score double")
    )
    # a candidate of several groups is found with the same score in each
    best = _first(found, "query", [F.desc("score"), "vec_id"], more).drop("rank")
    named = asked.select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"))
    pairs = named.join(best, "query").filter("vec_id <> query_id")
    once = pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = _first(once, "query_id", [F.desc("score"), "vec_id"], k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _first(rows, key, order, k):
    """The first ``k`` different vec_ids of each key; most others go before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates([key, "vec_id"])


def _compared(dim, k):
    def compare(candidates, queries):
        if not candidates.num_rows or not queries.num_rows:
            columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            columns = nearest_in_block(candidates, queries, dim, k)
        return pa.table([pa.array(c) for c in columns], names=["query", "vec_id", "score"])

    return compare
