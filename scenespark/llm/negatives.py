"""Hard negatives: for each anchor and each of its nearest positives, the best rows of other labels whose scores lie in a window below the positive's.

Anchors are clustered by direction (spherical k-means on a bounded sample; every anchor
joins its nearest centre). For a cluster whose members lie within an angle b of its
centre, no row v can score more than |anchor| |v| cos(max(0, angle(v, centre) - b)) with
any of them: rows sorted once by that bound are a list that the whole cluster shares,
and a member that walks it may stop where the next bound falls below the worst result
it still needs. The list is kept on two levels. Rows lie in tiles of a bounded size,
dealt by their nearest centre, and each cluster has its list of tiles: its own centre's
are walked first, and from there on each member is sent to those tiles alone that can
still hold a result. In a tile, each cluster sorts the rows by the bound once and its
members walk them in blocks of one matrix product until each is certified. Scores are
integer inner products, so results are exact and ties go to the lesser id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below_share, cut

#: Anchors that centres are fitted on at most (but for the chance in a hash), centres, and passes over them.
SAMPLE, CENTRES, PASSES = 4096, 16, 10

#: Least and most rows of a tile, anchors that meet it at once, rows of a block of the walk.
LEAST, MOST, CHUNK, BLOCK = 1024, 16384, 8192, 2048

#: No score: below all that count.
NONE = -(1 << 62)

#: What angles may be off by, as a share of |anchor| |row|.
SLACK = 1e-6

_FOUND = "key long, slot int, ids array<long>, scores array<long>"


def prepared(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): each component x as floor(scale * x), x a double, clipped to a long.

    Rows with a null id, label or vector, or any null or non-finite component, are left out.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(usable)
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros where they are shorter."""
    flat = column.combine_chunks()
    values, sizes = flat.flatten().to_numpy(), flat.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = m.astype(float)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm > 0, norm, 1)[:, None], norm


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centre that loses all its rows keeps its place."""
    units = _units(sample)[0]
    centres = units[np.linspace(0, len(units) - 1, min(k, len(units))).astype(int)]
    for _ in range(PASSES):
        of = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _bounds(units: np.ndarray, norms: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each row and cluster: the most that the row can score with a member of length one."""
    return norms[:, None] * np.minimum(1, np.cos(np.maximum(0, _angles(units, centres) - spread)) + SLACK)


def _located(centres: np.ndarray):
    """Rows with their nearest centre and the angle to it."""
    width = centres.shape[1]

    def run(batches):
        for b in batches:
            angles = _angles(_units(_matrix(pa.chunked_array([b.column("v")]), width))[0], centres)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "angle"])

    return run


def _tile_bounds(centres: np.ndarray, spread: np.ndarray):
    """Of each tile the greatest bound for each cluster, combined within a batch."""
    width, k = centres.shape[1], len(centres)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            bounds = _bounds(*_units(_matrix(pa.chunked_array([b.column("v")]), width)), centres, spread)
            cell, part = b.column("cell").to_numpy(), b.column("part").to_numpy()
            order = np.lexsort((part, cell))
            cell, part = cell[order], part[order]
            heads = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
            most = np.maximum.reduceat(bounds[order], heads)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell[heads], k)), pa.array(np.repeat(part[heads], k)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(heads))), pa.array(most.ravel())], names=["cell", "part", "cluster", "bound"])

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs: by floating point where that is exact, else as longs (which wrap around beyond 64 bits)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k best: falling scores, then rising ids."""
    if scores.shape[1] > 4 * k:
        # All that reach the k-th score are kept apart from those below it; ties at it go by id.
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], np.broadcast_to(ids, scores.shape[1:])[order]
        n = scores.shape[1]
        top = np.where(scores == NONE, -1, scores - scores.min(initial=0, where=scores != NONE))
        if float(top.max(initial=0)) * n < 2**62:
            ranked = top * n + (n - 1 - np.arange(n))
            at = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
        else:
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        scores, ids = np.take_along_axis(scores, at, 1), ids[at]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Walk:
    """The results so far of one cluster's members over one tile: for each slot the best scores within its window."""

    def __init__(self, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.low, self.high, self.same, self.k = low, high, same, k
        self.scores = np.full((*low.shape, k), NONE)
        self.ids = np.zeros((*low.shape, k), np.int64)

    def needed(self) -> np.ndarray:
        """The least score that could still change a member's results."""
        worst = np.where(self.scores[..., -1] == NONE, self.low, np.maximum(self.low, self.scores[..., -1]))
        return np.where(self.high >= self.low, worst, 1 << 62).min(axis=1)

    def take(self, who: np.ndarray, scores: np.ndarray, usable: np.ndarray, ids: np.ndarray) -> None:
        for slot in range(self.low.shape[1]):
            fits = usable & (scores >= self.low[who, slot, None]) & (scores <= self.high[who, slot, None])
            new, where = _best(np.where(fits, scores, NONE), ids, self.k)
            both = np.concatenate((self.scores[who, slot], new), axis=1)
            order = np.concatenate((self.ids[who, slot], where), axis=1)
            order_at = np.lexsort((order, -both), axis=1)[:, : self.k]
            self.scores[who, slot] = np.take_along_axis(both, order_at, 1)
            self.ids[who, slot] = np.take_along_axis(order, order_at, 1)


def _visit(centres: np.ndarray, spread: np.ndarray, same: bool, k: int):
    """Anchors that visit a tile (left) and its rows (right): each anchor's results there."""
    width = centres.shape[1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            rows, ids, labels = _matrix(right.column("v"), width), right.column("id").to_numpy(), right.column("label").to_numpy()
            units, norms = _units(rows)
            anchors, keys, own, own_label, cluster, low, high = (left.column(c) for c in ("v", "key", "id", "label", "cluster", "low", "high"))
            anchors, keys, own, own_label, cluster = _matrix(anchors, width), keys.to_numpy(), own.to_numpy(), own_label.to_numpy(), cluster.to_numpy()
            lengths = np.linalg.norm(anchors.astype(float), axis=1)
            low, high = (np.array(x.to_pylist(), np.int64).reshape(len(keys), -1) for x in (low, high))
            for c in np.unique(cluster).tolist():
                members = np.flatnonzero(cluster == c)
                bounds = _bounds(units, norms, centres[c : c + 1], spread[c : c + 1])[:, 0]
                order = np.lexsort((ids, -bounds))
                walk = Walk(low[members], high[members], same, k)
                for s in range(0, len(order), BLOCK):
                    going = np.flatnonzero(lengths[members] * (bounds[order[s]] + SLACK * norms[order[s]]) >= walk.needed())
                    if not len(going):
                        break
                    at, who = order[s : s + BLOCK], members[going]
                    alike = own_label[who][:, None] == labels[at][None, :]
                    usable = (alike if same else ~alike) & (own[who][:, None] != ids[at][None, :])
                    walk.take(going, _products(anchors[who], rows[at]), usable, ids[at])
                for m, slot in zip(*np.nonzero(walk.scores[..., 0] > NONE)):
                    n = int((walk.scores[m, slot] > NONE).sum())
                    for column, value in zip(out, (keys[members[m]], slot, walk.ids[m, slot, :n].tolist(), walk.scores[m, slot, :n].tolist())):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))], names=["key", "slot", "ids", "scores"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(key, slot, rank, id, score): the k best of what all tiles gave."""
    pairs = found.select("key", "slot", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("key", "slot", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    w = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Index:
    """Rows in tiles, anchors in clusters, and each cluster's list of tiles by their bounds."""

    def __init__(self, rows: DataFrame, anchors: DataFrame) -> None:
        spark = rows.sparkSession
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.empty = not n or anchors.isEmpty()
        if self.empty:
            return
        count = anchors.count()
        sample = anchors.where(below_share(F.xxhash64("key"), SAMPLE / count)).select("key", "v").collect() or anchors.orderBy("key").limit(1).select("key", "v").collect()
        sample.sort(key=lambda r: r["key"])
        self.centres = _centres(np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], np.int64).reshape(len(sample), width or 0), CENTRES)
        k = len(self.centres)
        located = anchors.mapInArrow(_located(self.centres), "key long, id long, label long, v array<long>, cell int, angle double")
        self.anchors = cut(located.withColumnRenamed("cell", "cluster"), "negatives_anchors")
        spread = {r[0]: r[1] for r in self.anchors.groupBy("cluster").agg(F.max("angle")).collect()}
        self.spread = np.array([spread.get(c, 0.0) for c in range(k)])
        cells = cut(rows.mapInArrow(_located(self.centres), "id long, label long, v array<long>, cell int, angle double").drop("angle"), "negatives_cells")
        each = min(MOST, max(LEAST, n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
        sizes = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}
        parts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 0) // each) or 1) for c in range(k)]), F.col("cell") + 1)
        self.rows = cells.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        bounds = self.rows.mapInArrow(_tile_bounds(self.centres, self.spread), "cell int, part int, cluster int, bound double")
        self.list = cut(bounds.groupBy("cell", "part", "cluster").agg(F.max("bound").alias("bound")), "negatives_list")
        self.chunks = -(-count // CHUNK)

    def _walk(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """visits: anchors with cell, part, low and high. No task holds more than a tile and a chunk of the anchors that visit it."""
        visits = visits.withColumn("chunk", F.pmod(F.col("key"), F.lit(self.chunks)).cast("int"))
        rows = self.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))))
        tile = ["cell", "part", "chunk"]
        return visits.groupBy(*tile).cogroup(rows.groupBy(*tile)).applyInArrow(_visit(self.centres, self.spread, same, k), _FOUND)

    def best(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """(key, slot, rank, id, score) for the anchors of windows (key, low, high: an array each, one item a slot)."""
        asked = self.anchors.join(windows, "key")
        here = self.list.select("cell", "part", "cluster", "bound")
        first = cut(self._walk(asked.join(here.where("cell = cluster").drop("bound"), "cluster"), same, k), "negatives_first")
        # What a member still needs, by its slots' worst results of its own centre's tiles.
        worst = _ranked(first, k).groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        worst = worst.where(F.col("n") >= k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("worst"))
        need = F.transform("low", lambda x, i: F.when(F.element_at("high", i + 1) >= x, F.greatest(x, F.coalesce(F.try_element_at("worst", i), x))))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        left = asked.join(worst, "key", "left").withColumn("need", F.array_min(need)).where("need IS NOT NULL")
        reach = length * (F.col("bound") + F.lit(SLACK)) * (1 + SLACK) + SLACK >= F.col("need")
        further = left.join(here.where("cell <> cluster"), "cluster").where(reach).select(*asked.columns, "cell", "part")
        return _ranked(first.unionByName(self._walk(further, same, k)), k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v) as prepared() gives them.

    An anchor's positives are its best `positives` other rows of its label (fewer, if there
    are fewer); for each, the best `negatives` rows of other labels whose score lies between
    low and high percent of the positive's come back in order. Scores are inner products
    with the anchor; higher ones first, ties by the lesser id. A negative positive score
    leaves an empty window, zero one of zeros. Vectors of unequal length are padded with
    zeros. A row with the anchor's id is never its partner; repeated rows are partners each,
    a repeated anchor row is one anchor. Anchors without positives or negatives do not
    appear, nor does anything for an empty table.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut(rows.select("id", "label", "v"), "negatives_rows")
    anchors = cut(rows.where(is_anchor).distinct().select(F.xxhash64("id", "label", "v").alias("key"), "id", "label", "v"), "negatives_asked")
    index = Index(rows, anchors)
    if index.empty:
        return spark.createDataFrame([], schema)
    every = lambda x: F.array(F.lit(x).cast("long"))
    found = cut(index.best(anchors.select("key", every(NONE + 1).alias("low"), every(-NONE - 1).alias("high")), True, positives), "negatives_positives")
    least = lambda s: -F.floor(-s * low / 100)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")
    s = lambda p: p["score"].cast("decimal(38,0)")  # noqa: E731  exact beyond 2^53
    windows = found.groupBy("key").agg(ordered).select("key", F.transform("p", lambda p: least(s(p)).cast("long")).alias("low"), F.transform("p", lambda p: F.floor(s(p) * high / 100).cast("long")).alias("high"))
    hard = index.best(windows, False, negatives)
    pairs = found.select("key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
