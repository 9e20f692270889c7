"""Exact nearest-neighbour distances from real to synthetic vectors.

Vectors are reduced to distinct ones with counts and ids, so copies cost nothing. Small tables are compared directly.

Up to ``BOX_DIMS`` dimensions, every key with many synthetic vectors is cut into boxes of about ``BOX_ROWS`` of them, at medians of a
sample. A real vector meets the box that it falls into, and after that only boxes that begin closer than its k-th neighbour: first the
``NEAR`` closest, then what is left. Inside a block the same is done with leaves of ``LEAF_ROWS`` vectors, so a real vector is compared
with a few hundred others however many there are. Bounds round the same way as distances, so none needs slack.

More dimensions, and vectors that are not finite, use an index of two layers:

* Codes. Each vector has one byte per dimension (its offset from its pivot, in steps of its own largest offset) and the exact
  length of what the code leaves out. Distances between codes plus or minus both rests bound the true distance from both sides.
  Offsets from a pivot keep the rests small among near copies too. Below ``EXACT_DIMS`` dimensions the code is the vector.
* Cells. A key with many synthetic vectors is partitioned around sampled pivots. The triangle inequality tells
  which cells can hold anything closer than what is known.

A real vector is visited in three rounds: with the cell of its nearest pivot, with the ``NEAR`` most promising cells, and with what
cells remain, by wards of about ``WARD_ROWS`` codes. So it travels at most ``1 + NEAR + wards`` times, whatever its dimension,
as id and code, not as an array. Cells and wards meet in blocks of bounded size; a block returns the ids of those that may be among
the ``k`` nearest, by their bounds. Only these few pairs fetch their vectors and get exact distances.
Pivots and codes steer the work: any choice of them gives the same distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH
from chronofid.session import checkpointed

CELL_ROWS = 4096
MAX_PIVOTS = 8192
BLOCK_REAL = 4096
BLOCK_SYNTH = 16384
#: Cells that a vector visits before the rest, and codes of a ward.
NEAR = 8
WARD_ROWS = 65536
#: Numbers in a table of distances that a task holds at a time: a few such tables of 2 MB, whatever the pivots and blocks.
TABLE = 250_000
#: Share of the length of two codes that their computed distance may be off.
SLACK = 1e-6
EXACT_DIMS = 16
#: Most dimensions that boxes serve, synthetic vectors of a box and of a leaf inside a block, and sampled ones a box.
BOX_DIMS = 4
BOX_ROWS = 8192
LEAF_ROWS = 128
SAMPLES_PER_BOX = 64
CELLS_CONF = "spark.chronofid.knnCellRows"

_BLOCK = "key string, vec array<double>, n long, best array<double>"


def smallest_distances(real: np.ndarray, synth: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest Euclidean distances of each real row, sorted; fewer columns if synth is shorter."""
    k = min(k, len(synth))
    out = np.empty((len(real), k))
    step = max(1, TABLE // max(1, len(synth)))
    for at in range(0, len(real), step):
        part = real[at : at + step]
        total = np.zeros((len(part), len(synth)))
        for d in range(real.shape[1]):
            total += np.square(part[:, d, None] - synth[None, :, d])
        nearest = np.partition(total, k - 1, axis=1)[:, :k]
        out[at : at + step] = np.sqrt(np.sort(nearest, axis=1))
    return out


def _finite(vector: str) -> Column:
    """Whether all numbers of an array are finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _compare(k: int):
    def block(real: pd.DataFrame, synth: pd.DataFrame) -> pd.DataFrame:
        if real.empty or synth.empty:
            best = [[] for _ in range(len(real))]
        else:
            copies = np.minimum(synth["copies"].to_numpy(), k)
            best = list(smallest_distances(_matrix(real["vec"]), np.repeat(_matrix(synth["other"]), copies, axis=0), k))
        return real[["key", "vec", "n"]].assign(best=best)

    return block


def _meet(real: DataFrame, synth: DataFrame, k: int, on: list[str]) -> DataFrame:
    # Both sides stem from one table: without names of its own the second would share columns with the first.
    names = [f"_{c}" for c in on]
    other = synth.select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.col("vec").alias("other"), F.col("n").alias("copies"))
    return real.groupBy(*on).cogroup(other.groupBy(*names)).applyInPandas(_compare(k), _BLOCK)


def distances(pair: DataFrame, key: str | None, vector: str, k: int) -> DataFrame:
    """Per key and distinct real vector: its count ``n`` and ``best``, up to ``k`` ascending distances.

    With a key, only synthetic vectors of the same key count; real vectors without any get an empty list.
    """
    text = F.lit("") if key is None else F.col(key).cast("string")
    slim = pair.where(F.col(vector).isNotNull()) if key is None else pair.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    vectors = slim.select(text.alias("key"), F.col(vector).cast("array<double>").alias("vec"), SYNTH)
    counted = vectors.groupBy("key", "vec", SYNTH).agg(F.count(F.lit(1)).alias("n"))
    distinct = checkpointed(counted.withColumn("id", F.monotonically_increasing_id()))
    sizes, dims, odd = {}, 0, False
    for r in distinct.groupBy(SYNTH).agg(F.count("id").alias("rows"), F.max(F.size("vec")).alias("dims"), F.bool_or(~_finite("vec")).alias("odd")).collect():
        sizes[r[SYNTH]], dims, odd = r["rows"], max(dims, r["dims"]), odd or r["odd"]
    real = distinct.where(~F.col(SYNTH)).drop(SYNTH)
    synth = distinct.where(SYNTH).drop(SYNTH)
    conf = pair.sparkSession.conf
    cell_rows = int(conf.get(CELLS_CONF, str(CELL_ROWS)))
    least_rows = sizes.get(True, 0) // MAX_PIVOTS
    if sizes.get(True, 0) <= cell_rows and sizes.get(False, 0) <= BLOCK_REAL:
        found = _meet(real.drop("id"), synth.drop("id"), k, ["key"])
    elif 1 <= dims <= BOX_DIMS:
        box_rows = max(int(conf.get(CELLS_CONF, str(BOX_ROWS))), least_rows)
        if odd:
            finite = synth.where(_finite("vec"))
            enough = finite.groupBy("key").agg(F.sum(F.least("n", F.lit(k))).alias("c")).where(F.col("c") >= k).select("key")
            boxed = checkpointed(real.where(_finite("vec")).join(enough, "key", "left_semi"))
            rest = checkpointed(real.join(boxed.select("id"), "id", "left_anti"))
            # Few in real tables; whatever is not finite is bounded by the codes.
            found = _by_boxes(boxed, finite, k, box_rows, dims)
            found = found.unionByName(_by_codes(rest, synth, k, max(cell_rows, least_rows)))
        else:
            found = _by_boxes(real, synth, k, box_rows, dims)
    else:
        found = _by_codes(real, synth, k, max(cell_rows, least_rows))
    # Callers read the distances several times; the blocks must not be compared again for each.
    found = checkpointed(found)
    if key is None:
        return found.drop("key")
    return found.withColumn(key, F.col("key").cast(pair.schema[key].dataType)).drop("key") if key != "key" else found


class Cells:
    """Pivots per large key, with the radius, inner radius and ward of each cell."""

    def __init__(self, pivots: dict[str, np.ndarray], stats: dict[tuple[str, int], tuple[float, float, int]]):
        self.pivots = pivots
        self.outer, self.inner, self.ward = {}, {}, {}
        for key, points in pivots.items():
            rows = [stats.get((key, c), (-np.inf, np.inf, 0)) for c in range(len(points))]
            self.outer[key] = np.array([r[0] for r in rows])
            self.inner[key] = np.array([r[1] for r in rows])
            # Wards follow the distance from one pivot, so that cells of a ward are not strewn all over.
            order = np.argsort(_to_pivots(points, points[:1])[:, 0], kind="stable")
            sizes = np.array([r[2] for r in rows])[order]
            ward = np.empty(len(points), np.int64)
            ward[order] = (np.cumsum(sizes) - sizes) // WARD_ROWS
            self.ward[key] = ward


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Codes of vectors around their centres, their scales, and the lengths of what they leave out (infinite if not finite)."""
    with np.errstate(invalid="ignore", over="ignore"):
        rounding = 1e-15 * np.sqrt(np.square(vectors).sum(axis=1))
    if vectors.shape[1] < EXACT_DIMS:
        finite = np.isfinite(vectors).all(axis=1)
        return [v.tobytes() for v in np.where(finite[:, None], vectors, 0.0)], np.ones(len(vectors)), np.where(finite, rounding, np.inf)
    with np.errstate(invalid="ignore", over="ignore"):
        offsets = vectors - centres
        scales = np.abs(offsets).max(axis=1)
        fine = np.isfinite(scales) & (scales > 0)
        codes = np.rint(np.where(fine[:, None], offsets, 0.0) / np.where(fine, scales, 1.0)[:, None] * 127).astype(np.int8)
        rest = np.sqrt(np.square(offsets - codes * (np.where(fine, scales, 0.0) / 127)[:, None]).sum(axis=1))
    return [c.tobytes() for c in codes], np.where(fine, scales, 0.0), np.where(np.isfinite(rest), rest + rounding, np.inf)


def decode(codes: pd.Series, scales: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The points that codes stand for."""
    dims, body = centres.shape[1], b"".join(codes)
    if dims < EXACT_DIMS:
        return np.frombuffer(body, np.float64).reshape(len(codes), dims)
    return centres + np.frombuffer(body, np.int8).reshape(len(codes), dims) * (scales / 127)[:, None]


def bounds_between(x: np.ndarray, x_rest: np.ndarray, y: np.ndarray, y_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all vectors of two sides, from the points of their codes and their rests."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    between = np.sqrt(np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0))
    off = x_rest[:, None] + y_rest[None, :] + SLACK * np.sqrt(xx[:, None] + yy[None, :])
    return between - off, between + off


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    total = np.zeros((len(vectors), len(pivots)))
    for d in range(vectors.shape[1]):
        total += np.square(vectors[:, d, None] - pivots[None, :, d])
    return np.sqrt(total)


def _slices(batches: Iterator[pd.DataFrame], pivots: dict[str, np.ndarray]):
    """Rows of a batch by key, in pieces whose distance table to the pivots stays small."""
    for batch in batches:
        for key, rows in batch.groupby("key", sort=False):
            points = pivots.get(key)
            step = len(rows) if points is None else max(1, TABLE // len(points))
            for at in range(0, len(rows), step):
                yield key, rows.iloc[at : at + step], points


def _pick_pivots(synth: DataFrame, cell_rows: int) -> dict[str, np.ndarray]:
    """About one pivot per ``cell_rows`` vectors of every key larger than that: at most about MAX_PIVOTS."""
    large = synth.groupBy("key").count().where(F.col("count") > cell_rows).select("key")
    draw = F.pmod(F.xxhash64("vec"), F.lit(cell_rows)) == 0
    rows = synth.where(draw).join(large, "key", "left_semi").select("key", "vec").collect()
    grouped: dict[str, list] = {}
    for row in rows:
        grouped.setdefault(row["key"], []).append(row["vec"])
    return {key: np.array(points, dtype=np.float64) for key, points in grouped.items()}


_CANDIDATES = "id long, other long, upper double"


def _centres(pivots: dict[str, np.ndarray], keys: pd.Series, cells: pd.Series, dims: int) -> np.ndarray:
    """The pivot of each row's cell; the origin for keys without pivots."""
    out = np.zeros((len(keys), dims))
    for key in keys.unique():
        if key in pivots:
            mine = (keys == key).to_numpy()
            out[mine] = pivots[key][cells[mine].to_numpy()]
    return out


def _candidates(k: int, pivots, dims: int):
    """Of a block, the pairs that may be among the ``k`` nearest of a real vector."""

    def block(real: pd.DataFrame, synth: pd.DataFrame) -> pd.DataFrame:
        if real.empty or synth.empty:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "upper": np.zeros(0)})
        points = lambda side: decode(side["code"], side["scale"].to_numpy(), _centres(pivots.value, side["key"], side["cell"], dims))
        theirs, rest, names = points(synth), synth["rest"].to_numpy(), synth["id"].to_numpy()
        mine, own, known, ids = points(real), real["rest"].to_numpy(), real["bound"].to_numpy(), real["id"].to_numpy()
        step, out = max(1, TABLE // len(names)), []
        for a in range(0, len(ids), step):
            lower, upper = bounds_between(mine[a : a + step], own[a : a + step], theirs, rest)
            kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(names) >= k else np.full(len(upper), np.inf)
            row, col = np.nonzero(lower <= np.minimum(kth, known[a : a + step])[:, None])
            out.append((ids[a + row], names[col], upper[row, col]))
        return pd.DataFrame({name: np.concatenate(parts) for name, parts in zip(("id", "other", "upper"), zip(*out))}, copy=False)

    return block


_CODE = ["key", "cell", "id", "code", "scale", "rest"]


def _blocks(routed: DataFrame, placed: DataFrame, place: str, mine: list[str], theirs: list[str], block_real: int):
    """Real rows (columns ``mine``) and synthetic rows (``theirs``) of each cell or ward (column ``place``), in blocks of bounded size."""
    crowd = routed.groupBy("key", place).agg(F.ceil(F.count("id") / block_real).alias("crowd"))
    depth = placed.groupBy("key", place).agg(F.ceil(F.count("id") / BLOCK_SYNTH).alias("depth"))
    cuts = checkpointed(crowd.join(depth, ["key", place]))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    here = routed.join(cuts, ["key", place]).withColumn("rb", F.pmod(F.xxhash64("id"), F.col("crowd"))).withColumn("sb", spread("depth"))
    there = placed.join(cuts, ["key", place]).withColumn("sb", F.pmod(F.xxhash64("id"), F.col("depth"))).withColumn("rb", spread("crowd"))
    # Both sides stem from one table: without names of its own the second would share columns with the first.
    on = ["key", place, "rb", "sb"]
    there = there.select(*[F.col(c).alias(f"_{c}") for c in on], *[F.col(c).alias(c) for c in theirs])
    return here.select(F.struct(*on).alias("at"), *mine).groupBy("at").cogroup(there.select(F.struct(*[F.col(f"_{c}").alias(c) for c in on]).alias("_at"), *theirs).groupBy("_at"))


def _against(routed: DataFrame, placed: DataFrame, place: str, k: int, pivots, dims: int) -> DataFrame:
    """Candidates of real codes routed to a cell or ward (column ``place``), block by block."""
    return _blocks(routed, placed, place, [*_CODE, "bound"], _CODE, BLOCK_REAL).applyInPandas(_candidates(k, pivots, dims), _CANDIDATES)


def _kth_upper(found: DataFrame, k: int) -> DataFrame:
    """Per real vector, what its k-th neighbour is within; no row if fewer than ``k`` are known."""
    best = F.slice(F.array_sort(F.collect_list("upper")), 1, k)
    return found.groupBy("id").agg(best.alias("best")).where(F.size("best") >= k).select("id", F.element_at("best", k).alias("kth"))


def _exact(real: DataFrame, synth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Distances of the candidate pairs that no bound excludes; every real vector has a row."""
    squares = F.zip_with("vec", "svec", lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    pairs = found.select("id", "other").join(real.select("id", "vec"), "id").join(
        synth.select(F.col("id").alias("other"), F.col("vec").alias("svec"), F.least("n", F.lit(k)).cast("int").alias("copies")), "other"
    )
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.array_repeat("distance", F.col("copies"))))), 1, k)
    per = pairs.select("id", "copies", distance.alias("distance")).groupBy("id").agg(best.alias("best"))
    none = F.array().cast("array<double>")
    return real.join(per, "id", "left").select("key", "vec", "n", F.coalesce("best", none).alias("best"))


def _by_codes(real: DataFrame, synth: DataFrame, k: int, cell_rows: int) -> DataFrame:
    context = real.sparkSession.sparkContext
    pivots = context.broadcast(_pick_pivots(synth, cell_rows))
    dims = (real.select(F.size("vec")).first() or synth.select(F.size("vec")).first() or [1])[0]

    def assign(batches):
        for _, rows, points in _slices(batches, pivots.value):
            vectors = _matrix(rows["vec"])
            cell, dist, centres = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(vectors.shape)
            if points is not None:
                far = _to_pivots(vectors, points)
                cell = far.argmin(axis=1)
                dist = far[np.arange(len(rows)), cell]
                centres = points[cell]
            code, scale, rest = encode(vectors, centres)
            yield rows[["key", "id"]].assign(cell=cell, code=code, scale=scale, rest=rest, dist=dist)

    schema = "key string, id long, cell long, code binary, scale double, rest double, dist double"
    home = checkpointed(real.mapInPandas(assign, schema))
    placed = checkpointed(synth.mapInPandas(assign, schema))
    # One row per pivot of a large key, so the table is as bounded as the pivots; other keys have one cell.
    sizes = placed.groupBy("key", "cell").agg(F.max("dist").alias("u"), F.min("dist").alias("l"), F.count("cell").alias("c"))
    wanted = real.sparkSession.createDataFrame([(x,) for x in pivots.value], "key string")
    stats = {(r["key"], r["cell"]): (r["u"], r["l"], r["c"]) for r in sizes.join(F.broadcast(wanted), "key", "left_semi").collect()}
    cells = context.broadcast(Cells(pivots.value, stats))
    # The place of a visit; for real vectors the cell stays the one their code refers to.
    others = placed.select(*_CODE, F.col("cell").alias("place"))
    visits = home.select(*_CODE, F.col("cell").alias("place"), F.lit(float("inf")).alias("bound"))
    found = checkpointed(_against(visits, others, "place", k, pivots, dims))
    if pivots.value:
        large = real.join(F.broadcast(wanted), "key", "left_semi").select("key", "id", "vec")

        def promising(key: str, rows: pd.DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Least distance that each cell may hold, which cells are worth a visit, and the bound of each row."""
            far = _to_pivots(_matrix(rows["vec"]), points)
            # Pivots are synthetic vectors, so the k-th nearest pivot bounds the k-th neighbour as well.
            bound = np.sort(far, axis=1)[:, k - 1] if len(points) >= k else np.full(len(rows), np.inf)
            bound = np.fmin(bound, rows["kth"].fillna(np.inf).to_numpy())
            least = np.maximum(far - cells.value.outer[key], cells.value.inner[key] - far)
            # Rounding may lift a bound by a hair; the slack only adds visits.
            worth = ~(least > bound[:, None] * (1 + 1e-9) + 1e-12)
            worth[np.arange(len(rows)), far.argmin(axis=1)] = False
            return least, worth, bound

        def near(batches):
            for key, rows, points in _slices(batches, cells.value.pivots):
                least, worth, bound = promising(key, rows, points)
                order = np.argsort(np.where(worth, least, np.inf), axis=1, kind="stable")[:, :NEAR]
                at, slot = np.nonzero(np.take_along_axis(worth, order, axis=1))
                yield rows.iloc[at][["id"]].assign(place=order[at, slot], bound=bound[at])

        def rest(batches):
            for key, rows, points in _slices(batches, cells.value.pivots):
                _, worth, bound = promising(key, rows, points)
                for at, seen in enumerate(rows["seen"]):
                    if seen is not None:
                        worth[at, np.asarray(seen, np.int64)] = False
                at, cell = np.nonzero(worth)
                wards = int(cells.value.ward[key].max()) + 1
                at, place = np.divmod(np.unique(at * wards + cells.value.ward[key][cell]), wards)
                yield rows.iloc[at][["id"]].assign(place=place, bound=bound[at])

        trips = "id long, place long, bound double"
        body = home.select(*_CODE)
        first = large.join(_kth_upper(found, k), "id", "left").select("key", "id", "vec", "kth")
        routed = checkpointed(first.mapInPandas(near, trips))
        found = checkpointed(found.unionByName(_against(routed.join(body, "id"), others, "place", k, pivots, dims)))
        seen = routed.groupBy("id").agg(F.collect_list("place").alias("seen"))
        second = large.join(_kth_upper(found, k), "id", "left").join(seen, "id", "left").select("key", "id", "vec", "kth", "seen")
        routed = checkpointed(second.mapInPandas(rest, trips))
        names = [(key, c, int(w)) for key, ward in cells.value.ward.items() for c, w in enumerate(ward)]
        wards = real.sparkSession.createDataFrame(names, "key string, cell long, place long")
        by_ward = placed.select(*_CODE).join(F.broadcast(wards), ["key", "cell"])
        found = checkpointed(found.unionByName(_against(routed.join(body, "id"), by_ward, "place", k, pivots, dims)).dropDuplicates(["id", "other"]))
    return _exact(real, synth, found, k)


# ---- boxes -----------------------------------------------------------------------------------------


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        total += np.square(x[:, d, None] - y[None, :, d])
    return total


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box; never more than that computed to a vector inside."""
    total = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        out = np.maximum(low[None, :, d] - x[:, d, None], x[:, d, None] - high[None, :, d])
        total += np.square(np.maximum(out, 0, out=out), out=out)
    return total


def leaves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, cut at medians of the widest dimension, and where each leaf starts."""
    todo, done = [np.arange(len(y))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            done.append(rows)
            continue
        part = y[rows]
        half = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return np.concatenate(done), np.cumsum([0] + [len(rows) for rows in done[:-1]])


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """``smallest_distances`` of finite rows, by leaves instead of comparing all."""
    k = min(k, len(y))
    order, starts = leaves(y)
    y, ends = y[order], np.append(starts[1:], len(y))
    low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    out = np.empty((len(x), k))
    step = max(1, 2_000_000 // len(starts))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        least = _to_boxes(part, low, high)
        best = np.full((len(part), k), np.inf)

        def visit(rows: np.ndarray, leaf: int) -> None:
            for cut in range(0, len(rows), 8192):
                some = rows[cut : cut + 8192]
                both = np.concatenate([best[some], _squares(part[some], y[starts[leaf] : ends[leaf]])], axis=1)
                best[some] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)

        home = least.argmin(axis=1)
        by_home = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[by_home], np.arange(len(starts) + 1))
        for leaf in range(len(starts)):
            if edges[leaf] < edges[leaf + 1]:
                visit(by_home[edges[leaf] : edges[leaf + 1]], leaf)
        least[np.arange(len(part)), home] = np.inf
        far, near = np.nonzero((least < best[:, -1:]).T)
        edges = np.searchsorted(far, np.arange(len(starts) + 1))
        for leaf in range(len(starts)):
            rows = near[edges[leaf] : edges[leaf + 1]]
            rows = rows[least[rows, leaf] < best[rows, -1]]
            if len(rows):
                visit(rows, leaf)
        out[at : at + step] = np.sqrt(best)
    return out


class Boxes:
    """A tree of cuts through the space of one key, the region of each box, and what its synthetic vectors span."""

    def __init__(self, sample: np.ndarray):
        self.dim, self.cut, self.next, regions = [], [], [], []
        whole = np.full((2, sample.shape[1]), np.inf) * np.array([[-1], [1]])
        todo = [(sample, whole, None)]
        while todo:
            points, region, parent = todo.pop()
            node = len(self.dim)
            if parent is not None:
                self.next[parent[0]][parent[1]] = node
            wide = np.ptp(points, axis=0)
            d = int(wide.argmax())
            if len(points) < 2 * SAMPLES_PER_BOX or not wide[d] > 0:
                self.dim.append(-1)
                self.cut.append(0.0)
                self.next.append([len(regions)] * 2)
                regions.append(region)
                continue
            middle = np.partition(points[:, d], len(points) // 2)[len(points) // 2]
            if middle == points[:, d].max():
                middle = points[points[:, d] < middle, d].max()
            self.dim.append(d)
            self.cut.append(float(middle))
            self.next.append([0, 0])
            left, right = region.copy(), region.copy()
            left[1, d] = right[0, d] = middle
            todo += [(points[points[:, d] <= middle], left, (node, 0)), (points[points[:, d] > middle], right, (node, 1))]
        self.dim, self.cut, self.next = np.array(self.dim), np.array(self.cut), np.array(self.next)
        self.regions = np.array(regions)
        self.low = np.full((len(regions), sample.shape[1]), np.inf)
        self.high, self.copies = -self.low, np.zeros(len(regions), np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The box that each row falls into."""
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.dim[node] >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = self.next[at, (x[inner, self.dim[at]] > self.cut[at]).astype(int)]
            inner = inner[self.dim[node[inner]] >= 0]
        return self.next[node, 0]

    def visits(self, x: np.ndarray, home: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, box, distance`` of the boxes besides their own that may hold something closer than the k-th neighbour known."""
        inside = np.minimum(x - self.regions[home, 0], self.regions[home, 1] - x).min(axis=1)
        with np.errstate(over="ignore"):
            rows = np.flatnonzero(~(kth <= np.sqrt(np.square(inside))))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        held = np.flatnonzero(self.copies)
        step = max(1, TABLE // max(1, len(held)))
        for at in range(0, len(rows) if len(held) else 0, step):
            some = rows[at : at + step]
            least, limit, known = np.sqrt(_to_boxes(x[some], self.low[held], self.high[held])), kth[some].copy(), ~np.isnan(kth[some])
            if not known.all():
                # Too few neighbours at home: as many vectors as needed lie within the far corners of these boxes.
                corner = np.zeros((int((~known).sum()), len(held)))
                for d in range(x.shape[1]):
                    mine = x[some[~known], d, None]
                    corner += np.square(np.maximum(np.abs(mine - self.low[held][None, :, d]), np.abs(mine - self.high[held][None, :, d])))
                order = np.argsort(corner, axis=1)
                enough = np.cumsum(self.copies[held][order], axis=1) >= k
                last = np.take_along_axis(np.sqrt(corner), order, axis=1)
                limit[~known] = np.where(enough.any(axis=1), last[np.arange(len(last)), enough.argmax(axis=1)], np.inf)
            worth = (least < limit[:, None]) | (~known[:, None] & (least <= limit[:, None]))
            worth &= held[None, :] != home[some][:, None]
            row, box = np.nonzero(worth)
            found.append((some[row], held[box], least[row, box]))
        return tuple(np.concatenate(f) for f in zip(*found))


def _nearest_of_block(k: int, axes: list[str]):
    def block(real: pd.DataFrame, synth: pd.DataFrame) -> pd.DataFrame:
        if real.empty or synth.empty:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "best": []})
        theirs = np.repeat(synth[axes].to_numpy(np.float64), synth["copies"].to_numpy(), axis=0)
        return pd.DataFrame({"id": real["id"].to_numpy(), "best": list(nearest(real[axes].to_numpy(np.float64), theirs, k))})

    return block


def _by_boxes(real: DataFrame, synth: DataFrame, k: int, box_rows: int, dims: int) -> DataFrame:
    spark = real.sparkSession
    axes = [f"x{d}" for d in range(dims)]
    wide = [F.element_at("vec", d + 1).alias(a) for d, a in enumerate(axes)]
    large = synth.groupBy("key").count().where(F.col("count") > box_rows).select("key")
    draw = F.pmod(F.xxhash64("vec"), F.lit(max(1, box_rows // SAMPLES_PER_BOX))) == 0
    sample = synth.where(draw).join(large, "key", "left_semi").select("key", *wide).toPandas().sort_values(["key", *axes])
    trees = {key: Boxes(rows[axes].to_numpy(np.float64)) for key, rows in sample.groupby("key")}
    shared = spark.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = np.zeros(len(batch), np.int64)
            for key, at in batch.groupby("key", sort=False).indices.items():
                if key in shared.value:
                    place[at] = shared.value[key].place(batch[axes].to_numpy(np.float64)[at])
            yield batch.assign(place=place)

    typed = ", ".join(f"{a} double" for a in axes)
    home = checkpointed(real.select("key", "id", *wide).mapInPandas(assign, f"key string, id long, {typed}, place long"))
    copies = F.least("n", F.lit(k)).cast("int").alias("copies")
    others = checkpointed(synth.select("key", "id", copies, *wide).mapInPandas(assign, f"key string, id long, copies int, {typed}, place long"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")

    def meet(rows: DataFrame, *earlier: DataFrame) -> DataFrame:
        """Per real vector, the best of its blocks and of earlier rounds."""
        blocks = _blocks(rows, others, "place", ["id", *axes], ["copies", *axes], 4 * BLOCK_REAL)
        found = blocks.applyInPandas(_nearest_of_block(k, axes), "id long, best array<double>")
        return reduce(DataFrame.unionByName, earlier, found).groupBy("id").agg(best)

    found = checkpointed(meet(home))
    if trees:
        wanted = F.broadcast(spark.createDataFrame([(x,) for x in trees], "key string"))
        spans = others.join(wanted, "key", "left_semi").groupBy("key", "place").agg(
            F.sum("copies").alias("copies"), F.array(*[F.min(a) for a in axes]).alias("low"), F.array(*[F.max(a) for a in axes]).alias("high")
        )
        for r in spans.collect():
            tree = trees[r["key"]]
            tree.low[r["place"]], tree.high[r["place"]], tree.copies[r["place"]] = r["low"], r["high"], r["copies"]
        known = spark.sparkContext.broadcast(trees)

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, rows in batch.groupby("key", sort=False):
                    row, box, least = known.value[key].visits(rows[axes].to_numpy(np.float64), rows["place"].to_numpy(), rows["kth"].to_numpy(np.float64), k)
                    order = np.lexsort((least, row))
                    row, box, least = row[order], box[order], least[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    yield rows.iloc[row][["key", "id", *axes]].assign(place=box, least=least, late=rank >= NEAR)

        first = found.select("id", F.try_element_at("best", F.lit(k)).alias("kth"))
        asked = home.join(wanted, "key", "left_semi").join(first, "id", "left")
        trips = checkpointed(asked.mapInPandas(visits, f"key string, id long, {typed}, place long, least double, late boolean"))
        more = checkpointed(meet(trips.where(~F.col("late")), found))
        late = trips.where("late").join(more.select("id", F.try_element_at("best", F.lit(k)).alias("kth")), "id", "left")
        late = checkpointed(late.where(F.col("kth").isNull() | (F.col("least") < F.col("kth"))))
        found = more if late.isEmpty() else meet(late, more)
    none = F.array().cast("array<double>")
    return real.join(found, "id", "left").select("key", "vec", "n", F.coalesce("best", none).alias("best"))
