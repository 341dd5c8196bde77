"""Nearest neighbours without comparing all pairs: exact by rings, or approximate by hash tables.

Equal vectors are collapsed first, so copies cost one search. For the exact
answer candidates are cut into rings around a bounded set of pivots. The
triangle inequality bounds how near a ring can be, so a search visits its rings
in the order of these bounds, a few more in each round, and leaves once its k-th
neighbour so far is nearer than any ring that is left. What two rounds leave open
meets runs of rings, eight chunks wide, in a last one, so that a table without
structure costs few visits. ``method="lsh"`` looks into
the buckets of p-stable hash tables instead. Rings and buckets are split into
chunks, and the searches of a chunk into packs, so no task sees more than a
fixed number of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.order import ranked_values
from sondage.operators.scale import feature_array
from sondage.operators.schema import ref
from sondage.session import BLOCK_ROWS, Rounds, cut_lineage, task_slots

MAX_PIVOTS = 512
MAX_RINGS = 64
# Searches that meet a chunk at a time: a chunk's rows are sent once for each pack.
PACK_ROWS = 16_384
# Rings that a search visits in its first round, and how many times as many it has visited after the second one.
FIRST_RINGS, MORE_RINGS = 2, 4
# Blocks of rows that neighbouring rings make up for the last round, and packs of rows that a pack of searches meets one after the other.
WIDE = 8
RUN_BLOCKS = 8
# Visits that a task hands over at a time, and distances that it holds at a time.
VISIT_ROWS, CELLS = 8_192, 8_000_000
# Ring tables up to this many rows go to every task; larger ones are met by a shuffle.
SMALL_TABLE = 100_000


@dataclass
class _Rings:
    """Pivots, and per ring: group, cell, nearest and farthest pivot distance, rows, chunks, its run of rings; chunks per run."""

    pivots: np.ndarray
    group: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    chunks: np.ndarray
    wide: np.ndarray
    wide_chunks: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed one dimension at a time so equal inputs give equal bits."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _assign(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                far = _distances(_matrix(batch["x"]), pivots)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), pd=far[np.arange(len(batch)), cell])

    return run


def _usable(rings: _Rings, g: np.ndarray, relation: str) -> np.ndarray:
    if relation == "same":
        return rings.group[None, :] == g[:, None]
    if relation == "other":
        return rings.group[None, :] != g[:, None]
    return np.ones((len(g), len(rings.group)), dtype=bool)


def _visits(rings: _Rings, relation: str, start: int, stop: int | None):
    """The chunks that each search visits in one round: those of its rings from place ``start`` to ``stop``; without
    ``stop`` the chunks of all runs of rings that hold one from ``start`` on.

    A search's rings stand in the order of the least distance they allow, then of the pivot's distance, which does
    not depend on what it has found, so the rounds divide them. Rings beyond the bound ``ub`` are left out.
    """
    step = max(1, int(4_000_000 // max(1, len(rings.group))))
    runs = np.flatnonzero(np.diff(rings.wide, prepend=-1))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at:at + step]
                far = _distances(_matrix(batch["x"]), rings.pivots)[:, rings.cell]
                near = np.maximum(np.maximum(far - rings.high, rings.low - far), 0.0)
                near[~_usable(rings, batch["g"].to_numpy(), relation)] = np.inf
                order = np.lexsort((far, near), axis=1)
                # a hair of slack keeps rounding from cutting off a tie
                bound = batch["ub"].to_numpy(dtype=float)[:, None] * (1 + 1e-9) + 1e-9
                if stop is None:
                    np.put_along_axis(near, order[:, :start], np.inf, 1)
                    who, block = np.nonzero(np.logical_or.reduceat((near <= bound) & (near < np.inf), runs, axis=1))
                    times = rings.wide_chunks[block]
                else:
                    order = order[:, start:stop]
                    reach = np.take_along_axis(near, order, 1)
                    who, place = np.nonzero((reach <= bound) & (reach < np.inf))
                    block = order[who, place]
                    times = rings.chunks[block]
                who, block = np.repeat(who, times), np.repeat(block, times)
                ends = np.cumsum(times)
                chunk = np.arange(len(block)) - np.repeat(ends - times, times)
                block = block.astype("int64") * (1 << 24) + chunk
                key, x, ub = batch["key"].to_numpy(), batch["x"].to_numpy(), batch["ub"].to_numpy(dtype=float)
                # vectors are repeated for a few visits at a time
                for some in range(0, len(who), VISIT_ROWS):
                    w = who[some:some + VISIT_ROWS]
                    yield pd.DataFrame({"key": key[w], "x": x[w], "ub": ub[w], "block": block[some:some + VISIT_ROWS]})

    return run


def _closest(asked: np.ndarray, points: np.ndarray, ub: np.ndarray, need: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, point, distance) of the ``need`` points nearest to each search that are within its bound, ties by place.
    With a ``mask`` only its pairs count.

    Products of matrices tell the few pairs that can count, with room for their rounding; only those get their distance.
    Short floats are tried first; where their rounding leaves many pairs open, long ones decide.
    """
    middle = points.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    a, b = asked - middle, points - middle
    own, theirs = (a * a).sum(axis=1), (b * b).sum(axis=1)
    most = max((float(v[np.isfinite(v)].max(initial=0.0)) for v in (own, theirs))) or 1.0
    scale = np.sqrt(most)
    # the square of a distance, less the search's own part
    left = np.concatenate((a * (-2.0 / scale), np.ones((len(a), 1))), axis=1)
    right = np.concatenate((b / scale, theirs[:, None] / most), axis=1)
    for kind in (np.float32, np.float64):
        rough = left.astype(kind) @ right.astype(kind).T
        if mask is not None:
            rough[~mask] = np.inf
        room = 4 * np.finfo(kind).eps * (a.shape[1] + 8) * (own / most + 1.0)
        limit = (ub * ub * (1 + 1e-9) - own) / most + room
        open_ = np.flatnonzero(~np.isfinite(ub))
        if len(open_):
            limit[open_] = np.partition(rough[open_], need - 1, axis=1)[:, need - 1] + 2 * room[open_]
        # what is not a number is not left out
        where = ~(rough > limit.astype(kind)[:, None])
        if mask is not None:
            where &= mask
        if kind is np.float64 or np.count_nonzero(where) <= 2 * need * len(a) + where.size // 50:
            break
    return _first(*np.nonzero(where), asked, points, need)


def _first(i: np.ndarray, j: np.ndarray, asked: np.ndarray, points: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a search and a point the ``need`` nearest of each search, ties by place, with their distances."""
    far = np.zeros(len(i))
    for k in range(asked.shape[1]):
        far += (asked[i, k] - points[j, k]) ** 2
    far = np.sqrt(far)
    by = np.lexsort((j, far, i))
    i, j, far = i[by], j[by], far[by]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < need
    return i[kept], j[kept], far[kept]


def _nearest(need: int):
    def run(searches: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(searches) or not len(rows):
            return pd.DataFrame({"key": [], "nbr": [], "dist": []})
        # rows are in id order, so ties break by id
        ids = rows["id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, points = ids[by_id], _matrix(rows["x"])[by_id]
        asked, ub, key = _matrix(searches["x"]), searches["ub"].to_numpy(dtype=float), searches["key"].to_numpy()
        take, step, found = min(need, len(ids)), max(1, CELLS // len(ids)), []
        for at in range(0, len(key), step):
            i, j, far = _closest(asked[at:at + step], points, ub[at:at + step], take)
            found.append(pd.DataFrame({"key": key[at + i], "nbr": ids[j], "dist": far}))
        return pd.concat(found)

    return run


def _packed(names: tuple[str, ...], size: int):
    """Rows as packs of arrays, at most ``size`` rows each."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while len(batch):
                some, batch = batch.iloc[:size - n], batch.iloc[size - n:]
                held.append(some)
                n += len(some)
                if n == size:
                    yield _pack(held, names)
                    held, n = [], 0
        if n:
            yield _pack(held, names)

    return run


def _pack(held: list[pd.DataFrame], names: tuple[str, ...]) -> pd.DataFrame:
    rows = pd.concat(held)
    return pd.DataFrame({"pack": [pickle.dumps([_matrix(rows[c]) if c == "x" else rows[c].to_numpy() for c in names])]})


def _meet(searches: DataFrame, n: int, rows: DataFrame, judge: Callable, need: int) -> DataFrame:
    """(key, nbr, dist): every pack of ``searches`` (key, g, x, ub) meets every block of ``rows`` (id, g, x, block), and the nearest rows of
    each run of blocks stay. Packs and blocks are brought together by task, so no vector is written for a meeting.

    ``judge(pack, block)`` gives (search, place, distance), from which a pack's bounds are drawn closer as its blocks go by.
    """
    spark = searches.sparkSession
    size = min(PACK_ROWS, max(BLOCK_ROWS, -(-n // (3 * task_slots(spark)))))
    asked = searches.select("key", "g", "x", "ub").mapInPandas(_packed(("key", "g", "x", "ub"), size), "pack binary")
    # a block is a pack of neighbouring rows; a run of them is one part
    count = rows.count()
    runs = max(1, -(-count // (RUN_BLOCKS * PACK_ROWS)))
    met = rows.repartitionByRange(runs, "block", "id").sortWithinPartitions("block", "id") if runs > 1 else rows.coalesce(1).sortWithinPartitions("block", "id")
    met = met.select("id", "g", "x", "block").mapInPandas(_packed(("id", "g", "x", "block"), PACK_ROWS), "pack binary")
    left = cut_lineage(asked).rdd.map(lambda r: bytes(r[0]))
    right = cut_lineage(met).rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def best(pack, found):
        i, nbr, far = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
        by = np.lexsort((nbr, far, i))
        i, nbr, far = i[by], nbr[by], far[by]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < need
        return i[kept], nbr[kept], far[kept]

    def run(pairs):
        last, pack, found = None, None, []
        for sent, block in pairs:
            if sent != last:
                if pack is not None:
                    yield told(pack, found)
                last, pack, found = sent, [*pickle.loads(sent), {}], []
            ids, g, x, at = pickle.loads(block)
            # rows stand in id order, so ties break by id
            by_id = np.argsort(ids, kind="stable")
            ids, g, x, at = ids[by_id], g[by_id], x[by_id], at[by_id]
            i, j, far = judge(pack, (ids, g, x, at))
            if len(i):
                found = [best(pack, [*found, (i, ids[j], far)])]
                i, _, far = found[0]
                full = np.flatnonzero(np.bincount(i, minlength=len(pack[0])) == need)
                pack[3] = pack[3].astype(float)
                pack[3][full] = np.minimum(pack[3][full], far[np.searchsorted(i, full, side="right") - 1])
        if pack is not None:
            yield told(pack, found)

    def told(pack, found):
        i, nbr, far = found[0] if found else best(pack, [])
        return (pickle.dumps((pack[0][i], nbr, far)),)

    def opened(batches):
        for batch in batches:
            for data in batch["found"]:
                key, nbr, far = pickle.loads(data)
                if len(key):
                    yield pd.DataFrame({"key": key, "nbr": nbr, "dist": far})

    found = spark.createDataFrame(left.cartesian(right).mapPartitions(run), "found binary").mapInPandas(opened, "key string, nbr long, dist double")
    found = cut_lineage(found)
    right.unpersist()
    return found


def _open_visits(rings: _Rings, relation: str, start: int):
    """Searches that have a ring within their bound from place ``start`` on, and the runs of rings to look into, as places of ``runs``."""
    runs = np.flatnonzero(np.diff(rings.wide, prepend=-1))

    def run(g: np.ndarray, x: np.ndarray, ub: np.ndarray) -> np.ndarray:
        """A truth for each search and run."""
        out = np.zeros((len(x), len(runs)), dtype=bool)
        step = max(1, int(4_000_000 // max(1, len(rings.group))))
        for at in range(0, len(x), step):
            some = slice(at, at + step)
            far = _distances(x[some], rings.pivots)[:, rings.cell]
            near = np.maximum(np.maximum(far - rings.high, rings.low - far), 0.0)
            near[~_usable(rings, g[some], relation)] = np.inf
            order = np.lexsort((far, near), axis=1)
            np.put_along_axis(near, order[:, :start], np.inf, 1)
            bound = ub[some].astype(float)[:, None] * (1 + 1e-9) + 1e-9
            out[some] = np.logical_or.reduceat((near <= bound) & (near < np.inf), runs, axis=1)
        return out

    return run


def _last_round(rings: _Rings, relation: str, start: int, searches: DataFrame, rows: DataFrame, need: int) -> DataFrame:
    """(key, nbr, dist) of what the first rounds leave open: packs of searches meet blocks of runs of rings, no pair of which is skipped but by the bounds."""
    wanted = _open_visits(rings, relation, start)

    def still(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch["x"])
                left = wanted(batch["g"].to_numpy(), x, batch["ub"].to_numpy(dtype=float)).any(axis=1)
                cell = np.concatenate([_distances(x[at:at + BLOCK_ROWS], rings.pivots).argmin(axis=1) for at in range(0, len(x), BLOCK_ROWS)])
                yield batch.assign(cell=cell.astype("int32"))[left]

    left = cut_lineage(searches.select("key", "g", "x", "ub").mapInPandas(still, "key string, g int, x array<double>, ub double, cell int"))
    n = left.count()
    # neighbouring searches look into the same runs
    parts = max(1, min(-(-n // BLOCK_ROWS), max(-(-n // PACK_ROWS), 3 * task_slots(searches.sparkSession))))
    left = left.repartitionByRange(parts, "cell", "key")

    def judge(pack, block):
        key, g, x, ub, held = pack
        if "runs" not in held:
            held["runs"] = wanted(g, x, ub.astype(float))
        ids, bg, points, at = block
        found = []
        for r in np.unique(at >> 24):
            mine = np.flatnonzero((at >> 24) == r)
            who = np.flatnonzero(held["runs"][:, r])
            if not len(who):
                continue
            near, bound, take = points[mine], ub.astype(float), min(need, len(mine))
            step = max(1, CELLS // len(mine))
            for a in range(0, len(who), step):
                w = who[a:a + step]
                i, j, far = _closest(x[w], near, bound[w], take)
                found.append((w[i], mine[j], far))
        return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, dtype=int),) * 3

    return _meet(left, n, rows, judge, need)


def _search(visits: DataFrame, rows: DataFrame, need: int) -> DataFrame:
    """Nearest rows of every visited chunk: (key, nbr, dist). Visits may bring the bound ``ub`` of what can count."""
    if "ub" not in visits.columns:
        visits = visits.withColumn("ub", F.lit(float("inf")))
    packs = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(PACK_ROWS)).cast("int").alias("packs"))
    left = visits.join(packs, "block").withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int")).drop("packs")
    right = rows.join(packs, "block").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - F.lit(1)))).drop("packs")
    return left.groupBy("block", "pack").cogroup(right.select("block", "pack", "id", "x").groupBy("block", "pack")).applyInPandas(
        _nearest(need), "key string, nbr long, dist double"
    )


def _keyed(df: DataFrame, columns: list[str] | Column, row_id: str, group: str | None) -> DataFrame:
    x = feature_array(columns) if isinstance(columns, list) else columns
    # 0.0 is added so that both zeros give one key
    x = F.transform(x, lambda v: v.cast("double") + F.lit(0.0))
    g = F.lit(0) if group is None else ref(group).cast("int")
    kept = df.select(ref(row_id).cast("long").alias("id"), g.alias("g"), x.alias("x"))
    text = F.concat_ws(",", F.transform("x", lambda v: v.cast("string")), F.col("g").cast("string"))
    return kept.withColumn("key", F.md5(text))


def _small(table: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it has few rows; many groups make it large, and then it is joined by its keys."""
    return F.broadcast(table) if table.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else table


def _build_rings(reps: DataFrame, n: int) -> tuple[_Rings, DataFrame]:
    pivots = reps.select("key", "x").distinct().orderBy(F.xxhash64("key"), "key").limit(min(MAX_PIVOTS, -(-n // BLOCK_ROWS))).collect()
    pivots = np.array([r["x"] for r in pivots], dtype=float)
    placed = reps.select("id", "g", "x").mapInPandas(_assign(pivots), "id long, g int, x array<double>, cell int, pd double").persist()
    cells = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("pd").alias("far"))
    cells = cells.withColumn("rings", F.least(F.lit(MAX_RINGS), F.ceil(F.col("n") / F.lit(BLOCK_ROWS))).cast("int")).drop("n")
    ring = F.least(F.floor(F.col("pd") / F.greatest(F.col("far"), F.lit(1e-300)) * F.col("rings")), F.col("rings") - 1).cast("int")
    ringed = placed.join(_small(cells), ["g", "cell"]).withColumn("ring", ring).drop("far", "rings")
    stats = ringed.groupBy("g", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("pd").alias("lo"), F.max("pd").alias("hi"))
    table = stats.orderBy("g", "cell", "ring").toPandas()
    chunks = np.maximum(1, np.ceil(table["n"].to_numpy() / BLOCK_ROWS)).astype(int)
    wide = _runs(table["g"].to_numpy(), table["n"].to_numpy(), WIDE * BLOCK_ROWS)
    wide_chunks = np.ceil(np.bincount(wide, table["n"].to_numpy()) / (WIDE * BLOCK_ROWS)).astype(int)
    index = reps.sparkSession.createDataFrame(
        pd.DataFrame({"g": table["g"], "cell": table["cell"], "ring": table["ring"], "at": np.arange(len(table)), "chunks": chunks, "wide": wide, "wide_chunks": wide_chunks[wide]}),
        "g int, cell int, ring int, at long, chunks int, wide long, wide_chunks int",
    )

    def block(at: str, chunks: str) -> Column:
        return F.col(at) * F.lit(1 << 24) + F.pmod(F.xxhash64("id"), F.col(chunks))

    rows = ringed.join(_small(index), ["g", "cell", "ring"]).select("id", "g", "x", block("at", "chunks").alias("block"), block("wide", "wide_chunks").alias("wide"))
    rings = _Rings(pivots, table["g"].to_numpy(), table["cell"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy(), table["n"].to_numpy(), chunks, wide, wide_chunks)
    return rings, rows


def _runs(group: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The number of each ring's run: neighbouring rings of one group with ``most`` rows at most, or a larger ring alone."""
    out, held = np.zeros(len(rows), dtype=np.int64), 0
    for i in range(len(rows)):
        new = i > 0 and (group[i] != group[i - 1] or held + rows[i] > most)
        held = rows[i] if new else held + rows[i]
        out[i] = out[i - 1] + new if i else 0
    return out


def _ranked(found: DataFrame, need: int) -> DataFrame:
    """(key, nbr, dist, r): the nearest ``need`` different rows of every search, ties by id."""
    order = Window.partitionBy("key").orderBy("dist", "nbr")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= need)


def _by_rings(searches: DataFrame, reps: DataFrame, n: int, need: int, relation: str) -> DataFrame:
    """Exact (key, nbr, dist): rounds over the rings, nearest bounds first, each with the bounds that the last one left."""
    rings, rows = _build_rings(reps, n)
    rows = cut_lineage(rows)
    visit = "key string, x array<double>, ub double, block long"
    open_ = searches.withColumn("ub", F.lit(float("inf")))
    found, rounds = None, Rounds(reps.sparkSession)
    for start, stop in ((0, FIRST_RINGS), (FIRST_RINGS, FIRST_RINGS * MORE_RINGS), (FIRST_RINGS * MORE_RINGS, None)):
        if start >= len(rings.group):
            break
        if stop is None:
            got = _last_round(rings, relation, start, open_, rows.select("id", "g", "x", F.col("wide").alias("block")), need)
            # a run may hold rings that a search has seen
            order = Window.partitionBy("key").orderBy("dist", "nbr")
            return found.unionByName(got).withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= need).select("key", "nbr", "dist").distinct()
        got = _search(open_.mapInPandas(_visits(rings, relation, start, stop), visit), rows.select("id", "x", "block"), need)
        both = got if found is None else found.unionByName(got)
        found = _ranked(both, need).select("key", "nbr", "dist")
        if stop < len(rings.group):
            with rounds.round():
                found = rounds.hand_on(found)
            bound = found.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max("dist").alias("far")).filter(F.col("held") == need).select("key", F.col("far").alias("ub"))
            open_ = searches.join(bound, "key", "left").withColumn("ub", F.coalesce("ub", F.lit(float("inf"))))
    return found


def knn_join(queries: DataFrame, base: DataFrame, columns: list[str] | Column, k: int, row_id: str = "respondent_id", group: str | None = None,
             relation: str = "any", exclude_self: bool = False, method: str = "exact", lsh: Lsh | None = None) -> DataFrame:
    """(row id, nbr_id, dist, rank): the k nearest base rows of every query row, ties by id.

    ``relation`` with ``group`` restricts neighbours to the ``same`` or to
    ``other`` groups. A row with fewer candidates gets fewer neighbours.
    ``method="lsh"`` finds most of them with bounded work, by the hash tables of
    ``lsh``; what it finds has exact distances.
    """
    need = k + 1 if exclude_self else k
    group = None if relation == "any" else group
    asked, given = _keyed(queries, columns, row_id, group), _keyed(base, columns, row_id, group)
    # of equal vectors only the first ids can be neighbours; the limit applies before the shuffle
    copies = Window.partitionBy("key").orderBy("id")
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method}")
    answer = f"{row_id} long, nbr_id long, dist double, rank int"
    rounds = Rounds(queries.sparkSession)
    # the tables of a search are larger than its answer, and go with its end
    with rounds.round():
        reps = cut_lineage(given.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= need).drop("copy"))
        n = reps.count()
        if n == 0:
            return queries.sparkSession.createDataFrame([], answer)
        searches = asked.dropDuplicates(["key"]).select("key", "g", "x")
        found = _by_rings(searches, reps, n, need, relation) if method == "exact" else _by_tables(searches, reps, need, relation, lsh or Lsh())
        lists = rounds.hand_on(_ranked(found, need).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "nbr", "dist"))).alias("near")))
    joined = asked.select("id", "key").join(lists, "key")
    near = F.filter("near", lambda v: v["nbr"] != F.col("id")) if exclude_self else F.col("near")
    flat = joined.select("id", F.posexplode(F.slice(near, 1, k)).alias("pos", "v"))
    return flat.select(F.col("id").alias(row_id), F.col("v.nbr").alias("nbr_id"), F.col("v.dist").alias("dist"), (F.col("pos") + F.lit(1)).alias("rank"))


@dataclass
class Lsh:
    """Hash tables of the approximate search.

    A hash is the cell of width ``width`` that a random projection falls in; a bucket is a run of ``hashes`` such cells. A
    search looks into its own bucket of each of ``tables`` tables and into those of the ``probes`` - 1 neighbouring cells
    that are nearest to it. Without a width it is ``scale`` times the median distance to the k-th neighbour within
    ``sample`` rows, which are taken by their hashes: a bounded sample, all rows are indexed. A bucket of more than
    ``crowd`` rows is divided once by as many further hashes; what is still larger is looked into chunk by chunk.
    """

    tables: int = 12
    hashes: int = 4
    probes: int = 16
    width: float | None = None
    scale: float = 1.0
    sample: int = 2_000
    crowd: int = 16_384
    seed: int = 42


class _Tables:
    """The projections, drawn from the seed alone, so every task has the same."""

    def __init__(self, lsh: Lsh, dims: int, width: float):
        rng = np.random.default_rng(lsh.seed)
        self.lsh, self.width = lsh, width
        self.planes = rng.normal(size=(lsh.tables * 2 * lsh.hashes, dims))
        self.shift = rng.uniform(size=lsh.tables * 2 * lsh.hashes)
        self.odd = rng.integers(0, 2**62, size=2 * lsh.hashes + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        # steps to neighbouring cells: none, one hash by one, two hashes by one each
        h, steps = lsh.hashes, [np.zeros(lsh.hashes, dtype=np.int64)]
        for i in range(h):
            for a in (-1, 1):
                one = np.zeros(h, dtype=np.int64)
                one[i] = a
                steps.append(one)
                for j in range(i):
                    for c in (-1, 1):
                        two = one.copy()
                        two[j] = c
                        steps.append(two)
        self.steps = np.array(steps)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells per (row, table, hash) and how far into the cell, from 0 to 1."""
        at = (x @ self.planes.T / self.width + self.shift).reshape(len(x), self.lsh.tables, -1)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def names(self, cells: np.ndarray, table: np.ndarray, first: int = 0) -> np.ndarray:
        """One number for a run of cells of a table; two runs with one number only add candidates."""
        out = (table.astype(np.uint64) + np.uint64(1)) * self.odd[-1]
        for k in range(cells.shape[-1]):
            out = (out ^ (out >> np.uint64(31)) ^ cells[..., k].astype(np.uint64)) * self.odd[first + k]
        return (out ^ (out >> np.uint64(29))).view(np.int64)

    def rows(self, batches):
        """(id, g, coarse, fine) of every row and table."""
        tables = np.arange(self.lsh.tables)
        for b in batches:
            if len(b):
                coarse, fine = self.held(b["g"].to_numpy(), _matrix(b["x"]))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), len(tables)), "coarse": coarse.ravel(), "fine": fine.ravel()})

    def held(self, g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coarse and fine bucket of every row and table."""
        h, cells = self.lsh.hashes, self.places(x)[0]
        coarse = self.names(cells[..., :h], np.arange(self.lsh.tables)[None, :] + 1000 * g[:, None])
        return coarse, self.names(cells[..., h:], coarse, h)

    def looks(self, g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coarse and fine bucket of every search, table and probe."""
        h, tables, probes = self.lsh.hashes, np.arange(self.lsh.tables), min(self.lsh.probes, len(self.steps))
        cells, part = self.places(x)
        # the squared way to the cells of each step, summed over its hashes
        way = np.where(self.steps[None, None] < 0, part[:, :, None, :h], np.where(self.steps[None, None] > 0, 1 - part[:, :, None, :h], 0.0))
        pick = np.argsort((way**2).sum(-1), axis=2, kind="stable")[..., :probes]
        near = cells[:, :, None, :h] + self.steps[pick]
        coarse = self.names(near, (tables[None, :] + 1000 * g[:, None])[..., None])
        return coarse, self.names(cells[:, :, None, h:], coarse, h)


def _width(reps: DataFrame, need: int, lsh: Lsh) -> float:
    """``scale`` times the median distance to the last neighbour that is asked for, within the sample."""
    some = np.array([r["x"] for r in reps.select("key", "x").orderBy(F.xxhash64("key"), "key").limit(lsh.sample).collect()], dtype=float)
    last = []
    for at in range(0, len(some), 256):
        far = np.sort(_distances(some[at:at + 256], some), axis=1)
        last.append(far[:, min(max(need - 1, 1), len(some) - 1)])
    return lsh.scale * float(np.median(np.concatenate(last))) or 1.0


def _by_tables(searches: DataFrame, reps: DataFrame, need: int, relation: str, lsh: Lsh) -> DataFrame:
    """Approximate (key, nbr, dist): of the rows that share a bucket or a neighbouring one with a search, the nearest."""
    if relation == "other":
        raise ValueError("hash tables hold the rows of a group together: ask for any or for the same group")
    tables = _Tables(lsh, len(reps.first()["x"]), lsh.width or _width(reps, need, lsh))
    # only the sizes of buckets are counted over all rows
    sizes = reps.select("id", "g", "x").mapInPandas(tables.rows, "id long, coarse long, fine long").groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))
    crowded = np.sort(np.array([r["coarse"] for r in sizes.filter(F.col("n") > tables.lsh.crowd).select("coarse").collect()], dtype=np.int64))

    def buckets(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
        return np.where(np.isin(coarse, crowded), fine, coarse) if len(crowded) else coarse

    def judge(pack, block):
        key, g, x, ub, held = pack
        if "looks" not in held:
            parts = [buckets(*tables.looks(g[at:at + BLOCK_ROWS], x[at:at + BLOCK_ROWS])) for at in range(0, len(x), BLOCK_ROWS)]
            held["looks"] = np.concatenate(parts)
        ids, bg, points, _ = block
        names = buckets(*tables.held(bg, points))
        order = np.argsort(names, axis=0, kind="stable")
        ordered = np.take_along_axis(names, order, 0)
        looks, found, take = held["looks"], [], min(need, len(ids))
        step = max(1, CELLS // len(ids))
        for at in range(0, len(x), step):
            w = slice(at, at + step)
            mask = np.zeros((len(x[w]), len(ids)), dtype=bool)
            for t in range(names.shape[1]):
                asked = looks[w, t].ravel()
                low, high = (np.searchsorted(ordered[:, t], asked, side=side) for side in ("left", "right"))
                n = high - low
                ends = np.cumsum(n)
                mask[np.repeat(np.arange(len(n)) // looks.shape[2], n), order[np.repeat(low - ends + n, n) + np.arange(int(n.sum())), t]] = True
            # few pairs get their distance at once, many are first thinned by a product
            some = np.count_nonzero(mask) * 50 < mask.size
            i, j, far = _first(*np.nonzero(mask), x[w], points, take) if some else _closest(x[w], points, ub[w].astype(float), take, mask)
            found.append((i + at, j, far))
        return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, dtype=int),) * 3

    return _meet(cut_lineage(searches.withColumn("ub", F.lit(float("inf")))), searches.count(), reps.withColumn("block", F.lit(0).cast("long")), judge, need)


def recall(found: DataFrame, exact: DataFrame, row_id: str = "respondent_id") -> DataFrame:
    """(rows, neighbours, recall): the part of the exact neighbours, by distance, that another answer holds.

    A neighbour counts when it is no farther than the exact one of the last rank, so ties are no misses.
    """
    last = exact.groupBy(ref(row_id)).agg(F.max("dist").alias("__far"), F.count(F.lit(1)).alias("__n"))
    hits = found.join(last, row_id).groupBy(ref(row_id)).agg(F.count_if(F.col("dist") <= F.col("__far") * (1 + 1e-12)).alias("__hit"))
    both = last.join(hits, row_id, "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum("__n").alias("neighbours"), (F.sum(F.coalesce(F.least("__hit", "__n"), F.lit(0))) / F.sum("__n")).alias("recall"))


def knn(df: DataFrame, columns: list[str] | Column, k: int, row_id: str = "respondent_id", group: str | None = None, relation: str = "any",
        include_self: bool = False, method: str = "exact", lsh: Lsh | None = None) -> DataFrame:
    """The k nearest rows of every row of one table."""
    return knn_join(df, df, columns, k, row_id, group, relation, exclude_self=not include_self, method=method, lsh=lsh)


def vote(neighbours: DataFrame, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """(row id, predicted): most frequent label of the neighbours; the smallest of several."""
    tagged = neighbours.join(labels.select(ref(row_id).alias("nbr_id"), ref(label).alias("__l")), "nbr_id")
    counts = tagged.groupBy(ref(row_id), "__l").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(ref(row_id)).agg(F.min_by("__l", F.struct(-F.col("__n"), F.col("__l"))).alias("predicted"))


def knn_predict(queries: DataFrame, base: DataFrame, columns: list[str], label: str, k: int = 5, row_id: str = "respondent_id") -> DataFrame:
    """(row id, predicted) by the labels of the k nearest base rows."""
    return vote(knn_join(queries, base, columns, k, row_id), base, row_id, label)


def avg_knn_distance(df: DataFrame, columns: list[str], row_id: str = "respondent_id", k: int = 5) -> float | None:
    """Mean distance to the k nearest rows, the row itself included at distance 0."""
    n = df.count()
    size = min(k, n - 1)
    if size < 1:
        return None
    # the row itself is one of the neighbours, at 0; k-1 others remain
    if size == 1:
        return 0.0
    others = knn(df, columns, size - 1, row_id)
    return others.agg((F.sum("dist") / F.lit(float(size * n))).alias("d")).first()[0]


def tomek_links(df: DataFrame, columns: list[str] | Column, label: str, row_id: str = "respondent_id") -> DataFrame:
    """Ids of rows that are mutual nearest neighbours of another class."""
    near = knn(df, columns, 1, row_id).select(ref(row_id).alias("a"), F.col("nbr_id").alias("b"))
    back = near.select(F.col("a").alias("b"), F.col("b").alias("a"))
    mutual = near.join(back, ["a", "b"])
    labels = df.select(ref(row_id).cast("long").alias("__id"), ref(label).alias("__l"))
    sided = mutual.join(labels.withColumnsRenamed({"__id": "a", "__l": "la"}), "a").join(labels.withColumnsRenamed({"__id": "b", "__l": "lb"}), "b")
    return sided.filter("la <> lb").select(F.col("a").alias(row_id))


def knn_vote_1d(query: DataFrame, base: DataFrame, column: str, label: str, k: int = 7, row_id: str = "respondent_id", buckets: int | None = None) -> DataFrame:
    """(row id, predicted): majority label of the k base rows nearest on one column, ties by id.

    Distinct values get consecutive positions, so neighbours are found by an
    even join on positions: k values on each side, at most k rows of each.
    """
    x = ref(column).cast("double") + F.lit(0.0)
    known = base.filter(ref(column).isNotNull()).select(x.alias("v"), ref(row_id).alias("id"), ref(label).alias("l"))
    first = Window.partitionBy("v").orderBy("id")
    kept = known.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    shelf = kept.groupBy("v").agg(F.collect_list(F.struct("id", "l")).alias("rows"))
    asked = query.filter(ref(column).isNotNull()).select(x.alias("v"), ref(row_id).alias(row_id))
    both = shelf.select("v", F.lit(1).alias("b")).unionByName(asked.select("v").distinct().withColumn("b", F.lit(0)))
    places = ranked_values(both, "v", {"base": F.sum("b"), "asked": F.count_if(F.col("b") == 0)}, buckets=buckets)
    shelf = shelf.join(places.filter("base > 0").select("v", F.col("base_before").alias("at")), "v")
    spot = (F.col("base_before") + F.col("base")).cast("long")
    wanted = places.filter("asked > 0").select(F.col("v").alias("q"), F.explode(F.sequence(spot - F.lit(k), spot + F.lit(k - 1))).alias("at"))
    pairs = wanted.join(shelf, "at").select("q", F.abs(F.col("v") - F.col("q")).alias("dist"), F.inline("rows"))
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))).filter(F.col("r") <= k)
    counts = near.groupBy("q", "l").agg(F.count(F.lit(1)).alias("n"))
    votes = counts.groupBy(F.col("q").alias("v")).agg(F.min_by("l", F.struct(-F.col("n"), F.col("l"))).alias("predicted"))
    return asked.join(votes, "v").select(row_id, "predicted")
