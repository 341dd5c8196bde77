"""Tree ensembles over binned features.

A column becomes codes of one byte: a code per value where it has at most 256, else its weighted quantiles. A forest
sends the coded table to every task, and a task grows whole trees. Boosting adds up histograms of the parts of a table level by level;
a table of one part is learned from in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.session import ensure_checkpoint_dir, task_slots

BINS = 256
# Values of a column that a task names before it keeps evenly spaced ones of them.
SKETCH = 2048
# Rows of a part in boosting: a table up to this size is learned from in one task, without a job for each level.
PART_ROWS = 131_072


# ------------------------------------------------------------------- binning


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the sorted values, each with the rows from the last kept one up to it."""
    if len(values) <= most:
        return values, counts
    total = np.cumsum(counts)
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, most + 1) / most - 1e-9).clip(0, len(values) - 1))
    return values[at], np.diff(total[at], prepend=0)


def _sketches(batches):
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch["x"])
        for j in range(x.shape[1]):
            values, counts = np.unique(x[:, j], return_counts=True)
            if j in held:
                values, counts = _added(*held[j], values, counts)
            held[j] = _thinned(values, counts, SKETCH)
    for j, (values, counts) in held.items():
        yield pd.DataFrame({"j": [j], "values": [values], "counts": [counts.astype("int64")]})


def _added(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    return values, np.bincount(where, np.concatenate((na, nb))).astype("int64")


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=float)
    if np.isnan(x).any():
        raise ValueError("a feature is null or not a number")
    return x


def _joined(part: pd.DataFrame) -> pd.DataFrame:
    values, counts = np.array([], dtype=float), np.array([], dtype="int64")
    # the order of the parts does not matter to a sum
    for v, n in sorted(zip(part["values"], part["counts"]), key=lambda p: (len(p[0]), tuple(p[0][:8]))):
        values, counts = _added(values, counts, np.asarray(v, dtype=float), np.asarray(n))
    kept, _ = _thinned(values, counts, BINS)
    middle = (kept[:-1] + kept[1:]) / 2
    return pd.DataFrame({"j": [int(part["j"].iloc[0])], "cuts": [np.where(middle < kept[1:], middle, kept[:-1])]})


def column_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Per feature the values that part its codes: a value up to the c-th cut and above the one before has code c."""
    parts = rows.select("x").mapInPandas(_sketches, "j int, values array<double>, counts array<long>")
    found = {r["j"]: np.array(r["cuts"], dtype=float) for r in parts.groupBy("j").applyInPandas(_joined, "j int, cuts array<double>").collect()}
    return [found[j] for j in sorted(found)]


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def plain_arrays(rows: DataFrame) -> DataFrame:
    """features, label and weight of the trainers as plain columns x, y, w."""
    return rows.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"))


def coded_arrays(batches, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a part: the features, the label, which is 0 or 1, and the weight."""
    held = [(_matrix(b["x"]), b["y"].to_numpy(dtype=float), b["w"].to_numpy(dtype=float)) for b in batches if len(b)]
    x, y, w = (np.concatenate([h[k] for h in held]) for k in range(3)) if held else (np.zeros((0, d)), np.zeros(0), np.zeros(0))
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("a label is not 0 or 1")
    return x, y, w


# ---------------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes in the order of their levels: ``feature`` is -1 at a leaf; codes up to ``bin`` go to node ``link``, others to the one
    after it. A leaf's ``link`` is its row of ``leaf``."""

    feature: np.ndarray
    bin: np.ndarray
    link: np.ndarray
    leaf: np.ndarray

    def at(self, codes: np.ndarray) -> np.ndarray:
        """The row of ``leaf`` that each row ends in."""
        at, live = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while len(live):
            here = at[live]
            f = self.feature[here]
            inner = f >= 0
            live, here, f = live[inner], here[inner], f[inner]
            at[live] = self.link[here] + (codes[live, f] > self.bin[here])
        return self.link[at]

    def packed(self) -> bytes:
        return pickle.dumps((self.feature.astype(np.int16), self.bin.astype(np.uint8), self.link.astype(np.int32), self.leaf.astype(np.float32)))

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        return Tree(*pickle.loads(data))


def _margins(trees: list[bytes], weights: list[float], codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes))
    for data, weight in zip(trees, weights):
        tree = Tree.unpacked(data)
        out += weight * tree.leaf[tree.at(codes), 0].astype(float)
    return out


def _shares(trees: list[bytes], weights: list[float], codes: np.ndarray) -> np.ndarray:
    """Mean shares of the classes from 1 on."""
    out = None
    for data in trees:
        tree = Tree.unpacked(data)
        part = tree.leaf[tree.at(codes)].astype(float)
        out = part if out is None else out + part
    return out / len(trees)


class Ensemble:
    """Trees and their cuts. ``transform`` adds ``probability`` and ``prediction``, as MLlib's models do."""

    def __init__(self, spark: SparkSession, kind: str, cuts: list[np.ndarray], trees: list[bytes], weights: list[float], importances: np.ndarray, classes: int = 2):
        self.spark, self.kind, self.cuts, self.trees, self.treeWeights, self.classes = spark, kind, cuts, trees, weights, classes
        total = importances.sum()
        self.featureImportances: DenseVector = Vectors.dense(importances / total if total else importances)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def totalNumNodes(self) -> int:
        return sum(len(Tree.unpacked(t).feature) for t in self.trees)

    @cached_property
    def _sent(self):
        return self.spark.sparkContext.broadcast((self.kind, self.cuts, self.trees, self.treeWeights))

    def probabilities(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of a matrix of features, usable in tasks: rows x classes."""
        sent = self._sent

        def run(x: np.ndarray) -> np.ndarray:
            kind, cuts, trees, weights = sent.value
            codes = _codes(x, cuts)
            if kind == "forest":
                rest = _shares(trees, weights, codes)
                return np.concatenate((1.0 - rest.sum(axis=1, keepdims=True), rest), axis=1)
            up = 1.0 / (1.0 + np.exp(-2.0 * _margins(trees, weights, codes)))
            return np.stack((1.0 - up, up), axis=1)

        return run

    def transform(self, df: DataFrame) -> DataFrame:
        judge = self.probabilities()

        @F.pandas_udf("array<double>")
        def shares(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(list(judge(_matrix(part))) if len(part) else [], dtype=object)

        out = df.withColumn("__p", shares(vector_to_array("features")))
        # the first of equal shares, as elsewhere
        best = (F.array_position("__p", F.array_max("__p")) - F.lit(1)).cast("double")
        return out.withColumns({"probability": array_to_vector("__p"), "prediction": best}).drop("__p")

    def coded(self, x: Column) -> Column:
        """The features as their codes, a byte each: rows that only wait to be judged are sent like this."""
        sent = self._sent

        @F.pandas_udf("binary")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([c.tobytes() for c in _codes(_matrix(part), sent.value[1])] if len(part) else [], dtype=object)

        return run(x)

    def hits_if_permuted(self) -> Callable:
        """A function for tasks, of coded features and those of other rows: the prediction as it is, then with each feature from the
        other row, a column each. Only the trees that ask for a feature are asked again."""
        if self.kind != "boosted":
            raise ValueError("boosted trees only")
        sent = self._sent

        def run(own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
            _, _, trees, weights = sent.value
            change, margin = np.zeros(own.shape), np.zeros(len(own))
            for data, weight in zip(trees, weights):
                tree = Tree.unpacked(data)
                told = weight * tree.leaf[tree.at(own), 0].astype(float)
                margin += told
                for j in np.unique(tree.feature[tree.feature >= 0]):
                    mixed = own.copy()
                    mixed[:, j] = theirs[:, j]
                    change[:, j] += weight * tree.leaf[tree.at(mixed), 0].astype(float) - told
            return np.concatenate((margin[:, None], margin[:, None] + change), axis=1) > 0

        return run

    def evaluateEachIteration(self, rows: DataFrame) -> list[float]:
        """Weighted mean of the logistic loss after each tree, over features, label and weight."""
        sent = self._sent

        def run(batches):
            kind, cuts, trees, weights = sent.value
            total, mass = np.zeros(len(trees)), 0.0
            for batch in batches:
                if not len(batch):
                    continue
                codes, sign, w = _codes(_matrix(batch["x"]), cuts), batch["y"].to_numpy() * 2 - 1, batch["w"].to_numpy()
                margin = np.zeros(len(batch))
                for t, (data, weight) in enumerate(zip(trees, weights)):
                    margin += _margins([data], [weight], codes)
                    total[t] += (w * 2.0 * np.logaddexp(0.0, -2.0 * sign * margin)).sum()
                mass += w.sum()
            yield pd.DataFrame({"t": np.arange(len(trees)), "loss": total, "mass": mass})

        found = plain_arrays(rows).mapInPandas(run, "t int, loss double, mass double").groupBy("t").agg((F.sum("loss") / F.sum("mass")).alias("loss"))
        return [r["loss"] for r in found.orderBy("t").collect()]


# --------------------------------------------------------------------- forest


def _runs(key: np.ndarray, sums: list[np.ndarray], cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys in order, and the sums over the rows of each; by counting where keys are few, else by sorting."""
    if cells <= 4 * len(key):
        seen = np.flatnonzero(np.bincount(key, minlength=cells))
        return seen, [np.bincount(key, s, minlength=cells)[seen] for s in sums]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], [np.add.reduceat(s[order], first) for s in sums]


def grow_tree(codes: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, take: int, depth: int, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """(tree, gains by feature): nodes are parted by Gini's impurity on ``take`` features drawn for each, until they are of one
    class, no drawn feature parts them, or they lie ``depth`` deep."""
    d, gains = codes.shape[1], np.zeros(codes.shape[1])
    width = int(codes.max(initial=0)) + 1
    feature, bins, links, leaves = [], [], [], []
    live, node = np.arange(len(y)), np.zeros(len(y), dtype=np.int64)
    held = np.bincount(y, w, minlength=classes)[None, :]
    begun, leaf_rows = 0, 0
    for level in range(depth + 1):
        m = len(held)
        begun += m
        whole = held.sum(axis=1)
        own = (held**2).sum(axis=1) / np.maximum(whole, 1e-300)
        open_ = (held.max(axis=1) < whole * (1 - 1e-12)) & (level < depth)
        best, best_f, best_b = np.zeros(m), np.full(m, -1), np.zeros(m, dtype=np.int64)
        best_left = np.zeros((m, classes))
        if open_.any():
            stays = open_[node]
            live, node = live[stays], node[stays]
            drawn = np.argpartition(rng.random((m, d)), take - 1, axis=1)[:, :take] if take < d else np.tile(np.arange(d), (m, 1))
            mine, weight = y[live], w[live]
            parts = [np.where(mine == c, weight, 0.0) for c in range(classes)]
            for s in range(take):
                key = node * width + codes[live, drawn[node, s]]
                seen, sums = _runs(key, parts, m * width)
                of = seen // width
                total = np.cumsum(np.stack(sums, axis=1), axis=0)
                first = np.flatnonzero(np.diff(of, prepend=-1))
                before = np.concatenate((np.zeros((1, classes)), total))[first]
                runs = np.diff(np.append(first, len(of)))
                left = total - np.repeat(before, runs, axis=0)
                right = held[of] - left
                lw, rw = left.sum(axis=1), right.sum(axis=1)
                right = np.maximum(right, 0.0)
                last = np.zeros(len(of), dtype=bool)
                last[first + runs - 1] = True
                gain = (left**2).sum(axis=1) / np.maximum(lw, 1e-300) + (right**2).sum(axis=1) / np.maximum(rw, 1e-300) - own[of]
                gain[last] = -1.0
                top = np.maximum.reduceat(gain, first)
                # the first of equal cuts
                at = np.flatnonzero(gain == np.repeat(top, runs))
                at = at[np.diff(of[at], prepend=-1) > 0]
                nodes = of[at]
                better = (gain[at] > best[nodes]) & (gain[at] > 1e-12 * whole[nodes])
                at, nodes = at[better], nodes[better]
                best[nodes], best_f[nodes], best_b[nodes], best_left[nodes] = gain[at], drawn[nodes, s], seen[at] % width, left[at]
        parted = best_f >= 0
        np.add.at(gains, best_f[parted], best[parted])
        rank = np.cumsum(parted) - 1
        ends = ~parted
        place = np.where(parted, begun + 2 * rank, leaf_rows + np.cumsum(ends) - 1)
        leaf_rows += int(ends.sum())
        feature.append(best_f)
        bins.append(best_b)
        links.append(place)
        leaves.append((held[ends] / np.maximum(whole[ends], 1e-300)[:, None])[:, 1:])
        if not parted.any():
            break
        goes = parted[node]
        live, node = live[goes], node[goes]
        node = 2 * rank[node] + (codes[live, best_f[node]] > best_b[node])
        held = np.stack([np.bincount(node, np.where(y[live] == c, w[live], 0.0), minlength=2 * int(parted.sum())) for c in range(classes)], axis=1)
    return Tree(np.concatenate(feature), np.concatenate(bins), np.concatenate(links), np.concatenate(leaves)), gains


def fit_forest(rows: DataFrame, trees: int, depth: int, seed: int) -> Ensemble:
    """A random forest over features, label and weight: rows by Poisson draws, the root of the number of features a node.

    The coded table, one byte a value, goes to every task. Each tree is one unit of work and hangs on the seed and its number.
    """
    spark, plain = rows.sparkSession, plain_arrays(rows).persist()
    cuts = column_cuts(plain)

    def coded(batches):
        for b in batches:
            if len(b):
                if not (b["y"].notna() & (b["y"] >= 0) & (b["y"] % 1 == 0)).all():
                    raise ValueError("a label is null or no class number")
                yield pd.DataFrame({"codes": [_codes(_matrix(b["x"]), cuts).tobytes()], "y": [b["y"].to_numpy().astype(np.uint8).tobytes()], "w": [b["w"].to_numpy(dtype=float).tobytes()]})

    blocks = plain.mapInPandas(coded, "codes binary, y binary, w binary").collect()
    plain.unpersist()
    codes = np.frombuffer(b"".join(b["codes"] for b in blocks), dtype=np.uint8).reshape(-1, max(len(cuts), 1))
    y, w = np.frombuffer(b"".join(b["y"] for b in blocks), dtype=np.uint8), np.frombuffer(b"".join(b["w"] for b in blocks))
    if not len(y):
        raise ValueError("no rows to learn from")
    classes, take = max(int(y.max()) + 1, 2), int(np.ceil(np.sqrt(codes.shape[1])))
    sent = spark.sparkContext.broadcast((codes, y, w))
    del blocks, codes, y, w

    def grow(batches):
        codes, y, w = sent.value
        for batch in batches:
            for t in batch["id"]:
                rng = np.random.default_rng([seed, int(t)])
                times = rng.poisson(1.0, len(y))
                in_ = np.flatnonzero(times)
                tree, gains = grow_tree(codes[in_], y[in_], (w * times)[in_], classes, take, depth, rng)
                yield pd.DataFrame({"t": [t], "tree": [tree.packed()], "gains": [gains / gains.sum() if gains.sum() else gains]})

    made = spark.range(trees).repartition(max(1, min(trees, 3 * task_slots(spark)))).mapInPandas(grow, "t long, tree binary, gains array<double>").collect()
    made.sort(key=lambda r: r["t"])
    sent.unpersist()
    return Ensemble(spark, "forest", cuts, [bytes(r["tree"]) for r in made], [1.0] * trees, np.sum([r["gains"] for r in made], axis=0), classes)


# ------------------------------------------------------------------- boosting


@dataclass
class Growing:
    """What boosting is after: the task parameters that every pass over the rows needs."""

    cuts: list[np.ndarray]
    depth: int
    rate: float
    sampling: float
    take: int
    least: int
    seed: int

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    @cached_property
    def offset(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes)))[:-1]


class Rows:
    """Coded rows of one part in a round: the slope of the loss, the rows drawn, and the node that each has come to."""

    def __init__(self, by: Growing, part: int, codes: np.ndarray, sign: np.ndarray, w: np.ndarray, margin: np.ndarray):
        self.by, self.part, self.codes, self.sign, self.w, self.margin = by, part, codes, sign, w, margin

    def begin(self, number: int) -> None:
        target = self.sign if number == 0 else 4.0 * self.sign / (1.0 + np.exp(np.minimum(2.0 * self.sign * self.margin, 700.0)))
        drawn = np.random.default_rng([self.by.seed, number, self.part]).random(len(self.w)) < self.by.sampling if self.by.sampling < 1 else slice(None)
        self.c, self.wt, self.told = self.codes[drawn], self.w[drawn], target[drawn]
        self.at = np.zeros(len(self.wt), dtype=np.int64)

    def step(self, feature: np.ndarray, bin_: np.ndarray, link: np.ndarray) -> None:
        """One level down; the arrays are those of the tree so far, and rows at a leaf stay."""
        f = feature[self.at]
        live = np.flatnonzero(f >= 0)
        here = self.at[live]
        self.at[live] = link[here] + (self.c[live, f[live]] > bin_[here])

    def counted(self, nodes: np.ndarray, first: int) -> np.ndarray:
        """Weight, weighted target and rows by cell of the ``nodes``, which are places in a level that begins at ``first``."""
        sizes, offset = self.by.sizes, self.by.offset
        # rows that came to a leaf above the level lie before it
        slot = np.full(max(int(self.at.max(initial=0)) + 1, first + int(nodes.max()) + 1), -1)
        slot[first + nodes] = np.arange(len(nodes))
        mine = slot[self.at]
        some = np.flatnonzero(mine >= 0)
        mine, codes, w = mine[some], self.c[some], self.wt[some]
        wr, out = w * self.told[some], np.zeros((3, len(nodes), int(sizes.sum())))
        for j, size in enumerate(sizes):
            key, cells, at = mine * size + codes[:, j], len(nodes) * int(size), slice(int(offset[j]), int(offset[j] + size))
            for k, v in enumerate((w, wr, None)):
                # without a limit of rows a weight says whether there are any
                if k < 2 or self.by.least > 1:
                    out[k, :, at] = np.bincount(key, v, minlength=cells).reshape(len(nodes), size)
        if self.by.least <= 1:
            out[2] = out[0] > 0
        return out

    def learned(self, tree: Tree, weight: float) -> None:
        self.margin = self.margin + weight * tree.leaf[tree.at(self.codes), 0]


class Here:
    """All rows in this task."""

    def __init__(self, rows: Rows):
        self.rows, self.seen = rows, 0

    def begin(self, number: int) -> None:
        self.rows.begin(number)
        self.seen = 0

    def count(self, tree: list[np.ndarray], level: int, nodes: np.ndarray, first: int) -> np.ndarray:
        for _ in range(self.seen, level):
            self.rows.step(*tree)
        self.seen = level
        return self.rows.counted(nodes, first)

    def learned(self, tree: Tree, weight: float) -> None:
        self.rows.learned(tree, weight)


class Spread:
    """Rows in many parts: a level is one job, whose tasks walk down the tree so far, and margins are kept from round to round."""

    def __init__(self, by: Growing, parts):
        # (part, codes, sign, weight, margin), the last of which grows by a tree a round
        self.by, self.parts, self.number = by, parts.persist(StorageLevel.MEMORY_AND_DISK), 0

    def begin(self, number: int) -> None:
        self.number = number

    def count(self, tree: list[np.ndarray], level: int, nodes: np.ndarray, first: int) -> np.ndarray:
        by, number = self.by, self.number

        def run(parts):
            for part in parts:
                rows = Rows(by, *part)
                rows.begin(number)
                for _ in range(level):
                    rows.step(*tree)
                yield rows.counted(nodes, first)

        # the order of the parts is fixed, so the sums have the same last bits
        return np.sum(self.parts.mapPartitions(run).collect(), axis=0)

    def learned(self, tree: Tree, weight: float) -> None:
        def run(parts):
            for part, codes, sign, w, margin in parts:
                yield part, codes, sign, w, margin + weight * tree.leaf[tree.at(codes), 0]

        before, self.parts = self.parts, self.parts.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
        if (self.number + 1) % 20 == 0:
            self.parts.checkpoint()
        self.parts.foreachPartition(lambda parts: [None for _ in parts])
        before.unpersist()


def _least_squares(by: Growing, rows: Here | Spread, shared: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """(tree, gains by feature) of the least weighted squares on the slope."""
    sizes, offset, d = by.sizes, by.offset, len(by.cuts)
    cells, ends, owner = int(sizes.sum()), np.cumsum(sizes) - 1, np.repeat(np.arange(d), sizes)
    tree, leaves, gained = [np.zeros(0, dtype=np.int64)] * 3, [], np.zeros(d)
    begun, leaf_rows, table = 0, 0, rows.count(tree, 0, np.arange(1), 0)
    for level in range(by.depth + 1):
        m, first = table.shape[1], begun
        begun += m
        whole = table[:, :, :sizes[0]].sum(axis=2)
        best, cut = np.full(m, -1.0), np.zeros(m, dtype=np.int64)
        if level < by.depth:
            drawn = shared.random((m, d)).argsort(axis=1).argsort(axis=1) < by.take
            total = np.cumsum(table, axis=2)
            left = total - np.concatenate((np.zeros((3, m, 1)), total[:, :, ends[:-1]]), axis=2)[:, :, owner]
            right = whole[:, :, None] - left
            # what is left after a difference of sums is not weight
            some = 1e-9 * whole[0][:, None]
            fits = drawn[:, owner] & (left[0] > some) & (right[0] > some) & (np.arange(cells) != ends[owner])
            if by.least > 1:
                fits &= (left[2] >= by.least - 0.5) & (right[2] >= by.least - 0.5)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - (whole[1] ** 2 / np.maximum(whole[0], 1e-300))[:, None], -1.0)
            cut = gain.argmax(axis=1)
            best = gain[np.arange(m), cut]
        parted = best > 1e-12 * np.maximum(whole[0], 1e-300)
        f = np.where(parted, owner[cut], -1)
        np.add.at(gained, f[parted], best[parted])
        rank, stop = np.cumsum(parted) - 1, ~parted
        link = np.where(parted, begun + 2 * rank, leaf_rows + np.cumsum(stop) - 1)
        leaf_rows += int(stop.sum())
        tree = [np.concatenate(pair) for pair in zip(tree, (f, np.where(parted, cut - offset[owner[cut]], 0), link))]
        leaves.append((whole[1][stop] / np.maximum(whole[0][stop], 1e-300))[:, None])
        if not parted.any():
            break
        at = np.flatnonzero(parted)
        lefts, rights = left[:, at, cut[at]], right[:, at, cut[at]]
        up, table = table, np.zeros((3, 2 * len(at), cells))
        if level + 1 < by.depth:
            # the child with less weight is counted, the other one has the rest
            small = 2 * np.arange(len(at)) + (lefts[0] > rights[0])
            part = rows.count(tree, level + 1, small, begun)
            table[:, small] = part
            rest = up[:, at] - part
            rest[[0, 2]] = np.maximum(rest[[0, 2]], 0.0)
            table[:, small ^ 1] = rest
        else:
            # leaves need their sums only
            table[:, 0::2, 0], table[:, 1::2, 0] = lefts, rights
    return Tree(*tree, np.concatenate(leaves)), gained


def _boost(by: Growing, rows: Here | Spread, rounds: int) -> tuple[list[bytes], list[float], np.ndarray]:
    """Logistic loss on signs: the first tree stands for itself, later ones count at the rate, as in MLlib's boosting."""
    shared, trees, weights, gains = np.random.default_rng(by.seed), [], [], np.zeros(len(by.cuts))
    for number in range(rounds):
        rows.begin(number)
        tree, gained = _least_squares(by, rows, shared)
        weight = 1.0 if number == 0 else by.rate
        rows.learned(tree, weight)
        gains += gained
        trees.append(tree.packed())
        weights.append(weight)
    return trees, weights, gains


def fit_boosted(rows: DataFrame, rounds: int, depth: int, rate: float, seed: int, sampling: float = 1.0, features: float = 1.0, least: int = 1, part_rows: int = PART_ROWS) -> Ensemble:
    """Boosted trees over features, label and weight. A round learns from a part ``sampling`` of the rows, a node looks at a part
    ``features`` of the columns, and a child has ``least`` rows. Up to ``part_rows`` rows are learned from in one task."""
    plain = plain_arrays(rows).persist()
    cuts, n = column_cuts(plain), plain.count()
    if not n:
        raise ValueError("no rows to learn from")
    by = Growing(cuts, depth, rate, sampling, max(1, int(np.ceil(features * len(cuts)))), least, seed)
    parts = -(-n // part_rows)

    def coded(batches):
        x, y, w = coded_arrays(batches, len(cuts))
        return _codes(x, cuts), y * 2 - 1, w, np.zeros(len(w))

    dealt = plain.repartition(parts)
    if parts == 1:
        def learn(batches):
            yield pd.DataFrame({"made": [pickle.dumps(_boost(by, Here(Rows(by, 0, *coded(batches))), rounds))]})

        made = pickle.loads(dealt.mapInPandas(learn, "made binary").collect()[0]["made"])
    else:
        def block(batches):
            yield pd.DataFrame({"block": [pickle.dumps(coded(batches))]})

        ensure_checkpoint_dir(rows.sparkSession)
        blocks = dealt.mapInPandas(block, "block binary").rdd.mapPartitionsWithIndex(lambda i, held: [(i, *pickle.loads(bytes(r[0]))) for r in held])
        spread = Spread(by, blocks)
        made = _boost(by, spread, rounds)
        spread.parts.unpersist()
    plain.unpersist()
    return Ensemble(rows.sparkSession, "boosted", cuts, *made)
