"""Oversampling, the tabular generator, and the loops that grow a table."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import vocab
from sondage.functions.draws import u, u_hash
from sondage.functions.rules import apply_constraints, filter_consistency
from sondage.functions.text import duration_text, round_step
from sondage.operators import metrics, neighbours
from sondage.operators.encode import clean_generated
from sondage.operators.models import fit_logistic
from sondage.operators.order import class_ranks, distinct_ranks, quantiles
from sondage.operators.relate import append, sample_upto, stratified_folds, trim_balanced
from sondage.operators.scale import FeatureLayout, assemble, feature_array, inverse_features
from sondage.operators.schema import class_subset, drop_null_rows, features_of, infer_roles, numeric_columns, ref
from sondage.session import Rounds, cut_lineage

# New rows of round r get ids -(r * 2^40 + n), so they never meet real ones.
ROUND_SPAN = 1 << 40


def _ordered(df: DataFrame, row_id: str, seed: int, rank: str, total: str) -> DataFrame:
    return class_ranks(df.withColumn("__all", F.lit(0)), ["__all"], u(ref(row_id), f"base:{seed}"), row_id, rank, total).drop("__all")


def smote(df: DataFrame, columns: list[str], label: str, targets: dict[int, int], k: int = 5, row_id: str = "respondent_id", seed: int = 42, round_no: int = 1) -> DataFrame:
    """Rows plus synthetic ones, up to ``targets[class]`` rows of each class.

    A synthetic row lies between a base row and one of its k nearest rows of
    the class: x + share * (neighbour - x). The plan (base position, neighbour
    rank, share) follows from the running number, so it can be recomputed.
    """
    parts, offset = [df], 0
    for value, wanted in targets.items():
        members = class_subset(df, value, label)
        have = members.count()
        extra = wanted - have
        if extra <= 0 or have < 2:
            continue
        near = neighbours.knn(members, columns, min(k, have - 1), row_id)
        made = _interpolate(members, near, columns, extra, min(k, have - 1), have, row_id, seed, -(round_no * ROUND_SPAN + offset))
        parts.append(made.withColumn(label, F.lit(value).cast(dict(df.dtypes)[label])))
        offset += extra
    out = parts[0]
    for p in parts[1:]:
        out = append(out, p.select(*[ref(c) for c in p.columns if c in df.columns]))
    return out


def _interpolate(members: DataFrame, near: DataFrame, columns: list[str], extra: int, k: int, have: int, row_id: str, seed: int, start: int,
                 plan: DataFrame | None = None) -> DataFrame:
    spark = members.sparkSession
    number = F.col("n")
    if plan is None:
        # bases in a shuffled order, each used floor or ceil of extra/have times
        plan = spark.range(extra).select(F.col("id").alias("n")).withColumn("base", F.pmod(number, F.lit(have)) + F.lit(1))
    plan = plan.withColumns({
        "rank": (F.floor(u(number, f"neighbour:{seed}") * F.lit(k)) + F.lit(1)).cast("int"), "share": u(number, f"share:{seed}"),
    })
    placed = _ordered(members.select(ref(row_id).alias("a"), feature_array(columns).alias("x")), "a", seed, "base", "__t").drop("__t")
    links = near.select(ref(row_id).alias("a"), F.col("nbr_id").alias("b"), "rank")
    others = members.select(ref(row_id).alias("b"), feature_array(columns).alias("y"))
    joined = plan.join(placed, "base").join(links, ["a", "rank"]).join(others, "b")
    mixed = joined.select((F.lit(start) - number).alias(row_id), F.zip_with("x", "y", lambda p, q: q - p).alias("d"), "x", "share")
    moved = mixed.select(row_id, F.transform(F.arrays_zip("x", "d"), lambda v: v["x"] + F.col("share") * v["d"]).alias("z"))
    return moved.select(row_id, *[F.get("z", i).alias(c) for i, c in enumerate(columns)])


def drop_tomek(df: DataFrame, columns: list[str], label: str, row_id: str = "respondent_id") -> DataFrame:
    """Without the rows that are mutual nearest neighbours of another class."""
    links = neighbours.tomek_links(df, columns, label, row_id)
    return df.join(links, row_id, "left_anti")


def smote_tomek(df: DataFrame, columns: list[str], label: str, targets: dict[int, int], k: int = 5, row_id: str = "respondent_id", seed: int = 42, round_no: int = 1) -> DataFrame:
    grown = cut_lineage(smote(df, columns, label, targets, k, row_id, seed, round_no))
    return drop_tomek(grown, columns, label, row_id)


def adasyn(df: DataFrame, columns: list[str], label: str, k: int = 5, row_id: str = "respondent_id", seed: int = 42, round_no: int = 1) -> DataFrame:
    """Minority rows surrounded by the other class get more synthetic rows.

    Each row's quota is its share of foreign neighbours times the class gap.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(ref(label)).count().collect()}
    top = max(sizes.values())
    out, offset, labels = df, 0, df.select(ref(row_id).alias("nbr_id"), ref(label).alias("__nl"))
    for value, have in sorted(sizes.items()):
        gap = top - have
        if gap <= 0 or have < 2:
            continue
        members = class_subset(df, value, label)
        around = neighbours.knn_join(members, df, columns, k, row_id, exclude_self=True).join(labels, "nbr_id")
        ratio = around.groupBy(ref(row_id).alias("a")).agg(F.avg((F.col("__nl") != F.lit(value)).cast("double")).alias("r"))
        whole = ratio.agg(F.sum("r")).first()[0]
        if not whole:
            continue
        quota = ratio.withColumn("q", F.bround(F.col("r") / F.lit(whole) * F.lit(gap)).cast("int")).filter("q > 0")
        near = neighbours.knn(members, columns, min(k, have - 1), row_id)
        placed = _ordered(members.select(ref(row_id).alias("a")), "a", seed, "base", "__t").drop("__t")
        # the jobs are numbered one after another, so a round stays inside its span of ids
        jobs = quota.join(placed, "a").select("base", F.explode(F.sequence(F.lit(1), "q")).alias("i"))
        jobs = cut_lineage(jobs.withColumns({"__all": F.lit(0), "__job": F.concat_ws("-", "base", "i")}))
        numbered = class_ranks(jobs, ["__all"], u(F.col("__job"), f"job:{seed}"), "__job", "__rank", "__t")
        plan = cut_lineage(numbered.select((F.col("__rank") - F.lit(1)).alias("n"), "base"))
        start = -(round_no * ROUND_SPAN + offset)
        made = _interpolate(members, near, columns, gap, min(k, have - 1), have, row_id, seed, start, plan)
        out = append(out, made.withColumn(label, F.lit(value).cast(dict(df.dtypes)[label])))
        offset += plan.count()
    return out


# ---------------------------------------------------------- checks per round


def knn_cv_f1(df: DataFrame, columns: list[str], label: str, row_id: str = "respondent_id", folds: int = 5) -> float:
    """Weighted F1 of nearest-neighbour voting, neighbours taken from the other folds."""
    n = df.count()
    split = cut_lineage(stratified_folds(df.select(ref(row_id), *[ref(c) for c in columns], ref(label)), label, min(folds, n), row_id))
    near = neighbours.knn(split, columns, max(1, min(5, n // 2)), row_id, group="fold", relation="other")
    votes = neighbours.vote(near, split, row_id, label)
    judged = split.select(ref(row_id), ref(label).alias("y"), "fold").join(votes, row_id)
    # one row per fold, class and prediction
    cells = judged.groupBy("fold", "y", F.col("predicted").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0)))
    real = cells.groupBy("fold", F.col("y").alias("c")).agg(F.sum("n").alias("real"), hit.alias("tp"))
    told = cells.groupBy("fold", F.col("p").alias("c")).agg(F.sum("n").alias("told"))
    both = real.join(told, ["fold", "c"], "left").withColumn("f1", F.lit(2.0) * F.col("tp") / (F.col("real") + F.coalesce("told", F.lit(0))))
    weighted = both.groupBy("fold").agg((F.sum(F.col("f1") * F.col("real")) / F.sum("real")).alias("f1"))
    return float(weighted.agg(F.avg("f1")).first()[0] or 0.0)


def augmentation_metrics(current: DataFrame, previous: DataFrame | None, columns: list[str], label: str, row_id: str = "respondent_id") -> dict[str, float]:
    """The six figures that decide whether a round is kept; a figure that cannot be formed gets its neutral value."""
    several = len({r[0] for r in current.select(ref(label)).distinct().limit(3).collect()}) > 1
    out = {"f1_weighted": knn_cv_f1(current, columns, label, row_id), "silhouette": 0.0, "kappa": 1.0, "cosine_similarity": 1.0}
    if several:
        out["silhouette"] = float(metrics.silhouette(current, columns, label, row_id)[0] or 0.0)
    if previous is not None:
        k = max(1, min(5, previous.count() // 2))
        votes = neighbours.knn_predict(current, previous, columns, label, k, row_id)
        out["kappa"] = metrics.cohen_kappa(current.select(ref(row_id), ref(label)).join(votes, row_id), label, "predicted")
        out["cosine_similarity"] = metrics.mean_cosine(current, previous, columns)
    out["avg_knn_distance"] = float(neighbours.avg_knn_distance(current, columns, row_id) or 0.0)
    out["anova_p_value"] = metrics.mean_anova_p(current, columns, label) if several else 1.0
    return out


# How much each figure may get worse in one round.
ALLOWED_DROP = {
    "f1_weighted": 0.05, "silhouette": 0.1, "kappa": 0.1, "cosine_similarity": 0.05, "avg_knn_distance": 0.2, "anova_p_value": 0.1,
}


def accept(figures: dict[str, float], previous: dict[str, float] | None) -> str:
    """'good' with no violation, 'tolerated' up to a third of the figures, else 'repeated'."""
    if previous is None:
        return "good"
    shared = [m for m in ALLOWED_DROP if m in figures and m in previous]

    def worse(name: str) -> float:
        if name == "avg_knn_distance":
            return figures[name] / previous[name] - 1.0 if previous[name] else (math.inf if figures[name] else 0.0)
        return previous[name] - figures[name]

    broken = sum(worse(m) > ALLOWED_DROP[m] for m in shared)
    return "good" if broken == 0 else "tolerated" if broken <= len(shared) // 3 else "repeated"


def accept_status(figures: dict[str, Column], previous: dict[str, Column]) -> Column:
    """The rule of ``accept`` over the columns of a history: a row without any earlier figure is 'good', a figure that either side lacks does not count."""
    shared = {m: figures[m].isNotNull() & previous[m].isNotNull() for m in ALLOWED_DROP if m in figures and m in previous}

    def worse(m: str) -> Column:
        now, before = figures[m], previous[m]
        if m == "avg_knn_distance":
            return F.when(before != 0, now / before - F.lit(1.0)).when(now != 0, F.lit(math.inf)).otherwise(F.lit(0.0))
        return before - now

    held = sum((has.cast("int") for has in shared.values()), F.lit(0))
    broken = sum(((has & (worse(m) > F.lit(ALLOWED_DROP[m]))).cast("int") for m, has in shared.items()), F.lit(0))
    return F.when(broken == 0, F.lit("good")).when(broken <= F.floor(held / F.lit(3)), F.lit("tolerated")).otherwise(F.lit("repeated"))


def _sizes(df: DataFrame, label: str) -> list[int]:
    found = {int(r[0]): r[1] for r in df.groupBy(ref(label)).count().collect()}
    return [found.get(i, 0) for i in range(max(2, max(found, default=0) + 1))]


def _told_if_short(step: str, size: int, goal: int) -> None:
    """A growth that ends before its goal says so."""
    if size < goal:
        warnings.warn(f"{step} stopped at {size} of {goal} rows: its rounds are used up", RuntimeWarning, stacklevel=3)


@dataclass
class GrowState:
    """Step size and history shared by both phases."""

    step_fraction: float = 0.2
    floor: float = 0.05
    max_rounds: int = 50
    seed: int = 42
    history: list[dict] = field(default_factory=list)
    rounds: int = 0


def _grow_round(rounds: Rounds, current: DataFrame, grown: DataFrame, before: dict | None, phase: int, number: int, columns: list[str], label: str, row_id: str, state: GrowState):
    grown = cut_lineage(grown)
    figures = augmentation_metrics(grown, current, columns, label, row_id)
    status = accept(figures, before)
    kept = status != "repeated"
    if not kept:
        state.step_fraction = max(state.step_fraction / 2, state.floor)
    # a rejected round is applied all the same once the step cannot shrink
    applied = kept or state.step_fraction == state.floor
    state.history.append({
        "phase": phase, "round": number, "class_distribution": _sizes(grown if kept else current, label), "metrics": figures, "status": status, "applied": applied,
    })
    return (rounds.hand_on(grown), figures) if applied else (current, before)


def balance_phase(df: DataFrame, columns: list[str], label: str, row_id: str, state: GrowState) -> DataFrame:
    """Raise the smaller class to the larger one, a share of the gap per round."""
    sizes = _sizes(df, label)
    minority = int(np.argmin(sizes))
    goal = sizes[1 - minority]
    rounds = Rounds(df.sparkSession)
    current, before, number = rounds.hand_on(df), None, 0
    while sizes[minority] < goal and number < state.max_rounds:
        number, state.rounds = number + 1, state.rounds + 1
        add = max(1, int((goal - sizes[minority]) * state.step_fraction))
        with rounds.round():
            grown = smote_tomek(current, columns, label, {minority: sizes[minority] + add}, row_id=row_id, seed=state.seed, round_no=state.rounds)
            current, before = _grow_round(rounds, current, grown, before, 1, number, columns, label, row_id, state)
        sizes = _sizes(current, label)
    _told_if_short("balance_phase", sizes[minority], goal)
    return current


def expand_phase(df: DataFrame, columns: list[str], label: str, total: int, row_id: str, state: GrowState) -> DataFrame:
    """Grow both classes by the same number per round until the table has ``total`` rows."""
    state.step_fraction = min(0.2, state.step_fraction * 2)
    rounds = Rounds(df.sparkSession)
    current, before, number = rounds.hand_on(df), None, 0
    sizes = _sizes(current, label)
    while sum(sizes) < total and number < state.max_rounds:
        number, state.rounds = number + 1, state.rounds + 1
        each = max(2, int((total - sum(sizes)) * state.step_fraction)) // 2
        with rounds.round():
            grown = smote(current, columns, label, {0: sizes[0] + each, 1: sizes[1] + each}, row_id=row_id, seed=state.seed, round_no=state.rounds)
            current, before = _grow_round(rounds, current, grown, before, 2, number, columns, label, row_id, state)
        sizes = _sizes(current, label)
    _told_if_short("expand_phase", sum(sizes), total)
    return current


def _confident(original: DataFrame, rows: DataFrame, label: str, row_id: str) -> DataFrame:
    """Rows with the prediction of a model of the original, its confidence and its polarity."""
    shared = [c for c in features_of(original, label, row_id) if c in rows.columns]
    fitted = fit_logistic(original, shared, label, balanced=False, max_iter=1000)
    out = fitted.predict(rows)
    return out.withColumns({"__c": F.greatest("score", F.lit(1.0) - F.col("score")), "__d": F.abs(F.lit(2.0) * F.col("score") - F.lit(1.0))})


def relabel_confident(original: DataFrame, rows: DataFrame, label: str = vocab.TARGET, row_id: str = "respondent_id", confidence: float = 0.8,
                      drop: bool = False, strict: bool = False) -> DataFrame:
    """Labels overwritten by confident predictions.

    ``drop`` keeps only rows that are confident and clearly on one side.
    ``strict`` needs the confidence to be above the limit, not at it.
    """
    marked = _confident(original, rows, label, row_id)
    sure = F.col("__c") > confidence if strict else F.col("__c") >= confidence
    kind = dict(rows.dtypes)[label]
    if drop:
        marked = marked.filter(sure & (F.col("__d") > 0.5)).withColumn(label, F.col("predicted").cast(kind))
    else:
        marked = marked.withColumn(label, F.when(sure, F.col("predicted").cast(kind)).otherwise(ref(label)))
    return marked.select(*[ref(c) for c in rows.columns])


def final_relabel(original: DataFrame, augmented: DataFrame, label: str = vocab.TARGET, row_id: str = "respondent_id") -> tuple[DataFrame, int]:
    """(relabelled rows, number of changed labels)."""
    out = relabel_confident(original, augmented, label, row_id, strict=True)
    changed = out.select(ref(row_id), ref(label).alias("__new")).join(augmented.select(ref(row_id), ref(label)), row_id).filter(F.col("__new") != ref(label)).count()
    return out, changed


def augment_smote(df: DataFrame, total: int = 2000, label: str = vocab.TARGET, row_id: str = "respondent_id", state: GrowState | None = None) -> tuple[DataFrame, list[dict]]:
    """Balance, expand, relabel; (rows, history)."""
    state = state or GrowState()
    columns = features_of(df, label, row_id)
    base = cut_lineage(df.select(ref(row_id), *[ref(c).cast("double").alias(c) for c in columns], ref(label).cast("int").alias(label)))
    grown = expand_phase(balance_phase(base, columns, label, row_id, state), columns, label, total, row_id, state)
    return final_relabel(base, grown, label, row_id)[0], state.history


# ---------------------------------------------------------- tabular generator

QUANTILES = 101
MAX_LEVELS = 10_000


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution function by Newton steps from a logistic start."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    z = np.log(p / (1 - p)) / 1.702
    for _ in range(8):
        z = z - (_normal_share(z) - p) / np.maximum(np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), 1e-12)
    return z


# The standard normal distribution function and its density at steps of 1/512; between them a cubic is off by less than 1e-13.
_STEPS, _END = 512, 9.0
_AT = np.linspace(-_END, _END, int(2 * _END * _STEPS) + 1)
_SHARE = np.array([0.5 * math.erfc(-z / math.sqrt(2.0)) for z in _AT])
_SLOPE = np.exp(-_AT * _AT / 2.0) / math.sqrt(2.0 * math.pi) / _STEPS


def _normal_share(z: np.ndarray) -> np.ndarray:
    """The normal distribution function over an array."""
    place = (np.clip(np.asarray(z, dtype=float), -_END, _END) + _END) * _STEPS
    i = np.minimum(place.astype(np.int64), len(_AT) - 2)
    t = place - i
    a, b, da, db = _SHARE[i], _SHARE[i + 1], _SLOPE[i], _SLOPE[i + 1]
    return a + t * (da + t * (3 * (b - a) - 2 * da - db + t * (2 * (a - b) + da + db)))


@dataclass
class TabularGenerator:
    """Gaussian copula: one table of quantiles or level shares per column, and their correlation.

    ``fit`` learns scalars only (columns x 101 and columns x columns); ``sample``
    draws rows from their running number inside Spark tasks.
    """

    kinds: dict[str, str]
    types: dict[str, str]
    cuts: dict[str, list[float]]
    levels: dict[str, tuple[list, list[float]]]
    factor: np.ndarray

    @staticmethod
    def fit(df: DataFrame, columns: list[str] | None = None, row_id: str = "respondent_id") -> "TabularGenerator":
        columns = [c for c in (columns or df.columns) if c != row_id and c not in vocab.EXCLUDED]
        df = df.select(*[ref(c) for c in columns])
        kinds = {c: role for c, _, role in infer_roles(df)}
        numeric = [c for c in columns if kinds[c] == "numerical"]
        cuts = quantiles(df, numeric, [i / (QUANTILES - 1) for i in range(QUANTILES)])
        cuts = {c: [0.0 if v is None else float(v) for v in cuts[c]] for c in numeric}
        levels: dict[str, tuple[list, list[float]]] = {}
        coded = [c for c in columns if c not in numeric]
        if coded:
            long = df.select(*[ref(c).cast("string").alias(c) for c in coded]).unpivot([], [ref(c) for c in coded], "column", "value")
            rows = long.groupBy("column", "value").count().limit(MAX_LEVELS * len(coded) + 1).collect()
            if len(rows) > MAX_LEVELS * len(coded):
                raise ValueError(f"more than {MAX_LEVELS} levels in a categorical column")
            for c in coded:
                mine = sorted(((r["value"], r["count"]) for r in rows if r["column"] == c), key=lambda t: (t[0] is None, t[0] or ""))
                whole = sum(n for _, n in mine)
                levels[c] = ([v for v, _ in mine], list(np.cumsum([n / whole for _, n in mine])))
        scores = df.select(*[ref(c).cast("double" if c in cuts else "string").alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(
            _score_sums(columns, cuts, levels), "i int, j int, s double, n double"
        ).groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        d = len(columns)
        moments = np.zeros((d + 1, d + 1))
        for r in scores:
            moments[r["i"], r["j"]] = r["s"] / max(r["n"], 1)
        mean = moments[d, :d]
        cov = moments[:d, :d] - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.where(np.diag(cov)[:, None] > 1e-9, cov / np.outer(sd, sd), 0.0)
        np.fill_diagonal(corr, 1.0)
        values, vectors = np.linalg.eigh((corr + corr.T) / 2)
        factor = vectors * np.sqrt(np.maximum(values, 0.0))
        factor /= np.maximum(np.linalg.norm(factor, axis=1, keepdims=True), 1e-12)
        return TabularGenerator(kinds, dict(df.dtypes), cuts, levels, factor)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def sample(self, spark, n: int, seed: int = 42, row_id: str = "respondent_id", start: int = 0) -> DataFrame:
        """n rows with ids start-1, start-2, ...; the same ids and seed give the same rows."""
        d = len(self.columns)
        draws = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: u_hash(F.struct(F.col("id"), i), f"gen:{seed}"))
        ids = spark.range(1, n + 1).select((F.lit(start) - F.col("id")).alias("id")).withColumn("p", draws)
        kinds = ", ".join(f"c{i} {'double' if c in self.cuts else 'string'}" for i, c in enumerate(self.columns))
        rows = ids.mapInPandas(_make_rows(self.columns, self.cuts, self.levels, self.factor), f"id long, {kinds}")
        out = []
        for i, c in enumerate(self.columns):
            whole = self.types[c] in ("int", "bigint", "smallint", "tinyint")
            value = F.bround(F.col(f"c{i}")) if whole and c in self.cuts else F.col(f"c{i}")
            out.append(value.cast(self.types[c]).alias(c))
        return rows.select(F.col("id").alias(row_id), *out)


def _score_sums(columns: list[str], cuts: dict, levels: dict):
    """Normal scores per batch, reduced to sums of products."""
    shares = np.linspace(0, 1, QUANTILES)
    tables = []
    for c in columns:
        if c in cuts:
            q = np.array(cuts[c])
            grid, first = np.unique(q, return_index=True)
            last = len(q) - 1 - np.unique(q[::-1], return_index=True)[1]
            tables.append((grid, _normal_quantile((shares[first] + shares[last]) / 2)))
        else:
            names, ends = levels[c]
            middle = (np.array([0.0, *ends[:-1]]) + np.array(ends)) / 2
            tables.append(({v: z for v, z in zip(names, _normal_quantile(middle))}, None))
    d = len(columns)
    at = np.indices((d + 1, d + 1)).reshape(2, -1)

    def run(batches):
        total, n = np.zeros((d + 1, d + 1)), 0
        for batch in batches:
            z = np.ones((len(batch), d + 1))
            for i, (grid, score) in enumerate(tables):
                column = batch[f"c{i}"]
                if score is None:
                    z[:, i] = [grid.get(None if v is None or v != v else v, 0.0) for v in column]
                else:
                    z[:, i] = np.nan_to_num(np.interp(column.to_numpy(dtype=float), grid, score))
            total += z.T @ z
            n += len(batch)
        yield pd.DataFrame({"i": at[0], "j": at[1], "s": total.ravel(), "n": float(n)})

    return run


def _make_rows(columns: list[str], cuts: dict, levels: dict, factor: np.ndarray):
    shares = np.linspace(0, 1, QUANTILES)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            p = _normal_share(_normal_quantile(np.array(batch["p"].tolist())) @ factor.T)
            out = {"id": batch["id"].to_numpy()}
            for i, c in enumerate(columns):
                if c in cuts:
                    out[f"c{i}"] = np.interp(p[:, i], shares, cuts[c])
                else:
                    names, ends = levels[c]
                    out[f"c{i}"] = np.array(names, dtype=object)[np.minimum(np.searchsorted(ends, p[:, i]), len(names) - 1)]
            yield pd.DataFrame(out)

    return run


def sample_per_class(df: DataFrame, n: int, label: str = vocab.TARGET, row_id: str = "respondent_id", seed: int = 42, start: int = 0) -> DataFrame:
    """Half the rows per class, from one generator per class."""
    half = n // 2
    parts = []
    for value, size, shift in ((0, half, 0), (1, n - half, half)):
        made = TabularGenerator.fit(class_subset(df, value, label), row_id=row_id).sample(df.sparkSession, size, seed, row_id, start - shift)
        parts.append(made.withColumn(label, F.lit(value).cast(dict(df.dtypes)[label])))
    return append(parts[0], parts[1])


def balance_batch(generator: TabularGenerator, spark, n: int, label: str = vocab.TARGET, row_id: str = "respondent_id", seed: int = 42, start: int = 0) -> DataFrame:
    """n rows; where the rarer class has under 30 %, up to n/2 per class out of 3n."""
    batch = generator.sample(spark, n, seed, row_id, start)
    sizes = {int(float(r[0])): r[1] for r in batch.groupBy(ref(label)).count().collect() if r[0] is not None}
    if min(sizes.get(0, 0), sizes.get(1, 0)) >= 0.3 * n:
        return batch
    more = generator.sample(spark, 3 * n, seed, row_id, start)
    return trim_balanced(more, label, max(1, n // 2), row_id, seed)


def validate_batch(current: DataFrame, new: DataFrame, label: str = vocab.TARGET, row_id: str = "respondent_id", ks: bool = True) -> dict:
    """Kappa, weighted F1, cosine and per-column KS of new rows against a model of the current ones."""
    shared = [c for c in features_of(current, label, row_id) if c in new.columns]
    fitted = fit_logistic(current, shared, label, balanced=False, max_iter=1000)
    judged = fitted.predict(new).select(ref(label), "predicted").persist()
    out = {
        "cohen_kappa": metrics.cohen_kappa(judged, label, "predicted"), "f1_score": metrics.f1(judged, label, "predicted", "weighted"),
        "cosine_similarity": metrics.mean_cosine(current, new, shared), "ks_distance": {},
    }
    if ks:
        out["ks_distance"] = {r["column"]: r["ks"] for r in metrics.ks_distance(current, new, shared).collect()}
    judged.unpersist()
    return out


def augment_incremental(df: DataFrame, max_size: int = 2000, step_fraction: float = 0.25, label: str = vocab.TARGET, row_id: str = "respondent_id",
                        seed: int = 42, confidence: float = 0.8, max_rounds: int = 50, score_batch=None) -> tuple[DataFrame, list[dict]]:
    """Grow by a share per round; every batch is scored, relabelled, checked and appended.

    ``score_batch`` labels a generated batch (the labelling run by default).
    """
    if score_batch is None:
        from sondage.operators.label import label_risk

        def score_batch(batch: DataFrame) -> DataFrame:
            return label_risk(batch, row_id)

    rounds = Rounds(df.sparkSession)
    current, history, number = rounds.hand_on(df), [], 0
    size = current.count()
    while size < max_size and number < max_rounds:
        number += 1
        add = min(max(1, int(size * step_fraction)), max_size - size)
        with rounds.round():
            batch = cut_lineage(sample_per_class(current, add, label, row_id, seed + number, -number * ROUND_SPAN))
            batch = score_batch(batch)
            batch = cut_lineage(relabel_confident(current, batch, label, row_id, confidence).select(*[ref(c) for c in current.columns if c in batch.columns]))
            figures = validate_batch(current, batch, label, row_id, ks=False)
            history.append({"round": number, "generated": add, "new_total": size + add, "metrics": figures})
            current = rounds.hand_on(append(current, batch))
        size = current.count()
    _told_if_short("augment_incremental", size, max_size)
    return current, history


@dataclass
class Funnel:
    """Rows generated and kept after each filter."""

    rounds: int = 0
    generated: int = 0
    confident: int = 0
    consistent: int = 0


def _filtered_batch(source: DataFrame, current: DataFrame, n: int, label: str, row_id: str, seed: int, start: int, confidence: float, funnel: Funnel,
                    one_class: bool = False) -> DataFrame:
    """``one_class``: the source holds one class only, which no batch can balance."""
    generator, spark = TabularGenerator.fit(source, row_id=row_id), current.sparkSession
    batch = cut_lineage(generator.sample(spark, n, seed, row_id, start) if one_class else balance_batch(generator, spark, n, label, row_id, seed, start))
    funnel.generated += n
    batch = cut_lineage(relabel_confident(current, batch, label, row_id, confidence, drop=True))
    funnel.confident += batch.count()
    batch = filter_consistency(batch)
    funnel.consistent += batch.count()
    return batch


def augment_filtered(df: DataFrame, max_size: int = 2000, step_fraction: float = 0.25, label: str = vocab.TARGET, row_id: str = "respondent_id", seed: int = 42,
                     confidence: float = 0.8, buffer: float = 1.5, max_rounds: int = 50, ks: bool = True) -> tuple[DataFrame, list[dict], Funnel]:
    """Grow by generated rows that pass the confidence and consistency filters."""
    keep = [c for c in df.columns if c not in vocab.EXCLUDED]
    rounds = Rounds(df.sparkSession)
    current, history, funnel = rounds.hand_on(df.select(*[ref(c) for c in keep])), [], Funnel()
    size = current.count()
    while size < max_size and funnel.rounds < max_rounds:
        funnel.rounds += 1
        left = max_size - size
        n = min(int(max(1, int(size * step_fraction)) * buffer), left * 3)
        with rounds.round():
            batch = _filtered_batch(current, current, n, label, row_id, seed + funnel.rounds, -funnel.rounds * ROUND_SPAN, confidence, funnel)
            batch = cut_lineage(sample_upto(batch, left, row_id, seed))
            added = batch.count()
            figures = validate_batch(current, batch, label, row_id, ks) if added else {"cohen_kappa": None, "f1_score": None, "cosine_similarity": None, "ks_distance": {}}
            history.append({"round": funnel.rounds, "generated": added, "new_total": size + added, "metrics": figures})
            current = rounds.hand_on(append(current, batch))
        size += added
    _told_if_short("augment_filtered", size, max_size)
    return current, history, funnel


def top_up(df: DataFrame, max_size: int, label: str = vocab.TARGET, row_id: str = "respondent_id", seed: int = 42, confidence: float = 0.8, buffer: float = 1.5,
           max_rounds: int = 20, funnel: Funnel | None = None) -> DataFrame:
    """Fill each class to half of ``max_size`` from a generator of that class, then trim to it.

    Warns where ``max_rounds`` end before a class is full.
    """
    rounds = Rounds(df.sparkSession)
    funnel, half, current, number = funnel or Funnel(), max_size // 2, rounds.hand_on(df), 0
    for value in (0, 1):
        for _ in range(max_rounds):
            lacking = half - class_subset(current, value, label).count()
            if lacking <= 0:
                break
            number += 1
            n = max(1, int(lacking * buffer))
            with rounds.round():
                batch = _filtered_batch(class_subset(current, value, label), current, n, label, row_id, seed + 1000 + number, -(1000 + number) * ROUND_SPAN, confidence, funnel, one_class=True)
                batch = sample_upto(class_subset(batch, value, label), lacking, row_id, seed)
                current = rounds.hand_on(append(current, batch))
        _told_if_short("top_up", class_subset(current, value, label).count(), half)
    return trim_balanced(current, label, half, row_id, seed)


def augmentation_summary(df: DataFrame, funnel: Funnel, label: str = vocab.TARGET) -> DataFrame:
    """One row: rounds, generated, kept after each filter, size and class sizes."""
    sizes = df.agg(F.count(F.lit(1)).alias("size"), F.count_if(ref(label) == 0).alias("class_0"), F.count_if(ref(label) == 1).alias("class_1"))
    return sizes.select(F.lit(funnel.rounds).alias("rounds"), F.lit(funnel.generated).alias("generated"), F.lit(funnel.confident).alias("kept_confident"),
                        F.lit(funnel.consistent).alias("kept_consistent"), "size", "class_0", "class_1")


def fill_to(df: DataFrame, total: int = 1000, row_id: str = "respondent_id", seed: int = 42) -> DataFrame:
    """Constrained original rows plus constrained generated ones, at most ``total``; rows with gaps are not generated."""
    original = apply_constraints(df, row_id)
    have = original.count()
    columns = [c for c in vocab.GENERATED_ORDER if c in original.columns]
    out = original.select(ref(row_id), *[ref(c) for c in columns])
    if have < total:
        made = TabularGenerator.fit(out, columns, row_id).sample(df.sparkSession, total - have, seed, row_id, -ROUND_SPAN)
        made = clean_generated(apply_constraints(drop_null_rows(made, columns), row_id))
        kinds = dict(out.dtypes)
        out = append(out, made.select(ref(row_id), *[ref(c).cast(kinds[c]).alias(c) for c in columns]))
        return out
    if have <= total:
        return out
    # only originals, more of them than asked for: the smallest ids by their ranks, so no task sorts or holds them all
    ranks = distinct_ranks(out.select(F.abs(ref(row_id)).alias("__id")), "__id").filter(F.col("rank") < total).select("__id")
    return out.withColumn("__id", F.abs(ref(row_id))).join(ranks, "__id").drop("__id")


def expand_decoded(df: DataFrame, layout: FeatureLayout, label: str = vocab.TARGET, ratio: float = 5.5, row_id: str = "respondent_id", seed: int = 42) -> DataFrame:
    """Balance by interpolation, multiply every class, and turn the arrays back into answers."""
    packed = assemble(df.select(ref(row_id), *[ref(c) for c in df.columns if c != row_id]), layout)
    columns = [f"f{i}" for i in range(layout.size)]
    wide = cut_lineage(packed.select(ref(row_id), *[F.get("features", i).alias(c) for i, c in enumerate(columns)], ref(label)))
    sizes = _sizes(wide, label)
    grown = cut_lineage(smote(wide, columns, label, {i: max(sizes) for i in range(len(sizes))}, row_id=row_id, seed=seed))
    out = grown
    for value in (0, 1):
        members = class_subset(grown, value, label)
        n = int(members.count() * ratio)
        made = TabularGenerator.fit(members.select(ref(row_id), *columns), columns, row_id).sample(df.sparkSession, n, seed, row_id, -(value + 2) * ROUND_SPAN)
        out = append(out, made.withColumn(label, F.lit(value).cast(dict(df.dtypes)[label])))
    back = inverse_features(out.select(ref(row_id), ref(label), feature_array(columns).alias("features")), layout)
    steps = {"Age": 1, "Income_Category": 100, "Essential_Needs_Percentage": 5}
    back = back.withColumns({c: round_step(ref(c), s) for c, s in steps.items() if c in back.columns})
    back = back.withColumns({c: F.bround(ref(c)).cast("int") for c in layout.passed})
    return back.withColumns({c: duration_text(ref(c)) for c in vocab.LIFETIMES if c in back.columns})
