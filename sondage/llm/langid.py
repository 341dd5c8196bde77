"""Language by rank-order profiles: out-of-place distance between most frequent n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from sondage.llm.common import arrow_pass, arrow_rows, col

# Length of the n-grams, and how many of the most frequent ones make a profile.
MAX_GRAM = 3
PROFILE = 300
UNKNOWN = "und"
# n-gram occurrences that a task sorts at a time while it counts.
COUNT_BLOCK = 4_000_000

# Share of the learning texts of a language and length that may score under its limit, and characters of the shortest beginning judged.
LOWEST, SHORTEST = 0.001, 4
# Steps of the score in which learning texts are counted, and lengths told apart: powers of two of n-gram occurrences.
STEPS, LENGTHS = 1_000, 48

BITS = np.uint64(21)
BLANK = 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: the lower-case letter, or BLANK for anything that is no letter."""
    out = np.full(0x110000, BLANK, dtype=np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_keys(text: str) -> np.ndarray:
    """One number per n-gram occurrence; words are padded by a blank, no n-gram spans two words."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not (codes != BLANK).any():
        return np.empty(0, dtype=np.uint64)
    s = np.concatenate(([BLANK], codes, [BLANK])).astype(np.uint64)
    s = s[np.concatenate(([True], (s[1:] != BLANK) | (s[:-1] != BLANK)))]
    pairs = s[:-1] | (s[1:] << BITS)
    triples = pairs[:-1] | (s[2:] << (BITS * np.uint64(2)))
    return np.concatenate((s[s != BLANK], pairs, triples[s[1:-1] != BLANK]))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def ranked(keys: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by key."""
    if not len(keys):
        return keys
    grams, counts = counted(keys)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, size: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language over all documents that have one (and fit ``where``).

    Counts cover every such text; tasks send their sums per n-gram, and only ``size`` n-grams per language reach
    the driver. Rows whose text or language is null teach nothing.
    """
    rows = docs.where(col(text).isNotNull() & col(lang).isNotNull())
    if where is not None:
        rows = rows.where(where)

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def flush():
            for name, parts in held.items():
                grams, counts = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = gram_keys(t)
                if len(keys):
                    held.setdefault(name, []).append(keys)
                    n += len(keys)
            if n > COUNT_BLOCK:
                yield from flush()
                n = 0
        yield from flush()

    counts = arrow_rows(rows.select(col(text).alias("text"), col(lang).cast("string").alias("lang")), run, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best n-grams of a language by two rounds: within a slice of the n-grams, then over the winners
    best = totals.withColumn("slice", F.pmod(F.hash("gram"), F.lit(64)))
    pick = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))), 1, size)
    first = best.groupBy("lang", "slice").agg(pick.alias("top")).select("lang", F.explode("top").alias("t")).select("lang", F.col("t.gram").alias("gram"), (-F.col("t.m")).alias("n"))
    return {r["lang"]: [g["gram"] for g in r["top"]] for r in first.groupBy("lang").agg(pick.alias("top")).collect()}


class Judge:
    """Scores texts against the profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.known = []
        for name in self.names:
            grams = np.asarray(profiles[name], dtype=np.uint64)
            order = np.argsort(grams)
            self.known.append((grams[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.of_keys(gram_keys(text) if text else np.empty(0, dtype=np.uint64))

    def of_keys(self, keys: np.ndarray) -> tuple[str, float]:
        top = ranked(keys, self.size)
        if not len(top) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(top))
        best = None
        for name, (grams, ranks) in zip(self.names, self.known):
            at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
            far = np.where(grams[at] == top, np.abs(ranks[at] - place), self.size).sum()
            if best is None or far < best[0]:
                best = (far, name)
        return best[1], float(1.0 - best[0] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), ``lang_pred`` and ``score`` (1 less the mean out-of-place distance over its maximum).

    A text that is null, empty or without a letter is ``und`` with score 0; so is every text where no profile exists.
    Equal distances go to the smaller language name. Whole texts are read; repeated rows are judged one by one; other
    columns, whatever their names, stay inside ``row``.
    """

    def make():
        judge = Judge(profiles)

        def fn(arrays):
            got = [judge(t) for t in arrays[0].to_pylist()]
            return [[g[0] for g in got], [g[1] for g in got]]

        return fn

    return arrow_pass(docs, make, {"text": col(text)}, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def beginnings(text: str) -> list[str]:
    """A text's beginnings of 4, 8, 16, ... characters, and the whole of it."""
    out, n = [], SHORTEST
    while n < len(text):
        out.append(text[:n])
        n *= 2
    return [*out, text]


def fit_limits(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang: str = "lang", lowest: float = LOWEST) -> dict[str, list[float]]:
    """For each language and length the score that all but the share ``lowest`` of its learning texts reach.

    All rows with a text and a language with a profile are judged by that profile, as a whole and by their beginnings,
    so short lengths have as many scores as long ones; tasks send counts per step of the score. A length with
    fewer than 1 / ``lowest`` scores takes those of the neighbouring lengths in, until it has enough or all.
    """

    def run(batches):
        judges = {name: Judge({name: grams}) for name, grams in profiles.items()}
        held: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in beginnings(t) if name in judges else []:
                    keys = gram_keys(part)
                    if len(keys):
                        k = (name, len(keys).bit_length(), int(judges[name].of_keys(keys)[1] * STEPS))
                        held[k] = held.get(k, 0) + 1
        cols = [*zip(*held)] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(held.values(), pa.int64())], names=["lang", "length", "step", "n"])

    rows = docs.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text).alias("text"), col(lang).cast("string").alias("lang"))
    counts = {name: np.zeros((LENGTHS, STEPS + 1), dtype=np.int64) for name in profiles}
    for r in arrow_rows(rows, run, "lang string, length int, step int, n long").groupBy("lang", "length", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["length"], r["step"]] += r["n"]
    out = {}
    for name, c in counts.items():
        out[name] = []
        for k in range(LENGTHS):
            around = next((x for w in range(LENGTHS) if (x := c[max(0, k - w) : k + w + 1].sum(axis=0)).sum() * lowest >= 1), c.sum(axis=0))
            under = np.cumsum(around) > lowest * around.sum()
            out[name].append(float(np.argmax(under)) / STEPS)
    return out


def known(docs: DataFrame, profiles: dict[str, list[int]], limits: dict[str, list[float]], text: str = "text") -> DataFrame:
    """The rows whose text reaches the limit of its nearest language and its length; texts without a letter reach none."""

    def make():
        judge = Judge(profiles)

        def stays(t):
            keys = gram_keys(t) if t else np.empty(0, dtype=np.uint64)
            name, score = judge.of_keys(keys)
            return name != UNKNOWN and score >= limits[name][len(keys).bit_length()]

        return lambda arrays: [[stays(t) for t in arrays[0].to_pylist()]]

    return arrow_pass(docs, make, {"text": col(text)}, [StructField("known", BooleanType())]).where("known").select("row.*")
