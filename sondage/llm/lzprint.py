"""Document fingerprints from Lempel-Ziv phrases: the phrase set, min-hashed, compares texts as compression would."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import arrow_rows, col

# Values of a signature, and hex digits of each.
HASHES = 64
DIGITS = 4
# Ordered stretches of documents, each read in turn by one task, for each shuffle partition.
STRETCHES = 4
# Phrases min-hashed at a time.
CHUNK = 16_384

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))


class Parser:
    """Lempel-Ziv (1978) parse of bytes, which can be copied in the middle of a text and go on along two ways."""

    __slots__ = ("known", "node", "cuts", "n")

    def __init__(self):
        self.known: dict[int, int] = {}
        self.node, self.n = 0, 0
        self.cuts: list[int] = [0]

    def copy(self) -> Parser:
        other = Parser()
        other.known, other.node, other.n, other.cuts = self.known.copy(), self.node, self.n, self.cuts.copy()
        return other

    def feed(self, raw: bytes) -> None:
        """A phrase ends with the first byte that makes it new; a state is (known phrase, next byte)."""
        known, node, cuts = self.known, self.node, self.cuts
        get, cut, size = known.get, cuts.append, len(known)
        for i, c in enumerate(raw, self.n + 1):
            key = node << 8 | c
            node = get(key)
            if node is None:
                size += 1
                known[key] = size
                node = 0
                cut(i)
        self.node = node
        self.n += len(raw)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(_P, 1 << 16), _powers(_PINV, 1 << 16)]


def powers(k: int, n: int) -> np.ndarray:
    if len(_POWERS[k]) < n:
        _POWERS[k] = _powers((_P, _PINV)[k], n)
    return _POWERS[k][:n]


def signature(raw: bytes, cuts: list[int]) -> np.ndarray:
    """The minimum of each hash over the set of phrases; the last phrase may be unfinished, then it is a known one or its own."""
    if not raw:
        return np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    cut = np.asarray(cuts if cuts[-1] == len(raw) else [*cuts, len(raw)], dtype=np.int64)
    values = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(0, len(raw)), dtype=np.uint64)))
    x = (sums[cut[1:]] - sums[cut[:-1]]) * powers(1, len(raw) + 1)[cut[:-1]]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    out = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        for k in range(HASHES):
            out[k] = min(out[k], (part * _MUL[k] + _ADD[k]).min())
    return out


def to_hex(sig: np.ndarray) -> str:
    return (sig >> np.uint64(64 - 4 * DIGITS)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a >> np.uint64(64 - 4 * DIGITS) == b >> np.uint64(64 - 4 * DIGITS)))


def head_tail(text: str) -> tuple[str, int]:
    """The part of a text that an edit leaves, and how many code points it replaces."""
    cut = len(text) // 2
    return text[: len(text) - cut], cut


def at_most(name: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most a column's value, by two short searches instead of a long one."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds) - 1) + 1
    runs = [bounds[i : i + k] for i in range(0, len(bounds), k)]

    def count(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col(name)))

    def literal(values: list[int]) -> Column:
        return F.array(*[F.lit(int(v)).cast("long") for v in values])

    run = count(literal([r[0] for r in runs]))
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * k + count(F.element_at(F.array(*[literal(r) for r in runs]), F.greatest(run, F.lit(1)))))


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The edited text is the text whose last floor(n/2) code points are replaced by the first as many (or all) of the next
    document in descending order of ids, after the last the first. Equal ids follow one another by text, descending;
    null ids come last; null texts count as empty, and an empty text has the fingerprint of no phrase, alike only to
    itself. Repeated rows each get a result; a table of one row is its own next; extra columns are ignored.

    Ids are cut into ordered stretches; each row goes to its stretch, and the first row of a stretch also to the one
    before it, so every task finds all the neighbours it needs and texts are shuffled once. A parse is done once up to
    the edit and from there goes on both ways.
    """
    spark = docs.sparkSession
    base = docs.select(col(doc_id).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("t"))
    parts = STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(base.agg(F.percentile_approx("id", shares, 10_000)).first()[0] or []))
    # stretch 0 has the largest ids; ids of null are the last stretch
    base = base.withColumn("s", F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - at_most("id", bounds)))
    first_null = F.xxhash64(F.max(F.when(F.col("id").isNull(), F.col("t"))))
    found = {r["s"]: (r["top"], r["hash"]) for r in base.groupBy("s").agg(F.max("id").alias("top"), first_null.alias("hash")).collect()}  # a row per stretch
    if not found:
        return spark.createDataFrame([], SCHEMA)
    order = sorted(found)
    starts = [(s, *(found[s] if found[s][0] is None else (found[s][0], None)), order[k - 1]) for k, s in enumerate(order)]
    starts = F.broadcast(spark.createDataFrame(starts, "s int, top long, hash long, before int")).alias("f")
    same = (F.col("d.s") == F.col("f.s")) & F.col("d.id").eqNullSafe(F.col("f.top")) & (F.col("f.hash").isNull() | (F.xxhash64("d.t") == F.col("f.hash")))
    marked = base.alias("d").join(starts, same, "left").select("d.s", "d.id", "d.t", "f.before")
    both = F.filter(F.array(F.struct(F.col("s").alias("s"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("s"), F.lit(1).alias("guest"))), lambda x: x["s"].isNotNull())
    dealt = marked.select("id", "t", F.explode(both).alias("to")).select(F.col("to.s").alias("s"), F.col("to.guest").alias("guest"), "id", "t")
    dealt = dealt.repartition(len(order), "s").sortWithinPartitions("s", "guest", F.desc_nulls_last("id"), F.desc("t"))

    def run(batches):
        held = None  # (stretch, id, text, signature, parser at the edit)
        over = None  # the stretch whose first guest has been met

        def parsed(i, t):
            head, _ = head_tail(t)
            first, whole = head.encode(), t.encode()
            p = Parser()
            p.feed(first)
            fork = p.copy()
            p.feed(whole[len(first) :])
            return i, t, signature(whole, p.cuts), first, fork

        def row(cur, nxt):
            i, t, sig, first, fork = cur
            _, cut = head_tail(t)
            rest = nxt[1][:cut].encode()
            fork.feed(rest)
            edited = first + rest
            own = signature(edited, fork.cuts)
            return i, len(t), hashlib.sha256(edited).hexdigest(), to_hex(sig), to_hex(own), likeness(sig, own), likeness(sig, nxt[2])

        for b in batches:
            out = []
            for s, g, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                if g and over == s:
                    continue
                cur = parsed(i, t)
                if held is not None and held[0] == s:
                    out.append(row(held[1], cur))
                held = (s, cur)
                if g:
                    over, held = s, None
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return arrow_rows(dealt, run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
