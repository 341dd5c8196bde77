"""SimHash near-duplicates: positional bytes as an inverted index, shared bytes tallied per pair, then verified."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sondage.llm.common import arrow_pass, arrow_rows, col, raw_text
from sondage.llm.components import connected
from sondage.session import cut_lineage

SHINGLE = 3
SEED = 42
BITS = 3
BYTES = 8
# Two fingerprints that differ in at most BITS bits share at least this many of their 8 positional bytes.
SHARED = BYTES - BITS
POSITIONS = list(combinations(range(BYTES), SHARED))
# Shingles whose bits are counted at a time, and members of a list compared with all of it at a time.
CHUNK = 65_536
DENSE = 1_024


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Of a text in UTF-8: A-Z lower-cased, words between ASCII white space, a bit set where over half the hashes set it."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    h, n = xxhash.xxh64_intdigest, len(words) - size + 1
    ones = np.zeros(64, dtype=np.int64)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[size - 1 :]
    for at in range(0, n, CHUNK):
        hashes = np.array([h(flat[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row) and ``fp``, the fingerprint as a signed 64-bit number; null and empty texts have 0."""

    def make():
        def fn(arrays):
            return [pa.array(np.array([fingerprint(t) for t in arrays[0].to_pylist()], dtype=np.uint64).view(np.int64))]

        return fn

    return arrow_pass(docs, make, {"raw": raw_text(text)}, [StructField("fp", LongType())])


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared(x: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes are zero in an exclusive or, that is, shared."""
    return (x[..., None].view(np.uint8) == 0).sum(axis=-1)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that reach the guaranteed number of shared bytes and pass the check of their bits."""
    x = np.bitwise_xor(a, b)
    return (_shared(x) >= SHARED) & (_ones(x) <= BITS)


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list, (member, smallest member it is linked with in this list): enough to keep all connections.

    Members are distinct and share five bytes, so only 24 bits are free: a list above DENSE members is searched by
    flipping up to three of its free bits, whose number of look-ups does not grow with the square of the list.
    """
    n = len(members)
    members = np.sort(members)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(ii: np.ndarray, jj: np.ndarray) -> None:
        for i, j in zip(ii.tolist(), jj.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)

    if n <= DENSE:
        i, j = np.nonzero(np.triu(tally(members[:, None], members[None, :]), 1))
        join(i, j)
    else:
        spread = np.bitwise_or.reduce(members ^ members[0])
        free = [np.uint64(1) << np.uint64(k) for k in range(64) if int(spread) >> k & 1]
        for k in range(1, BITS + 1):
            for flip in combinations(free, k):
                other = members ^ np.bitwise_or.reduce(np.array(flip, dtype=np.uint64))
                at = np.minimum(np.searchsorted(members, other), n - 1)
                hit = np.flatnonzero((members[at] == other) & (other > members))
                join(hit, at[hit])
    top = np.array([find(i) for i in range(n)])
    own = top != np.arange(n)
    return members[own], members[top[own]]


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints, at least a spanning forest of all pairs with 3 or fewer differing bits.

    The inverted index has a list for each choice of five byte positions and the bytes there: the lists of the single
    positional bytes, met five at a time, since a pair that counts must share five. Lists of single bytes would hold
    1/256 of all fingerprints each; these hold those that agree in 40 bits, never more than 2^24 different ones,
    however many copies a group has. Each list tallies the shared bytes of its pairs, keeps those that reach five,
    verifies the bits, and sends on a forest, so a group of m near copies gives at most 56 m links.
    """
    parts = []
    for k, places in enumerate(POSITIONS):
        mask = sum(0xFF << (8 * p) for p in places)
        mask -= (mask >> 63) << 64
        parts.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("v")))
    lists = prints.select(col(fp).cast("long").alias("fp")).where("fp IS NOT NULL").distinct().select("fp", F.explode(F.array(*parts)).alias("p"))
    lists = lists.select("p.k", "p.v", "fp")
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held_key, held = None, []

        def found(parts):
            a, b = _forest(np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            f = batch.column(2).to_numpy().view(np.uint64)
            if not len(f):
                continue
            start = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))))
            stop = np.concatenate((start[1:], [len(f)]))
            # lists of one member inside the batch need no look; the first and last may go on in a neighbouring batch
            todo = np.flatnonzero(stop - start > 1)
            for g in sorted({0, len(start) - 1, *todo.tolist()}):
                key, part = (k[start[g]], v[start[g]]), f[start[g] : stop[g]]
                if held and key != held_key:
                    if len(held) > 1 or len(held[0]) > 1:
                        yield found(held)
                    held = []
                held_key = key
                held.append(part)
        if held and (len(held) > 1 or len(held[0]) > 1):
            yield found(held)

    dealt = lists.repartition(width, "k", "v").sortWithinPartitions("k", "v")
    # rows are three numbers here: batches can be long
    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))
    return dealt.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id) per document; component_id is the smallest id that its links reach.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows share a fingerprint and
    so a component; null ids are smallest of nothing, a component of them alone has component null. Extra columns are
    ignored, an empty table gives an empty result.
    """
    light = with_fingerprint(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")))
    light = cut_lineage(light.select("row.doc_id", F.xxhash64("row.text").alias("text_hash"), "fp"))
    prints = cut_lineage(light.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(prints))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return light.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def hubs(docs: DataFrame) -> DataFrame:
    """(a, b): of each text of (node, text) that has near copies by its fingerprint a link to the smallest node of its component."""
    light = with_fingerprint(docs.select("node", "text"))
    light = cut_lineage(light.select("row.node", "fp").distinct())
    prints = cut_lineage(light.groupBy("fp").agg(F.min("node").alias("first")))
    roots = connected(links(prints)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("hub"))
    named = light.join(rooted.join(lowest, "root").select("fp", "hub"), "fp").where("node <> hub")
    return named.select(F.col("hub").alias("a"), F.col("node").alias("b"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (ids of null last, then
    by the hash of the text); of rows with the same id and text one stays. All columns are kept."""
    return first_of_each(docs, groups(docs, doc_id, text), doc_id, text)


def first_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of the rows of ``docs`` one for each root of ``found`` (doc_id, text_hash, root)."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(doc_id).alias("id"), F.xxhash64(col(text)).alias("hash"))
    kept = packed.alias("d").join(best.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.hash") == F.col("k.hash")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")
