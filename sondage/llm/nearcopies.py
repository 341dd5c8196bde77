"""Near copies by five-word Jaccard similarity: an inverted index over the positional bytes of a sketch, shared bytes tallied per pair, whole texts decide."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from sondage.llm.common import arrow_pass, arrow_rows, col, raw_text
from sondage.llm.components import connected
from sondage.session import Rounds, cut_lineage

SHINGLE = 5
SEED = 42
# Two texts are near copies when their sets of shingles share this part of their union: LIKE[0] / LIKE[1].
LIKE = (4, 5)
# Lists of the index: a pair of similarity s shares none with probability (1 - s ** ROWS) ** BANDS: 5e-6 at 0.8.
BANDS, ROWS = 40, 6
# Shingles whose min-hashes are taken at a time.
CHUNK = 4_096
# Positional bytes of 240 that a pair has to share before its texts are read: one of similarity 0.8 shares fewer with probability 5e-5 (binomial).
SHARED = 168
# Members of a list that one task compares with as many others: longer lists are dealt into pairs of blocks.
BLOCK = 512

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes) -> np.ndarray:
    """The set of shingle hashes of a text in UTF-8, sorted: A-Z lower-cased, words between ASCII white space.

    A text of up to five words is one shingle; all texts without a word share one.
    """
    words = raw.lower().split()
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - SHINGLE])]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(flat[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])), dtype=np.uint64, count=len(starts)))


def least(hashes: np.ndarray) -> np.ndarray:
    """The min-hashes of a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[at : at + CHUNK, None] * _TIMES + _PLUS).min(axis=0))
    return low


def list_keys(low: np.ndarray) -> np.ndarray:
    """The lists a text stands in: of each band its number and its min-hashes folded into 64 bits."""
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ low[:, k]) * _MIX
    return key


def sketch(low: np.ndarray) -> bytes:
    """A byte of each min-hash: two texts share a positional byte about as often as their similarity."""
    return (low >> np.uint64(20)).astype(np.uint8).tobytes()


def identity(text: str) -> Column:
    """What stands for a whole text: 128 bits of md5, null as empty. Different texts with one digest are not to be expected at any size."""
    return F.unhex(F.md5(raw_text(text)))


def _sketched(docs: DataFrame) -> DataFrame:
    """(node, size, keys, bytes) per row of (node, text)."""

    def make():
        def fn(arrays):
            sets = [shingles(t) for t in arrays[0].to_pylist()]
            low = [least(s) for s in sets]
            keys = np.array([list_keys(x) for x in low], dtype=np.uint64).reshape(-1).view(np.int64)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            return [pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.array([sketch(x) for x in low], pa.binary())]

        return fn

    fields = [StructField("size", LongType()), StructField("keys", ArrayType(LongType())), StructField("bytes", BinaryType())]
    return arrow_pass(docs, make, {"raw": raw_text("text")}, fields).select("row.node", "size", "keys", "bytes")


def _of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (node, text) for each of the nodes; texts of no node are left where they are."""
    return docs.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _short_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, held): the shingle hashes of the nodes' texts cut to 32 bits, for a comparison that whole hashes confirm."""

    def make():
        return lambda arrays: [pa.array([np.unique(shingles(t).astype("<u4")).tobytes() for t in arrays[0].to_pylist()], pa.binary())]

    return arrow_pass(_of(docs, nodes), make, {"raw": raw_text("text")}, [StructField("held", BinaryType())]).select("row.node", "held")


def _possible(m: Column, n: Column) -> Column:
    """Sizes that allow the similarity at all."""
    return F.least(m, n) * LIKE[1] >= F.greatest(m, n) * LIKE[0]


def _tally(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that share enough positional bytes."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1) for c in (2, 3))
                t = t.filter(pa.array((x == y).sum(axis=1) >= SHARED))
            yield t.select(["a", "b"])

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("bytes").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("bytes").alias("y")), "b")
    return arrow_rows(both.select("a", "b", "x", "y"), run, "a binary, b binary")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole texts are similar enough. Texts in no pair are left where they are."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def make():
        return lambda arrays: [[shingles(t).view(np.int64) for t in arrays[0].to_pylist()]]

    sets = arrow_pass(_of(docs, ends), make, {"raw": raw_text("text")}, [StructField("held", ArrayType(LongType()))]).select("row.node", "held")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * (LIKE[0] + LIKE[1]) >= (F.size("x") + F.size("y")) * LIKE[0]).select("a", "b")


def _compare(t: pa.Table) -> pa.Table:
    """Of one pair of blocks of a list links enough to connect its near copies that are not connected yet.

    A pair meets in the first list that both stand in, and counts when at least one of the two is not in its list's
    largest component (``odd``): the others are connected. Bits, then bytes of the sketches leave few pairs out of many; their
    short sets decide, and a pair that links found here already connect is not looked at.
    """
    block, size, odd = t["block"].to_numpy(), t["size"].to_numpy(), t["odd"].to_numpy(zero_copy_only=False)
    root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
    held = np.frombuffer(b"".join(t["bytes"].to_pylist()), dtype=np.uint8).reshape(len(block), -1)
    keys = np.array(t["keys"].to_pylist(), dtype=np.int64)
    band = int(np.flatnonzero(keys[0] == t["key"][0].as_py())[0])
    sets = [np.frombuffer(x, dtype="<u4") for x in t["held"].to_pylist()]
    # one bit of each byte: equal bits are counted first, by words of 64
    bits = np.ascontiguousarray(np.packbits(np.pad(held & 1, ((0, 0), (0, -held.shape[1] % 64))), axis=1)).view(np.uint64)
    most = held.shape[1] - SHARED
    apart = block.max() != block.min()
    a, b = [], []
    for i in np.flatnonzero(odd):
        ok = (root != root[i]) & (np.minimum(size, size[i]) * LIKE[1] >= np.maximum(size, size[i]) * LIKE[0])
        if apart:
            ok &= block != block[i]
        j = np.flatnonzero(ok)
        # a differing bit is a differing byte
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= most]
        shared = (held[j] == held[i]).sum(axis=1)
        j, shared = j[shared >= SHARED], shared[shared >= SHARED]
        first = (keys[j] == keys[i]).argmax(axis=1) == band
        for k in j[first][np.argsort(-shared[first], kind="stable")].tolist():
            if root[k] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if both * (LIKE[0] + LIKE[1]) >= (len(sets[i]) + len(sets[k])) * LIKE[0]:
                a.append(int(i))
                b.append(k)
                root[root == root[k]] = root[i]
    node = t["node"].combine_chunks()
    return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})


def _unconnected(lists: DataFrame, found: DataFrame, keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of the lists that ``found`` lacks, by short sets.

    A list of m members is dealt into blocks by their digests, and each pair of blocks is a group of its own, so a task
    holds 2 * BLOCK members at most, however long the list and however unlike its members, and a group gives fewer links
    than it has members.
    """
    rooted = lists.join(connected(found), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    shape = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    shape = shape.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = cut_lineage(rooted.join(shape.select("key", "main", blocks.alias("blocks")), "key").withColumn("odd", F.col("root") != F.col("main")))
    nodes = open_.select("node").distinct()
    held = keyed.select("node", "keys", "bytes").join(_short_sets(docs, nodes), "node")
    open_ = open_.withColumn("block", F.pmod(F.hash("node"), F.col("blocks"))).join(held, "node")
    dealt = open_.select("key", "node", "size", "root", "odd", "block", "keys", "bytes", "held", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    links_ = dealt.groupBy("key", "low", "high").applyInArrow(_compare, "a binary, b binary")
    return links_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame) -> DataFrame:
    """(a, b): verified links between the texts of (node, text), enough to connect all near copies that share a list.

    Each member of a list meets the list's smallest one. Members that are then still unconnected meet all of their list,
    block by block. All links are verified by the sets of whole texts. A list of m texts that are not alike costs m * m
    comparisons of sketches, spread over its pairs of blocks.
    """
    keyed = cut_lineage(_sketched(docs).dropDuplicates(["node"]))
    lists = keyed.select("node", "size", F.explode("keys").alias("key"))
    hubs = lists.groupBy("key").agg(F.min(F.struct("node", "size")).alias("hub"), F.max("node").alias("last")).where("hub.node < last")
    lists = cut_lineage(lists.join(hubs.select("key", "hub"), "key"))
    stars = lists.where(_possible(F.col("size"), F.col("hub.size"))).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).where("a < b").distinct()
    found = cut_lineage(_verified(cut_lineage(_tally(stars, keyed.select("node", "bytes"))), docs))
    more = cut_lineage(_unconnected(lists.select("key", "node", "size"), found, keyed, docs))
    return found.unionByName(_verified(more, docs))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", further: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (ids of null last, then by
    the digest of the text); of rows with the same id and text one stays. All columns are kept.
    ``further`` gives more links (a, b) between the texts of (node, text).

    Repeated rows and texts are one text, null and blank texts are alike among themselves, texts of up to five words are
    alike when equal but for case and white space. Whole texts are compared, however long: a text is held by one task at a
    time as its shingle hashes, 8 bytes a word. Extra columns may have any name; an empty table gives an empty result.
    """
    light = docs.select(identity(text).alias("node"), col(text).alias("text"))
    rounds = Rounds(docs.sparkSession)
    with rounds.round():  # of the tables that are written for the links only the components stay
        found = links(light) if further is None else further(light).unionByName(links(light))
        roots = rounds.hand_on(connected(found)).withColumnRenamed("node", "hash")
    ids = docs.select(col(doc_id).alias("id"), identity(text).alias("hash"))
    # one key for both, the join and the rows that come twice, so whole rows are shuffled once; a null within it equals a null
    key = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = ids.join(roots, "hash", "left").groupBy(F.coalesce("root", "hash").alias("r")).agg(F.min(key).alias("key")).select("key")
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(doc_id).alias("id"), identity(text).alias("hash"))
    kept = packed.select("row", key.alias("key")).join(best, "key", "left_semi")
    return kept.dropDuplicates(["key"]).select("row.*")
