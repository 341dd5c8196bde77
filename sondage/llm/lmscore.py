"""Cross-entropy difference: matched target and background n-gram models over one vocabulary score each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import col, raw_text, small_batches

# Bytes of text in a chunk of documents, on average; there are at least as many chunks as shuffle partitions.
CHUNK_BYTES = 16 * 1024 * 1024
# Weight of the shorter history, in units of counts.
BACKOFF = 4.0
# What stands between two texts, as the word after the last and before the first; no word holds white space.
MARK = b"\n"

_ALL = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], dtype=np.uint64)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _MUL[0] + second * _MUL[1]
    x = (x ^ (x >> np.uint64(31))) * _MUL[2]
    return x ^ (x >> np.uint64(29))


class Chunk:
    """The words and word pairs of some documents, each known by a 64-bit hash; ``grams`` has them once each, sorted.

    Every text with words ends with a mark that is also what its first word follows, so each word is as often
    a history as it occurs. The hash ``_ALL`` counts all words and marks.
    """

    def __init__(self, raws: list[bytes]):
        number = _Numbers({MARK: 0})
        parts = []
        self.words = np.zeros(len(raws), dtype=np.int64)
        for k, raw in enumerate(raws):
            words = raw.lower().split()
            if words:
                self.words[k] = len(words)
                words.append(MARK)
                parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
        self.word = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        self.before = np.concatenate((np.zeros(1, dtype=np.int64), self.word[:-1])) if parts else self.word
        self.owner = np.repeat(np.arange(len(raws)), np.where(self.words > 0, self.words + 1, 0))
        self.kinds = len(number)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)
        pairs, self.pair = np.unique(self.before * self.kinds + self.word, return_inverse=True)
        self.pair_kinds = len(pairs)
        every = np.concatenate(([_ALL], hashes, pair_hash(hashes[pairs // self.kinds], hashes[pairs % self.kinds])))
        self.grams, self.at = np.unique(every, return_inverse=True)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each gram stands in the documents that ``chosen`` marks."""
        take = chosen[self.owner]
        n = [[take.sum()], np.bincount(self.word[take], minlength=self.kinds), np.bincount(self.pair[take], minlength=self.pair_kinds)]
        return np.bincount(self.at, np.concatenate(n), len(self.grams)).astype(np.uint64)

    def losses(self, background: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss per token (the mark counts as one) of each document by the target and the background model.

        Pairs are smoothed by single words. Every word occurs in the background, so its single-word model needs no
        smoothing; the target's is smoothed by the background's. Both are distributions over the same words.
        """
        b, t = background.astype(float)[self.at], target.astype(float)[self.at]
        b1, t1, b2, t2 = b[1 : 1 + self.kinds], t[1 : 1 + self.kinds], b[1 + self.kinds :], t[1 + self.kinds :]
        one_b = b1 / max(b[0], 1.0)
        one_t = (t1 + BACKOFF * one_b) / (t[0] + BACKOFF)
        per_doc = np.maximum(self.words + 1, 1)
        out = []
        for one, history, pair in ((one_t, t1, t2), (one_b, b1, b2)):
            p = (pair[self.pair] + BACKOFF * one[self.word]) / (history[self.before] + BACKOFF)
            out.append(np.bincount(self.owner, -np.log(p), len(self.words)) / per_doc)
        return out[0], out[1]


def edges(n: int) -> np.ndarray:
    """The inner bounds of n equal ranges of 64-bit hashes."""
    return np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as byte planes, compressed: sorted hashes less their forerunners have empty high planes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def unpack(blob: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8")[:, :, 0]


def _rows(columns: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_GRAMS = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_TOTALS = pa.schema([("chunk", pa.int32()), ("range", pa.int32()), ("blob", pa.binary())])


def chunk_of(doc_id: Column, other: Column, n: int) -> Column:
    """The chunk of an id; rows without one are dealt by another value."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), other)), F.lit(n)).cast("int")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", value: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) per document.

    Target: the documents labelled ``value``; background: all documents. Tokens are words, A-Z lower-cased, between
    ASCII white space; both models are word-pair models over all words that occur, without any cut. score is the
    target's loss per token less the background's; lower is nearer to the target. Null, empty and blank texts have no
    token and null losses and score. Without any label the target model is the background's single-word model. A document with several
    labels is a target if one of them fits; repeated rows count and are scored each; null ids are never targets; extra
    columns are ignored; an empty table gives an empty result.

    Documents are dealt once into chunks by id, where they meet their labels. A chunk sends each of its words and pairs
    once, with its counts, to the range of hashes it is in; a range adds up and sends each chunk the totals of what it had
    sent; the chunk scores its documents. So neither a frequent word nor a long text is more than a row per chunk, both
    models stay spread over the cluster, and nothing passes through the driver but the size of the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(col(doc_id).alias("doc_id"), raw_text(text).alias("raw"))
    size = base.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    dealt = base.select(chunk_of(F.col("doc_id"), F.col("raw").cast("string"), n).alias("chunk"), "doc_id", "raw").repartition(n, "chunk")
    good = labels.where((col(label) == value) & col(doc_id).isNotNull()).select(col(doc_id).alias("good"))
    good = good.select(chunk_of(F.col("good"), F.lit(""), n).alias("chunk"), "good").repartition(n, "chunk")
    bounds = edges(n)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _GRAMS.empty_table()
        chunk = Chunk(left.column("raw").to_pylist())
        marked = set(right.column("good").to_pylist())
        background = chunk.counts(np.ones(left.num_rows, dtype=bool))
        target = chunk.counts(np.array([i in marked for i in left.column("doc_id").to_pylist()], dtype=bool))
        cut = np.concatenate(([0], np.searchsorted(chunk.grams, bounds), [len(chunk.grams)]))
        rows = []
        for k in np.flatnonzero(np.diff(cut)):
            part = slice(cut[k], cut[k + 1])
            rows.append((k, pack(np.diff(chunk.grams[part], prepend=np.uint64(0)), background[part], target[part])))
        return _rows([[k for k, _ in rows], [left.column("chunk")[0].as_py()] * len(rows), [b for _, b in rows]], _GRAMS)

    def add_up(sent: pa.Table) -> pa.Table:
        found = [unpack(b, 3) for b in sent.column("blob").to_pylist()]
        grams = np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found])
        kinds, at = np.unique(grams, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([f[k] for f in found]), len(kinds)).astype(np.uint64) for k in (1, 2)]
        stops = np.cumsum([f.shape[1] for f in found])
        blobs = [pack(sums[0][own], sums[1][own]) for own in np.split(at, stops[:-1])]
        return _rows([sent.column("chunk").to_pylist(), sent.column("range").to_pylist(), blobs], _TOTALS)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.column("raw").to_pylist())
        order = np.argsort(right.column("range").to_numpy())
        blobs = right.column("blob").to_pylist()
        totals = np.concatenate([unpack(blobs[k], 2) for k in order], axis=1)
        target, background = chunk.losses(totals[0], totals[1])
        none = chunk.words == 0
        columns = [pa.array(chunk.words), *(pa.array(x, mask=none) for x in (target, background, target - background))]
        return pa.table([left.column("doc_id"), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    grams = dealt.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(count, "range int, chunk int, blob binary")
    totals = grams.repartition(n, "range").groupBy("range").applyInArrow(add_up, "chunk int, range int, blob binary").repartition(n, "chunk")
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(judge, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
