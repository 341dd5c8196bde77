"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from sondage.llm.common import arrow_pass, arrow_rows, col, raw_text

# Words of a tile at least (an item of fewer words is met as a whole), and the share of an item's words that tiles must cover.
MIN_MATCH = 5
COVERAGE = 0.4
# Bytes of benchmark text that one pass over the documents holds: a larger benchmark is dealt in blocks of this size.
BLOCK_BYTES = 4_000_000

_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, split at every ASCII character that is no letter and no digit."""
    return raw.translate(_LOWER).split()


def gram_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin values of the ``size`` words from each place in ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + ids[at + k].astype(np.uint64) + np.uint64(1)
    return out


def tiles(seeds_doc: np.ndarray, seeds_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles, longest first; ties by item place, then by document place.

    A seed is a place where ``size`` words agree. Seeds that follow one another on a diagonal are one match; each round
    marks the longest matches whose words are free in both texts and drops the seeds that touch them.
    """
    d, i = seeds_doc, seeds_item
    out: list[tuple[int, int, int]] = []
    while len(d):
        order = np.lexsort((d, d - i))
        d, i = d[order], i[order]
        start = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 1) | (np.diff(d - i) != 0))))
        length = np.diff(np.concatenate((start, [len(d)]))) + size - 1
        best = length.max()
        found = sorted((int(i[s]), int(d[s])) for s in start[length == best])
        marked = [found[0]]
        free_item, free_doc = np.array([found[0][0]]), np.array([found[0][1]])
        for a, b in found[1:]:
            if (np.abs(free_item - a) >= best).all() and (np.abs(free_doc - b) >= best).all():
                marked.append((a, b))
                free_item, free_doc = np.append(free_item, a), np.append(free_doc, b)
        keep = np.ones(len(d), dtype=bool)
        for a, b in marked:
            out.append((a, b, int(best)))
            keep &= ((i + size <= a) | (i >= a + best)) & ((d + size <= b) | (d >= b + best))
        d, i = d[keep], i[keep]
    return out


class Index:
    """The words and word runs of a block of benchmark items.

    Seeds are runs of ``size`` words; an item of fewer words has one seed, all of it. Runs of each length are looked up by themselves.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        self.size, self.vocab = size, {}
        self.ids, self.length, self.tokens = [], [], []
        runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, (item, raw) in enumerate(items):
            t = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(raw)], dtype=np.int64)
            self.ids.append(item)
            self.length.append(len(t))
            self.tokens.append(t)
            if len(t):
                seed = min(size, len(t))
                at = np.arange(len(t) - seed + 1)
                runs.setdefault(seed, []).append((gram_hashes(t, at, seed), np.full(len(at), n), at))
        # seed length -> (hashes in order, item, place)
        self.runs = {}
        for seed, found in sorted(runs.items()):
            hashes, owner, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes, kind="stable")
            self.runs[seed] = hashes[order], owner[order], place[order]

    def match(self, raw: bytes, coverage: float, alone: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, tiles, matched words, words) of the items that a document covers; with ``alone`` an item of fewer than ``size`` words must be all of the text."""
        if not self.runs:
            return []
        w = words(raw)
        ids = np.fromiter(map(self.vocab.get, w, repeat(-1)), dtype=np.int64, count=len(w))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        return [m for size in self.runs if (len(w) == size if alone and size < self.size else len(w) >= size) for m in self._match(ids, known, size, coverage)]

    def _match(self, ids: np.ndarray, known: np.ndarray, size: int, coverage: float) -> list[tuple[int, int, int, int]]:
        hashes, owner, places = self.runs[size]
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            return []
        h = gram_hashes(ids, at, size)
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        hit = hi > lo
        if not hit.any():
            return []
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        post = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        doc, item, place = np.repeat(at, n), owner[post], places[post]
        out = []
        order = np.argsort(item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            k, d, p = int(item[part[0]]), doc[part], place[part]
            t = self.tokens[k]
            same = np.all([ids[d + j] == t[p + j] for j in range(size)], axis=0)
            d, p = d[same], p[same]
            if len(t) < self.size:
                # every seed is the whole item: the first place is its tile
                d, p = d[:1], p[:1]
            found = tiles(d, p, size)
            matched = sum(x[2] for x in found)
            if found and matched >= coverage * self.length[k]:
                out.append((self.ids[k], len(found), matched, self.length[k]))
        return out


def blocks(benchmark: DataFrame, size: int, item_id: str, text: str, block_bytes: int) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one after the other; repeated items count once, null texts not at all."""
    rows = benchmark.select(col(item_id).cast("long").alias("item"), raw_text(text).alias("raw")).where(F.col("item").isNotNull() & (F.octet_length("raw") > 0)).distinct()
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows
        yield Index(sorted((r["item"], bytes(r["raw"])) for r in part.collect()), size)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = MIN_MATCH, coverage: float = COVERAGE, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_tiles, matched, item_words, coverage): every document and item whose tiles cover ``coverage`` of it.

    The benchmark is the stated query set: it meets all documents in blocks of bounded size, one pass a block. Tiles are
    the longest runs of equal words first, each at least ``size`` words and none overlapping, so moved passages count.
    An item of fewer than ``size`` words matches where all of it stands at one place. Null and empty texts match nothing;
    repeated rows give repeated results; extra columns are ignored.
    """
    parts = []
    picked = docs.select(col(doc_id).cast("long").alias("doc_id"), raw_text(text).alias("raw"))
    for index in blocks(benchmark, size, item_id, text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                rows = [(i, *m, m[2] / m[3]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in index.match(t, coverage)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "n_tiles", "matched", "item_words", "coverage"])

        parts.append(arrow_rows(picked, run, "doc_id long, item_id long, n_tiles int, matched int, item_words int, coverage double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = MIN_MATCH, coverage: float = COVERAGE, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that cover no benchmark item; the columns are those of ``docs``.

    An item of fewer than ``size`` words takes only documents that consist of it: a word or two stand in clean texts as well.
    """
    for index in blocks(benchmark, size, item_id, text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            index = shared.value
            return lambda arrays: [[bool(index.match(t, coverage, alone=True)) for t in arrays[0].to_pylist()]]

        docs = arrow_pass(docs, make, {"raw": raw_text(text)}, [StructField("leaked", BooleanType())]).where("NOT leaked").select("row.*")
    return docs
