"""Shards cut from a Hilbert curve over quantised metadata, so that few of them hold what a filter on any dimension asks for."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from sondage.llm.common import arrow_pass, col
from sondage.llm.ranks import fixed, numbered

# Cells of a dimension are 2 to this power; with four dimensions the place on the curve has 32 bits.
BITS = 8
SHARDS = 24
# Bytes that every document counts besides its text.
ROW_BYTES = 8
# Dimensions and how they are cut: names into equally many different values, sizes by their logarithm, numbers evenly.
DIMENSIONS = (("source", "name"), ("lang", "name"), ("n_chars", "size"), ("doc_id", "number"))


def curve(cells: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits (Skilling, 2004)."""
    x = [c.astype(np.uint64) for c in cells]
    one, n = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(hit, low, swap)
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(b) & one, (one << np.uint64(b)) - one, np.uint64(0))
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << one | ((v ^ turn) >> np.uint64(b) & one)
    return out


def _named(df: DataFrame, name: str):
    """A value as bytes that sort as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), col(name).cast("string")), F.lit(""))


def name_cuts(docs: DataFrame, name: str, bits: int = BITS) -> list[tuple[bytes, int]]:
    """The smallest value of each cell in use and the cell, when the distinct values in order are dealt evenly to 2**bits cells."""
    ranked = numbered(fixed(docs.select(_named(docs, name).alias("v")).distinct()), [], ["v", "tie"])
    cell = ranked.select("v", F.expr(f"pos * {1 << bits} DIV n").alias("cell"))
    return sorted((r["v"].encode(), r["cell"]) for r in cell.groupBy("cell").agg(F.min("v").alias("v")).collect())


def _stepped(values: np.ndarray) -> np.ndarray:
    """A size's power of two and the three bits below its leading one: eight even steps to every doubling."""
    v = np.maximum(values, 0).astype(np.float64) + 1.0
    part, power = np.frexp(v)
    return (power.astype(np.int64) - 1) * 8 + (np.floor(part * 16).astype(np.int64) - 8)


class Grid:
    """The cuts of all dimensions: bounded by the number of cells, whatever the table."""

    def __init__(self, dims, cuts: dict[str, list[tuple[bytes, int]]], ends: dict[str, tuple[int, int]], bits: int):
        self.dims, self.cuts, self.ends, self.bits = dims, cuts, ends, bits

    def cells(self, arrays: list[pa.Array]) -> list[np.ndarray]:
        out = []
        for (name, kind), a in zip(self.dims, arrays):
            if kind == "name":
                firsts, cell = [v for v, _ in self.cuts[name]], [c for _, c in self.cuts[name]]
                # few different values a batch: the dictionary is searched, not every row
                codes = a.dictionary_encode()
                found = np.array([cell[max(0, bisect_right(firsts, v.encode()) - 1)] for v in codes.dictionary.to_pylist()], dtype=np.uint64)
                out.append(found[codes.indices.to_numpy()] if len(a) else np.zeros(0, dtype=np.uint64))
                continue
            low, high = self.ends[name]
            known = ~a.is_null().to_numpy(zero_copy_only=False)
            v = a.fill_null(low).to_numpy().astype(np.int64)
            if kind == "size":
                low, high = (int(x) for x in _stepped(np.array([low, high])))
                v = _stepped(v)
            width = (high - low) // (1 << self.bits) + 1
            # the distance from the lowest value fits 64 bits without a sign
            far = v.astype(np.uint64) - np.array([low], dtype=np.int64).astype(np.uint64)
            out.append(np.where(known, far // np.uint64(width), np.uint64(0)))
        return out


def fit_grid(docs: DataFrame, dims=DIMENSIONS, bits: int = BITS) -> Grid:
    """Cuts over all rows: names by the order of their different values, numbers between the smallest and the largest."""
    if bits * len(dims) > 62:
        raise ValueError("a place on the curve has to fit 62 bits")
    plain = [n for n, k in dims if k != "name"]
    aggs = [x for n in plain for x in (F.min(col(n).cast("long")), F.max(col(n).cast("long")))]
    row = docs.agg(*aggs).first() if plain else ()
    ends = {n: (row[2 * k] or 0, row[2 * k + 1] or 0) for k, n in enumerate(plain)}
    return Grid(dims, {n: name_cuts(docs, n, bits) for n, k in dims if k == "name"}, ends, bits)


def ordered(docs: DataFrame, keep: list[str], grid: Grid) -> DataFrame:
    """(keep ..., cells, place): each row's cell per dimension and its place on the curve, in one pass without a shuffle."""

    def make():
        def fn(arrays):
            cells = grid.cells(arrays)
            place = curve(cells, grid.bits)
            flat = np.stack(cells, axis=1).astype(np.int32).reshape(-1) if len(place) else np.zeros(0, dtype=np.int32)
            ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * len(cells))
            return [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(place.astype(np.int64))]

        return fn

    inputs = {str(k): _named(docs, n) if kind == "name" else col(n).cast("long") for k, (n, kind) in enumerate(grid.dims)}
    narrow = docs.select(*[F.col(c) for c in keep], *[c.alias(f"__d{k}") for k, c in inputs.items()])
    out = arrow_pass(narrow, make, {k: F.col(f"__d{k}") for k in inputs}, [StructField("cells", ArrayType(IntegerType())), StructField("place", LongType())])
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "cells", "place")


def shard(docs: DataFrame, shards: int = SHARDS, dims=DIMENSIONS, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", grid: Grid | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, cells, place, shard, slot) per row.

    Rows stand in the order of their place on the Hilbert curve over ``dims``, then of id, size and crc32; the order is cut
    in ``shards`` runs whose numbers of rows differ by at most one, and ``slot`` numbers a run from 0. ``size`` is the text's
    bytes in UTF-8 and 8 more.

    Null names are a value of their own before all others, null numbers stand with the smallest, null texts have 0 bytes
    and the crc32 of nothing, null ids come first among equals. Rows alike in every key may swap their slots. A table with
    fewer rows than shards leaves shards empty; an empty table gives an empty result. Other columns are ignored. Only ids,
    sizes and cells are sorted, never texts; equal keys are split by the row's own number, so no range holds a hot group.
    """
    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    grid = grid or fit_grid(docs, dims, bits)
    keyed = docs.select(col(doc_id).alias("__id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("__size"), F.crc32(raw).alias("__crc"), *[col(n) for n, _ in grid.dims])
    placed = ordered(keyed, ["__id", "__size", "__crc"], grid).withColumnsRenamed({"__id": "doc_id", "__size": "size", "__crc": "text_crc32"})
    rows = numbered(fixed(placed), [], ["place", "doc_id", "size", "text_crc32", "tie"])
    at = F.expr(f"pos * {shards} DIV n")
    rows = rows.withColumn("shard", at.cast("int"))
    slot = F.col("pos") - F.expr(f"(CAST(shard AS BIGINT) * n + {shards - 1}) DIV {shards}")
    return rows.select("doc_id", "size", "text_crc32", "cells", "place", "shard", slot.alias("slot"))


def zones(rows: DataFrame, columns: list[str], by: str = "shard") -> DataFrame:
    """(shard, rows, min_x, max_x, nulls_x ...): what each shard holds of every column, for pruning."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.min(col(c)).alias(f"min_{c}"), F.max(col(c)).alias(f"max_{c}"), F.count_if(col(c).isNull()).alias(f"nulls_{c}")]
    return rows.groupBy(by).agg(*aggs)


def pruned(zone_map: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The shards that may hold a row within all of ``ranges`` (column: lowest and highest value, None for open)."""
    for c, (low, high) in ranges.items():
        if low is not None:
            zone_map = zone_map.where(F.col(f"max_{c}") >= F.lit(low))
        if high is not None:
            zone_map = zone_map.where(F.col(f"min_{c}") <= F.lit(high))
    return zone_map


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dims=DIMENSIONS, doc_id: str = "doc_id", text: str = "text", tasks: int | None = None) -> None:
    """The documents as Parquet, one folder a shard and in curve order inside its files, so that readers skip files and row groups.

    A shard is written by as many tasks as its part of ``tasks`` (the session's shuffle partitions), not by one.
    """
    from sondage.session import shuffle_partitions

    raw = F.coalesce(col(text), F.lit("")).cast("binary")
    grid = fit_grid(docs, dims)
    key = [F.col("doc_id").alias("__i"), F.col("size").alias("__s"), F.col("text_crc32").alias("__c")]
    # equal rows share their keys, so a key takes one shard and slot: the smallest
    where = shard(docs, shards, dims, doc_id=doc_id, text=text, grid=grid).groupBy(*key).agg(F.min(F.struct("shard", "slot")).alias("at"))
    id_, size, crc = col(doc_id), (F.octet_length(raw) + ROW_BYTES).cast("long"), F.crc32(raw)
    rows = docs.join(where, id_.eqNullSafe(F.col("__i")) & (size == F.col("__s")) & (crc == F.col("__c")))
    rows = rows.select(*[col(c) for c in docs.columns], F.col("at.shard").alias("shard"), F.col("at.slot").alias("__slot"))
    rows = rows.repartitionByRange(tasks or shuffle_partitions(docs.sparkSession), "shard", "__slot").sortWithinPartitions("shard", "__slot")
    rows.drop("__slot").write.partitionBy("shard").parquet(path)
