"""Ranked lexical search over an index in strata of equal length normaliser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sondage.llm.common import arrow_rows, col, raw_text, small_batches, written
from sondage.session import cut_lineage

TOP = 10
# Postings that a task holds while it sorts them into strata, and bytes of a long text whose terms are counted at a time.
CHUNK = 1_000_000
PIECE = 1 << 20
# Bytes of the index that a task writes or reads at a time: a task's part of a large corpus has thousands of pieces.
GROUP_BYTES = 8 * 1024 * 1024
# Strata that each query visits first, to learn a score that the others have to reach.
FIRST = 8
# Open strata that are sent to every task; beyond them the bounds of the pieces, which are as strict, decide alone.
STRATA = 100_000
# Bytes of query text that one pass over the index holds: more queries are dealt in blocks of this size.
BLOCK_BYTES = 4_000_000
# Scores that a task adds up at a time.
CELLS = 1_000_000
# Fixed values of the score: full weight of length, its part, and the scale of a term's share.
LENGTH, LENGTH_PART, SCALE = 100, 75, 1_000_000_000

# A term is a run of ASCII digits and letters and of anything beyond ASCII; A-Z are lower-cased.
_TERMS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8; a long text is taken in pieces cut between terms."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        # a term that the cut would divide goes on into this piece
        while end < len(raw) and _TERMS[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_TERMS).split()
        at = end


def term_counts(raw: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    got = Counter()
    for terms in pieces(raw):
        got.update(terms)
    return got


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""

    def run(batches):
        documents = words = 0
        for batch in batches:
            for t in batch.column(0):
                n = sum(map(len, pieces(t.as_buffer().to_pybytes())))
                documents, words = documents + (n > 0), words + n
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([words], pa.int64())], names=["documents", "words"])

    sums = arrow_rows(docs.select(raw_text(text).alias("raw")), run, "documents long, words long")
    row = sums.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def normaliser(n: int, documents: int, words: int) -> int:
    return LENGTH - LENGTH_PART + (LENGTH_PART * n * documents) // words


INDEX = "m long, docs array<{id}>, terms array<string>, tfs array<int>, counts array<int>, slots array<int>"


def build_index(docs: DataFrame, size: tuple[int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents with a term, without a shuffle: (m, docs, terms, tfs, counts, slots).

    A row is a piece of a stratum: documents (``docs``, by id) with one normaliser m, and its postings by term and tf: the
    k-th run belongs to ``terms[k]``, occurring ``tfs[k]`` times in each of ``counts[k]`` documents, whose places in ``docs``
    are the next ones of ``slots``. A task sorts ``CHUNK`` postings at a time, so a piece is never longer; a
    stratum of a third of all documents is many pieces. Every term of every whole text is in the index.
    """
    small_batches(docs.sparkSession)
    documents, words = size
    kind = docs.select(col(doc_id)).schema[0].dataType
    schema = StructType.fromDDL(INDEX.format(id="long"))
    schema = StructType([StructField(f.name, ArrayType(kind)) if f.name == "docs" else f for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        norms: list[int] = []
        vocabulary: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        held = 0

        def flush():
            m = np.array(norms, dtype=np.int64)
            names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
            lengths = np.array([len(p) for p in parts])
            owner = np.repeat(np.arange(len(m)), lengths)
            term, tf = np.concatenate(parts), np.concatenate(tfs)
            # documents of a stratum by id, so that slots rise with ids
            keys = pa.array(ids, arrow_id)
            order = np.array(pc.sort_indices(keys, null_placement="at_end"))
            order = order[np.argsort(m[order], kind="stable")]
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            first = np.flatnonzero(np.concatenate(([True], np.diff(m[order]) != 0)))
            stops = np.concatenate((first[1:], [len(order)]))
            stratum = np.searchsorted(first, place, side="right") - 1
            by = np.lexsort((place[owner], tf, term, stratum[owner]))
            owner, term, tf = owner[by], term[by], tf[by]
            s = stratum[owner]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(s) != 0) | (np.diff(term) != 0) | (np.diff(tf) != 0))))
            counts = np.diff(np.concatenate((new, [len(s)])))
            slots = place[owner] - first[s]
            of = s[new]
            edge = np.searchsorted(of, np.arange(len(first) + 1))
            slot_edge = np.concatenate((new, [len(s)]))[edge]

            def lists(values, edges):
                return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(m[order][first]),
                    lists(keys.take(pa.array(order)), np.concatenate((first, stops[-1:]))),
                    lists(names.take(pa.array(term[new])), edge),
                    lists(pa.array(tf[new].astype(np.int32)), edge),
                    lists(pa.array(counts.astype(np.int32)), edge),
                    lists(pa.array(slots.astype(np.int32)), slot_edge),
                ],
                names=[f.name for f in schema],
            )
            for x in (ids, norms, vocabulary, parts, tfs):
                x.clear()

        for batch in batches:
            arrow_id = batch.column(0).type
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = term_counts(t)
                if not got:
                    continue
                ids.append(key)
                norms.append(normaliser(got.total(), documents, words))
                parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in got), dtype=np.int32, count=len(got)))
                tfs.append(np.fromiter(got.values(), dtype=np.int32, count=len(got)))
                held += len(got)
                if held >= CHUNK:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return docs.select(col(doc_id).alias("doc_id"), raw_text(text).alias("raw")).mapInArrow(run, schema)


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, repeats) of (item_id, text): the terms of each query; ``item`` tells rows with the same id apart."""

    def run(batches):
        for batch in batches:
            rows = [(i, w.decode(), n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w, n in term_counts(t).items()]
            item, term, n = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["item", "term", "repeats"])

    return arrow_rows(queries.select("item", raw_text(text).alias("raw")), run, "item long, term string, repeats long")


def strata(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(m, term, df, most) for the terms of one block of queries: documents of the stratum that hold the term, and its largest tf there."""
    runs = index.select("m", F.explode(F.arrays_zip("terms", "tfs", "counts")).alias("r")).select("m", F.col("r.terms").alias("term"), F.col("r.tfs").alias("tf"), F.col("r.counts").cast("long").alias("n"))
    return runs.join(F.broadcast(terms), "term", "left_semi").groupBy("m", "term").agg(F.sum("n").alias("df"), F.max("tf").cast("long").alias("most"))


def weight(df, documents: int):
    return F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def impact(tf, m):
    """A term's share at a tf and a normaliser, before its weight."""
    return F.expr(f"({SCALE} * {tf}) DIV (1000 * {tf} + 8 * {m})")


class Batch:
    """The queries of one block: for each term its queries and what an impact is multiplied by there."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.items = np.array(sorted({r[0] for r in rows}), dtype=np.int64)
        at = {int(i): k for k, i in enumerate(self.items)}
        names = sorted({r[1] for r in rows})
        self.terms = {t: k for k, t in enumerate(names)}
        term = np.array([self.terms[r[1]] for r in rows], dtype=np.int64)
        by = np.argsort(term, kind="stable")
        self.item = np.array([at[r[0]] for r in rows], dtype=np.int64)[by]
        self.value = np.array([r[2] for r in rows], dtype=np.int64)[by]
        self.start = np.searchsorted(term[by], np.arange(len(names) + 1))


def _spread(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs ``which`` of a compressed table: the places of their entries, and whose they are."""
    n = start[which + 1] - start[which]
    of = np.repeat(np.arange(len(which)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[which][of], of


def _piece(batch: Batch, m: int, terms: list[str], tfs: np.ndarray, counts: np.ndarray, slots: np.ndarray, size: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, slots, scores) of the documents of a stratum's piece that reach the query's floor; pieces whose bound lies below it cost no visit."""
    found = np.fromiter((batch.terms.get(t, -1) for t in terms), dtype=np.int64, count=len(terms))
    hit = np.flatnonzero(found >= 0)
    if not len(hit):
        return
    # one division for each tf of the stratum
    kinds, which = np.unique(tfs[hit].astype(np.int64), return_inverse=True)
    share = (SCALE * kinds // (1000 * kinds + 8 * m))[which]
    term = found[hit]
    # the largest tf of a term is its last run, and no document scores more than all of them together
    last = np.flatnonzero(np.concatenate((term[1:] != term[:-1], [True])))
    place, of = _spread(batch.start, term[last])
    bound = np.zeros(len(batch.items), dtype=np.int64)
    np.add.at(bound, batch.item[place], batch.value[place] * share[last][of])
    open_ = np.flatnonzero((bound >= floor) & (bound > 0))
    if not len(open_):
        return
    ends = np.cumsum(counts.astype(np.int64))
    begin = np.concatenate(([0], ends))
    for at in range(0, len(open_), max(1, CELLS // size)):
        group = open_[at : at + max(1, CELLS // size)]
        row = np.full(len(batch.items), -1, dtype=np.int64)
        row[group] = np.arange(len(group))
        scores = np.zeros(len(group) * size, dtype=np.int64)
        # runs a few at a time, so that what is spread out stays bounded
        work = (batch.start[term + 1] - batch.start[term]) * counts[hit]
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(work) // CELLS)) + 1):
            place, of = _spread(batch.start, term[part])
            keep = row[batch.item[place]] >= 0
            place, of = place[keep], of[keep]
            doc, run = _spread(begin, hit[part][of])
            np.add.at(scores, row[batch.item[place]][run] * size + slots[doc], (batch.value[place] * share[part][of])[run])
        scores = scores.reshape(len(group), size)
        for k, q in enumerate(group.tolist()):
            good = np.flatnonzero((scores[k] >= floor[q]) & (scores[k] > 0))
            if len(good):
                yield q, good, scores[k][good]


def _best(rows: list[tuple], top: int) -> list[tuple]:
    """The first of (score, id): highest scores, then smallest ids, null ids last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:top]


def _visit(index: DataFrame, batch: Batch, floors: dict[int, int], top: int) -> DataFrame:
    """(item, doc_id, score): of each task the best documents of every query, at or above the query's floor."""
    schema = StructType([*StructType.fromDDL("item long").fields, StructField("doc_id", index.schema["docs"].dataType.elementType), *StructType.fromDDL("score long").fields])

    def run(batches):
        best: dict[int, list[tuple]] = {}
        floor = np.array([floors.get(int(i), 1) for i in batch.items], dtype=np.int64)
        kind = None
        for b in batches:
            kind = b.column(1).type.value_type
            for k in range(b.num_rows):
                docs, terms, tfs, counts, slots = (b.column(c)[k].values for c in range(1, 6))
                for q, at, scores in _piece(batch, b.column(0)[k].as_py(), terms.to_pylist(), tfs.to_numpy(), counts.to_numpy(), slots.to_numpy(), len(docs), floor):
                    # slots rise with ids: a stable sort by score leaves ties in their order
                    first = np.argsort(-scores, kind="stable")[:top]
                    kept = _best(best.get(q, []) + list(zip(scores[first].tolist(), docs.take(pa.array(at[first])).to_pylist())), top)
                    best[q] = kept
                    if len(kept) == top:
                        floor[q] = max(floor[q], kept[-1][0])
        rows = [(int(batch.items[q]), i, s) for q, kept in best.items() for s, i in kept]
        item, ids, score = zip(*rows) if rows else ([], [], [])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return arrow_rows(index, run, schema)


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_index(index: DataFrame, documents: int, terms: DataFrame, top: int = TOP, first: int = FIRST) -> DataFrame:
    """(item, rank, doc_id, score) for one block of (item, term, repeats).

    Strata are visited by their bounds: what a document with the stratum's largest tf of every term would score. The
    ``first`` strata of each query give it a floor, the score of its last place so far; then only strata, and pieces of them,
    whose bound reaches that floor are looked into. All others cannot hold a document that belongs in the list, so it is exact.
    """
    terms = cut_lineage(terms)
    heads = cut_lineage(strata(index, terms.select("term").distinct()))
    df = heads.groupBy("term").agg(F.sum("df").alias("df"))
    weighted = cut_lineage(terms.join(df, "term").select("item", "term", (F.col("repeats") * weight(F.col("df"), documents)).alias("value")))
    # bounded: the terms of one block of queries
    batch = Batch([tuple(r) for r in weighted.select("item", "term", "value").collect()])
    bounds = heads.join(F.broadcast(weighted), "term").groupBy("item", "m").agg(F.sum(F.col("value") * impact("most", "m")).alias("bound"))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    bounds = cut_lineage(bounds.where("bound > 0").withColumn("place", F.row_number().over(order)))
    early = bounds.where(F.col("place") <= first)
    # at most ``first`` normalisers for each query of the block
    begun = cut_lineage(_top(_visit(index.join(F.broadcast(early.select("m").distinct()), "m", "left_semi"), batch, {}, top), top))
    floors = {r["item"]: r["floor"] for r in begun.groupBy("item").agg(F.max("rank").alias("n"), F.min("score").alias("floor")).where(F.col("n") == top).collect()}
    # the strata still open for some query; pieces seen before are seen again only where they can still count
    edge = index.sparkSession.createDataFrame(list(floors.items()) or [(-1, 0)], "item long, floor long")
    still = cut_lineage(bounds.join(F.broadcast(edge), "item", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(1))).select("m").distinct())
    if still.count() <= STRATA:
        index = index.join(F.broadcast(still), "m", "left_semi")
    rest = _visit(index, batch, floors, top)
    return _top(rest, top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, index: DataFrame | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents of each row of ``queries``, higher scores and then smaller ids first.

    ``index`` and ``size`` may come from an earlier ``build_index`` and ``corpus_size``; else the index is built and written once.
    Null and empty texts have no terms: such documents count nowhere, such queries find nothing. Repeated rows are
    documents and queries of their own; null ids come last among equal scores. Ids keep their type. An empty table on
    either side gives an empty result; other columns are ignored.
    """
    size = size or corpus_size(docs, text)
    if index is None:
        index = written(build_index(docs, size, doc_id, text), "index", GROUP_BYTES)
    named = cut_lineage(queries.select(F.monotonically_increasing_id().alias("item"), col(item_id).alias("item_id"), col(item_text).alias("text")))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    out = None
    for k in range(blocks):
        some = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else named
        got = search_index(index, size[0], query_terms(some, text="text"), top)
        out = got if out is None else out.unionByName(got)
    return out.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
