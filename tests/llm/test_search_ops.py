"""Ranked search, the Merkle manifest and the Hilbert shards against plain versions and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import hilbert, merkle, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_search(docs, queries, top):
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, words = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, q in queries:
        scored = []
        for doc, b in bags:
            m = 25 + 75 * b.total() * n // words
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in Counter(TERM.findall(low(q))).items() if t in b)
            if s > 0:
                scored.append((-s, doc is None, doc if doc is not None else 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_against_all_documents(spark, docs, empty):
    queries = [(1, "The CAT sat on the mat, the cat"), (2, "luna canción numero 3"), (3, None), (4, " ..."), (5, "nothingofthis here"), (6, "Noël ÀÉ 😀 𝒳"), (None, "long words"), (7, "bird bird bird 49"), (1, "cat")]
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_search(rows, queries, 10)
    assert found(ranked.search(docs, q)) == want
    # blocks of queries, tiny strata pieces and another top give the same lists
    assert found(ranked.search(docs, q, top=3, block_bytes=120)) == plain_search(rows, queries, 3)
    assert ranked.search(empty, q).count() == 0 and ranked.search(docs, q.where("1 = 0")).count() == 0
    texts = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")
    assert found(ranked.search(texts, q)) == plain_search([(r["doc_id"], r["text"]) for r in texts.collect()], queries, 10)


def test_strata_hold_every_posting_and_bounds_hold(spark, docs, monkeypatch):
    size = ranked.corpus_size(docs)
    index = ranked.build_index(docs, size)
    got = Counter()
    for r in index.collect():
        at = 0
        for t, tf, n in zip(r["terms"], r["tfs"], r["counts"]):
            for s in r["slots"][at : at + n]:
                got[r["docs"][s], r["m"], t, tf] += 1
            at += n
        assert at == len(r["slots"])
    want = Counter()
    for r in docs.collect():
        b = Counter(TERM.findall(low(r["text"])))
        for t, tf in b.items():
            want[r["doc_id"], ranked.normaliser(b.total(), *size), t, tf] += 1
    assert got == want
    rng = random.Random(3)
    text = "".join(rng.choice("aZ9 é\n-") for _ in range(5000))
    monkeypatch.setattr(ranked, "PIECE", 7)
    assert ranked.term_counts(text.encode()) == Counter(w.encode() for w in TERM.findall(low(text)))


def test_many_copies_and_floors(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(300)] + ["w1 w2 w3 copy"] * 200
    rows = list(enumerate(texts))
    queries = [(k, " ".join(rng.choices(vocab, k=6))) for k in range(20)] + [(99, "copy w2"), (100, texts[4])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame(queries, "item_id long, text string")
    assert found(ranked.search(d, q)) == plain_search(rows, queries, 10)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """The root, and each leaf's steps (before, after)."""
    steps, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k in range(len(leaves)):
            run = level[where[k] // fanout * fanout :][:fanout]
            steps[k].append(("".join(run[: where[k] % fanout]), "".join(run[where[k] % fanout + 1 :])))
            where[k] //= fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], steps


def plain_manifest(rows, fanout):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    by = {}
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        mine = leaf(r, r["text"])
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, mine, leaf(r, low(r["text"])) if hit and r["text"] is not None else mine))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    low_trees = {x: plain_tree([r[2] for r in sorted(by[x])], fanout) for x in names}
    root, high = plain_tree([low_trees[x][0] for x in names], fanout)
    out = []
    for x, up in zip(names, high):
        for r, steps in zip(sorted(by[x]), low_trees[x][1]):
            acc = r[3]
            for a, b in steps + up:
                acc = sha(a + acc + b)
            out.append((r[1] if r[0] else None, r[2], low_trees[x][0], root, sha("".join(a + b for a, b in steps + up)), acc))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [8])
def test_manifest_against_a_plain_tree(docs, empty, fanout):
    got = merkle.manifest(docs, now={"text": merkle.tampered()}, fanout=fanout)
    rows = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("present"), F.col("proof"))).collect()
    assert sorted(map(tuple, rows), key=str) == plain_manifest(docs.collect(), fanout)
    assert merkle.manifest(empty, fanout=fanout).count() == 0


def test_manifest_of_one_row_and_of_many_groups(spark):
    one = spark.createDataFrame([(1, "s", None, 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["present"] and r["proof"] == []
    rows = [(k, "s", None if k % 7 == 0 else f"l{k % 23}", k, f"Text {k}") for k in range(400)] + [(5, "s", "l5", 5, "Text 5")] * 3
    many = spark.createDataFrame(rows, one.schema).repartition(5)
    got = merkle.manifest(many)
    rows = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert sorted((t[:5] for t in map(tuple, rows)), key=str) == sorted((t[:5] for t in plain_manifest(many.collect(), 8)), key=str)
    assert {r[3] == r[5] for r in rows} == {True}
    other = merkle.manifest(many.withColumn("text", F.when(F.col("doc_id") == 8, "x").otherwise(F.col("text"))))
    names = many.select("doc_id", "lang").distinct()
    found = merkle.changed(got.join(names, "doc_id").select("lang", "subroot"), other.join(names, "doc_id").select("lang", "subroot"), "lang").collect()
    assert [r["lang"] for r in found] == ["l8"]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
    place = hilbert.curve(list(cells), bits)
    assert sorted(place.tolist()) == list(range(len(place)))
    walk = cells[:, np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_of_odd_rows(docs, empty):
    rows = hilbert.shard(docs, shards=7).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    placed = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["place"] for r in placed] == sorted(r["place"] for r in rows)
    for r in rows:
        assert r["place"] == int(hilbert.curve([np.array([c]) for c in r["cells"]])[0])
    few = hilbert.shard(docs.limit(3), shards=24).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few) and len({r["shard"] for r in few}) == 3
    assert hilbert.shard(empty).count() == 0


def test_cells_are_even_and_filters_skip_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k - 2**62 if k == 0 else k, f"s{rng.randint(0, 700):04d}", rng.choice(["de", "en", "en", None]), int(10 ** rng.uniform(1, 5)), f"text {k}") for k in range(4000)]
    d = spark.createDataFrame(rows[1:], "doc_id long, source string, lang string, n_chars long, text string")
    grid = hilbert.fit_grid(d)
    got = hilbert.shard(d, shards=64, grid=grid).join(d.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    names = sorted({r[1] for r in rows})
    for r in got.collect():
        assert r["cells"][0] == names.index(r["source"]) * 256 // len(names)
    few = d.where("source < 's0005'")
    cuts = hilbert.name_cuts(few, "source")
    assert [c for _, c in cuts] == [k * 256 // len(cuts) for k in range(len(cuts))] and len(cuts) == few.select("source").distinct().count()
    zone_map = hilbert.zones(got, ["source", "lang", "n_chars", "doc_id"]).cache()
    for ranges in ({"source": ("s0100", "s0150")}, {"n_chars": (20_000, None)}, {"doc_id": (100, 400)}):
        kept = {r["shard"] for r in hilbert.pruned(zone_map, ranges).collect()}
        (c, (a, b)), = ranges.items()
        need = {r["shard"] for r in got.collect() if (a is None or r[c] >= a) and (b is None or r[c] <= b)}
        assert need <= kept and len(kept) <= 40
    hilbert.write_shards(d, f"{tmp_path}/out", shards=6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").exceptAll(d).count() == 0 and back.count() == d.count()
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == Counter(r["shard"] for r in hilbert.shard(d, shards=6).collect())
    # ids at both ends of 64 bits
    assert hilbert.shard(spark.createDataFrame(rows[:1] + [(2**62, "s", "x", 1, "t"), (-(2**63), "s", "x", -5, "t"), (2**63 - 1, None, None, None, None)], d.schema)).count() == 4
