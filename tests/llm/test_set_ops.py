"""SimHash groups, mixing, tiling, URL templates, page text and the pipeline against plain versions and odd rows."""

import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sondage.llm import components, decontaminate, htmltext, mixing, nearcopies, simhash, urltree
from tools.check import TABLES, rows_of


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups(docs, empty):
    got = simhash.groups(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 204:
            assert r["fp"] % 2**64 == plain_fingerprint(text[r["doc_id"]])
    prints = sorted({r["fp"] % 2**64 for r in got})
    root = plain_components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    low = {}
    for r in got:
        k = root[r["fp"] % 2**64]
        if r["doc_id"] is not None:
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    assert len(got) == docs.count() and all(r["component_id"] == low.get(root[r["fp"] % 2**64]) for r in got)
    assert simhash.groups(empty).count() == 0


def test_links_keep_every_connection_in_dense_groups(spark):
    rng = random.Random(5)
    center, prints = rng.getrandbits(64), set()
    for _ in range(1500):  # one dense group, and pairs far from it at exactly 3 and 4 bits
        x = center
        for b in rng.sample(range(24), rng.randint(0, 6)):
            x ^= 1 << b
        prints.add(x)
    for d in (3, 4):
        for _ in range(40):
            x = rng.getrandbits(64)
            prints |= {x, x ^ sum(1 << b for b in rng.sample(range(64), d))}
    prints = sorted(prints)
    f = np.array(prints, dtype=np.uint64)
    pairs = [(prints[i], prints[i + 1 + int(j)]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3)]
    want = plain_components(prints, pairs)
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in prints], "fp long")
    links = simhash.links(df)
    assert links.count() <= 56 * len(prints)
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components.connected(links).collect()}
    groups = {}
    for x in prints:
        groups.setdefault(got.get(x, x), set()).add(x)
    wanted = {}
    for x in prints:
        wanted.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("dense", [4, 4096])
def test_forest_either_way(monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(3)
    members = np.unique(rng.integers(0, 2**24, 300).astype(np.uint64) & np.uint64(0xF0F00F))
    a, b = simhash._forest(members)
    want = plain_components(members.tolist(), [(x, y) for x in members.tolist() for y in members.tolist() if x < y and (x ^ y).bit_count() <= 3])
    assert plain_components(members.tolist(), list(zip(a.tolist(), b.tolist()))) == want


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 500), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}


def test_one_of_each_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = simhash.groups(docs).collect()
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({r["root"] for r in found})
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {r["component_id"] for r in found if r["component_id"] is not None}


def test_mix_reaches_targets(docs, labels, empty):
    got = mixing.mix(docs, mixing.label_weights(labels)).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    full, target = set(), {}
    while True:  # plain water filling
        left = 1.5 * total - sum(2 * size[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    target.update({s: 2.0 * size[s] for s in full})
    for s in names:
        assert by[s][0]["source_size"] == size[s] and abs(by[s][0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), mixing.label_weights(labels)).collect()))
    assert mixing.mix(empty).count() == 0


def test_heavier_documents_come_first(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    weight = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    # targets: s0 is full at two epochs, s1 gets 6667 of its 8000 words, s2 one epoch and two thirds
    for source, epochs, words in (("s1", 0, 6667), ("s2", 1, 5333)):
        got = mixing.mix(docs, weight).where(F.col("source") == source).collect()
        rest = {k: sum(r["taken"] - epochs * r["size"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)}
        assert sum(rest.values()) == words and min(r["taken"] for r in got) >= 4 * epochs
        assert rest[0] > 1.2 * rest[1]


def plain_tiles(doc, item, size):
    """Greedy string tiling by comparing every pair of places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best, at = size - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n > best:
                    best, at = n, [(i, d)]
                elif n == best and n >= size:
                    at.append((i, d))
        if not at:
            return out
        for i, d in at:
            if not used_i & set(range(i, i + best)) and not used_d & set(range(d, d + best)):
                used_i |= set(range(i, i + best))
                used_d |= set(range(d, d + best))
                out.append((i, d, best))


def test_tiling_against_all_places():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.choice("abcd") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.5:
            doc[3:3] = item[len(item) // 2 :] + item[: len(item) // 2]
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        d, i = (np.array([s[k] for s in seeds], dtype=np.int64) for k in (0, 1))
        assert sorted(decontaminate.tiles(d, i, 3)) == sorted(plain_tiles(doc, item, 3))


def test_moved_passages_are_caught_and_blocks_agree(spark, docs, empty):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(12)] + [(50, "Too short"), (51, None), (None, "no id here at all but words"), (3, " ".join(f"w3x{j}" for j in range(30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[4][1].split()
    more = spark.createDataFrame([(900, "some lead " + " ".join(w[15:] + ["and"] + w[:15]) + " tail"), (901, " ".join(w[:8])), (902, items[5][1].upper() + ", " + items[6][1]), (903, "far too short, too short"), (904, "TOO: short"), (905, "too"), (906, "too so short")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    for size in (decontaminate.BLOCK_BYTES, 300):
        got = decontaminate.contaminated(every, bench, block_bytes=size).collect()
        assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in got) == [(900, 4, 2, 1.0), (902, 5, 1, 1.0), (902, 6, 1, 1.0), (903, 50, 1, 1.0), (904, 50, 1, 1.0)]
        kept = decontaminate.drop_contaminated(every, bench, block_bytes=size)
        assert kept.columns == every.columns and sorted(r[0] for r in every.subtract(kept).collect()) == [900, 902, 904] and kept.count() == every.count() - 3
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("1 = 0")).count() == docs.count()


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Com", "http://a.com/", "https://x.Example.com/en/1?q=/#z", "https://www.example.com/en/1", "https://b.www.example.com/en/", "http://xexample.com/en/", "http://n.net/es/", "http://n.net/es", "http://net/es/a#b", "a://b://c/d"]
    # one host whose numbered pages are blocked under one branch and free under the other
    urls += [f"http://h.net/es/{k}" for k in range(40)] + [f"http://h.net/en/{k}" for k in range(40)] + [f"http://deep.org/{'/'.join('abcdefghijkl')}/{k}" for k in range(3)]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string").withColumn("template", F.lit("clash"))
    got = {r["page_id"]: r for r in urltree.judge(pages, RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "allow")
    assert got[len(urls) - 1]["template"] == "/*" * 13
    assert urltree.judge(pages.where("1 = 0"), RULES).count() == 0


def test_templates_reject_by_purity(spark):
    rules = [("block", "h.org", "/p/1"), ("allow", "ok.org", "/")]
    urls = [f"http://h.org/p/{k}" for k in range(200)] + [f"http://h.org/q/{k}" for k in range(30)] + [f"http://ok.org/{c}/{k}" for c in "abc" for k in range(60)]
    got = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r["verdict"] for r in got if r["host"] == "ok.org"} == {"allow"}
    # pages without a rule share the template of pages that are all blocked; another branch has no label and stays free
    assert {r["verdict"] for r in got if r["path"].startswith("/p/") and r["rule"] is None} == {"block"}
    assert {r["verdict"] for r in got if r["path"].startswith("/q/")} == {"allow"}


def plain_templates(rows):
    """Template of each (host, shape): the tree walked in plain Python, level by level to the deepest segment."""
    at = {(h, s): "" for h, s, *_ in rows}
    parts = {(h, s): [x for x in s.split("/") if x] for h, s, *_ in rows}
    for d in range(max(map(len, parts.values()), default=0)):
        groups = {}
        for h, s, n, a, b in rows:
            if len(parts[h, s]) > d:
                kids = groups.setdefault((h, at[h, s]), {})
                old = kids.get(parts[h, s][d], (0, 0, 0))
                kids[parts[h, s][d]] = (old[0] + n, old[1] + a, old[2] + b)
        step = {}
        for node, kids in groups.items():
            n_all, a_all, b_all = (sum(v[k] for v in kids.values()) for k in range(3))
            for seg, (n, a, b) in kids.items():
                if n < urltree.MIN_URLS or n < urltree.MIN_SHARE * n_all:
                    step[node, seg] = "*"
                    continue
                share = b_all / (a_all + b_all) if a + b else 0
                near = a + b and abs(b - (a + b) * share) <= urltree.DIFFERENT * math.sqrt((a + b) * max(share * (1 - share), 1e-9))
                step[node, seg] = "+" if near else seg
        at = {(h, s): t + "/" + step[(h, t), parts[h, s][d]] if len(parts[h, s]) > d else t for (h, s), t in at.items()}
    return at


def test_templates_against_a_plain_tree_at_any_depth(spark):
    rng = np.random.default_rng(5)
    rows = {}
    for _ in range(900):
        host = f"h{rng.integers(3)}"
        shape = "".join(f"/{'abc'[int(rng.integers(3) * rng.random())]}" for _ in range(rng.integers(0, 5)))
        if rng.random() < 0.4:
            shape += "/x" * 11 + ("/p" if rng.random() < 0.5 else "/q") + f"/r{rng.integers(4)}"
        n, a, b = rows.get((host, shape), (0, 0, 0))
        blocked = rng.random() < (0.9 if "/p" in shape else 0.1)
        known = rng.random() < 0.7
        rows[host, shape] = (n + 1, a + int(known and not blocked), b + int(known and blocked))
    rows = [(*k, *v) for k, v in rows.items()]
    got = {(r["host"], r["shape"]): r["template"] for r in urltree.templates(spark.createDataFrame(rows, "host string, shape string, n long, allow long, block long")).collect()}
    assert got == plain_templates(rows)
    # branches that differ only at the twelfth segment and deeper are told apart
    assert any(t.count("/") > 12 and "/p" in t for t in got.values()) and any("/q" in t for t in got.values())


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">X</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &lt;1&gt;</h1><p><b>Bold</b>ly  said.<br><p>Second
 line<ul><li>one<li>two</ul></article><footer>&copy; foot</footer></body></html>"""


def test_blocks_of_a_page():
    found = htmltext.blocks(PAGE)
    assert [b[1] for b in found if htmltext.teach(b[0])] == ["Head <1>", "Boldly said.", "Second line", "one", "two"]
    assert [b[1] for b in found if not htmltext.teach(b[0])] == ["T & t", "X", "Buy", "© foot"]
    for odd in ("", "<", "a < b", "<p", "<!-- x", "<script>never", "</p></div>", "<p>" * 3000 + "deep", "&#0;&bogus;", "plain"):
        htmltext.blocks(odd)
    assert htmltext.blocks("a < b")[0][1] == "a < b"


def test_gradients_of_the_recurrent_labeller():
    rng = np.random.default_rng(0)
    z, wh = rng.normal(size=(5, 3, 4 * htmltext.HIDDEN)).astype(np.float32), rng.normal(size=(htmltext.HIDDEN, 4 * htmltext.HIDDEN)).astype(np.float32) * 0.2
    out, kept = htmltext.run_lstm(z, wh)
    weight = rng.normal(size=out.shape).astype(np.float32)
    dz, dwh = htmltext.back_lstm(weight, kept, wh)
    for at in ((0, 1, 2), (4, 0, 20), (2, 2, 50)):
        up, down = z.copy(), z.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = ((htmltext.run_lstm(up, wh)[0] - htmltext.run_lstm(down, wh)[0]) * weight).sum() / 2e-2
        assert abs(slope - dz[at]) < 2e-2
    x = rng.normal(size=(4, 2, 3)).astype(np.float32)
    lengths = np.array([4, 2])
    assert np.array_equal(htmltext.flipped(htmltext.flipped(x, lengths), lengths), x)


def test_main_text_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u", "<p>no article</p>"), (10**6 + 3, "u", PAGE), (None, None, PAGE)], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").unionByName(odd).withColumn("text", F.lit("clash"))
    model = htmltext.fit_labeller(every)
    got = htmltext.extract(every, model).select("row.page_id", "row.html", "text", "n_chars").collect()
    assert len(got) == every.count()
    for r in got:
        want = " ".join(b[1] for b in htmltext.blocks(r["html"] or "") if htmltext.teach(b[0]))
        if r["page_id"] is None or r["page_id"] < 10**6:
            assert r["text"] == want
        assert r["n_chars"] == len(r["text"])
    assert {r["text"] for r in got if not r["html"]} == {""}
    assert htmltext.fit_labeller(every.where("1 = 0")) is not None
    assert htmltext.extract(every.where("1 = 0"), model).count() == 0


def test_sql_of_the_queries(spark, sf):
    import __spark_entry__ as entry
    from sondage.llm.queries import ORACLE

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLE.items():
        df = entry.queries()[name](spark, sf)
        cur = con.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall()), name


def plain_near(texts):
    """The smallest id that each text reaches by five-word similarities of 0.8 or more."""

    def plain(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {k: plain(t) for k, t in texts.items()}
    ids = sorted(sets)
    return plain_components(ids, [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert 4 <= len(names) <= 5 and cp.ORACLE_SQL is None
    held = [docs]
    for _, stage in cp.STAGES:
        held.append(stage(spark, held[-1], sf))
    for before, after in zip(held[:-2], held[1:-1]):
        assert after.columns == before.columns and 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0
    sizes = [d.count() for d in held]
    done = cp.run(spark, sf)
    assert done.count() == sizes[-1]
    # only the last stage's rows are left in the shared folder
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    assert len(list(top.glob("corpus-*"))) == 1
    # near copies: the smallest id of each component by five-word similarity stays
    texts = {r["doc_id"]: r["text"] for r in held[2].select("doc_id", "text").collect()}
    root = plain_near(texts)
    assert {r["doc_id"] for r in held[3].select("doc_id").collect()} == set(root.values())
    assert set(root.values()) < set(texts)
    # the mix keeps texts and columns
    assert held[5].columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert held[5].select(docs.columns).exceptAll(held[4]).count() == 0
    sums = mixing.mix(held[4], mixing.label_weights(spark.read.parquet(f"{sf}/labels.parquet")))
    assert held[5].groupBy("source").agg(F.sum("taken").alias("w")).exceptAll(sums.groupBy("source").agg(F.sum("taken").alias("w"))).count() == 0
    # benchmark passages: nothing that is left covers an item
    assert decontaminate.contaminated(held[4], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0


def test_pipeline_odd_rows(spark, docs, sf):
    import corpus_pipeline as cp

    left = docs
    for _, stage in cp.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
        left.count()
    assert cp.STAGES[-1][1](spark, left, sf).count() > 0
    none = docs.where("1 = 0")
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(60):  # copies of one text with 1 to 8 of 200 words changed: five-word similarities around 0.8
        base = rng.choices(vocab, k=200)
        for n in (0, 1, 2, 4, 5, 8):
            other = list(base)
            for at in rng.sample(range(200), n):
                other[at] = rng.choice(vocab)
            texts.append(" ".join(other))
    texts += ["one two three", "One  two\tthree", "one two four", None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    root = plain_near(dict(enumerate(texts)))
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs).collect()}
    assert kept == set(root.values())
    assert len({r["doc_id"] for r in simhash.keep_one(docs).collect()}) > len(kept)
    assert nearcopies.keep_one(docs.where("1 = 0")).count() == 0


@pytest.mark.parametrize("block", [16])
def test_long_lists_of_unlike_texts_are_compared_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(5000)]
    frame = rng.choices(vocab, k=150)
    texts = [" ".join(frame + rng.choices(vocab, k=50)) for _ in range(150)]  # one template: similar at 0.6
    for k in range(0, 60, 3):  # near copies within the template's lists, not of the list's smallest member
        w = texts[k].split()
        w[170 + k % 7] = "changed"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.keep_one(docs).collect()}
    root = plain_near(dict(enumerate(texts)))
    assert kept == set(root.values()) and 150 <= len(kept) < len(texts)


def test_every_row_gets_one_share(spark, docs, labels):
    doubled = docs.unionByName(docs.where("doc_id < 5 or doc_id is null"))
    got = mixing.with_mix(doubled, mixing.label_weights(labels))
    assert got.columns == [*[c for c in docs.columns if c not in ("size", "target", "taken")], "size", "source_size", "target", "taken"]
    plain = mixing.mix(doubled, mixing.label_weights(labels))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
