"""What keeps a larger corpus within memory, and links that only one of two methods finds; rows are made here."""

import os
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sondage.llm import nearcopies, ranked, simhash
from sondage.llm.common import written
from sondage.session import SHUFFLES_GO, cut_lineage, ensure_checkpoint_dir


def test_index_has_small_row_groups(spark, monkeypatch):
    long = spark.range(400).repartition(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64("id", i)).alias("v"))
    back = written(long, "long", 65_536)
    group = pq.ParquetFile(back.inputFiles()[0].removeprefix("file:")).metadata
    assert group.num_row_groups > 4 and back.exceptAll(long).count() == 0 and back.count() == 400
    asked = []
    monkeypatch.setattr(ranked, "written", lambda df, name, group_bytes=None: (asked.append(group_bytes), df)[1])
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen")], "doc_id long, text string")
    found = ranked.search(docs, spark.createDataFrame([(9, "hen")], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in found] == [2] and asked == [ranked.GROUP_BYTES]


def test_near_copies_of_the_pipeline_are_linked_by_fingerprint_too(spark, sf):
    import corpus_pipeline as cp

    base = "alpha beta gamma " * 400
    texts = [base + " ".join(f"{tail}{k}" for k in range(60)) for tail in "xy"] + ["something else that is not alike at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # one fingerprint, but few shingles in common
    assert sorted(r["doc_id"] for r in cp.one_of_each(spark, docs, sf).collect()) == [0, 2]


def test_shuffle_files_go_once_their_rows_are_written(spark):
    tops = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(SHUFFLES_GO)
    dealt = spark.range(5_000).repartition(7, "id")  # held here, so no garbage collection takes its files
    kept = cut_lineage(dealt)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLES_GO) == setting
    assert kept.count() == dealt.count() == 5_000


def test_near_copies_leave_only_their_components_behind(spark):
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(top))
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(None, "a text without an id"), (None, "a text without an id"), (3, long), (3, long), (5, long + " more"), (None, long), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = nearcopies.keep_one(docs, further=simhash.hubs)
    assert {tuple(r) for r in kept.collect()} == {(3, long), (7, None), (None, "a text without an id")} and kept.count() == 3
    assert sum(n.startswith("rdd-") for n in set(os.listdir(top)) - before) == 1
