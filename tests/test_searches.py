"""Searches in rows without structure write no vector for a meeting and leave one table."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sondage.operators import neighbours
from sondage.session import ensure_checkpoint_dir


def test_last_round_and_hash_tables_send_no_visits(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 50)
    monkeypatch.setattr(neighbours, "RUN_BLOCKS", 2)
    sent, real = [], neighbours._search
    monkeypatch.setattr(neighbours, "_search", lambda v, r, n: (sent.append(1), real(v, r, n))[1])
    x = np.random.default_rng(7).normal(size=(700, 8))
    x[::90] = x[3]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "respondent_id long, x array<double>").repartition(5).cache()
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(Path(root).rglob("rdd-*"))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = np.argsort(far, axis=1, kind="stable")[:, :4]
    got = neighbours.knn(df, F.col("x"), 4).collect()
    # two rounds of visits, the third meets blocks
    assert len(sent) == 2 and len(got) == 2800
    assert all(np.isclose(r["dist"], far[r["respondent_id"], want[r["respondent_id"], r["rank"] - 1]]) for r in got)
    assert len(set(Path(root).rglob("rdd-*")) - before) <= 1
    sent.clear()
    found = neighbours.knn(df, F.col("x"), 4, method="lsh", lsh=neighbours.Lsh(sample=300))
    rows = found.collect()
    assert not sent and all(np.isclose(r["dist"], far[r["respondent_id"], r["nbr_id"]]) for r in rows)
    assert neighbours.recall(found, neighbours.knn(df, F.col("x"), 4)).first()["recall"] > 0.9


def test_a_mask_of_pairs_bounds_the_nearest():
    rng = np.random.default_rng(2)
    asked, points, mask = rng.normal(size=(30, 5)), rng.normal(size=(80, 5)), rng.random((30, 80)) < 0.1
    mask[4] = False
    i, j, far = neighbours._closest(asked, points, np.full(30, np.inf), 6, mask)
    all_far = np.where(mask, neighbours._distances(asked, points), np.inf)
    for k in range(30):
        mine = j[i == k]
        assert list(mine) == list(np.argsort(all_far[k], kind="stable")[: min(6, mask[k].sum())])
    assert mask[i, j].all() and (np.diff(i) >= 0).all()
