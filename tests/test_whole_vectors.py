"""Queries over whole tables that have no SQL, against brute force over small fixtures."""

import numpy as np
import pytest

from tidemark import registry
from tidemark.operators import clustering

SF = "/root/testdata/sf0.001"


def brute_pairs(spark):
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    x = np.array([r[2] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if abs(rows[i][0] - rows[j][0]) * 600 <= 48 * 3600 and s[i, j] >= 0.3]
    return [(rows[i][0], rows[j][0], s[i, j], rows[i][1] == rows[j][1]) for i, j in near]


def test_similar_pairs_of_all_vectors(spark):
    """Document vectors: the windows of the smallest table are cells of their own, so candidates find every pair."""
    from tidemark.plans.views import view
    from tidemark.queries_events import story_items

    rows = story_items(lambda name: view(spark, SF, name)).select("id", "at", "embedding").collect()
    expected = {}
    for i, r in enumerate(sorted(rows)):
        for o in sorted(rows)[i + 1 :]:
            x, y = (np.array(t["embedding"], dtype=np.float64) for t in (r, o))
            n = np.linalg.norm(x) * np.linalg.norm(y)
            if abs(r["at"] - o["at"]) <= 48 * 3600 and n and x @ y / n >= 0.8:
                expected[r["id"], o["id"]] = x @ y / n
    got = {(r["a"], r["b"]): r["similarity"] for r in registry.QUERIES["j3_similar_pairs_whole"](spark, SF).collect()}
    assert expected and got == pytest.approx(expected)


def test_threshold_sweep_of_all_vectors(spark):
    thresholds = [0.3, 0.35, 0.4, *clustering.SWEEP]
    assert len(clustering.SWEEP) == 10
    pairs = brute_pairs(spark)
    expected = {t: (sum(same for *_, s, same in pairs if s >= t), sum(not same for *_, s, same in pairs if s >= t)) for t in thresholds}
    rows = registry.QUERIES["a17_threshold_sweep"](spark, SF).collect()
    assert len(rows) == 13 and {r["threshold"]: (r["tp"], r["fp"]) for r in rows} == expected


def test_sweep_of_documents_finds_near_copies(spark):
    rows = sorted(registry.QUERIES["a17_threshold_sweep_whole"](spark, "/root/testdata/sf0.01").collect())
    assert [r["threshold"] for r in rows] == sorted(clustering.SWEEP) and all(r["tp"] > 0 for r in rows)
    assert all(x["tp"] >= y["tp"] and x["fp"] >= y["fp"] for x, y in zip(rows, rows[1:]))
