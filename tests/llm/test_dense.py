"""Embeddings with a third of all vectors in one group of distinct near copies, against brute force."""

import numpy as np
import pandas as pd

from tidemark.llm import embedding_dedup


def test_dense_group_keeps_its_links(spark):
    rng = np.random.default_rng(1)
    n, group = 30_000, 10_000
    x, noise, centre = rng.standard_normal((n, 64)), rng.standard_normal((group, 64)), rng.standard_normal(64)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x[:group] = centre / np.linalg.norm(centre) + 0.235 * noise  # two of five of its pairs are at the threshold or above
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(x[k : k + 2000] @ x.T >= 0.95).sum(1) - 1 for k in range(0, n, 2000)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = embedding_dedup.near_duplicates(df, trees=3).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert (found <= links).all()
    assert found.sum() >= 0.98 * links.sum()
    assert (got["component_id"][:group].to_numpy()[links[:group] > 0] == 0).all()
