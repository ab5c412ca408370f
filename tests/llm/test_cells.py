"""Embeddings in many cells: what is shuffled, and links across borders, in cores and between equal vectors, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidemark.llm import embedding_dedup


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def vectors(rng, n):
    x = rng.standard_normal((n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_shuffle_of_few_copies(spark, tmp_path):
    """Each vector goes to a few cells only: bytes shuffled stay near those of the vectors, links at the threshold are found."""
    rng = np.random.default_rng(3)
    n, pairs = 40_000, 2_000
    x = vectors(rng, n)
    other = vectors(rng, pairs)
    other -= (other * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    near = 0.9505
    x[-pairs:] = near * x[:pairs] + np.sqrt(1 - near**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x.astype(np.float32))}), tmp_path / "embeddings.parquet")
    before = shuffled(spark)
    got = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).toPandas().sort_values("vec_id")
    assert shuffled(spark) - before < 8 * n * 64 * 4
    assert got["n_links"].sum() >= 0.98 * 2 * pairs


def test_cells_cores_and_copies(spark):
    rng = np.random.default_rng(4)
    x = vectors(rng, 9_000)
    x[:2000] = x[0] + 0.1 * vectors(rng, 2000)  # a core: all pairs link
    x[2000:3500] = x[2000] + 0.23 * vectors(rng, 1500)  # at the threshold
    x[3500:5000] = x[rng.integers(5000, 5100, 1500)] + 0.15 * vectors(rng, 1500)
    x[8900:] = x[rng.integers(0, 5100, 100)] * rng.uniform(0.5, 2, (100, 1))  # of the same direction, mostly
    x[8990:] = x[5:15]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.concatenate([(u[k : k + 1000] @ u.T >= 0.95).sum(1) - 1 for k in range(0, len(u), 1000)])
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(20_000, [1e200, 1e200]), (20_001, [1e-200, 1e-200]), (20_002, [1.0, -1.0]), (20_003, [3.0, 3.0]), (20_003, [3.0, 3.0]), (20_004, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({"target": 200}, {"target": 200, "leaf": 150}):  # the second compares blocks
        got = embedding_dedup.near_duplicates(df, **options).toPandas().groupby("vec_id").max()
        found = got["n_links"].to_numpy()[: len(x)]
        assert (found <= links).all()
        assert found.sum() >= 0.995 * links.sum()
        assert (found[:2000] == links[:2000]).all()
        assert (got["component_id"][:2000] == 0).all() and (got["component_id"][8990:9000] == 0).all()
        assert got["n_links"][20_000] == got["n_links"][20_003] == 3 and got["component_id"][20_003] == 20_000 and got["n_links"][20_002] == 0
