"""Nearest rows against brute force."""

import numpy as np
from pyspark.sql import functions as F

from funnelscope.llm import ann


def test_small_leaves_give_all_neighbours(spark):
    draw = np.random.default_rng(2)
    vectors = np.concatenate([draw.normal([10, 0, 0], 1, (20, 3)), draw.normal([0, 10, 0], 1, (2, 3)), draw.normal([0, 0, 10], 1, (1, 3))])
    tree = ann.Tree(np.array([[1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float), [[1, 2, 3], [], [], []])
    leaf = tree.assign(ann.unit(vectors))
    assert np.bincount(leaf).tolist() == [20, 2, 1]
    rows = spark.createDataFrame([(i, i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vectors, leaf))],
                                 "row long, vec_id long, vector array<double>, leaf int")
    got = ann.search(ann.Index(rows, tree, 1, 5), F.lit(True)).toPandas()
    assert got.groupby("query_id").size().to_dict() == {i: 5 for i in range(23)}
    near = ann.unit(vectors) @ ann.unit(vectors).T
    np.fill_diagonal(near, -2)
    exact = np.argsort(-near, 1)[:, :5]
    for i in range(20):
        assert got[got["query_id"] == i].sort_values("rank")["vec_id"].tolist() == exact[i].tolist()
