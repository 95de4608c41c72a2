import random

import pytest

from burstseries.llm.components import component_labels


@pytest.mark.parametrize("order", ["shuffled", "rising", "ends"])
def test_long_path(spark, order):
    """A chain of 400 versions, each linked to the next only, beside a star, a loop and a pair given twice."""
    n, rng = 400, random.Random(3)
    ids = list(range(100, 100 + n))
    if order == "shuffled":
        rng.shuffle(ids)
    elif order == "ends":  # small ids at both ends
        ids = ids[0::2] + ids[1::2][::-1]
    edges = list(zip(ids, ids[1:], strict=False))
    edges += [(5000, 6000 + i) for i in range(50)] + [(7, 7), (9001, 9000), (9000, 9001)]
    rng.shuffle(edges)
    got = {r["v"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(100, 100 + n), 100) | dict.fromkeys([5000, *range(6000, 6050)], 5000) | {9000: 9000, 9001: 9000}
    assert got == want
