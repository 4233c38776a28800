import numpy as np

from catalog_fusion.llm.parity_join import _next_pairs


def test_rounds_give_every_pair_in_whatever_order_rows_come(spark):
    nodes = list(range(100, 112))
    bits = np.zeros(16, np.uint64).tobytes()  # all distances tie
    sketches = spark.createDataFrame([(n, bits) for n in nodes], "node long, bits binary")

    def given(order, low, high):
        rows = [(1, n, 40, len(nodes), 100 + n % 2) for n in order]
        members = spark.createDataFrame(rows, "name long, node long, n long, size long, label long").coalesce(1)
        return {(r["x"], r["y"]) for r in _next_pairs(members, sketches, low, high).collect()}

    first, rest = given(nodes, 0, 16), given(nodes[::-1], 16, 1 << 62)
    assert len(first) == 16 and not first & rest
    assert first | rest == {(x, y) for x in nodes for y in nodes if x < y and (x - y) % 2}
