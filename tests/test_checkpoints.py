"""Resuming from checkpoints: what they were made for decides, and a clean end removes them."""

import datetime as dt

from pyspark.sql import functions as F

from funnelscope.sources import checkpoints

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 5, 1)
LAYERS = "audit_id long, layer int, notes string, finished_at timestamp"


def test_resume(spark, tmp_path):
    layers, headers, removals = (f"{tmp_path}/{x}" for x in ("layers", "headers", "removals"))
    requests = spark.createDataFrame([(1, "u", "i", ["a"]), (2, "u2", "i", ["a"]), (3, "u", None, ["b"]), (4, "u", "i", ["b"]), (5, "u", "i", None), (6, "u", "i", [])],
                                     "audit_id long, url string, icp string, competitors array<string>")

    def found():
        rows = checkpoints.checkpoint_resume(spark, requests, layers, headers, removals).collect()
        return {r["audit_id"]: (r["state"], r["keywords"], r["sources"], [tuple(x) for x in r["completed"]]) for r in rows}
    assert found() == {i: ("none", None, None, []) for i in range(1, 7)}

    checkpoints.checkpoint_write(spark.createDataFrame(
        [(1, 1, "old", START), (1, 1, "new", START + HOUR), (1, 5, "five", START), (2, 1, "x", START), (3, 2, "two", START), (4, 5, "five", START), (4, 1, "one", START), (5, 1, "one", START)], LAYERS), layers)
    header = lambda i, icp="i", competitors=("a",), at=START: (i, "u", icp, competitors and list(competitors), ["k"], {"Home": "s"}, at)
    checkpoints.headers_write(spark.createDataFrame(
        [header(1, icp="former"), header(1, at=START + HOUR), header(2), header(3, icp=None), header(4), header(5, competitors=None)], checkpoints.HEADER_SCHEMA), headers)
    kept = (["k"], {"Home": "s"})
    expected = {1: ("resumed", *kept, [(1, "new"), (5, "five")]), 2: ("other target", None, None, []), 3: ("resumed", *kept, [(2, "two")]),
                4: ("competitors changed", *kept, [(1, "one")]), 5: ("resumed", *kept, [(1, "one")]), 6: ("none", None, None, [])}
    assert found() == expected

    checkpoints.checkpoints_remove(requests.where("audit_id in (1, 5)").select("audit_id", F.lit(START + HOUR).alias("removed_at")), removals)
    expected[1] = expected[5] = ("none", None, None, [])
    assert found() == expected
    # a later run of the same audit starts its own checkpoint
    checkpoints.checkpoint_write(spark.createDataFrame([(1, 2, "again", START + 2 * HOUR)], LAYERS), layers)
    checkpoints.headers_write(spark.createDataFrame([header(1, at=START + 2 * HOUR)], checkpoints.HEADER_SCHEMA), headers)
    expected[1] = ("resumed", *kept, [(2, "again")])
    assert found() == expected
