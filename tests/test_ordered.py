import hashlib
import io
from contextlib import redirect_stdout

import numpy as np

from tessitura.operators import ordered as O
from tessitura.plans import registry


def test_nearest_rank(spark):
    rng = np.random.default_rng(4)
    made = {"a": np.round(rng.normal(size=900), 2), "b": np.full(300, 2.0), None: rng.normal(size=41), "d": np.array([5.0]), "e": np.arange(11.0), "f": np.array([1.0, np.nan, np.inf])}
    rows = [(k, float(v)) for k, x in made.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    # Many small ranges: a group's values lie in several of them.
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for share in (0.95, 0.0, 0.5, 1.0):
            got = {r.k: (r.n, r.ranked) for r in O.nearest_rank(df, ("k",), "v", share).collect()}
            want = {k: (len(x), float(np.sort(x)[round(share * (len(x) - 1))])) for k, x in made.items()}
            assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_ordered_digest(spark):
    made = {"x": [f"c{i % 700:04}" for i in range(1500)], "y": ["é", "z", "Z"], None: ["n", None], "w": [None]}
    df = spark.createDataFrame([(k, "m", i) for k, x in made.items() for i in x], "k string, m string, i string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.k: (r.n, r.digest) for r in O.ordered_digest(df, ("k", "m"), "i").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    held = {k: sorted({i for i in x if i is not None}, key=str.encode) for k, x in made.items()}
    assert got == {k: (len(set(x)), hashlib.sha256("".join(i + "\n" for i in held[k]).encode()).hexdigest() if held[k] else None) for k, x in made.items()}


def test_no_query_gathers_a_group(spark, data):
    for name in ("latency_p95", "config_metrics", "ordered_hash"):
        text = io.StringIO()
        with redirect_stdout(text):
            registry.queries()[name](spark, data).explain()
        assert "collect_list" not in text.getvalue(), name
