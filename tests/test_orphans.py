import random

from tessitura.operators import orphans as O

REFS = "ref_table string, ref_key string, key string, time long, period string"


def brute(refs, parents, removals):
    out = set()
    for table, ref, key, time, period in refs:
        if key is None:
            continue
        held = [t for k, t in parents if k == key]
        gone = [t for k, t in removals if k == key and t is not None and time is not None and t <= time]
        by_then = [t for t in held if time is not None and t <= time]
        if not held:
            out.add((table, ref, key, period, "missing"))
        elif not by_then:
            out.add((table, ref, key, period, "late"))
        elif gone and max(gone) >= max(by_then):
            out.add((table, ref, key, period, "deleted"))
    return out


def run(spark, refs, parents, removals, **settings):
    found = O.orphan_references(
        # Extra columns of clashing names are ignored.
        spark.createDataFrame([(*r, 1, "x") for r in refs], REFS + ", range int, reason string"),
        spark.createDataFrame([(*p, True) for p in parents], "key string, time long, born boolean"),
        spark.createDataFrame(removals, "key string, time long"), **settings,
    ).collect()
    rows = {tuple(r) for r in found}
    assert len(rows) == len(found)
    return rows


def made(seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 10 + [f"k{i}" for i in range(40)] + ["z" * 300, ""])
    refs = [(rng.choice("ab"), f"r{i % 90}", rng.choice([key(), None]) if i % 9 == 0 else key(), rng.choice([None, *range(20)]), "2024-01") for i in range(400)]
    parents = [(key(), rng.choice([O.FIRST_INSTANT, *range(20)])) for _ in range(60)] + [(None, 3)]
    removals = [(key(), rng.choice([None, *range(20)])) for _ in range(30)] + [(None, 3)]
    return refs + refs[:20], parents + parents[:5], removals


def test_equals_brute_force(spark):
    for seed in range(3):
        refs, parents, removals = made(seed)
        assert run(spark, refs, parents, removals) == brute(refs, parents, removals)
        # Small ranges and splits give the same: the hot key is spread.
        assert run(spark, refs, parents, removals, range_rows=10) == brute(refs, parents, removals)


def test_one_parent_collected_many_times(spark):
    refs = [("a", f"r{i}", k, t, "2024-01") for i in range(40) for k in ("hot", "gone") for t in (None, 5, 50, 400)]
    parents = [("hot", t) for t in range(10, 300)] + [("gone", 1)]
    removals = [("hot", 350), ("gone", 1), ("never", 2)]
    assert run(spark, refs, parents, removals, range_rows=20) == brute(refs, parents, removals)


def test_empty_tables(spark):
    refs, parents, removals = made(7)
    assert run(spark, refs, [], removals) == brute(refs, [], removals)
    assert run(spark, refs, parents, []) == brute(refs, parents, [])
    assert run(spark, [], parents, removals) == set()


def test_report(spark):
    found = spark.createDataFrame([("a", "r1", "k", "2024-01", "late"), ("a", "r2", "k", "2024-01", "late")], "ref_table string, ref_key string, document_id string, period string, reason string")
    assert [tuple(r) for r in O.orphan_report(found).collect()] == [("a", "2024-01", "late", 2, 1)]
