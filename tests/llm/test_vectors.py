import numpy as np

from tessitura.llm import vectors as V

SCHEMA = "chunk_id string, model string, embedding array<float>, indexed_at timestamp_ntz, item int, vector string"


def brute(rows, k=5):
    out, by = set(), {}
    for c, m, e in rows:
        if c is None or m is None or e is None:
            continue
        x = np.array([np.nan if v is None else v for v in e], np.float64)
        if len(x) == int(m.rsplit("-")[-1]) and np.isfinite(x).all() and x.any():
            by.setdefault(m, {})[c] = x / np.linalg.norm(x)
    for held in by.values():
        ids = sorted(held)
        x = np.stack([held[i] for i in ids])
        s = np.round(x @ x.T, 12)
        np.fill_diagonal(s, -9)
        for i in range(len(ids)):
            for j in np.argsort(-s[i], kind="stable")[: min(k, len(ids) - 1)]:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8))
    rows = [(f"c{i:05}", "m-8", (centres[i % 20] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(f"s{i}", "s-4", [1.0, 2.0, 3.0, float(i % 3)]) for i in range(30)]  # many ties
    rows += [("lone", "x-2", [1.0, 0.0]), ("bad1", "m-8", None), ("bad2", "m-8", [0.0] * 8), ("bad3", "m-8", [float("nan")] * 8), ("bad4", "m-8", [1.0] * 7), ("bad5", None, [1.0] * 8), (None, "m-8", [1.0] * 8), ("bad6", "m-8", [1.0] * 7 + [None]), rows[0], rows[1]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "clash") for r in rows], SCHEMA)


def pairs(spark, rows, **settings):
    return {tuple(r) for r in V.similar_pairs(frame(spark, rows), "chunk_id", "model", "embedding", "indexed_at", **settings).collect()}


def test_one_part_is_exact(spark):
    rows = made(300)
    assert pairs(spark, rows) == brute(rows)


def test_parts_keep_recall(spark):
    rows = made(3000)
    want, got = brute(rows), pairs(spark, rows, part_rows=200)
    assert len(want & got) >= 0.97 * len(want)


def test_divided_parts_keep_recall(spark, monkeypatch):
    """A router of four parts only: larger parts are divided again, twice."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 150)
    monkeypatch.setattr(V, "ROUTED_ROWS", 400)
    fitted = []
    divide = V._divide
    monkeypatch.setattr(V, "_divide", lambda *a: fitted.append(1) or divide(*a))
    rows = made(4000, 4)
    rows += [(f"h{i:03}", "m-8", (np.float32(1 + i) * np.array(rows[0][2], np.float32)).tolist()) for i in range(300)]  # can't be divided
    want, got = brute(rows), pairs(spark, rows, part_rows=60, fan_out=4, most_probes=4)
    assert fitted and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_exact_has_no_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 300)
    rows = made(1500, 6)
    assert pairs(spark, rows, part_rows=50, exact=True) == brute(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = made(400, 2)
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    assert pairs(spark, rows) == brute(rows)


def test_cells_are_bounded_on_both_sides(spark, monkeypatch):
    search = V._search

    def bounded(cell, k, dims):
        assert cell.num_rows <= 200, cell.num_rows
        return search(cell, k, dims)

    rows = made(400, 2)
    rows += [(f"l{i:03}", "m-8", (np.float32(1 + i) * np.array(rows[0][2], np.float32)).tolist()) for i in range(150)]  # one direction, many lengths
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    monkeypatch.setattr(V, "BATCH_ROWS", 50)
    monkeypatch.setattr(V, "_search", bounded)
    assert pairs(spark, rows) == brute(rows)


def test_many_equal_vectors(spark):
    rows = [(f"e{i:03}", "m-2", [1.0, 1.0]) for i in range(200)] + [("z", "m-2", [1.0, 0.9])]
    assert pairs(spark, rows) == brute(rows)


def test_copies_among_others(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 4)).astype(np.float32)
    rows = [(f"v{i:03}", "m-4", base[i % 40].tolist()) for i in range(90)]  # twice or thrice each
    rows += [(f"x{i:03}", "m-4", (3 * base[i]).tolist()) for i in range(10)]  # same direction, other length
    rows += [(f"h{i:03}", "m-4", base[0].tolist()) for i in range(60)] + rows[:7]
    assert pairs(spark, rows) == brute(rows)


def test_last_of_unlike_rows_and_empty(spark):
    rows = made(50)
    df = frame(spark, rows)
    assert V.usable_vectors(df, "chunk_id", "model", "embedding", "indexed_at").where("item like 'bad%'").count() == 0
    two = [("a", "m-2", [1.0, 0.0], 1), ("a", "m-2", [0.0, 1.0], 2), ("b", "m-2", [0.0, 1.0], 1)]
    d2 = spark.createDataFrame(two, "chunk_id string, model string, embedding array<float>, t int").selectExpr("chunk_id", "model", "embedding", "timestamp_seconds(t) as t")
    assert [r.vector for r in V.usable_vectors(d2, "chunk_id", "model", "embedding", "t").where("item = 'a'").collect()] == [[0.0, 1.0]]
    assert V.similar_pairs(df.limit(0), "chunk_id", "model", "embedding").count() == 0
