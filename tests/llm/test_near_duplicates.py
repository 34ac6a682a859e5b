import random
import re

from tessitura.llm import near_duplicates as N


def shingles(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, t=0.5):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if a is None or b is None or a == b or x is None or y is None:
                continue
            s, u = shingles(x), shingles(y)
            if s and u and len(s & u) >= t * len(s | u):
                out.add((min(a, b), max(a, b)))
    return out


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"palavra{i}" for i in range(400)]
    rows = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        rows.append((f"d{d:03}", " ".join(words)))
        for v in range(rng.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(int(len(words) * rng.uniform(0, 0.12))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                half = len(edited) // 2
                edited = edited[half:] + edited[:half]
            rows.append((f"d{d:03}v{v}", " ".join(edited)))
    same = "um texto igual que muitos documentos trazem por inteiro e sem mudança alguma"
    rows += [(f"s{i}", same.upper() if i % 2 else same + ".") for i in range(12)]
    return rows + [("s0", same), ("n1", None), (None, same), ("e1", ""), ("e2", ""), ("c1", "duas palavras"), ("c2", "duas palavras"), ("c3", "a b c"), ("c4", "A, b; c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "id string, texto string, text string, cls int")


def test_pairs_equal_brute_force(spark):
    rows = made(4)
    got = {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(frame(spark, rows), "id", "texto").collect()}
    want = brute(rows)
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 50
    assert ("c3", "c4") in got and ("c1", "c2") not in got


def test_hot_band_is_split_alike(spark, monkeypatch):
    rows = made(9)
    usual = {tuple(r) for r in N.near_duplicate_pairs(frame(spark, rows), "id", "texto").collect()}
    monkeypatch.setattr(N, "HOT", 2)
    assert {tuple(r) for r in N.near_duplicate_pairs(frame(spark, rows), "id", "texto").collect()} == usual


def test_groups(spark):
    rows = made(4)
    got = {r.id: r.group_id for r in N.near_duplicate_groups(frame(spark, rows), "id", "texto").collect()}
    for a, b in {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(frame(spark, rows), "id", "texto").collect()}:
        assert got[a] == got[b]
    assert len({got[f"s{i}"] for i in range(12)}) == 1 and got["d000"].startswith("d000")
    assert got["s3"] == "s0"
    assert got["c1"] == "c1" and got["e1"] == "e1" and "n1" not in got  # too short for a run, but with a text


def test_bands_follow_the_threshold(spark):
    assert N.banding(0.5) == (40, 3)
    for t in (0.2, 0.3, 0.4, 0.8, 0.95):
        bands, rows = N.banding(t)
        assert (1 - t**rows) ** bands <= N.BAND_MISS
    rows = made(6)
    for t in (0.3, 0.8):
        got = {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(frame(spark, rows), "id", "texto", threshold=t).collect()}
        want = brute(rows, t)
        assert got <= want and len(got) >= 0.97 * len(want) > 20


def test_words_are_those_of_the_pattern(monkeypatch):
    texts = ["Um texto, 2º e três: água_fria İstanbul", "", "...", "a" * 50 + " b", "電力 Ω≥µ x²", "um\ntexto\n2º", "fim ﬁm e\u0301"]
    for chunk in (300_000, 7, 1):
        monkeypatch.setattr(N, "_CHUNK", chunk)
        hashed = N.word_hashes(texts)
        words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
        assert [len(h) for h in hashed] == [len(w) for w in words]
        table = {}
        for h, w in zip(hashed, words):
            for a, b in zip(h.tolist(), w):
                assert table.setdefault(b, a) == a
        assert len(set(table.values())) == len(table)
    a, b = N.word_hashes(["um dois três", "dois um três"])
    assert N.sequence_hash(a) != N.sequence_hash(b) == N.sequence_hash(N.word_hashes(["DOIS, um; três!"])[0])


def test_bounds_and_empty(spark):
    least = N.least_matches(0.5, 0.001)
    assert len(least) == N.BATCHES and all(64 * (k + 1) * 0.5 <= m < 64 * (k + 1) * 0.75 for k, m in enumerate(least))
    assert N.near_duplicate_pairs(frame(spark, made(1)).limit(0), "id", "texto").count() == 0
