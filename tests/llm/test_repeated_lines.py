import random

from tessitura.llm import repeated_lines as R

SCHEMA = "registro long, id string, fonte string, texto string, text string, line_no int"


def key(line):
    return "".join(c.lower() for c in line if c.isalpha())


def brute(rows, min_letters=15, min_docs=5, share=0.05):
    docs, total = {}, {}
    for _, i, f, t in rows:
        if f is None:
            continue
        if i is not None:
            total.setdefault(f, set()).add(i)
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_letters and i is not None:
                docs.setdefault((f, key(line)), set()).add(i)
    gone = {k for k, v in docs.items() if len(v) >= min_docs and len(v) >= share * len(total[k[0]])}
    return sorted((r, n) for r, i, f, t in rows for n, line in enumerate((t or "").split("\n"), 1) if f is not None and (f, key(line)) in gone)


def made(seed, n):
    rng = random.Random(seed)
    common = ["Este texto não substitui o publicado, edição {}.", "AVALIE A CLAREZA DO TEXTO: {} estrelas", "Página da equipe {} de redação", "curta"]
    rows = []
    for r in range(n):
        lines = [f"Linha própria número {''.join(rng.choice('abcdefghij') for _ in range(18))}" for _ in range(rng.randint(0, 4))]
        lines += [c.format(rng.randint(1, 99)) for c in common if rng.random() < 0.3] * rng.randint(1, 2)
        rng.shuffle(lines)
        rows.append((r, f"d{rng.randint(0, n // 2)}", rng.choice(["a", "a", "a", "b", "c"]), "\n".join(lines)))
    return rows + [(n, None, "a", common[0]), (n + 1, "x", None, common[0]), (n + 2, "y", "a", None), (n + 3, "z", "a", ""), (n + 4, "z", "c", "\n\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_equals_brute_force(spark):
    for seed, n in ((1, 60), (2, 300)):
        rows = made(seed, n)
        found = R.find_repeated_lines(frame(spark, rows), "registro", "id", "fonte", "texto")
        assert sorted((x.registro, x.line_no) for x in found.collect()) == brute(rows)


def test_hot_line_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(r, f"d{r}", "a", "a mesma linha em todos\noutra linha repetida aqui") for r in range(400)]
        found = R.find_repeated_lines(frame(spark, rows), "registro", "id", "fonte", "texto")
        assert found.count() == 800
        blocks = R.find_repeated_blocks(frame(spark, rows), "registro", "id", "fonte", "texto").collect()
        assert [(b.n_lines, b.docs, b.places) for b in blocks] == [(2, 400, 400)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clean_text(spark):
    rows = [(r, f"d{r}", "a", f"própria {'abcdefgh'[r]} linha do documento\numa linha que se repete" if r < 7 else None) for r in range(8)]
    clean = {x.registro: (x.text, x.removed) for x in R.remove_repeated_lines(frame(spark, rows), "registro", "id", "fonte", "texto").collect()}
    assert clean[0] == ("própria a linha do documento", 1) and clean[7] == (None, 0)
    assert R.remove_repeated_lines(frame(spark, rows).limit(0), "registro", "id", "fonte", "texto").count() == 0


def brute_blocks(rows, min_docs=5, share=0.05):
    seqs, total = [], {}
    for _, i, f, t in rows:
        seqs.append((f, i, [key(x) for x in t.split("\n") if len(key(x)) >= 15]))
        total.setdefault(f, set()).add(i)
    docs, places = {}, {}
    for f, i, s in seqs:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                docs.setdefault((f, tuple(s[a:b])), set()).add(i)
                places[f, tuple(s[a:b])] = places.get((f, tuple(s[a:b])), 0) + 1
    good = {k for k, v in docs.items() if len(v) >= min_docs and len(v) >= share * len(total[k[0]])}
    held = {(f, part, places[f, b]) for f, b in good for part in (b[1:], b[:-1])}
    return sorted((k[0], len(k[1]), len(docs[k]), places[k]) for k in good if (*k, places[k]) not in held)


def test_blocks_are_whole_however_long(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(18))
    notice, other = [f"aviso legal {word()}" for _ in range(40)], [f"rodapé do sítio {word()}" for _ in range(6)]
    rows = []
    for r in range(60):
        own = [f"linha própria {word()}" for _ in range(rng.randint(1, 4))]
        lines = own[:1] + (notice if r % 3 == 0 else []) + own[1:2] + (other[: rng.choice([2, 4, 6])] if r % 2 else []) + own[2:]
        rows.append((r, f"d{r}", "ab"[r % 5 == 0], "\n".join(lines)))
    got = R.find_repeated_blocks(frame(spark, rows), "registro", "id", "fonte", "texto").collect()
    assert sorted((b.source, b.n_lines, b.docs, b.places) for b in got) == brute_blocks(rows)
    assert max(b.n_lines for b in got) == 40
