import random

from talusgrid.llm import near


def brute(texts, size=5, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().split()
        if not w:
            return None
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}

    sets = [shingles(t) for t in texts]
    n = len(sets)
    links = [0] * n
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None:
                if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [(find(i), links[i]) for i in range(n)]


def made_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "a b", "a b", "a  b c", "A b c", "é", "x" * 3000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    line = [rng.choice(words) for _ in range(20)]
    texts += [" ".join(line + [rng.choice(words) for _ in range(30)]) for _ in range(30)]
    return texts + texts[12:16]


def found(spark, texts, **options):
    df = spark.createDataFrame(
        [(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, digest string, root long"
    ).repartition(3)
    rows = near.similar(df, **options).collect()
    assert len(rows) == len(texts)
    return [(r.class_id, r.n_links) for r in sorted(rows, key=lambda r: r["_id"])], df


def test_equals_brute_force(spark):
    texts = made_texts()
    got, df = found(spark, texts)
    assert got == brute(texts)
    kept = near.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(texts)})


def test_groups_larger_than_a_block(spark):
    texts = made_texts()
    got, _ = found(spark, texts, block=3)
    assert got == brute(texts)


def test_thresholds_of_the_posterior():
    least = [near.least_matches(n, 0.8, 1e-7) for n in near.STEPS]
    assert least == sorted(least) and 0 < least[0] < 8 and least[-1] < 40
    assert near.least_matches(16, 0.8, 1e-2) > least[0]


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "z"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    rows = near.similar(df).collect()
    assert sorted(r.n_links for r in rows) == [0, 2, 2, 2]
    assert near.keep_first(df).count() == 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near.similar(df).count() == 0


def test_many_repeated_rows_and_null_ids(spark):
    """Rows repeated with one id and text are copies of each other; one of them stays."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(None, text, "a")] * 3000 + [(7, text + " more", "b")] * 2 + [(8, "quite another text of seven words", "c"), (None, None, "d"), (None, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = near.similar(df).collect()
    assert len(found) == len(rows)
    assert sorted({r.n_links for r in found}) == [0, 3001]
    kept = near.keep_first(df)
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(None, text, "a"), (8, rows[-3][1], "c"), (None, None, "d")]))
