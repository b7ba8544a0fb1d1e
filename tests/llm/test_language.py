import numpy as np

from talusgrid.llm import language, queries


def test_gradients():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 257, (5, language.WINDOW)).astype(np.int16)
    y = np.array([0, 1, 2, 1, 0])
    net = language.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = language.predict(net.tables(), x)
        return -np.log(p[np.arange(5), y]).mean()

    g = net.grads(x, y)
    for name in net.p:
        flat = net.p[name].ravel()
        for k in rng.integers(0, flat.size, 3) if name != "e" else [x[0, 3] * language.EMBED, x[1, 9] * language.EMBED + 2]:
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-6 - g[name].ravel()[k]) < 1e-4


def test_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    train = spark.createDataFrame([("aaa bbb " * 9, "x"), ("ccc ddd " * 9, "y")] * 5, "text string, lang string")
    net, classes = language.fit(train, steps=30)
    assert classes == ["x", "y"]
    df = spark.createDataFrame(
        [(1, None, "k"), (2, "", "k"), (3, "12 !?", "k"), (4, "é", "k"), (4, "é", "k"), (5, "aaa " * 5000, "k")],
        "id long, text string, lang_pred string",
    )
    rows = language.identify(df, net, classes).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.lang_pred in classes for r in rows[3:])
    assert language.identify(df.limit(0), net, classes).count() == 0
    none, _ = language.fit(train.limit(0))
    assert none is None and {r.lang_pred for r in language.identify(df, none, []).collect()} == {"und"}


def test_copies_leave_the_sample_to_other_languages(spark, monkeypatch):
    learnt = {}
    monkeypatch.setattr(language.Network, "train", lambda self, x, y, steps: learnt.update(x=x, y=y) or self)
    dealt = "pmod(xxhash64(concat('copy number ', id), 3), 1000000)"
    first = spark.range(5000).selectExpr(f"min_by(concat('copy number ', id), {dealt}) AS t").first().t
    rows = [(first, "a")] * 300 + [(f"{lang} text {k} of it", lang) for lang in "abc" for k in range(200)]
    language.fit(spark.createDataFrame(rows, "text string, lang string"), rows=20)
    for k in range(3):
        assert len(np.unique(learnt["x"][learnt["y"] == k], axis=0)) > 10, k


def test_many_equal_rows_in_any_language(spark, monkeypatch):
    learnt = {}
    monkeypatch.setattr(language.Network, "train", lambda self, x, y, steps: learnt.update(x=x, y=y) or self)
    for crowded in "abc":
        rows = [(f"{lang} words number {k} " * 20, lang) for lang in "abc" for k in range(60)]
        rows += [("the same text again and again " * 9, crowded)] * 6000
        _, classes = language.fit(spark.createDataFrame(rows, "text string, lang string"), rows=40)
        assert classes == ["a", "b", "c"]
        for k in range(3):
            assert len(np.unique(learnt["x"][learnt["y"] == k], axis=0)) > 30, (crowded, k)


def test_rare_languages_are_classes_too(spark, monkeypatch):
    monkeypatch.setattr(language.Network, "train", lambda self, x, y, steps: self)
    rows = [(f"words of {k}", f"l{k:03}") for k in range(300)] + [("common words", "l000")] * 500
    _, classes = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(classes) == 300


def test_predictions_are_those_of_each_whole_text_alone(spark):
    """The batched prediction against windows of one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    net, classes = language.fit(docs, steps=60)
    for r in language.identify(docs.select("doc_id", "text"), net, classes).collect():
        raw = (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
            continue
        x = language.windows_of(raw)
        p = language.predict(net.tables(), x)
        weight = (x < 256).sum(axis=1)
        share = (p * weight[:, None]).sum(axis=0) / weight.sum()
        assert r.lang_pred == classes[share.argmax()] and abs(r.lang_score - share.max()) < 1e-5, (r.doc_id, r.lang_score, share.max())
