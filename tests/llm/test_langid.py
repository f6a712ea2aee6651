import numpy as np

from scholia.llm import langid


def small(seed=3):
    return langid.train([b"the cat and the dog", "été où ça".encode()] * 8, ["en", "fr"] * 8, seed, dims=3, per_width=2, epochs=1)


def test_gradients_agree_with_differences():
    net = small()
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    mask = (net.filters != 0).astype(float)
    x, y, weight = langid.cut([b"the dog and", "où ça été".encode(), b"a dog"])[0], np.array([0, 1, 0]), np.array([1.0, 2.0, 0.5])

    def loss():
        top = np.maximum(net.pooled(x)[2] + net.bias, 0)
        return float(-(np.log(langid.softmax(top @ net.out + net.out_bias))[np.arange(3), y] * weight).mean())

    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    for p, g in zip(params, langid._gradients(net, x, y, weight, mask), strict=True):
        for at in {int(np.abs(g).argmax()), g.size // 2, 0}:
            old, got = p.flat[at], []
            for step in (1e-6, -1e-6):
                p.flat[at] = old + step
                got.append(loss())
            p.flat[at] = old
            if (mask.flat[at] if p is net.filters else at >= net.embed.shape[1] or p is not net.embed):
                assert abs((got[0] - got[1]) / 2e-6 - g.flat[at]) < 1e-5


def test_prediction_is_the_mean_over_all_windows():
    net = small()
    for text in ("the dog", "où " * 100, "x" * 256, "y" * 257, "the cat été " * 300, "é" * 5000):
        raw, at, total = text.encode(), 0, np.zeros(2)
        while True:
            part = raw[at : at + langid.WINDOW]
            new = len(part) - (langid.WINDOW - langid.STRIDE if at else 0)
            total += net.probabilities(np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] * max(new, 1)
            if at + langid.WINDOW >= len(raw):
                break
            at += langid.STRIDE
        (label,), (score,) = net.predict([text])
        assert label == net.labels[int(total.argmax())] and abs(score - total.max() / total.sum()) < 1e-5


def test_sample_takes_windows_from_everywhere_and_copies_once(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "train", lambda windows, langs: taken.append(list(zip(windows, langs, strict=True))))
    unlike = "".join(f"{i:07d} " for i in range(40_000))
    rows = [(i, "same text again and again", "en") for i in range(3000)] + [(9, unlike, "de"), (8, "kurz", "nl"), (7, None, "nl"), (6, "x", None), (5, "", "fr")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "h"), sample=100)
    got = taken[0]
    assert len(got) == len(set(got)) and sum(k == "en" for _, k in got) == 1 and sum(k == "nl" for _, k in got) == 1
    at = sorted(int(w.split()[1]) for w, k in got if k == "de")
    assert 60 < len(at) < 140 and at[len(at) // 2] > 10_000 and at[-1] > 35_000


def test_query_covers_all_rows_and_is_accurate_on_the_held_out_fold(spark, sf_dir):
    from scholia.llm.queries import op2_language

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_language(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (langid.crc_fold(r.doc_id) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.9


def test_edge_texts_nulls_and_clashing_columns(spark):
    net = langid.train([b"the cat and the dog went home " * 8, b"le chat et le chien vont ensemble " * 7] * 20, ["en", "fr"] * 20)
    long = "le chat et le chien vont ensemble " * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 34 !?", None), (None, "the cat and the dog", "b"), (5, long, "b"), (5, long, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(((r.id or 0, r.lang_pred, r.score) for r in langid.predict(df, net).collect()))
    assert [x[:2] for x in got] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "fr"), (5, "fr")]
    assert [x[2] for x in got if x[1] == "und"] == [0, 0, 0]
    kept = langid.keep_identified(df, net)
    assert kept.columns == df.columns and kept.count() == 3
    assert langid.predict(df.limit(0), net).count() == 0
    nothing = langid.fit(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(df, nothing).collect()] == ["und"] * 6


def test_a_network_fitted_to_reject_drops_gibberish_and_keeps_texts(spark, sf_dir):
    """Random letters go; documents held out, short texts and those whose language is told stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs.where(langid.fold() != 2), reject=True)
    assert langid.UNKNOWN in net.labels
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10))))
    odd = [" ".join(word() for _ in range(n)) for n in (60, 100, 400) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate([*odd, "xq zvw", None, "", "12 !", "_ 3"])]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), net, least=0.24).collect()}
    assert len(odd) in kept and not kept & set(range(len(odd) + 1, len(rows))) and len(kept) <= 0.1 * len(odd) + 1
    clean = docs.where(langid.fold() == 2)
    assert langid.keep_identified(clean, net, least=0.24).count() >= 0.995 * clean.count()
    assert langid.gibberish([], 5) == [] and langid.gibberish([b"12"], 5) == []
