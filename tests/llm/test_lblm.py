import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import lblm
from scholia.llm.langid import crc_fold


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({c: " " for c in range(9, 14)}).split(" ") if w] + ["\n"]


def base(docs, training):
    seen = Counter(w for d in docs if training(d) for w in words(d[1]))
    n, v = sum(seen.values()), len(seen)
    return n, {(d[0], d[1]): (len(words(d[1])), sum(seen[w] > 0 for w in words(d[1])), sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(d[1]))) for d in docs}


@pytest.mark.parametrize("head", [lblm.HEAD, 200])
def test_query_equals_plain_counts_and_beats_them(spark, sf_dir, monkeypatch, head):
    from scholia.llm.queries import op5_lm

    monkeypatch.setattr(lblm, "HEAD", head)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, want = base(docs, lambda d: crc_fold(d[0], 7) != 2)
    texts = dict(docs)
    got = op5_lm(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n_tokens, n_known, score = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, crc_fold(r.doc_id, 7) == 2)
        assert abs(r.base_score - score) < 1e-6 * max(1, abs(score))
    held = [r for r in got if r.held_out]
    # Beyond the unigram base by a quarter of a decimal place a token.
    assert sum(r.score - r.base_score for r in held) > 0.25 * sum(r.n_tokens for r in held)


def vocabulary(counts):
    endings = sorted({w[-2:] for w in counts})[:3]
    bare = lblm.Vocabulary([], endings, {}, 0)
    totals = {}
    for w, n in counts.items():
        c = bare.class_of(w)
        totals[c] = (totals.get(c, (0, 0))[0] + n, totals.get(c, (0, 0))[1] + 1)
    return lblm.Vocabulary(list(counts.items()), endings, totals, 5)


def test_probabilities_of_all_words_sum_to_one(monkeypatch):
    monkeypatch.setattr(lblm, "LEAST_COUNT", 3)
    counts = {f"w{i}{e}": 1 + (i * 7) % 11 for i in range(30) for e in ("en", "on", "é", "x.", "st")}
    vocab = vocabulary(counts)
    rng = np.random.default_rng(0)
    words = [w.encode() for w in counts]
    found = np.concatenate([vocab.windows([words[i] for i in rng.integers(0, len(words), 12)]) for _ in range(40)])
    model = lblm.train(found, vocab, dims=4, least_steps=30)
    tables = model.tables()
    for context in found[:5, :-1]:
        every = np.array([[*context, row] for row in range(len(vocab.counts))])
        p = 10 ** model.log10(every, vocab, tables)
        assert abs(p.sum() - 1) < 1e-5
        # A class's common place is shared out among its rarer words and one place for unseen ones.
        for c in range(vocab.n_classes - 1):
            rest = [n for w, n in counts.items() if vocab.class_of(w) == c and w.encode() not in vocab.row]
            assert abs(sum(n + 1 for n in rest) + 1 - 10 ** vocab.rest_share[c]) < 1e-6


def test_query_score_equals_plain_products(spark, sf_dir, monkeypatch):
    held = {}
    real = lblm.train
    monkeypatch.setattr(lblm, "train", lambda found, vocab, **k: held.update(vocab=vocab, model=real(found, vocab, **k)) or held["model"])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.score for r in lblm.score(df, F.col("doc_id") % 5 > 0).collect()}
    vocab, m = held["vocab"], held["model"]
    seen = Counter(w for i, t in docs if i % 5 for w in words(t))
    for i, text in docs[:12]:
        total, before = 0.0, [vocab.begin] * lblm.CONTEXT
        for w in words(text):
            h = sum(m.r[c] @ m.mix[k] for k, c in enumerate(before[-lblm.CONTEXT :]))
            row = vocab.end if w == "\n" else int(vocab.rows([w.encode()])[0])
            c = vocab.cls[row]
            a, b = vocab.start[c], vocab.start[c + 1]
            for s, k in ((h @ m.u.T + m.u_bias, c), (h @ m.q[a:b].T + m.q_bias[a:b], row - a)):
                total += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if vocab.is_rest[row]:
                total += math.log10(seen[w] + 1) - vocab.rest_share[c]
            before.append(row)
        assert abs(got[i] - total) < 1e-3 * abs(total)


def test_noise_contrastive_gradients_lower_the_loss_to_the_data():
    counts = {"aan": 400, "bbn": 300, "ccm": 200, "ddm": 100}
    vocab = vocabulary(counts)
    pairs = {"aan": "ccm", "ccm": "bbn", "bbn": "ddm", "ddm": "aan"}
    text = ["aan"]
    for _ in range(800):
        text.append(pairs[text[-1]])
    found = vocab.windows([w.encode() for w in text])
    model = lblm.train(found, vocab, dims=8, batch=256, least_steps=300)
    assert model.log10(found[5:-1], vocab, model.tables()).mean() > -0.05


def test_most_frequent_takes_part_of_a_tie(spark):
    df = spark.createDataFrame([(f"w{i}", 3 if i < 500 else 900 - i % 2) for i in range(600)], "word string, n long")
    got = lblm.most_frequent(df, 300)
    assert 250 <= len(got) <= 300 and sum(n > 3 for _, n in got) == 100 and got == sorted(got, key=lambda x: (-x[1], x[0]))
    assert len(lblm.most_frequent(df, 600)) == 600 and len(lblm.most_frequent(df, 50)) <= 50 and lblm.most_frequent(df.limit(0)) == []


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, True, "a"), (1, None, True, "a"), (2, "", False, "b"), (None, "Word wörd, word. WORD", True, None), (4, "unseen Word " * 40_000, False, "c"), (4, "unseen Word " * 40_000, False, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, word string")
    n, want = base([r[:3] for r in rows], lambda d: d[2])
    got = lblm.score(df, F.col("learn")).collect()
    assert len(got) == 6
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.id)
        n_tokens, n_known, score = want[r.id, text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and abs(r.base_score - score) < 1e-6 * abs(score)
        assert math.isfinite(r.score) and r.score < 0
    assert lblm.score(df.limit(0), F.col("learn")).count() == 0
    assert [r.train_tokens for r in lblm.score(df, F.lit(False)).collect()] == [0] * 6


def test_drawn_windows_equal_all_windows():
    vocab = vocabulary({f"w{i}": 50 for i in range(9)})
    for n in (0, 1, 2, 3, 7, 400):
        words = [b"w%d" % (i * 7 % 13) for i in range(n)]
        for drawn in ([], [0], [n], range(n + 1), range(0, n + 1, 97)):
            drawn = np.array(sorted(set(drawn)), np.int64)
            assert (vocab.windows_at(words, drawn) == vocab.windows(words)[drawn]).all()


def test_scores_beyond_single_precision_are_shifted():
    rng = np.random.default_rng(3)
    for scale in (1, 30, 3000):
        h = np.column_stack([rng.normal(size=(50, 6)), np.ones(50)]).astype(np.float32)
        vectors, bias, at = scale * rng.normal(size=(11, 6)), rng.normal(size=11), rng.integers(0, 11, 50)
        s = h[:, :-1].astype(float) @ vectors.T + bias
        wanted = s[np.arange(50), at] - np.logaddexp.reduce(s, axis=1)
        got = lblm._log_softmax_at(h, vectors, bias, at)
        assert np.allclose(got, wanted, rtol=1e-5, atol=1e-5 * scale)


def test_positions_outside_the_drawn_ones_are_learned_by_all_tasks(spark, monkeypatch):
    """With almost no drawn position, what texts say must come from the passes over all of them."""
    monkeypatch.setattr(lblm, "EXAMPLES", 1)
    learned = []
    real = lblm.learn_all
    monkeypatch.setattr(lblm, "learn_all", lambda *a, **k: learned.append(real(*a, **k)))
    cycle = "aan ccm bbn ddm " * 2_000
    rows = [(i, cycle, True) for i in range(60)] + [(100, cycle, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3, "doc_id")
    got = {r.id: r for r in lblm.score(df, F.col("learn")).collect()}
    assert learned == [60 * 8_001] == [got[100].train_tokens]
    # A count of words alone gives -0.6 a token.
    assert got[100].score > -0.3 * got[100].n_tokens and got[100].base_score < -0.59 * got[100].n_tokens


def test_column_sums_and_kept_memory_give_the_plain_steps():
    """Gradients summed by column move rows as those summed after sorting, and a step's results don't hang on the memory it finds."""
    rng = np.random.default_rng(5)
    rows, grads = rng.integers(0, 40, 300).astype(np.int32), rng.normal(size=(300, 6)).astype(np.float32)
    moved = []
    for step, given in ((lblm._step, grads), (lblm._step_by_column, grads.T)):
        param, seen = np.ones((50, 6), np.float32), np.full(50, 1e-3, np.float32)
        step(param, seen, rows, given, 0.1)
        moved.append((param, seen))
    assert np.allclose(moved[0][0], moved[1][0], atol=1e-5) and np.allclose(moved[0][1], moved[1][1], rtol=1e-4)

    vocab = vocabulary({f"w{i}{e}": 60 + i for i in range(20) for e in ("en", "on", "st")})
    words = list(vocab.row)
    found = vocab.windows([words[i] for i in rng.integers(0, len(words), 5_000)])
    start = lblm.train(found, vocab, dims=4, least_steps=20)
    used, fresh = lblm.Learner(start, vocab, 1), lblm.Learner(start, vocab, 1)
    for name in ("each", "h", "away", "g_h", "own_h", "qw", "q", "part_h", "word_away", "word_g", "g_each"):
        used.room(name, 200_000)[:] = np.nan
    for learner in (used, fresh):
        learner.learn(found)
    assert all(np.array_equal(getattr(used.net, k), getattr(fresh.net, k)) and np.isfinite(getattr(used.net, k)).all() for k in lblm.PARAMETERS)
    assert used.net.log10(found, vocab, used.net.tables()).mean() > start.log10(found, vocab, start.tables()).mean() - 0.05


def test_words_of_a_slice_are_looked_up_once():
    """Tokens come from a slice's distinct words: the same as text by text, and a class is asked for once an ending, not once a word."""
    odd = "".join(map(chr, [*range(1, 0x180), 0x85, 0xA0, 0x2003, 0x3000, 0x1F600]))
    texts = [None, "", " ", "\n\n", " lead Trail ", "ÄÖ äÖ", odd, " x ".join(odd), "w3en w3EN other", *(f"w{i % 9}en rare{i}en rare{i}st" for i in range(400))]
    at, distinct, sizes = lblm.split_words(pa.array(["cut off", *texts], pa.string()).slice(1))
    wanted = [lblm.tokens(t) for t in texts]
    assert len(set(distinct.to_pylist())) == len(distinct) and sizes.tolist() == [len(w) for w in wanted]
    assert [distinct[i].as_py().encode() for i in at.tolist()] == [w for t in wanted for w in t]

    vocab = vocabulary({f"w{i}en": 50 for i in range(9)})
    windows, asked, real = np.concatenate([vocab.windows(w) for w in wanted]), [], vocab.class_of
    vocab.class_of = lambda word: asked.append(word) or real(word)
    assert np.array_equal(vocab.text_windows(pa.array(texts, pa.string())), windows)
    assert len(asked) == len(set(asked)) and sum(a in ("en", "st") for a in asked) == 2


def test_counts_of_many_slices_are_summed_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(lblm, "FLUSH", 40)
    monkeypatch.setattr(lblm, "text_slices", lambda batch, column, limit=0: (batch.slice(i, 1) for i in range(batch.num_rows)))
    texts = [None, "  ", *(" ".join(f"w{(i * j) % 61}" for j in range(1 + i % 50)) for i in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    seen = Counter(w for t in texts for w in words(t))
    assert {r.word: r.n for r in lblm.word_counts(df).collect()} == seen
    assert lblm.word_counts(df.limit(0)).count() == 0


def test_a_step_equals_one_written_out_by_position(monkeypatch):
    """Sums over positions, blocks and rows of the context give the gradients of single positions and moves of AdaGrad."""
    monkeypatch.setattr(lblm, "LEAST_COUNT", 3)
    vocab = vocabulary({f"w{i}{e}": 1 + (i * 7) % 11 for i in range(30) for e in ("en", "on", "é", "x.", "st")})
    # Several parts of positions and of blocks.
    monkeypatch.setattr(lblm, "NEAR", 100)
    monkeypatch.setattr(lblm, "NEAR_BLOCKS", 5)
    rng = np.random.default_rng(2)
    names = [b"w%d%s" % (i % 33, e) for i in range(99) for e in (b"en", b"on", b"st", b"q")]
    found = vocab.windows([names[i] for i in rng.integers(0, len(names), 299)])
    start = lblm.train(found, vocab, dims=4, least_steps=20)
    learner = lblm.Learner(start, vocab, 3)
    # The same draws in the same order.
    draws = np.random.default_rng(3)
    learner.step(found)
    part = found[np.argsort(found[:, -1], kind="stable")]
    p = {k: getattr(start, k).astype(float) for k in lblm.PARAMETERS}
    g = {k: np.zeros_like(v) for k, v in p.items()}
    drawn = np.minimum(np.searchsorted(learner.cls_ends, draws.random(lblm.CLASS_NOISE) * learner.cls_ends[-1]), vocab.n_classes - 1)
    order = vocab.cls[part[:, -1]]
    blocks = [at[i : i + lblm.BLOCK] for c in sorted(set(order)) for at in [np.flatnonzero(order == c)] for i in range(0, len(at), lblm.BLOCK)]
    random = draws.random((len(blocks), lblm.WORD_NOISE))
    for block, x in zip(blocks, random, strict=True):
        c = order[block[0]]
        low, high = vocab.start[c], vocab.start[c + 1]
        noise = np.clip(np.searchsorted(learner.ends, learner.below[low] + x * (learner.below[high] - learner.below[low])), low, high - 1)
        for *ctx, word in part[block].tolist():
            h = sum(p["r"][k] @ p["mix"][i] for i, k in enumerate(ctx))
            met = [("u", c, 1, learner.cls_noise), *(("u", k, 0, learner.cls_noise) for k in drawn)]
            if high - low > 1:
                met += [("q", word, 1, learner.word_noise), *(("q", k, 0, learner.word_noise) for k in noise)]
            g_h = 0
            for name, k, data, of_noise in met:
                away = 1 / (1 + np.exp(-(h @ p[name][k] + p[f"{name}_bias"][k] - of_noise[k]))) - data
                g_h = g_h + away * p[name][k]
                g[name][k] += away * h
                g[f"{name}_bias"][k] += away
            for i, k in enumerate(ctx):
                g["r"][k] += p["mix"][i] @ g_h
                g["mix"][i] += np.outer(p["r"][k], g_h)
    for k in lblm.PARAMETERS:
        flat = g[k].reshape(len(g[k]), -1)
        seen = start.seen[k] + (flat**2).mean(axis=1)
        wanted = p[k] - (learner.rate / np.sqrt(seen)).reshape(-1, *[1] * (g[k].ndim - 1)) * g[k]
        assert np.allclose(getattr(learner.net, k), wanted, atol=2e-5), k
        assert np.allclose(learner.net.seen[k], seen, rtol=1e-3), k
