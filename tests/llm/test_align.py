import hashlib
import json
import random
from bisect import bisect_left, bisect_right
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from scholia.llm import align
from scholia.llm.bpe import pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Brute force: whole texts by the libraries, every pair of tokens compared by their byte ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        a_bytes = pieces(json.load(f))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, links_of, count = [], [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(map(b_bytes, y)) != whole:
            x, y = [], []
        spans = []
        for ids, raw in ((x, a_bytes.__getitem__), (y, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(raw(i)), i))
                at += len(raw(i))
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        sides = [[[] for _ in ends], [[] for _ in ends]]
        for side, own in zip(sides, spans, strict=True):
            for _, e, i in own:
                side[bisect_left(ends, e)].append(str(i))
        groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*sides, strict=True)]
        starts = [u for u, _, _ in spans[1]]
        links = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1][max(0, bisect_right(starts, s) - 1) : bisect_left(starts, e)] if s < v and u < e]
        links_of.append(links)
        count.update(links)
        rows.append([len(x), len(y), len(ends), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""])
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(*r[:4], sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, links_of, strict=True)]


def texts(n=300):
    rng = random.Random(12)
    parts = [
        "Hello", "hello", "world.", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "ß.", "日本語", "½.", "١٢", "😀", "<|endoftext|>", "<s>", "</s>", "▁", "́", "​", "　", "\x1c", "\x85", "aaaa", "aa", "a",
        "...", "3.14", "x=1;", "foo,bar", "'s", ");", "Ünïcödé!", " trailing ", "internationalisation",
    ]
    return [None, "", " ", "\n", "a" * 3000, "no end" * 500, *["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(n)], "same text here.", "same text here."]


def test_random_texts_equal_brute_force(spark):
    some = texts()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(some)], "doc_id long, text string, n_a int, row string").repartition(3)
    got = {r.id: tuple(r)[1:] for r in align.align(df, A, B).collect()}
    want = plain(some)
    assert sum(w[0] > 0 for w in want) > 100 and sum(w[0] == 0 for w in want) > 3
    for i, w in enumerate(want):
        assert got[i] == w, some[i]


def test_no_pair_is_broadcast_and_a_small_table_change_nothing(spark, monkeypatch):
    some = texts(60)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, align.align(df, A, B).collect()))
    monkeypatch.setattr(align, "FREQUENT", 3)
    assert sorted(map(tuple, align.align(df, A, B).collect())) == want
    own = align.Aligner(A, B)
    monkeypatch.setattr(align, "TABLE_UNITS", 10)
    for _ in range(2):
        for t in some:
            counts, digests, _, _ = own.aligned([t, t])
            row = next(w for w in want if w[0] == some.index(t))
            assert (*counts[:, 0].tolist(), digests[0]) == (*row[1:5], row[7]) == (*counts[:, 1].tolist(), digests[1])


def test_query_equals_brute_force(spark, sf_dir):
    from scholia.llm.queries import op12_align

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_align(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, plain([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(empty, A, B).collect() == []
    rows = align.align(spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string"), A, B).collect()
    assert sorted((r.id is None, r.n_a, r.count_sum) for r in rows) == [(False, 0, 0), (False, 2, 6), (False, 2, 6), (True, 2, 6)]
