import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from scholia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, texts, capacity=4096):
    """Pieces equal the library's ids; sequences are gapless and within capacity. Gives their number and the least possible."""
    lib, want = library(), []
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.id if "id" in r else r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_random_parts_equal_the_library():
    rng, lib, own = random.Random(5), library(), packing.Encoder(PATH)
    parts = ["Hello", "wörld.", "don't", " ", "  ", "\n", "\t", "\x1c", "\x85", "É", "é.", "ǅ", "İx.", "ΑΣ", "ΑΣ.", "日本", "½.", "²,", "1234.", "😀!", "<|endoftext|>", "<|startoftext|>.", "...", ".'s", "'s", "'LL", "a.b", "a_b.", "\u0301", "e\u0301.", "\u3000", "\u200b", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(12)))
        assert own.encode(pa.array([text]))[0].tolist() == lib.encode(text, add_special_tokens=False).ids, text


    for c in [*range(32, 0x250), *range(0x250, 0x3000, 37)]:
        for text in (f"a{chr(c)}", f"{chr(c)}!?", f"{chr(c)}{chr(c)}%", f"{chr(c)}1."):
            assert own.encode(pa.array([text]))[0].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_crossover_keeps_every_piece_once_and_finds_a_perfect_packing():
    rng = np.random.Generator(np.random.PCG64(1))
    lengths = np.sort(rng.integers(1, 900, 400))[::-1].copy()
    a, b = (packing.Packing(packing.best_fit(lengths, rng.permutation(400), np.zeros(400, np.int64), [], 1000), lengths) for _ in range(2))
    for _ in range(50):
        child = packing.crossover(a, b, lengths, 1000, rng)
        assert child.loads.max() <= 1000 and child.loads.min() > 0 and child.loads.sum() == lengths.sum()
        a, b = b, child
    # Thirds that decreasing best fit can't see: 6 bins are enough.
    hard = np.array([44, 44, 37, 37, 33, 33, 31, 31, 29, 29, 28, 28, 25, 25, 22, 22, 21, 21, 16, 16, 4, 4])
    hard = np.sort(hard)[::-1].copy()
    found = packing.evolved(hard, [], None, [3], capacity=100, children=400)
    assert len(packing.Packing(found[0], hard).loads) <= len(packing.Packing(packing.best_fit(hard, np.arange(len(hard)), np.zeros(len(hard), np.int64), [], 100), hard).loads)


def test_levels_and_islands_pack_well(spark, monkeypatch):
    monkeypatch.setattr(packing, "REGION", 60)
    rng = random.Random(2)
    texts = [(i, rng.choice([None, "", "word " * rng.randrange(1, 60), "a b, c. " * rng.randrange(1, 20)])) for i in range(500)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, row int, region string").repartition(4)
    got = packing.pack(df, PATH, capacity=100).collect()
    used, least = check(got, texts, 100)
    assert used <= least + max(2, least // 100)
    assert sorted(map(tuple, packing.pack(df, PATH, capacity=100).collect())) == sorted(map(tuple, got))


def test_query_and_edge_rows(spark, sf_dir):
    from scholia.llm.queries import op11_pack

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(op11_pack(spark, sf_dir).collect(), docs)
    assert used <= least + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, None), (1, "x " * 9000), (1, "x " * 9000)], "doc_id long, text string"), PATH).collect()
    assert sorted(r.length for r in rows) == [1, 809, 809, 4096, 4096, 4096, 4096] and len({r.sequence_id for r in rows}) == 5
