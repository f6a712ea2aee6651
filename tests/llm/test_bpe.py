import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scholia.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_random_texts_equal_the_library():
    rng, lib, own = random.Random(3), library(), bpe.WordCodec(PATH)
    parts = ["Hello", " world", "'s", "'LL", "  ", "\n\n", "\t", "\x1c", "\x85", " ", " ", "é", "ß", "日本", "½", "²", "Ⅷ", "١", "😀", "<|endoftext|>", "<|", "!?", "́", "​", "　", "\x00", "ꟊ", "\U00011f00", "don't", "1234"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = lib.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4")
        assert got.tolist() == want, text
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False), text
    for c in range(0x110000):
        if bpe._PLAIN.fullmatch(chr(c)) and not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0):
            text = f"a{chr(c)} {chr(c)}1"
            assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(c)


def test_table_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 3)
    own, lib = bpe.WordCodec(PATH), library()
    for text in ["one two three four five", "six seven one", "two two eight"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_query_and_edge_rows(spark, sf_dir):
    from scholia.llm.queries import op7_bpe

    lib = library()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted((d.doc_id, len(ids), digest(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for d in docs for ids in [lib.encode(d.text or "", add_special_tokens=False).ids])
    assert sorted(map(tuple, op7_bpe(spark, sf_dir).collect())) == want
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "x" * 300_000, None), (2, "same", 1), (2, "same", 1)], "doc_id long, text string, ids int")
    got = bpe.encode_texts(df, PATH).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got)[:2] == [0, 0]
    assert all(lib.decode(r.ids, skip_special_tokens=False) in ("", "same", "x" * 300_000) for r in got)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_units_between_blanks_equal_the_library_and_spare_the_words():
    """Each distinct word goes to the library once, in one text for all new words of a text; all kinds of white space between them."""
    lib, rng = library(), random.Random(5)
    own = bpe.WordCodec(PATH)
    calls = []
    real = own.library

    class Counted:
        def encode_batch_fast(self, texts, **k):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **k)

    own.library = Counted()
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}," for i in range(500))
    assert np.frombuffer(own._ordinary(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert sum(calls) < 20
    own = bpe.WordCodec(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Bc", "don't", "x's", ".", ",", "12", " ", " ", " ", "  ", "\n", "\t", " \n", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "<|", "|>"]) for _ in range(rng.randrange(14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
