import hashlib
import random
import re

import numpy as np
import pytest

from scholia.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["a.b", "@", "x-1", ".", "..", "com", "1", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "(", ")", "+49 30 1234567", "é", "@b.c", "0000", "٣", "%", "_"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("1" * 200_000 + ".1.1") == [] and pii.base_spans("a" * 200_000) == []


def test_gradients_agree_with_differences():
    x, y = pii.labelled_windows(4)
    net = pii.Tagger(hidden=3, dims=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = x[:, :20], y[:, :20]
    _, grads = net.gradients(x, y)
    for k, p in net.p.items():
        at = (int(x[0, 3]), 0) if k == "E" else tuple(np.array(p.shape) // 2)
        old, got = p[at], []
        for step in (1e-3, -1e-3):
            p[at] = old + step
            got.append(net.gradients(x, y)[0])
        p[at] = old
        assert abs((got[0] - got[1]) / 2e-3 - grads[k][at]) < 1e-3


def test_network_finds_held_out_spans_and_joins_windows(tagger):
    x, y = pii.labelled_windows(300, seed=77)
    got = tagger.decode(x)
    assert (got == y)[y > 0].mean() > 0.9 and (got == y)[got > 0].mean() > 0.9
    found = 0
    for pad in range(100):
        text = "the quest " * 30 + "an " * (pad // 3) + "ka la"[: pad % 3] + " call 555-123-4567 now and then " + "la " * 60
        (_, spans), = pii.all_spans([text], tagger)
        at = text.index("555")
        found += ("phone", at, at + 12) in spans
    assert found >= 90


def test_spans_are_those_of_all_windows(tagger):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäé"
    some = lambda least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    signs = ["  ", "\n", "...", " - ", "((", "\u3000", "、", "+", "/", "—" * 40, " " * 70, "." * 60]
    texts = []
    for _ in range(400):
        texts.append(f"{some(0, 300)} {'.'.join(some(5, 25) for _ in range(3))}@exämple.com {some(0, 200)}")
        parts = [rng.choice([some(1, 90), rng.choice(signs), "555-123-4567", "(030) 123 4567", "0301/1234567", "1.2.3.4", "12", "a@b", f"{some(20, 74)}@{some(3, 60)}.org", "4111 1111 1111 1111", "@", "٣", "漢字"]) for _ in range(rng.randrange(25))]
        texts.append(rng.choice(["", " "]).join(parts))
    every = tagger.spans(texts, everything=True)
    assert tagger.spans(texts) == every
    assert sum(any(k == "email" for k, *_ in spans) for spans in every[::2]) > 200
    assert tagger.spans(["", "7", "@", "no digit at all " * 50]) == [[], [], [], []]


def test_network_finds_planted_spans_outside_the_patterns(tagger):
    """Forms written for this test by rules of their own, among plain words and look-alikes that are no personal data."""
    rng = random.Random(31)
    words = "please call our office about the order before noon or write to the desk when it is closed again".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)}/{d(7)}"]
    alike = [lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: d(6), lambda: f"{d(1)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"#{d(4)}"]
    right = found = planted = 0
    for _ in range(300):
        text, spans = "", set()
        for _ in range(rng.randrange(10, 60)):
            roll = rng.random()
            part = rng.choice(forms)() if roll < 0.05 else rng.choice(alike)() if roll < 0.1 else rng.choice(words)
            if roll < 0.05:
                spans.add(("phone", len(text), len(text) + len(part)))
            text += part + " "
        ((_, got),) = pii.all_spans([text], tagger)
        right, found, planted = right + len(spans & set(got)), found + len(got), planted + len(spans)
    print(f"planted {planted}, found {found}, right {right}")
    assert right / planted >= 0.9 and right / found >= 0.9


def test_query_equals_plain_patterns(spark, sf_dir):
    from scholia.llm.queries import op6_pii

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op6_pii(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = plain(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))


def test_mask_leaves_nothing_and_keeps_columns(spark, tagger):
    rows = [(1, "mail a.b@c.de, +49 30 1234567 or 10.0.0.1", "x"), (None, None, None), (3, "", "x"), (4, "clean words 2024 only", "x"), (5, "w " * 60_000 + "a@b.c", "y"), (5, "w " * 60_000 + "a@b.c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.mask(df, tagger)
    assert out.columns == df.columns
    got = [r.text for r in out.collect()]
    assert got[1:4] == [None, "", "clean words 2024 only"] and got[0] == "mail [EMAIL], [PHONE] or [IP]" and got[4].endswith(" [EMAIL]")
    assert not any(pii.base_spans(t) for t in got if t)
    assert pii.find(df.limit(0), tagger).count() == 0 and pii.mask(df.limit(0), tagger).count() == 0
    assert [r.spans for r in pii.find(df.where("doc_id is null or doc_id = 3"), tagger).collect()] == ["", ""]
