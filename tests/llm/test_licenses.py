import re
import time

from scholia.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def own_spans(text):
    """Every start of a longer template by trying all starts: (label, first, last, cover) of the best one nearby."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, out = WORD.findall(low), []
    for label, template in licenses.TEMPLATES.items():
        t = template.split()
        size = len(t) - 1
        near = min(size, licenses.MERGE)
        hits = {(i - p, p) for p in range(size) for i in range(len(words) - 1) if words[i : i + 2] == t[p : p + 2]}
        starts, found = sorted({d for d, _ in hits}), []
        for d in starts:
            own = [(e, p) for e, p in hits if d <= e <= d + near]
            cover = len({p for _, p in own}) / size
            if cover >= licenses.COVER:
                found.append((cover, -d, min(e + p for e, p in own), max(e + p for e, p in own) + 1))
        out += [(label, a, b, c) for c, d, a, b in found if (c, d) == max((x, y) for x, y, _, _ in found if abs(y - d) <= near)]
    return sorted(out)


def test_query_equals_plain_form(spark, sf_dir):
    from scholia.llm.queries import op4_licenses

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op4_licenses(spark, sf_dir).collect())
    assert [r[:6] for r in got] == sorted((d.doc_id, *plain(d.text)) for d in docs)
    assert any(r[2] for r in got)
    texts = {d.doc_id: d.text for d in docs}
    for r in got:
        own = own_spans(texts[r[0]])
        base = plain(texts[r[0]])[4]
        assert r[6] == ",".join(sorted({k for k, *_ in own} | set(filter(None, base.split(",")))))
        assert abs(r[7] - max([c for *_, c in own] + [1.0 if base else 0.0])) < 1e-9


def test_spans_equal_plain_form_and_no_run_of_votes_hides_one(spark):
    gpl, mit, isc = (licenses.TEMPLATES[k].split() for k in ("gpl-notice", "mit-notice", "isc-text"))
    texts = [
        " ".join(["this program"] * 60 + gpl), " ".join(gpl + ["of the"] * 50 + gpl), " ".join(mit * 3), " ".join(isc[:8] + ["x"] * 5 + isc[8:]), " ".join(isc[:8] + ["x"] * 14 + isc[8:]),
        " ".join(gpl[:20] + gpl[9:]), " ".join(w for i, w in enumerate(isc) if i % 7 != 3), " ".join(["free software foundation"] * 40), " ".join(reversed(gpl)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.id, r.label, r.first_word, r.last_word, round(r.cover, 9)) for r in licenses.spans(df).where("not exact").collect()]
    assert sorted(found) == sorted((i, k, a, b, round(c, 9)) for i, t in enumerate(texts) for k, a, b, c in own_spans(t))
    assert {(0, "gpl-notice"), (1, "gpl-notice"), (3, "isc-text")} <= {(r[0], r[1]) for r in found}
    assert sum(r[:2] == (2, "mit-notice") for r in found) == 3 and sum(r[:2] == (1, "gpl-notice") for r in found) == 2


def test_a_megabyte_of_separators_takes_seconds(spark):
    df = spark.createDataFrame([(1, " " * (1 << 20) + "mit license"), (2, "mit license" + "-" * (1 << 20)), (3, ("mit" + " " * 50_000) * 20 + "license")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.id: (r.n_words, r.n_base, r.first_word) for r in licenses.scan(df).collect()}
    assert got == {1: (2, 1, 0), 2: (2, 1, 0), 3: (21, 1, 19)}
    assert time.monotonic() - began < 60


def test_edge_texts_and_clashing_columns(spark):
    gpl = licenses.TEMPLATES["gpl-notice"].split()
    texts = [
        None, "", " ,. ", "MIT License", "(mit license) mit LICENSE mit license", "mit-license/apache license; general public license",
        "general public", "public license general public license", "mit é license", "İ ǅ MIT\tLicense K", "word " * 30_000 + "apache license",
        " ".join(gpl), " ".join(gpl[:9] + ["oh", "well"] + gpl[10:]), " ".join(gpl[:5]), "of the " * 400,
    ]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1), (None, "mit license", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, size int")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[:6] for r in got] == want
    labels = {r[0]: (r[6], r[7]) for r in got}
    assert labels[11] == ("gpl,gpl-notice", 1.0) and labels[12][0] == "gpl,gpl-notice" and labels[13] == ("", 0.0) and labels[14] == ("", 0.0)
    assert licenses.scan(df.limit(0)).count() == 0
