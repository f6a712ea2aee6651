import hashlib

from scholia.llm import imatch

SCHEMA = "doc_id long, text string, bucket string, h int"


def check(rows, got):
    """Every row's own length, edited digest and order, computed plainly."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_query_equals_plain_form_and_tells_edits_from_neighbours(spark, sf_dir):
    from scholia.llm.queries import op3_imatch

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_imatch(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    check(docs, got)
    texts, by_text = dict(docs), {}
    for r in got:
        by_text.setdefault(texts[r.id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_far_ids_nulls_repeats_and_clashing_columns(spark):
    rows = [(10**12, "a b c d e f"), (-5, "p q r s"), (0, None), (2048, "İx ñ 日本 語 zz"), (5000, ""), (None, "null id here"), (7, "x " * 100_000)]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)
    check(rows, imatch.edited_fingerprints(df).collect())
    twice = spark.createDataFrame([(1, "same words here", "b", 1)] * 3, SCHEMA)
    got = imatch.edited_fingerprints(twice).collect()
    assert len(got) == 3 and {r.near_next for r in got} == {1.0} and {r.near_edited for r in got} <= {0.0, 1.0}
    one = imatch.edited_fingerprints(df.where("doc_id = 2048")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert imatch.edited_fingerprints(df.limit(0)).count() == 0
