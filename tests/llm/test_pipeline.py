import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard import brute_kept
from scholia.llm import langid, pii
from scholia.plans.lineage import written


def test_every_stage_on_its_own_input_and_the_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf_dir)))
        assert name == "tokens" or seen[-1].columns == columns
    raw, spoken, unique, masked, mixed, tokens = [df.collect() for df in seen]

    net = langid.fit(docs, reject=True)
    labels, scores = net.predict([r.text for r in raw])
    least = corpus_pipeline.LEAST_RATIO / (len(net.labels) - 1)
    passes = lambda r, k, s: s >= least if k != "und" else s > 0 and (s < corpus_pipeline.GIBBERISH or len(r.text.encode()) < langid.WINDOW)
    assert {r.doc_id for r in spoken} == {r.doc_id for r, k, s in zip(raw, labels, scores, strict=True) if passes(r, k, s)}
    assert len(spoken) > 0.995 * len(raw)

    # By definition: of texts linked over pairs of a similarity of 0.8 or more of their five-word shingles one stays.
    assert {r.doc_id for r in unique} == brute_kept([(r.doc_id, r.text) for r in sorted(spoken, key=lambda r: r.doc_id)])
    assert {r.doc_id: r.text for r in unique}.items() <= {r.doc_id: r.text for r in raw}.items()

    before = {r.doc_id: r.text for r in unique}
    assert {r.doc_id for r in masked} == set(before)
    for r in masked:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or any(pii.all_spans([before[r.doc_id]], pii.trained())[0])

    clean = {r.doc_id: r.text for r in masked}
    copies = {}
    for r in mixed:
        assert r.text == clean[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(tokens) == len(mixed)
    for r in tokens:
        want = lib.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.ids_sha256) for r in tokens)


def test_language_stage_drops_planted_gibberish(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10))))
    odd = spark.createDataFrame([(-1 - i, " ".join(word() for _ in range(120))) for i in range(30)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = [r.doc_id for r in corpus_pipeline.identify_language(spark, both, sf_dir).select("doc_id").collect()]
    assert sum(i < 0 for i in kept) <= 2 and sum(i >= 0 for i in kept) > 0.995 * docs.count()


def test_stages_stand_empty_tables_nulls_and_clashing_columns(spark, sf_dir):
    rows = [(1, "the cat and the dog went home again", "en", "s", 35, 1), (1, "the cat and the dog went home again", "en", "s", 35, 1), (2, None, None, None, None, 2), (3, "", "en", None, 0, 3), (None, "le chat et le chien sont a@b.fr ici", "fr", "t", 36, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key int").withColumn("row", F.lit(1)).withColumn("draw", F.lit("x")).withColumn("h", F.lit(2))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, sf_dir))
            assert name == "tokens" or out.columns == docs.columns
            docs = out
        assert docs.count() in (0, 2, 3, 4, 5, 6)
    assert docs.count() == 0
