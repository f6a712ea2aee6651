from scholia.operators import review
from scholia.queries import QUERIES


def found(spark, tags, synonyms=None):
    known = spark.createDataFrame(synonyms, "a string, b string") if synonyms else None
    rows = review.similar_tags(spark.createDataFrame([(t,) for t in tags], "tag string"), known).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) and all(r.a < r.b for r in rows)
    return {(r.a, r.b) for r in rows}


def test_every_kind_wherever_it_lies(spark):
    alike = [
        ("#sql", "#mysql"), ("#docker", "#odcker"), ("#docker", "#ocker"), ("#windows-service", "#win-service"), ("#backup", "#backups"), ("#query", "#queries"), ("#leaf", "#leaves"),
        ("#k8s", "#kubernetes"), ("#ml", "#machine-learning"), ("#Git", "#git"), ("#xray", "#array"), ("#service-win", "#win-service"), ("#日本", "#東日本"),
    ]
    got = found(spark, sorted({t for pair in alike for t in pair}))
    assert {tuple(sorted(p)) for p in alike} - got == {("#array", "#xray")}
    assert not found(spark, ["#alpha", "#omega", "#lang-en", "#lang-fr", "#", "#error", "#bug"])
    assert found(spark, ["#error", "#bug", "#x1"], [("#error", "#bug"), ("#bug", "#none")]) == {("#bug", "#error")}


def test_query_gives_containments_and_edits_of_all_tags(spark, sf_dir):
    from pyspark.sql import functions as F

    from scholia.functions import notes
    from scholia.sources import corpus

    tags = {r.tag for r in notes.parsed(corpus.entries(spark, sf_dir)).select(F.explode("tags").alias("tag")).collect()}
    one = lambda a: {a[:i] + a[i + 1 :] for i in range(len(a))}
    edit = lambda a, b: abs(len(a) - len(b)) <= 1 and (a in one(b) or b in one(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1))
    want = {(a, b) for a in tags for b in tags if a < b and (a[1:] in b or b[1:] in a or edit(a, b))}
    got = {tuple(r) for r in QUERIES["similar_tags_all"](spark, sf_dir).select("a", "b").collect()}
    assert want <= got and len(QUERIES["similar_tags"](spark, sf_dir).collect()) < len(want)
