"""Thin queries of this subpackage's operators over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.langid import fit, fold, predict

    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(fold() != 2))
    found = predict(docs, net).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.imatch import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.langid import fold
    from scholia.llm.lblm import score

    found = score(table(spark, sf_dir, "documents"), fold(parts=7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.pii import find, trained

    return find(table(spark, sf_dir, "documents"), trained()).withColumnRenamed("id", "doc_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scholia.llm.bpe import encode_texts

    found = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return found.withColumnRenamed("id", "doc_id")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents"))
    drawn = lambda part: F.array_join(F.transform("draws", lambda d: d[part].cast("string")), ",")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), drawn("shard").alias("shards"), drawn("position").alias("positions"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns come from texts as they are. The last three are of the same conversations with an image and a document in each user turn, sized by its text."""
    from scholia.llm.chat import attached, digests, format_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select stack(2, -1L, 0L, 'user', m, -1L, 1L, 'assistant', m) as (conv_id, turn, role, text) from (select '<|im_end|><|im_start|>assistant ok' as m)")
    every = rows.unionByName(own)
    text = F.coalesce("text", F.lit(""))
    part = lambda kind, **own: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(k) for k, c in own.items()]))
    ref = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit("/"), F.coalesce(F.col("turn").cast("string"), F.lit("none")))
    placed = F.array(part("text", text=text), part("image", ref=ref, width=F.length(text), height=F.lit(56)), part("document", ref=ref, pages=F.length(text) % 4))
    parts = F.when(F.col("role") == "user", placed).otherwise(F.array(part("text", text=text)))
    typed = attached(format_turns(every.withColumn("text", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))))
    plain = digests(format_turns(every, typed=False)).drop("n_attachments", "attachment_tokens")
    return plain.join(typed.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scholia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scholia.llm.align import align

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholia.llm.resample import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op1_simhash": op1_simhash, "op2_language": op2_language, "op3_imatch": op3_imatch, "op4_licenses": op4_licenses, "op5_lm": op5_lm, "op6_pii": op6_pii, "op7_bpe": op7_bpe, "op8_mix": op8_mix, "op9_vectors": op9_vectors, "op10_chat": op10_chat, "op11_pack": op11_pack, "op12_align": op12_align, "op13_resample": op13_resample}
ORACLE_SQL: dict[str, str] = {
    "op9_vectors": """
with recursive unit as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
roots as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links l where l.a = r.vec_id) as n_links, component_id, vec_id = component_id as kept from roots r""",
    "op10_chat": """
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped as (select *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') as e,
  replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') as r from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(r) + 1 + length(e) + length('<|im_end|>') + 1)::bigint as formatted_chars, 2 * count(*) filter (role = 'user') as n_attachments,
  coalesce(sum(case when role = 'user' then greatest(1, 2 * ((length(text) + 27) // 28)) + 512 * greatest(1, length(text) % 4) end), 0)::bigint as attachment_tokens,
  (formatted_chars + coalesce(list_sum(list_transform(range(1, count(*) filter (role = 'user') + 1), lambda i: length('<|image_' || i || '|>') + length('<|document_' || i || '|>'))), 0))::bigint as typed_chars
from escaped group by conv_id""",
    "op13_resample": r"""
with crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) as t),
worded as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
wanted as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
each as (select r, unnest(ws) as w from worded),
hexed as (select w, hex(w) as h from (select w from each union select w from wanted)),
bucket as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: ('0x' || substring(h, 2 * k + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as b from hexed, crc_table),
own as (select b, count(*) as s from each join bucket using (w) group by b), target as (select b, count(*) as t from wanted join bucket using (w) group by b),
gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from each) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from wanted) + 10000))))::bigint as g from own full join target using (b)),
sums as (select r, count(*) as n, sum(g)::bigint as total from each join bucket using (w) join gain using (b) group by r),
weighed as (select doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight, ('0x' || substring(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from worded left join sums using (r)),
noisy as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from weighed),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last, n_features) as k from noisy)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= (select count(*) from noisy where n_features >= 20) * 10 // 100 then k end as rank from ranked""",
}
