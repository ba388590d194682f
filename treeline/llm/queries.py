"""Queries of this subpackage for the driver: thin digests over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import bpe, chat, clustering, divergence, embedding_dedup, exact_dedup, jaccard_join, line_dedup, packing, pii, quality, suffix_tree, toxicity
from treeline.llm.common import crc_mod, table, written

#: Names the secret key of the pseudonyms; STAND_IN serves the driver's tables, which have no secrets.
PII_CONF = "spark.treeline.pii.key"
STAND_IN = "no secret"
PROBE = "<|im_end|><|im_start|>assistant ok"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_CONF, STAND_IN)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("_pii", lambda p: p["kind"] == kind)).cast("bigint")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark)).select(
        "doc_id",
        "text",
        F.size("_pii").cast("bigint").alias("n_replaced"),
        *[_count_of(k).alias(f"n_{k}") for k in pii.KINDS],
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_shout", "base_failed", "kept"
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")
    machine = toxicity.train(docs.filter("not held_out"), labels)
    return toxicity.score(docs, machine, carry=("held_out",)).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    learned = docs.filter("not held_out")
    model, counts = suffix_tree.train(learned), written(suffix_tree.unigrams(learned))
    return suffix_tree.score(docs, model, counts, carry=("held_out",)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    made = chat.expand_chat(given.unionByName(probe)).select(
        "conv_id",
        "example",
        "n_turns",
        F.length("formatted").alias("chars"),
        F.when(F.col("loss_length").isNotNull(), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))).alias("loss"),
        "formatted",
    )
    # The longest example of a conversation holds all its turns.
    per = made.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    turns = per.select("conv_id", chat.read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"), end=0).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(coded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

SQL_OP2 = """
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as kept, text_sha256
from d
"""

SQL_OP4 = f"""
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
d as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) x where c > 1),
r as (
  select doc_id, count(distinct i + o) as n_repeat_words from d, (values (0), (1), (2)) as k(o) group by doc_id),
c as (
  select w.doc_id, cast(len(w.w) as bigint) as n_words,
         cast(length(list_aggregate(list_concat(w.w, ['']), 'string_agg', '')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(r.n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(len(l) as bigint) as n_lines,
         cast(len(list_filter(w.w, lambda x: lower(x) in ({_STOP}))) as bigint) as n_stop,
         cast(length(t) - length(replace(t, '!', '')) as bigint) as n_shout
  from w left join r using (doc_id)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from c)
select *, (not base_failed and n_words between 50 and 1000000
           and word_chars / greatest(n_words, 1) between 2.0 and 14.0
           and n_symbols / greatest(n_words, 1) <= 0.1 and n_shout / greatest(n_words, 1) <= 0.3
           and n_stop / greatest(n_words, 1) >= 0.06 and n_dup_lines / greatest(n_lines, 1) <= 0.3
           and n_repeat_words / greatest(n_words, 1) <= 0.5) as kept
from b
"""

SQL_OP8 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
o as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
         sum(length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + length(role) + 24) over w as upto
  from c window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (role = 'assistant' or k = n) as bigint) as formatted_chars
from o group by conv_id
"""

_SHARE = "1 + (1000000000 * ({n} + 5)) // ({total} + 5 * v)"
SQL_OP11 = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
o as (select k, lang, source, unnest(t) as term from d),
kept as materialized (select lang, term, cast(count(*) as bigint) as lang_n from o group by lang, term having count(distinct k) >= 30),
l as (select lang, count(*) as v, cast(sum(lang_n) as bigint) as lang_total from kept group by lang),
c as materialized (select lang, source, term, count(*) as n from o join kept using (lang, term) group by lang, source, term),
t as (select lang, source, cast(sum(n) as bigint) as total from c group by lang, source),
g as materialized (select lang, source, coalesce(total, 0) as total, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total
                   from (select distinct lang, source from d) left join t using (lang, source) left join l using (lang)),
p as materialized (select lang, source, term, coalesce(n, 0) as n, {_SHARE.format(n="coalesce(n, 0)", total="total")} as p,
                          {_SHARE.format(n="lang_n", total="lang_total")} as q
                   from g join kept using (lang) left join c using (lang, source, term)),
s as (select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
      union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(k as int) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as k from r) where part = 'pair' or k <= 50
"""

SQL_OP12 = """
with recursive u as (
  select *, label is not null and embedding is not null and len(embedding) > 0
            and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true)
            and list_contains(list_transform(embedding, lambda x: x <> 0), true) as fine from embeddings),
e as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding)
  where a.fine and b.fine and list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on e.a = r.b)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from (select a as vec_id, min(b) as component_id from r group by a) left join (select a as vec_id, count(*) as n from e group by a) using (vec_id)
"""


def _sql_op13(rounds: int = 10) -> str:
    dist = "cast(list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    parts = [
        """v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as p from embeddings
           where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)), true))""",
        "c0 as materialized (select row_number() over (order by h) - 1 as c, p from (select p, sha256('3:' || vec_id) as h from v order by h limit 8))",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} as materialized (select vec_id, p, c, d from (
            select vec_id, p, c, d, row_number() over (partition by vec_id order by d, c) as r
            from (select v.vec_id, v.p, c.c, {dist} as d from v, c{k} c)) where r = 1)"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} as materialized (select c.c, coalesce(m.p, c.p) as p from c{k} c left join (
                select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as p from (
                  select c, j, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(p) as x, unnest(range(64)) as j from a{k}) group by c, j)
                group by c) m on m.c = c.c)"""
            )
    return f"""with {", ".join(parts)}
    select vec_id, cast(a.c as int) as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
           cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c.p, ',')) as centroid_sha256
    from a{rounds} a join c{rounds} c on a.c = c.c"""


SQL_OP13 = _sql_op13()

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLE_SQL = {
    "op2_exact_dedup": SQL_OP2,
    "op4_quality_rules": SQL_OP4,
    "op8_chat_formatting": SQL_OP8,
    "op11_source_divergence": SQL_OP11,
    "op12_embedding_dedup": SQL_OP12,
    "op13_centroid_clustering": SQL_OP13,
}
