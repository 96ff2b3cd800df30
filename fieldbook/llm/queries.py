"""The registered queries of this subpackage, one for each operator, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import (chat, decontam, hard_negatives, jaccard, kmeans_tree, licenses, mixing, phrases, pii, quality,
                           secret_grammar, sharding, suffix_dedup)
from fieldbook.llm.common import table
from fieldbook.session import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


@query("op1_balanced_label_propagation")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sixteen shards of equal counts, equal texts together as far as that allows."""
    docs = sharding.text_facts(table(spark, sf, "documents")).select("doc_id", "size", "text_crc32", "text_link")
    return sharding.place(docs, "text_link").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Licence paragraphs of every document, with family, probability and likeness to the template."""
    docs = table(spark, sf, "documents")
    return licenses.scan(docs, licenses.fit(docs)).withColumnRenamed("id", "doc_id")


@query("op3_chat_round_trip", """
with t as (
  select conv_id, turn, role, text from conversations
  union all values (cast(-7 as bigint), cast(0 as bigint), 'user', '\\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from t),
f as (select *,
  length(role) + 2 * (length(role) - length(regexp_replace(role, '[\\\\#<:!\\n]', '', 'g'))) as role_chars,
  case when contains(text, '###') or contains(text, '</turn>')
       then 1 + length(text) + length(text) - length(regexp_replace(text, '[\\\\#<]', '', 'g')) else length(text) end as body
  from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ') + length(role) + length(role) - length(regexp_replace(role, '[\\\\#<:!\\n]', '', 'g'))
       + length(': ') + body + length('</turn>') + 1) as bigint) as formatted_chars
from f group by conv_id
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation rendered, read back, and measured on what was read back."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    back = chat.read_back(chat.render(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that no 400-byte string occurring elsewhere covers."""
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"), with_text=False).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_temperature_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Documents repeated so that no source comes more than twice as often as another, by pass and block."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", F.col("__source_weight").alias("weight"),
                                   F.col("__pass").alias("pass"), F.col("__block").alias("block"))


@query("op6_kmeans_tree_search")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.search(vectors, F.col("vec_id") % 100 == 0)


@query("op7_spaced_seed_decontamination")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold benchmark items, substitutions allowed."""
    return decontam.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op8_personal_data")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in every whole text."""
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda m: m["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda m: m["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("pii")).alias("spans"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document by subword embeddings that learn from four fifths of the labelled ids."""
    docs = table(spark, sf, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.fit(docs, table(spark, sf, "labels").where(fold != 0), label_col="quality")
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose five-word shingle sets overlap by 75 of 100."""
    return jaccard.link_components(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op11_bond_hard_negatives", """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.id)
qualify row_number() over w <= 5
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """For every hundredth vector, other-label rows that score just under each of its five best same-label rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query("op12_secret_grammar")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every whole text: the patterns' and those that automata of known credentials accept."""
    found = secret_grammar.find(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in secret_grammar.BASE],
                        F.sha2(secret_grammar.listed(F.col("base")), 256).alias("base_sha256"),
                        secret_grammar.listed(F.col("spans")).alias("spans"))


@query("op13_phrase_subtrees", r"""
with d as (
  select row_number() over () as i, coalesce(lang, 'und') as lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents where text is not null),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as k from words where len(w) > 0),
f as (
  select lang, 1 as size, w[k] as phrase, count(*) as a from places group by all
  union all select lang, 2, w[k] || ' ' || w[k + 1], count(*) from places where k + 1 <= len(w) group by all having count(*) >= 10
  union all select lang, 3, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2], count(*) from places where k + 2 <= len(w) group by all having count(*) >= 10),
total as (select lang, cast(sum(a) as bigint) as n from f where size = 1 group by lang),
c as (select lang, size, phrase, a, string_split(phrase, ' ') as w from f where size > 1),
cuts as (
  select c.lang, c.phrase, c.a, k, x.a as l, y.a as r,
         cast((cast(1000000 as hugeint) * c.a * c.a) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from (select *, unnest(range(1, size)) as k from c) c
  join f x on x.lang = c.lang and x.size = k and x.phrase = array_to_string(c.w[1:k], ' ')
  join f y on y.lang = c.lang and y.size = c.size - k and y.phrase = array_to_string(c.w[k + 1:], ' ')),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, part, max(a) as longer from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from c where size = 3)
  group by lang, part)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from weakest join total using (lang) left join longer on longer.lang = weakest.lang and part = phrase
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """The two thousand strongest phrases of two and three words of each language."""
    return phrases.collocations(table(spark, sf, "documents").select("text", "lang"))
