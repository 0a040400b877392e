"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, idfile, lm_queries, phrase_queries, pii, sharding, simhash, syncmers, toxicity, urlfilter, vec_queries
from .common import materialize, new_path, small_batches, table, text_or_empty


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, classes linked within four bits."""
    small_batches(spark)
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url judged by rules, else by its template. A page is labelled by the document whose id its url names: bad if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    named = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    bad = labels.select("doc_id", ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("bad"))
    known = pages.select("page_id", F.when(named != "", named).cast("long").alias("n")).join(bad, F.col("n") == F.col("doc_id")).select("page_id", "bad")
    return urlfilter.judge(pages, known)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal counts that match the mixture of sources."""
    text = text_or_empty("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = sharding.interleave(docs, 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    rows = syncmers.with_next(docs, "doc_id", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))
    hashed = F.xxhash64("next_text").alias("next_x")
    rows = rows.select("row", F.col("id").alias("doc_id"), "next_id", F.xxhash64("text").alias("x"), hashed, F.explode(both).alias("b"))
    keys = ["row", "doc_id", "next_id", "x", "next_x", "kind", "n_chars", "sha"]
    rows = rows.select("row", "doc_id", "next_id", "x", "next_x", "b.kind", F.char_length("b.t").cast("long").alias("n_chars"), F.when(F.col("b.kind") == 1, F.sha2("b.t", 256)).alias("sha"), "b.t")
    found = materialize(syncmers.sketches(rows, keys, "t"), "sketches")
    own = found.where("kind = 0").drop("kind", "sha")
    edited_rows = found.where("kind = 1").select(F.col("row").alias("r"), F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("doc_id").alias("i"), F.col("x").alias("ix"), F.col("fingerprint").alias("next_fingerprint")).distinct()
    joined = own.join(edited_rows, own.row == edited_rows.r).join(after, F.col("next_id").eqNullSafe(F.col("i")) & (F.col("next_x") == F.col("ix")))
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", syncmers.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), syncmers.likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine that never saw the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score_documents(docs, model)
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    turns = table(spark, sf_dir, "conversations")
    return chat.render(turns, chat.maximal_conversations(turns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and places of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.annotate(docs, pii.train(docs))
    shown = lambda name: F.array_join(F.transform(F.col(f"found.{name}"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(F.col("found.base"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op10_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as bit planes and read back."""
    path = new_path(spark, "ids")
    idfile.write_ids(table(spark, sf_dir, "documents"), path)
    return idfile.read_documents(spark, path)


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_urlfilter, op3_decontamination, op4_sharding, op5_syncmers, op6_toxicity, op7_bpe, op8_chat, op9_pii, op10_idfile, vec_queries.op11_veccodes, lm_queries.op12_suffixtree, phrase_queries.op13_collocations)}


#: DuckDB's SQL for the queries that SQL can express.
def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": SHARDING_SQL, "op8_chat": CHAT_SQL, "op11_veccodes": vec_queries.VECCODES_SQL, "op13_collocations": phrase_queries.COLLOCATIONS_SQL}


CHAT_SQL = """
with turns as (
  select conv_id, list('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) order by turn nulls last, role, text) as parts
  from conversations where conv_id is not null group by conv_id),
whole as (select parts, min(conv_id) as conv_id, count(*) as n_copies from turns group by parts),
prefixes as (select distinct parts[1:k] as parts from (select parts, unnest(range(1, len(parts))) as k from whole))
select conv_id, cast(len(parts) as bigint) as n_turns, n_copies, array_to_string(parts, '') as rendered
from whole where parts not in (select parts from prefixes)
"""

SHARDING_SQL = """
with t(i, v) as (select i, list_reduce([i::ubigint, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) from range(16) r(i)),
nib as (select list(v order by i) as v from t),
hexes as (select doc_id, source, coalesce(text, '') as x, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::ubigint) as bytes from documents),
sums as (
  select doc_id, source, cast(len(bytes) + 1 as bigint) as size,
    cast(xor(list_reduce(list_prepend(4294967295::ubigint, bytes), lambda c, b: xor(xor(xor(c, b) >> 4, nib.v[1 + (xor(c, b) & 15)::bigint]) >> 4, nib.v[1 + (xor(xor(c, b) >> 4, nib.v[1 + (xor(c, b) & 15)::bigint]) & 15)::bigint])), 4294967295::ubigint) as bigint) as text_crc32,
    md5('interleave:' || doc_id) as h
  from hexes, nib),
ranked as (select *, row_number() over (partition by source order by h) - 1 as r, count(*) over (partition by source) as n, count(*) over () as total from sums),
placed as (select *, row_number() over (order by (2 * r + 1) / (2 * n)::double, source, r) - 1 as p from ranked)
select doc_id, size, text_crc32, 'rows' as law, cast(p * 16 // total as integer) as shard,
  cast(p - (p * 16 // total * total + 15) // 16 as bigint) as slot, cast(null as integer) as grown_shard
from placed
"""
