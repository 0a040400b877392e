"""The registered query of vector codes and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import veccodes
from .common import materialize, table


def op11_veccodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings under codebooks of 16 parts and 64 entries after two rounds, and their errors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = veccodes.learn(rows, "embedding", "vec_id")
    coded = materialize(veccodes.encode(rows, books, "embedding", ["vec_id", "label"]), "codes")
    out = veccodes.with_label_error(coded, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    nearest = f"""
near{n} as (
  select q.r, q.p, q.v, arg_min(b.e, (list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) as e,
    min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d
  from parts q join books{n} b using (p) group by all)"""
    moved = f"""
moved{n} as (
  select p, e, list(m order by i) as v from (
    select p, e, i, cast(floor(sum(x) / count(*)) as bigint) as m from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from near{n}) group by p, e, i) group by p, e),
books{n + 1} as (select p, e, coalesce(m.v, b.v) as v from books{n} b left join moved{n} m using (p, e))"""
    return nearest + "," + moved


VECCODES_SQL = f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as (select r, p, v[len(v) * p // 16 + 1 : len(v) * (p + 1) // 16] as v from kept, range(16) t(p)),
books0 as (select p, cast(r - 1 as integer) as e, v from parts where r <= 64),
{_round(0)},{_round(1)},{_round(2).split(",\nmoved2")[0]},
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near2 group by r),
sha as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from books2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (r), sha
"""
