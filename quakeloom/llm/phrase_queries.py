"""The registered query of phrase collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations
from .common import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 most cohesive phrases of 2 to 5 words, from all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
lines as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, m, phrase, count(*) as f from (
    select lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase from lines, range(1, 6) t(m))
  group by all),
totals as (select lang, cast(sum(f) as bigint) as n from grams where m = 1 group by lang),
own as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from grams where m > 1 and f >= 100),
cuts as (
  select o.lang, o.phrase, o.a, k, x.f as l, y.f as r, n, (1000 * o.a::hugeint * n) // (x.f::hugeint * y.f) as score
  from own o, range(1, 5) t(k), totals, grams x, grams y
  where k < o.m and totals.lang = o.lang and x.lang = o.lang and y.lang = o.lang
    and x.phrase = array_to_string(o.w[1:k], ' ') and y.phrase = array_to_string(o.w[k + 1 :], ' ')),
best as (select lang, phrase, arg_min(cuts, (score, k)) as b from cuts group by all),
inside as (
  select o.lang, array_to_string(o.w[i : i + s - 1], ' ') as phrase, max(o.a) as longer
  from own o, range(2, 5) t(s), range(1, 5) u(i) where s < o.m and i + s - 1 <= o.m group by all),
kept as (select b.* from (select lang, phrase, unnest(b) from best) b left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score from kept)
select * from ranked where rank <= 2000
"""
