"""Op 6. Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, target rows / own rows. A document's count inverts the Poisson distribution
with that mean at a uniform number hashed from the seed and its id; the document is repeated count times and the copies
are ordered by a hash over the whole result. A rate over PART_RATE is the sum of several independent Poisson parts, so
that no rate underflows.

Defined cases: rows with a null source form one source; a null id hashes as the string 'null'; rows that repeat an id
get the same count; texts are carried as they are (null, empty, very long); an empty table gives an empty result;
further columns are kept in replicate() and the helper columns have reserved names starting with `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialise, small_enough, table

PART_RATE = 16.0
#: P(Poisson(16) > 80) is below 1e-25, less than the step of the uniform numbers.
TERMS = 80
#: Sources, one row of about 1 KB each, that may be broadcast; with more, the join shuffles and AQE splits hot sources.
BROADCAST_SOURCES, SOURCE_BYTES = 20_000, 16 << 20


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by ':' (52 bits); another engine can repeat it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) * (2.0**-52)


def shuffle_key(*parts: Column) -> Column:
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_rates(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, source_col: str = "source", total_rows: int | None = None) -> DataFrame:
    """_mix_source, _mix_n, _mix_rate, _mix_parts, _mix_cdf (of one part) for each source.

    weights: target share of each source (a source that is not named gets 0); None: shares in proportion to
    rows ** temperature. total_rows: rows wanted in the mean; None: as many as df has.
    """
    n = df.groupBy(F.col(source_col).alias("_mix_source")).agg(F.count("*").alias("_mix_n"))
    if weights is None:
        share = F.pow(F.col("_mix_n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("_mix_source") == name, F.lit(float(w))).otherwise(share)
    n = n.withColumn("_mix_share", share)
    n = materialise(n, "sources")
    every, shares = n.agg(F.sum("_mix_n"), F.sum("_mix_share")).first()
    wanted = F.lit((every or 0) if total_rows is None else total_rows)
    rates = n.withColumn("_mix_rate", F.coalesce(F.try_divide(wanted * F.col("_mix_share"), F.lit(shares)) / F.col("_mix_n"), F.lit(0.0)))
    rates = rates.withColumn("_mix_parts", F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / PART_RATE)).cast("int"))
    part = F.col("_mix_rate") / F.col("_mix_parts")
    first = F.exp(-part)
    start = F.struct(first.alias("t"), first.alias("c"), F.array(first).alias("l"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda a, j: F.struct((a["t"] * part / j).alias("t"), (a["c"] + a["t"] * part / j).alias("c"), F.concat(a["l"], F.array(a["c"] + a["t"] * part / j)).alias("l")),
    )
    return rates.select("_mix_source", "_mix_n", "_mix_rate", "_mix_parts", steps["l"].alias("_mix_cdf"))


def replicate(df: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", total_rows: int | None = None) -> DataFrame:
    """df's rows, each repeated by its count, with _mix_copy (from 0), _mix_copies, _mix_rate and _mix_key added; not ordered yet."""
    rates = source_rates(df, weights, temperature, source_col, total_rows)
    if small_enough(rates.select("_mix_source"), BROADCAST_SOURCES, SOURCE_BYTES):
        rates = F.broadcast(rates)
    joined = df.join(rates, df[source_col].eqNullSafe(rates["_mix_source"]))
    draws = F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), lambda j: F.size(F.filter(F.col("_mix_cdf"), lambda c: uniform(F.lit(seed), F.col(id_col), j) >= c)))
    single = F.col("_mix_parts") == 1
    # the usual case draws its uniform number once a row, before the comparison with the distribution's steps
    joined = joined.withColumn("_mix_u", uniform(F.lit(seed), F.col(id_col), F.lit(1)))
    count = F.when(single, F.size(F.filter(F.col("_mix_cdf"), lambda c: F.col("_mix_u") >= c))).otherwise(F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    out = joined.withColumn("_mix_copies", count).where("_mix_copies > 0")
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)))
    return out.withColumn("_mix_key", shuffle_key(F.lit(seed), F.lit("order"), F.col(id_col), F.col("_mix_copy"))).drop("_mix_source", "_mix_n", "_mix_parts", "_mix_cdf", "_mix_u")


def mix(df: DataFrame, **how) -> DataFrame:
    """replicate(), shuffled globally: ordered by a hash of seed, id and copy."""
    return replicate(df, **how).orderBy("_mix_key", how.get("id_col", "doc_id"), "_mix_copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture: doc_id, source, n_bytes, copy, copies, rate (rounded), shuffle_key, in shuffled order.

    The mixture itself, whole rows in shuffled order, is written to the shared folder; n_bytes is read from its copies.
    """
    mixed = materialise(mix(table(spark, sf_dir, "documents")), "mixed")
    told = mixed.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.col("_mix_copy").cast("long").alias("copy"), F.col("_mix_copies").cast("long").alias("copies"), F.round("_mix_rate", 9).alias("rate"), F.col("_mix_key").alias("shuffle_key"))
    return told.orderBy("shuffle_key", "doc_id", "copy")  # files are read back in any order; only these narrow rows move again


OP6_SQL = """
with recursive n as (select source, count(*) as n from documents group by source),
r as (select source, n, (select sum(n) from n) * (sqrt(n) / (select sum(sqrt(n)) from n)) / n as rate from n),
p as (select source, rate, greatest(1, ceil(rate / 16.0))::bigint as parts from r),
s as (
  select source, rate, parts, 0 as j, exp(-rate / parts) as t, exp(-rate / parts) as c from p
  union all
  select source, rate, parts, j + 1, t * (rate / parts) / (j + 1), c + t * (rate / parts) / (j + 1) from s where j < 80),
l as (select source, rate, parts, list(c order by j) as cdf from s group by all),
d as (
  select d.doc_id, d.source, strlen(d.text)::bigint as n_bytes, l.rate, l.cdf, x.part,
    (('0x' || substr(md5('mix-1:' || d.doc_id || ':' || x.part), 1, 13))::bigint + 0.5) * pow(2.0, -52) as u
  from documents d join l on d.source is not distinct from l.source, lateral (select unnest(range(1, l.parts + 1)) as part) x),
c as (select doc_id, source, n_bytes, rate, sum(len(list_filter(cdf, lambda v: u >= v)))::bigint as copies from d group by all)
select doc_id, source, n_bytes, k as copy, copies, round(rate, 9) as rate,
  ('0x' || substr(md5('mix-1:order:' || doc_id || ':' || k), 1, 15))::bigint as shuffle_key
from (select *, unnest(range(0, copies)) as k from c where copies > 0)
"""
