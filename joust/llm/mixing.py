"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects target / source size copies. Documents are put in order within their source
(longest first, then id), the expected copies are prefix-summed, one random offset a source is added, and a
document is emitted once for each integer that its step crosses. Longest first bounds the miss of a source's
words by its longest document. The order comes from one range shuffle, so a source with a third of the rows is
spread over partitions; only counts by (source, partition) are summed in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_names, partitions, small, stored, table

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) rows, one a source -> plus target: shares of all sizes by repeating weights, at most cap x size.

    Water filling in closed form: in order of cap * size / weight the capped sources are a prefix, and a source
    is in it if the level that the rest would get without it is above its own ratio. Windows run over one row
    a source.
    """
    ix = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    x = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (ix % len(weights) + 1).cast("int")).cast("double"))
    x = x.withColumn("__c", F.col(size).cast("double") * cap)
    rising = Window.orderBy(F.col("__c") / F.col("__w"), F.col(source).asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("__level", (F.sum(size).over(whole).cast("double") - F.coalesce(F.sum("__c").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    x = x.withColumn("__full", F.col("__level") > F.col("__c") / F.col("__w"))
    left = F.sum(size).over(whole).cast("double") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__c"))).over(whole), F.lit(0.0))
    share = F.try_divide(left, F.sum("__w").over(whole) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__w"))).over(whole), F.lit(0.0)))
    return x.withColumn("target", F.when(F.col("__full"), F.col("__c")).otherwise(share * F.col("__w"))).drop("__w", "__c", "__level", "__full")


def mix(df: DataFrame, size: Column, source: str = "source", ident: str = "doc_id", weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """All rows of df with its columns, plus __size, __source_size, __target and __copies (0 to cap).

    Defined cases: a null source is a source of its own, last in order; null or empty texts have size 0 and move
    no words; rows with the same id and size are ordered arbitrarily among themselves and each counts; an empty
    table gives an empty result; the caller's other columns pass through untouched (names starting with `__` are
    reserved). Reruns give the same result for the same rows, however they are partitioned.
    """
    spark, src = df.sparkSession, F.col(source)
    placed = df.withColumn("__size", size).repartitionByRange(partitions(spark), src.asc_nulls_last(), F.col("__size").desc(), F.col(ident).asc())
    placed = placed.sortWithinPartitions(src.asc_nulls_last(), F.col("__size").desc(), F.col(ident).asc()).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed, "mix").withColumn("__block", F.shiftright("__at", 33))
    blocks = placed.groupBy(src.alias("__source"), "__block").agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum"), F.min("__at").alias("__first"))
    goal = targets(blocks.groupBy("__source").agg(F.sum("__sum").alias("__source_size")), "__source", "__source_size", weights, cap).withColumnRenamed("target", "__target")
    before = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    blocks = blocks.join(goal.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).select("__source", "__source_size", "__target", "__before", F.col("__block").alias("__b"))
    # a row a partition, and one more a source: stored, its size is known before the rows would be shuffled for it
    blocks = stored(blocks, "mix-blocks")
    rank = (F.col("__at") + F.col("__before")).cast("double")
    rate = F.coalesce(F.try_divide(F.col("__target"), F.col("__source_size").cast("double")), F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("__source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = F.least(F.floor(offset + rate * (rank + 1.0)) - F.floor(offset + rate * rank), F.lit(cap)).cast("int")
    return placed.join(blocks, src.eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__b"))).withColumn("__copies", copies).drop("__at", "__block", "__b", "__before", "__source")


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(docs, F.col("size")).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).cast("long").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document once for each copy that the mix takes of it. The mix is made of narrow rows, and its
    copies come back to the documents by id, source and a hash of the text; texts are not sorted.

    Defined cases: those of mix(); documents of size 0 go if the mix takes no copy of them; rows that share id, source and
    text get the copies of all of them in turn, as if in any order; the columns of docs pass through, whatever their names.
    """
    id_, source, k, copies, many, place = own_names(docs, "__id", "__source", "__k", "__copies", "__many", "__place")
    narrow = docs.select("doc_id", "source", F.xxhash64("text").alias("k"), words(F.col("text")).alias("size"))
    taken = mix(narrow, F.col("size")).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("k").alias(k)).agg(F.sum("__copies").alias(copies), F.count("*").alias(many))
    taken = stored(taken.where(F.col(copies) > 0), "mix-copies")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(k))
    found = docs.join(small(taken), same)
    # of m equal rows the first take one copy more where the copies of all do not divide
    one, more = found.where(F.col(many) == 1), found.where(F.col(many) > 1)
    if not taken.where(F.col(many) > 1).isEmpty():
        more = more.withColumn(place, F.row_number().over(Window.partitionBy(id_, source, k).orderBy(k)))
        share = F.floor(F.col(copies) / F.col(many)) + (F.col(place) <= F.col(copies) % F.col(many)).cast("long")
        found = one.unionByName(more.withColumn(copies, share).drop(place)).where(F.col(copies) > 0)
    return found.withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


ORACLE = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([1.0::double, 2.0::double, 3.0::double])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, source_size::double * 3 as c, (sum(source_size) over ())::double as t from s),
l as (select *, (t - coalesce(sum(c) over b, 0.0)) / (sum(w) over () - coalesce(sum(w) over b, 0.0)) > c / w as capped from w
  window b as (order by c / w, source nulls last rows between unbounded preceding and 1 preceding)),
g as (select source, source_size, case when capped then c else (t - coalesce(sum(case when capped then c end) over (), 0.0)) / nullif(sum(w) over () - coalesce(sum(case when capped then w end) over (), 0.0), 0) * w end as target,
  ('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8))::ubigint::double / 4294967296.0 as u from l),
r as (select d.doc_id, d.size, g.source_size, g.target, g.u, coalesce(g.target / nullif(g.source_size, 0)::double, 0.0) as rate,
  (row_number() over (partition by d.source order by d.size desc, d.doc_id) - 1)::double as r from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (least(floor(u + rate * (r + 1.0)) - floor(u + rate * r), 3) * size)::bigint as taken from r
"""
