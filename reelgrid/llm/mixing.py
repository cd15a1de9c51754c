"""Mixing sources to target weights by cuts in a random order.

Each document gets a hash-random key. Inside a source the documents are ordered by key, in ranges of the key (uniform, so
that the ranges need no sampling and are alike at every size): one sum of sizes for each range, prefix sums over
the ranges, and running sums inside a range give every document its place in the source without a sort of the
whole source in one task. The source is then cut at its exact budget; where the budget is larger than the source,
the whole source is repeated first, and the cut falls in the last repeat. The document at the cut gives the words up to it.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id is hashed like any other.
Equal keys (repeated rows) are ordered by id, then text digest; rows equal in all of them are interchangeable.
An empty table gives no rows. A source without words has the target 0.
Long texts are counted whole. Other columns are not read; carried ones travel in a struct, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from reelgrid.llm.texts import each

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the random key inside a source: hexadecimal digits of the key.
RANGE_DIGITS = 3


def sizes(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, key, range, tie, and the carried columns in a struct `doc`."""
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       key.alias("key"), F.substring(key, 1, RANGE_DIGITS).alias("range"), F.xxhash64(F.col(text)).alias("tie"),
                       *([F.struct(*each(carry)).alias("doc")] if carry is not None else []))


def targets(per_source: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Adds `target`: shares by weight of all words, none above `most` times the source, the excess shared again by weight.

    Water-filling in closed form: with the sources in the order of cap / weight, those that are full at the final level
    come first, and the level follows from the sums of caps and weights before each. One row for each source.
    """
    ranked = per_source.withColumn("__n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") - 1) % len(weights) + 1)
    shaped = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("__cap") / F.col("__w"), "__n")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)))
             / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(earlier), F.lit(0.0))))
    stepped = shaped.withColumn("__level", level)
    # the first source that is not full at its level fixes the level for itself and all later ones
    found = stepped.withColumn("__fix", F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.struct(
        (F.col("__cap") / F.col("__w")).alias("at"), F.col("__n").alias("n"), F.col("__level").alias("level")))).over(everything))
    return found.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__fix.level") * F.col("__w"), F.col("__cap"))).alias("target"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds `before`: the words of the source ahead of the document in the random order."""
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("__range"))
    ahead = sums.select(F.col("source").alias("__s"), F.col("range").alias("__r"), F.coalesce(F.sum("__range").over(
        W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(ahead, local["source"].eqNullSafe(ahead["__s"]) & (local["range"] == ahead["__r"]))
            .withColumn("before", F.col("__ahead") + F.col("__inside")))


def taken(target: Column, source_size: Column, size: Column, before: Column) -> Column:
    """Words of a document in the mix: whole repeats of the source, then what the cut leaves of it."""
    epochs = F.when(source_size > 0, F.floor(target / source_size)).otherwise(F.lit(0))
    rest = F.floor(target) - epochs * source_size
    return (epochs * size + F.least(F.greatest(rest - before, F.lit(0)), size)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: list[float] | None = None, most: float = 3, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of `docs`. `carry` names more columns of `docs` to
    return, in a struct `doc`."""
    rows = sizes(docs, doc_id, text, source, seed, carry)
    per_source = sizes(docs, doc_id, text, source, seed).groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(per_source, weights or [1.0, 2.0, 3.0], most).withColumnRenamed("source", "__t")
    spread = placed(rows)
    return (spread.join(aims, spread["source"].eqNullSafe(aims["__t"]))
            .select(*(["doc"] if carry is not None else []), "doc_id", "source", "size", "source_size", "target",
                    taken(F.col("target"), F.col("source_size"), F.col("size"), F.col("before")).alias("taken")))


SQL = r"""
with s as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5('mix|' || coalesce(doc_id::varchar, '')) as key from documents),
p as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from s group by source),
w as (select *, [1.0, 2.0, 3.0][(n - 1) % 3 + 1]::double as w, source_size * 3.0::double as cap from p),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double
        / (sum(w) over () - coalesce(sum(w) over o, 0)) as level from w
      window o as (order by cap / w, n rows between unbounded preceding and 1 preceding)),
f as (select arg_min(level, (cap / w, n)) as level from l where cap >= level * w),
t as (select source, source_size, least(cap, coalesce(f.level * w, cap)) as target from l, f),
b as (select s.*, t.source_size, t.target, coalesce(sum(size) over (partition by s.source order by key, doc_id
        rows between unbounded preceding and 1 preceding), 0) as before
      from s join t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then floor(target / source_size) else 0 end * size
   + least(greatest(floor(target) - case when source_size > 0 then floor(target / source_size) else 0 end * source_size - before, 0), size))::bigint as taken
from b
"""
