"""Mixing sources to target weights with exact word budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, numbered, prefix_sums, reliable, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str, seed: str = SEED) -> Column:
    """Random by hash, the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of the sum
    of sizes; a target stops at ``most`` times its source's size and the rest is shared again by weight. The fixed
    point is min(most * size, level * weight): sorted by most * size / weight, the capped sources come first,
    and the level is what they leave over the weights that remain. Ranks and sums are distributed prefix
    sums, so the number of sources has no bound."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    ranked = prefix_sums(sizes, ["source"], "source_size").select(
        "source", "source_size", F.col("total").alias("all_size"), weight.alias("weight"))
    ranked = ranked.select("*", (most * F.col("source_size")).alias("cap"), (most * F.col("source_size") / F.col("weight")).alias("ratio"))
    by_cap = prefix_sums(ranked, ["ratio", "source"], "cap").withColumnsRenamed({"before": "cap_before"}).drop("index", "total", "count")
    both = prefix_sums(by_cap, ["ratio", "source"], "weight").withColumnsRenamed({"before": "weight_before"})
    # a source is capped if the level that its predecessors leave is at or over its ratio
    level = (share * F.col("all_size") - F.col("cap_before")) / (F.col("total") - F.col("weight_before"))
    levels = reliable(both.select("source", "source_size", "weight", "cap", "ratio", "cap_before", level.alias("level")))
    found = levels.filter(F.col("level") < F.col("ratio")).agg(F.min(F.struct("ratio", "cap_before", "level"))["level"]).first()[0]  # one number
    return levels.select("source", "source_size", F.least("cap", F.lit(found) * F.col("weight")).alias("target"))  # least skips a null


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` has row, doc_id, source and size (words). Adds source_size, target, copies (whole times the
    mix takes the row) and taken (copies * size).

    Within a source, rows follow a hash of doc_id and are range-sorted; every full epoch takes all rows once, and
    the last one takes the rows whose middle word lies before the remaining budget. Rows without words follow the
    same rule (they take no words). Ties follow the size, then the input. Rows of a null source are a source of
    their own. An empty table gives no rows."""
    keyed = docs.withColumn("shuffle_key", shuffle_key("doc_id", seed))
    sums = reliable(prefix_sums(keyed.withColumn("row_of", F.col("row")).drop("row"), ["shuffle_key", "size"], "size", ["source"]))
    targets = source_targets(sums.groupBy("source").agg(F.max("total").alias("source_size")), weights, share, most)
    joined = sums.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    last = F.when(2 * F.col("before") + F.col("size") < 2 * rest, 1).otherwise(0)
    return (joined.withColumn("epochs", epochs.cast("long")).withColumn("copies", (F.col("epochs") + last).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("row_of", "row")
            .drop("before", "index", "total", "count", "shuffle_key", "epochs"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix, repeated ones included, with the columns of ``docs``."""
    row = fresh(docs, "row")
    held = reliable(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = held.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    copies = mix(slim, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(f"{row}_copies"))
    out = held.join(copies, row).withColumn(f"{row}_copy", F.explode(F.expr(f"sequence(1, `{row}_copies`)")))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = numbered(docs.select("doc_id", "source", word_count().alias("size"))).drop("node")
    return mix(slim).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, 'null')) as k
  from documents),
sums as (
  select *, coalesce(sum(size) over (partition by source order by k, size, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before,
         sum(size) over (partition by source)::bigint as source_size from sized),
ranked as (
  select source, max(source_size) as source_size, row_number() over (order by source nulls last) - 1 as i from sums group by source),
weighted as (
  select *, case i % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, 2.0::double * source_size as cap from ranked),
ordered as (
  select *, cap / weight as ratio,
    coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as cap_before,
    sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as weight_left,
    sum(source_size) over ()::double as all_size from weighted),
levels as (select *, (1.5::double * all_size - cap_before) / weight_left as level from ordered),
last as (select (select level from levels where level < ratio order by ratio, cap_before limit 1) as level),
targets as (
  select l.source, l.source_size, case when last.level is null then l.cap else least(l.cap, last.level * l.weight) end as target
  from levels l cross join last)
select s.doc_id, s.size, s.source_size, t.target, s.source, c.copies, c.copies * s.size as taken
from sums s join targets t on s.source is not distinct from t.source,
lateral (select (case when s.source_size > 0 then floor(t.target / s.source_size) else 0 end
  + case when 2 * s.before + s.size < 2 * (t.target - (case when s.source_size > 0 then floor(t.target / s.source_size) else 0 end) * s.source_size) then 1 else 0 end)::bigint as copies) c
"""
