"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a key that is random but fixed by a hash.  Within a source, documents are ordered
by key; equal-width ranges of the key are the sort ranges, evenly filled because keys are uniform.
Sums per range, their prefix sums and prefix sums inside a range give each document the words
before it, and the source is cut at its budget exactly.  A budget of several times the source repeats whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED = 20240611
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size.  No target exceeds
    ``most`` times the source; what that leaves is shared by weight again until none is above.  In order of cap over
    weight, the level (total - caps before) / (weights from here) is first feasible at one source: those before get their cap.
    """
    rank = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy()
    t = sizes.withColumn("_rank", F.row_number().over(rank) - 1)
    t = t.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("_cap", F.col("source_size").cast("double") * most)
    t = t.withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    t = t.withColumn("_at", F.row_number().over(by_level))
    t = t.withColumn("_first", F.min(F.when(F.col("_fits"), F.col("_at"))).over(everything))
    t = t.withColumn("_final", F.max(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(everything))
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    return t.select("source", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_final") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, epochs, before, rest) for every row of ``docs`` (doc_id, source, size).

    ``taken`` counts words: whole epochs, and in the last, unfinished one the words up to the budget, so a source's
    taken words are its target rounded.  ``before`` and ``rest`` say where the document and the cut of that epoch lie.
    Null sizes count as 0, a null source is a source of its own, rows with equal doc_id and size are
    ordered arbitrarily but exchangeably, and an empty table gives no rows.  No other columns are carried.
    """
    size = F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("_key")
    base = common.materialize(docs.select("doc_id", "source", size, name, key), "mix")
    ranges = min(65536, max(256, 1 << (base.count() // 20_000).bit_length()))
    base = base.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    sums = base.groupBy("_s", "_range").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    of_source = sums.groupBy("_s").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    wanted = targets(of_source.select("source", "source_size"), weights, most).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    earlier = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_s", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")).join(wanted, "_s")
    inside = Window.partitionBy("_s", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("_upto", F.sum("size").over(inside)).join(starts, ["_s", "_range"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.withColumn("before", F.col("_start") + F.col("_upto") - F.col("size"))
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    placed = placed.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source", "epochs", "before", "rest")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as the mix takes it.

    The document that a budget cuts comes with its first words up to the budget, and ``n_chars`` follows its text.  Empty documents
    go along with the epochs.  ``doc_id`` must identify a document; rows that share it are taken alike, as the first of them is.
    """
    spark_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    part = F.col("taken") - F.col("epochs") * F.col("size")
    last = (F.col("rest") > 0) & ((part > 0) | (F.col("size") == 0) & (F.col("before") <= F.col("rest")))
    times = (F.col("epochs") + F.when(last, 1).otherwise(0)).cast("int")
    cut = F.when((part > 0) & (part < F.col("size")), part).cast("int")
    how = mix(sized, seed).select(spark_id.alias("_id"), times.alias("_times"), cut.alias("_cut")).groupBy("_id").agg(F.max(F.struct("_times", "_cut")).alias("_how")).select("_id", "_how.*")
    packed = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), spark_id.alias("_id"), F.col("text").alias("_text"))
    copies = packed.join(how.where("_times > 0"), "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    # Pieces are a word with the white space before it, so the first ones are the text's beginning as it stands.
    pieces = F.split("_text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    is_cut = (F.col("_copy") == F.col("_times")) & F.col("_cut").isNotNull()
    copies = copies.withColumn("_text", F.when(is_cut, F.array_join(F.slice(pieces, F.lit(1), F.coalesce("_cut", F.lit(0))), "")).otherwise(F.col("_text")))
    out = {c: F.col(f"_doc.`{c}`").alias(c) for c in docs.columns} | {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(is_cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars")).alias("n_chars")
    return copies.select(*out.values())


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the mix over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as rk, 3.0::double * source_size as cap from s),
w as (select *, (rk % 3 + 1)::double as w from r),
o as (select *, row_number() over lv as pos,
        (sum(source_size::double) over () - coalesce(sum(cap) over (lv rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (lv rows between current row and unbounded following) as lam
      from w window lv as (order by cap / w, rk)),
f as (select *, min(case when lam * w <= cap then pos end) over () as k from o),
t as (select source, source_size, case when k is null or pos < k then cap else max(case when pos = k then lam end) over () * w end as target from f),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::bigint as budget,
        (sum(d.size) over (partition by d.source order by md5('{SEED}:' || coalesce(d.doc_id::varchar, 'null')), d.doc_id, d.size rows between unbounded preceding and current row) - d.size)::bigint as bef
      from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as ep from p)
select doc_id, size, source_size, target,
  (ep * size + greatest(0, least(size, budget - ep * source_size - bef)))::bigint as taken from e
"""
