"""Mixing sources to target weights by hash-random keys and exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, null_key, parts_for, ranked, word_count

#: Sources in code-point order weigh these in turn.
WEIGHTS = (5, 2, 1)
#: All targets together, as a multiple of all sizes.
SHARE = 1.5
#: No target goes beyond this many times its source's size.
MAX_EPOCHS = 2
#: Rows of one hash range of a source: what one window task sorts at a time.
BUCKET_ROWS = 1000
#: Buckets of a block, as a power of two: what one window task adds up.
BLOCK_BITS = 14
#: Up to so many sources their table (a few dozen bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(base: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """One row per source: ``_s, source_size, n_rows, target``; and their number.

    The targets share ``share`` times all sizes by weight. A target above
    ``max_epochs`` times its source's size stops there and the excess is shared
    again by weight, until none is above: each round is one aggregate of the
    table of sources, and the level rises monotonically to its fixed point.
    """
    totals = base.groupBy("_s", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = [F.col("_source").asc_nulls_last()]
    sources = ranked(totals, order, "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("_w", weight.cast("long")), "sources")
    n, size, all_w = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    budget = float(share) * size
    level, capped = budget / all_w if all_w else 0.0, -1
    while True:
        above = F.col("source_size") * float(max_epochs) <= F.col("_w") * F.lit(level)
        k, s, w = sources.where(above).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if k == capped or k == n:
            break
        capped, level = k, (budget - float(max_epochs) * s) / (all_w - w)
    target = F.when(above, F.col("source_size") * float(max_epochs)).otherwise(F.col("_w") * F.lit(level))
    return sources.select("_s", "source_size", "n_rows", target.cast("double").alias("target")), n


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """How many words a mix takes of each row: ``id, keep..., size, source_size, target, taken``.

    Every row gets a hash-random key from its id and text. Within a source rows stand in
    the order of their keys; the running sum of sizes before a row says how much
    of the budget is left for it. A budget of several times the source's size
    takes whole epochs first and cuts the last one exactly at the budget, so
    the row at the cut is taken in part.

    The running sum is distributed: keys are uniform, so equal ranges of the key
    split any source, however hot, into buckets of about ``BUCKET_ROWS`` rows;
    bucket totals, summed in blocks and blocks of a source, give each bucket's
    offset and one window per bucket the rest.

    Defined results: a null or empty text has size 0 and takes 0. A null source
    is a source, last in order. Rows that share an id (null ids too) have keys by
    their texts; rows that are equal in both are interchangeable. Ids may be of
    any type. An empty table gives no rows. Other columns are carried only when named in
    ``keep``; their names may not be those of the result.
    """
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col(text_col), F.lit("")))
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), *[F.col(c).alias(f"_keep_{c}") for c in keep], word_count(F.col(text_col)).alias("size"), key.alias("_key")).withColumn("_s", null_key(F.col("_source")))
    narrow = materialize(rows.select("_id", "_source", "_s", "size", "_key"), "sizes")
    sources, n = source_targets(narrow, weights, share, max_epochs)
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_rows") / F.lit(float(BUCKET_ROWS))))).cast("int")
    sources = sources.withColumn("_bits", bits)
    hint = F.broadcast if n <= BROADCAST_SOURCES else (lambda d: d)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(hint(sources), "_s").withColumn("_bucket", F.expr("shiftright(_key, 60 - _bits)"))

    totals = placed(narrow).groupBy("_s", "_bucket").agg(F.sum("size").alias("_size"))
    # prefix sums in two levels, so that no task holds all buckets of a source
    totals = materialize(totals.withColumn("_block", F.shiftright("_bucket", BLOCK_BITS)), "buckets")
    first = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("_s", "_block").agg(F.sum("_size").alias("_size")).select("_s", "_block", F.coalesce(F.sum("_size").over(first), F.lit(0)).alias("_ahead"))
    earlier = Window.partitionBy("_s", "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_s", "_block", "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")).join(blocks, ["_s", "_block"])
    offsets = offsets.select("_s", "_bucket", (F.col("_offset") + F.col("_ahead")).alias("_offset"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = placed(rows if keep else narrow).join(offsets, ["_s", "_bucket"])
    before = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("_offset")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - before
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed_rows.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source_size", "target", taken.cast("long").alias("taken"))
