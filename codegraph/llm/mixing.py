"""Mixing sources to target weights by temperature (operator 10, native).

A source's weight is its token share to the power `exponent`, normalised.
The exponent is bisected: the smallest (flattest mix) that keeps every source
within `max_epochs` passes over its documents, or the one whose weights have
`target_entropy` (nats).  The token budget is the smallest that leaves no
document out: the source with the fewest passes gets exactly one.

Weights are realised as block permutations.  In every pass the documents are
permuted by a hash of seed, pass and doc_id; its leading hex digits number the
block, and a document's position is its place in the order of its block's
hashes.  Whole passes take every document; of the last,
partial pass the blocks up to a cut block are taken, and of the cut block the
documents up to a cut key, so that the budget is met to within one document.
Only block sums and one cut row a source are computed; a hot source is spread
over its blocks, and no window sees more than one block.  Tokens are counted
once, into a stored table of (doc_id, source, tokens).  More sources than a
broadcast may hold are joined by a merge join of stored tables, which adaptive
execution splits where a source is hot.

All of it is DataFrame and SQL functions.  Defined cases: a null source is a
source of its own; null or empty texts count no tokens; a source without any
tokens gets one pass and weight 0; rows that repeat a doc_id fall in or out
together; an empty table gives an empty result; input columns named like the
four new ones are replaced, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, small, stored, unused

MAX_EPOCHS = 2.0
BLOCK_DIGITS = 3
SEED = "mix"
STEPS = 60
#: One row a source; up to here, counted first, the tables of plans and cuts are broadcast.
BROADCAST_BYTES = 16 << 20


def count_tokens(text: Column) -> Column:
    """White-space words, the token measure of the mix."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def bisected_exponent(shares: Column, max_epochs: float | None, target_entropy: float | None) -> Column:
    """The exponent in [0, 1] for an array of positive shares."""
    top, least = F.array_max(shares), F.array_min(shares)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def fits(t: Column) -> Column:
        if target_entropy is None:
            return F.pow(top / least, F.lit(1.0) - t) <= F.lit(float(max_epochs))
        # entropy = ln z - sum(w ln w) / z falls as the exponent rises
        z = total(F.transform(shares, lambda s: F.pow(s, t)))
        return F.log(z) - total(F.transform(shares, lambda s: F.pow(s, t) * t * F.log(s))) / z <= F.lit(float(target_entropy))

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        return F.when(fits(mid), F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), a["hi"].alias("hi")))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["hi"]))


def source_cuts(docs: DataFrame, text: str, doc_id: str, source: str, max_epochs: float | None, target_entropy: float | None, seed: str, block_digits: int) -> DataFrame:
    """One row a source: its weight, whole passes, and the cut of its last pass."""
    rows = stored(docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), count_tokens(F.col(text)).alias("n_tokens")), "mix-tokens")
    stats = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("total")), "mix-sources")
    # one number a source in one row: a million sources are 8 MB
    row = stats.filter("total > 0").agg(F.collect_list("total").alias("totals"))
    row = row.select(F.transform("totals", lambda t: t / F.aggregate("totals", F.lit(0.0), lambda a, x: a + x)).alias("shares"))
    row = row.select(F.array_max("shares").alias("top"), "shares", bisected_exponent(F.col("shares"), max_epochs, target_entropy).alias("exponent"))
    row = row.select("top", "exponent", F.aggregate("shares", F.lit(0.0), lambda a, s: a + F.pow(s, F.col("exponent"))).alias("z"))
    grand = stats.agg(F.sum("total").alias("grand"))
    share = F.col("total") / F.col("grand")
    plan = stats.join(F.broadcast(row), F.lit(True)).join(F.broadcast(grand), F.lit(True)).select(
        "source", "total", "exponent",
        F.when(F.col("total") > 0, F.pow(share, F.col("exponent")) / F.col("z")).otherwise(0.0).alias("weight"),
        F.when(F.col("total") > 0, F.pow(F.col("top") / share, 1 - F.col("exponent"))).otherwise(1.0).alias("passes"),
    )
    whole = F.floor(F.col("passes") + 1e-9)
    plan = stored(plan.withColumn("whole", whole).withColumn("rest", F.floor(F.greatest(F.col("passes") - F.col("whole"), F.lit(0.0)) * F.col("total") + 1e-6)), "mix-plan")

    # blocks of the last pass: sums, then the block in which the budget ends, then the key in it
    small = plan.filter("rest > 0").select("source", "whole", "rest")
    keyed = with_plan(rows, small, "inner").withColumn("key", order_key(F.col("doc_id"), F.col("whole") + 1, seed)).withColumn("block", F.substring("key", 1, block_digits))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    cut = stored(sums.filter("before < rest AND before + tokens >= rest").select("source", F.col("block").alias("cut_block"), F.col("before").alias("block_start")), "mix-blocks")
    inside = with_plan(keyed, cut, "inner").filter(F.col("block") == F.col("cut_block"))
    inside = inside.groupBy("source", "key", "block_start", "rest").agg(F.sum("n_tokens").alias("tokens"))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("before", F.col("block_start") + F.coalesce(F.sum("tokens").over(by_key), F.lit(0))).filter("before < rest")
    ends = taken.groupBy("source").agg(F.max("key").alias("cut_key"))
    cuts = stored(with_plan(plan, ends, "left"), "mix-cuts")
    drop(rows, stats, plan, cut)
    return cuts


def with_plan(rows: DataFrame, plan: DataFrame, how: str) -> DataFrame:
    """rows joined to a table of one row a source, broadcast only within its checked size."""
    right = plan.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(right) if small(plan, BROADCAST_BYTES) else right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def placed(rows: DataFrame, doc_id: str, epoch: str, seed: str = SEED, block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """rows with _block and _position, the place of a row in the permutation of its block of its pass."""
    key = unused(rows.columns, "key")
    keyed = rows.withColumn(key, order_key(F.col(doc_id), F.col(epoch), seed)).withColumn("_block", F.substring(key, 1, block_digits))
    inside = Window.partitionBy(epoch, "_block").orderBy(key)
    return keyed.withColumn("_position", F.row_number().over(inside).cast("long")).drop(key)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_epochs: float | None = MAX_EPOCHS, target_entropy: float | None = None, seed: str = SEED, block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """docs, a row for each pass that takes it, with _epoch, _block, _position, _weight.

    The new columns replace ones of their names.  Every document comes at
    least once; (_epoch, _block, _position) is the order of the permutation.
    """
    cuts = source_cuts(docs, text, doc_id, source, max_epochs, target_entropy, seed, block_digits)
    base = docs.drop(*(c for c in docs.columns if c.lower() in ("_weight", "_epoch", "_block", "_position")))
    name, whole, cut = (unused([*base.columns, "_weight"], c) for c in ("name", "whole", "cut"))
    right = cuts.select(F.col("source").alias(name), F.col("whole").alias(whole), F.col("cut_key").alias(cut), F.col("weight").alias("_weight"))
    joined = base.join(F.broadcast(right) if small(cuts, BROADCAST_BYTES) else right, base[source].cast("string").eqNullSafe(F.col(name)))
    more = F.when(F.col(cut).isNotNull() & (order_key(base[doc_id], F.col(whole) + 1, seed) <= F.col(cut)), 1).otherwise(0)
    out = joined.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole) + more))).drop(name, whole, cut)
    return placed(out, doc_id, "_epoch", seed, block_digits)


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> tuple[DataFrame, list[str]]:
    """A mix whose new columns were dropped, with columns to sort it by again: the pass, and the key in it.

    The passes of a document are its copies, so their number is the pass.
    """
    epoch, key, mark = (unused(docs.columns, c) for c in ("epoch", "key", "mark"))
    copies = Window.partitionBy(doc_id, mark).orderBy(mark)
    numbered = docs.withColumn(mark, F.xxhash64(F.col(text))).withColumn(epoch, F.row_number().over(copies).cast("long")).drop(mark)
    return numbered.withColumn(key, order_key(F.col(doc_id), F.col(epoch), seed)), [epoch, key]
