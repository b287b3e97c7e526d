"""Long texts of one key as a table of ordered, bounded chunks.

A CVE may hold a third of all references, so its text cannot be one ``collect_list``.  The pieces of
a key are put into place by their byte offsets: running sums inside (key, bucket of the
order), plus the totals of the key's earlier buckets, one row each.  A chunk takes the pieces that
begin in its share of ``most`` bytes; chunks of one key are built in different tasks.
Whoever needs the whole text as one value (a model's prompt) folds the chunks of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a chunk, and pieces of one bucket of the order.
MOST, BUCKET = 1 << 20, 1024


def offsets(pieces: DataFrame, key: str, order: str, size: Column, tie: str, bucket: int = BUCKET) -> DataFrame:
    """``pieces`` with ``_at``: the sum of ``size`` over the key's earlier pieces, by ``order`` (whole
    numbers), then ``tie``.  No task holds more of a key than one bucket of its order."""
    d = pieces.withColumn("_size", size.cast("long")).withColumn("_b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy(key, "_b").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_at", F.sum("_size").over(inside) - F.col("_size"))
    totals = d.groupBy(key, "_b").agg(F.sum("_size").alias("_m"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_k"), F.col("_b").alias("_tb"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    d = d.join(totals, d[key].eqNullSafe(totals["_k"]) & d["_b"].eqNullSafe(totals["_tb"]))
    return d.withColumn("_at", F.col("_at") + F.col("_before")).drop("_size", "_b", "_k", "_tb", "_before")


def text_chunks(pieces: DataFrame, key: str, order: str = "pos", text: str = "text", most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """(key, chunk, text): the texts of each key in ``order`` (ties by text), in chunks of about
    ``most`` bytes, numbered from 0 without gaps of text; the chunks of a key joined are its
    whole text.  A piece is never split, so a chunk is at most one piece longer.  Null texts are
    left out; a key may be null."""
    d = pieces.select(key, F.col(order).cast("long").alias("_o"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    d = offsets(d, key, "_o", F.octet_length("_t"), "_t", bucket).withColumn("chunk", F.floor(F.col("_at") / most))
    parts = F.array_sort(F.collect_list(F.struct("_at", "_o", "_t")))
    return d.groupBy(key, "chunk").agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "").alias(text))


def folded(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): the chunks of each key as one value."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "").alias(text))


def list_chunks(items: DataFrame, by: list[str], order: Column, item: Column, most: int = 1000) -> DataFrame:
    """(by..., chunk, items): the items of each key in lists of about ``most``, for writers that keep lists.
    The chunk is the item's hash, so a key needs no ordered pass; inside a list ``order`` holds."""
    d = items.select(*by, order.alias("_o"), item.alias("_i"))
    total = d.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("_parts")).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_parts")
    same = [d[c].eqNullSafe(total[f"_by_{c}"]) for c in by]
    d = d.join(total, same).withColumn("chunk", F.pmod(F.xxhash64("_o"), F.col("_parts")))
    parts = F.array_sort(F.collect_list(F.struct("_o", "_i")), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return d.groupBy(*by, "chunk").agg(F.transform(parts, lambda x: x["_i"]).alias("items"))
