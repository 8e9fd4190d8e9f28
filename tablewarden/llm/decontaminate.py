"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations alone.

A test item counts as contained in a document if at least ``share`` of its distinct word shingles occur there.  Items fall into
classes by their number of shingles, each class twice as large as the one before.  An item's signature is its k smallest shingle
hashes; k belongs to the class and is one more than the shingles that an item of it may lack, so every document that contains
the item holds one of them: the search loses nothing, however long the document.  What it finds is verified on the shingles
themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_small, rows_of

WIDTH, SHARE = 5, 0.8
CLASSES = 40  # items of up to 2**40 shingles


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(df: DataFrame, size: Column, of: str, made: Column, lengths: list[int], *keep: str) -> DataFrame:
    """One row per position: ``shingle`` made from ``of`` at position ``i``.  ``lengths`` are the shingle lengths wanted."""
    parts = []
    for length in lengths:
        at = F.explode(F.when(size >= length, F.sequence(F.lit(0), size - length)))
        parts.append(df.select(*keep, of, at.alias("i")).select(*keep, F.lit(length).alias("length"), _at(of, length, made).alias("shingle")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _at(of: str, length: int, join: Column | None) -> Column:
    pieces = [F.get(of, F.col("i") + k) for k in range(length)]
    return F.xxhash64(*pieces) if join is None else F.concat_ws(" ", *pieces)


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``item_hash``, ``length``, ``shingle``, ``code`` (its hash), ``n_item``, ``need`` (shingles), ``signs`` (is in the signature): the distinct shingles of every item.

    Items of fewer than five words have one shingle, all their words; items without words have none.  Repeated equal rows count once.
    """
    flat = rows_of(items, item_id=F.col(id_col).cast("bigint"), words=words_of(F.col(text_col))).where(F.size("words") > 0)
    flat = flat.withColumn("item_hash", F.xxhash64("words")).distinct()
    least = F.least(F.size("words"), F.lit(WIDTH))
    spread = flat.withColumn("length", least).select("item_id", "item_hash", "length", "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("i"))
    whole = F.array_join(F.slice("words", F.col("i") + 1, F.col("length")), " ")
    code = F.lit(None).cast("bigint")
    for length in range(1, WIDTH + 1):
        hashes = [F.xxhash64(F.get("words", F.col("i") + k)) for k in range(length)]
        code = F.when(F.col("length") == length, F.xxhash64(*hashes)).otherwise(code)
    distinct = spread.select("item_id", "item_hash", "length", whole.alias("shingle"), code.alias("code")).distinct()
    key = ["item_id", "item_hash"]
    sizes = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n_item"), F.sort_array(F.collect_set("code")).alias("codes"))
    need = F.ceil(F.col("n_item") * F.lit(SHARE).cast("decimal(3,2)")).cast("bigint")
    # Of u shingles, the most in the class, u - ceil(share * u) may be lacking.
    k = F.lit(1)
    for c in range(1, CLASSES):
        upper = 2 ** (c + 1) - 1
        k = F.when(F.col("n_item") >= 2**c, upper - math.ceil(round(SHARE * upper, 6)) + 1).otherwise(k)
    sized = sizes.select(*key, "n_item", need.alias("need"), F.slice("codes", 1, k.cast("int")).alias("signature"))
    same = [F.col(f"one.{c}").eqNullSafe(F.col(f"all.{c}")) for c in key]
    joined = distinct.alias("one").join(sized.alias("all"), same)
    return joined.select("one.item_id", "one.item_hash", "length", "shingle", "code", "n_item", "need", F.array_contains("signature", F.col("code")).alias("signs"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``n_shared``, ``n_item``: every document (row text) with every item it contains.

    Null and empty texts contain nothing and null or wordless items are in nothing.  Rows with equal id and text count once; null
    ids of either side are kept as null.  Empty tables give no rows.  The items' shingles are broadcast only if they were counted
    and are few; the documents are never grouped by shingle, so a passage in a third of them makes no hot key.
    """
    table = cut_lineage(item_shingles(items, item_col, item_text_col))
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # at most five numbers
    flat = rows_of(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col)
    flat = flat.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    if not lengths:
        return flat.where("false").select("doc_id", "text_hash", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).cast("bigint").alias("n_item"))

    key = ["doc_id", "text_hash"]
    coded = flat.select(*key, F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    probes = shingles(coded, F.size("codes"), "codes", None, lengths, *key).withColumnRenamed("shingle", "code")
    signatures = cut_lineage(table.where("signs").select("length", "code", "item_id", "item_hash").distinct())
    found = cut_lineage(join_small(probes, signatures, ["length", "code"], "inner").select(*key, "item_id", "item_hash").distinct())

    # The documents found are read again and compared shingle by shingle with the items found in them.
    chosen = cut_lineage(found.select(F.coalesce("doc_id", F.lit(-1)).alias("id_key"), "text_hash").distinct())
    again = join_small(flat.withColumn("id_key", F.coalesce("doc_id", F.lit(-1))), chosen, ["id_key", "text_hash"], "left_semi")
    texts = shingles(again, F.size("words"), "words", F.lit(""), lengths, *key)
    parts = cut_lineage(table.select("item_id", "item_hash", "length", "shingle", "n_item", "need"))
    hits = join_small(texts, parts, ["length", "shingle"], "inner").distinct()
    counted = hits.groupBy(*key, "item_id", "item_hash", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.where("n_shared >= need").select(*key, "item_id", "n_shared", "n_item")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; all other rows and columns stay."""
    found = cut_lineage(contained(docs, items, id_col, text_col).select(F.coalesce("doc_id", F.lit(-1)).alias("__id_key"), F.col("text_hash").alias("__text_hash")).distinct())
    keyed = docs.withColumns({"__id_key": F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)), "__text_hash": F.xxhash64(F.col(text_col))})
    return join_small(keyed, found, ["__id_key", "__text_hash"], "left_anti").drop("__id_key", "__text_hash")
