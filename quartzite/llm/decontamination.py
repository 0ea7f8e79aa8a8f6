"""Benchmark decontamination in DataFrame functions only.

A document is contaminated by an item if some window of it, as many words long as the item, has a weighted Jaccard similarity of at
least ``similarity`` with the item, over word shingles counted with repeats.

1. Windows. Such a window shares at least ``need`` shingles with its item, and a window moved on to start at its first shared
   shingle shares no fewer. So windows as long as an item are laid where a document's shingle is one of some item of that length, and only
   where enough such shingles follow. Which item that may be is left open.
2. Fingerprints. Windows and items get 64-bit SimHash fingerprints of their (shingle, occurrence number) pairs, so repeats count as they do in
   the similarity and don't flip the same bits together.
3. Multi-index blocks. 64 bits make eight blocks; two fingerprints within ``RADIUS`` = 23 bits differ by at most two bits in one block.
   Items are indexed under every block value within two bits, so looking up a window's eight block values finds all items in the radius.
   At a similarity of 0.8 the distance is 9 on average; the tests draw pairs for many item lengths and find none beyond the radius.
4. Candidates within the radius are verified by their exact similarity.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, ascii_lower, fresh, stored
from .line_dedup import row_key

BLOCKS, WIDTH, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1


def word_hashes(text: Column) -> Column:
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order, repeats included."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def with_prints(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``keys`` (unique) and print, the SimHash of the array column ``hashes``: a bit is 1 if it is set in over half of its elements.

    The elements are the hashes with their occurrence numbers, so repeats are elements of their own, as they are for the weighted similarity;
    the first occurrence is the hash itself, and only arrays with repeats are counted. One sum counts two bits, the second 32 places higher.
    """
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(pair)).alias(f"b{b}") for b in range(32)]
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    plain = rows.filter(~repeats).select(*keys, F.explode(hashes).alias("h"))
    times = rows.filter(repeats).select(*keys, F.explode(hashes).alias("h")).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("c"))
    numbered = times.select(*keys, F.explode(F.sequence(F.lit(1), "c")).alias("nth"), "h").select(*keys, F.when(F.col("nth") == 1, F.col("h")).otherwise(F.xxhash64("h", "nth")).alias("h"))
    counted = plain.unionByName(numbered).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    set_ = lambda count, b: F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    low = [set_(F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1)), b) for b in range(32)]
    high = [set_(F.shiftrightunsigned(f"b{b}", 32), b + 32) for b in range(32)]
    return counted.select(*keys, reduce(Column.bitwiseOR, low + high).alias("print"))


def block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _items(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, k (shingle length), s (number of shingles), item (their hashes); items without words are left out."""
    words = benchmark.select(F.col(id_col).alias("item_id"), word_hashes(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    per_k = F.lit(None)
    for j in range(k, 0, -1):
        per_k = F.when(F.least(F.size("words"), F.lit(k)) == j, shingles(F.col("words"), j)).otherwise(per_k)
    return words.withColumn("k", F.least(F.size("words"), F.lit(k))).withColumn("item", per_k).withColumn("s", F.size("item")).drop("words")


def _windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, t: float, broadcast_rows: int) -> DataFrame | None:
    """doc_id, row, k, s, start, window: the item-sized windows that may be similar to an item; None without items."""
    index = items.select("k", "s", F.explode("item").alias("h")).distinct()
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # 1 to ``words``
    small = index.count() <= broadcast_rows
    # posexplode_outer: for posexplode, the optimizer adds a filter that repeats the whole shingle expression inside its own lambda.
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), row_key(F.col(text_col)).alias("row"), word_hashes(F.col(text_col)).alias("words"))
    found, names = None, ["doc_id", "row", "s", "n", "pos", "start"]
    for k in lengths:
        rows = base.select("doc_id", "row", shingles(F.col("words"), k).alias("hs"))
        size_, at = F.least("s", "n"), F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - F.col("s")))
        own = index.filter(F.col("k") == k).select("s", "h")
        cut = F.slice("hs", at + 1, size_).alias("window")
        if small:
            hits = rows.select("doc_id", "row", "hs", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h")).join(F.broadcast(own), "h")
            hits = hits.select(*names[:-1], at.alias("start"), cut)
        else:
            hits = rows.select("doc_id", "row", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h")).join(own, "h").select(*names[:-1], at.alias("start"))
        # Hits that follow within the item's length, in units of it; a window pushed back from the text's end may also hold earlier ones.
        over = Window.partitionBy("doc_id", "row", "s").orderBy("unit")
        ahead = F.count(F.lit(1)).over(over.rangeBetween(0, 1))
        around = F.count(F.lit(1)).over(over.rangeBetween(-1, 1))
        need = F.ceil(F.lit(t) * (F.col("s") + size_) / (1 + t) - 1e-9)
        hits = hits.withColumn("unit", F.col("pos") / F.col("s").cast("double")).withColumn("enough", F.when(F.col("start") < F.col("pos"), around).otherwise(ahead) >= need).filter("enough")
        if not small:
            hits = hits.select(*names).join(rows, ["doc_id", "row"]).withColumn("window", cut)
        part = hits.select("doc_id", "row", F.lit(k).alias("k"), "s", "start", "window")
        found = part if found is None else found.unionByName(part)
    return found


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, words: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """doc_id, row, item_id, similarity, start of every window that is similar enough; rows without id have the id LAST_ID."""
    t = float(similarity)
    items = stored(_items(benchmark, item_id_col, item_text_col, words).withColumn("item_row", F.xxhash64("item")), "items")
    laid = _windows(docs, items, id_col, text_col, t, broadcast_rows)
    ids = items.select("item_id", "item_row", "k", "s").distinct()
    if laid is None:
        none = ids.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
        return none.filter(F.lit(False))
    at = ["doc_id", "row", "k", "s", "start"]
    windows = stored(laid.dropDuplicates(at), "windows")
    probes = with_prints(windows, at, "window").select("*", F.posexplode(F.array(*[block(F.col("print"), b) for b in range(BLOCKS)])).alias("block", "value"))
    masks = [m for m in range(1 << WIDTH) if m.bit_count() <= NEAR]
    texts = items.select("item_row", "k", "s", "item").dropDuplicates(["item_row", "k", "s"])
    prints = with_prints(texts, ["item_row", "k", "s"], "item").withColumnRenamed("print", "item_print")
    table = prints.select("*", F.posexplode(F.array(*[block(F.col("item_print"), b) for b in range(BLOCKS)])).alias("block", "exact"))
    table = table.select("item_row", "k", "s", "item_print", "block", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("exact").bitwiseXOR(m))).alias("value"))
    far = F.col("print").bitwiseXOR(F.col("item_print"))
    # A pair that meets in several blocks counts in the first of them only.
    earlier = F.lit(False)
    for b in range(BLOCKS - 1):
        earlier = earlier | ((F.col("block") > b) & (F.bit_count(block(far, b)) <= NEAR))
    pairs = probes.join(table, ["k", "s", "block", "value"]).filter((F.bit_count(far) <= RADIUS) & ~earlier).select(*at, "item_row")
    # Sum of the lesser over the sum of the greater counts of each shingle.
    mine = pairs.join(windows, at).select(*at, "item_row", F.size("window").alias("n"), F.explode("window").alias("h")).groupBy(*at, "item_row", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    theirs = texts.select("item_row", "k", "s", F.explode("item").alias("h")).groupBy("item_row", "k", "s", "h").agg(F.count(F.lit(1)).alias("d"))
    same = mine.join(theirs, ["item_row", "k", "s", "h"]).groupBy(*at, "item_row", "n").agg(F.sum(F.least("c", "d")).alias("same"))
    exact = same.withColumn("similarity", F.col("same") / (F.col("n") + F.col("s") - F.col("same")).cast("double")).filter(F.col("similarity") >= t - 1e-12)
    return exact.join(ids, ["item_row", "k", "s"]).select("doc_id", "row", "item_id", "similarity", "start")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, similarity, start (first word of the best window).

    Texts are lower-cased (A-Z) and split at [\x20\x09-\x0D]. Items of fewer than ``words`` words are one shingle, their whole sequence; items
    and documents without words match nothing; a document shorter than an item is one window. Rows of one id are one document, each text
    of it is searched; rows with a null id are one document too. Empty tables give no rows; other columns are ignored. An item
    index of up to ``broadcast_rows`` shingles is sent to every task; a larger one is joined by shuffle, and the windows are cut from a
    second read of the matched documents.
    """
    found = _found(docs, benchmark, id_col, text_col, item_id_col, item_text_col, words, similarity, broadcast_rows)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select(F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")).alias("doc_id"), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """``docs`` without the rows whose own text :func:`contaminated` finds, those with a null id included; all columns stay."""
    found = _found(docs, benchmark, id_col, text_col, item_id_col, item_text_col, words, similarity, broadcast_rows)
    same, digest = fresh("same_id", docs), fresh("same_row", docs)
    gone = found.select(F.col("doc_id").alias(same), F.col("row").alias(digest)).distinct()
    return docs.join(gone, (F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)) == gone[same]) & (row_key(docs[text_col]) == gone[digest]), "left_anti")


assert math.comb(WIDTH, 2) + WIDTH + 1 == 37  # values within NEAR bits of a block
