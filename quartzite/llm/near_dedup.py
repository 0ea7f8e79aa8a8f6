"""Near-duplicate groups by SimHash fingerprints and the exact Jaccard similarity of word shingles.

1. Profiles. Of each text's sorted set of shingle hashes, a hash of the set, its size, its SimHash fingerprint and two parity sketches are stored;
   equal sets are one from here on. The sets themselves, larger than the texts, are computed again where they are needed.
2. Fingerprints. They are compared in the tiles of ``simhash_dedup``; those within ``radius`` bits name candidates, and what the exact
   check confirms is grouped by large and small stars. Two sets of a group are not compared again.
3. Prefixes. No radius follows from a similarity, so an index gives the pairs that lie farther apart. In any fixed order of all shingles, two
   sets of similarity t share one of their first n - ceil(t * n) + 1. So only these are indexed, and no pair is lost. Shingles that are
   frequent in a sample go last; that only saves time.
4. Stars. Every set is compared with the least and the greatest set of each index entry, which ties dense groups together.
5. Pairs. Entries that still hold sets of several groups are compared pair by pair.
6. Candidates pass two parity sketches (two sets differ by no less than their sketches, so nothing is lost), a short one and one of a bit or
   more per shingle, before the sets themselves are compared.

Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, settled, stored
from .components import components, grouped, one_each
from .line_dedup import row_key
from .simhash_dedup import MANY, SEED, fingerprint, links, neighbours, shingle_hashes

BITS = 512
SKETCH = [f"p{k}" for k in range(BITS // 64)]
#: Of one row in SAMPLE, the FREQUENT most frequent shingles go last in the order; entries of the first HOT are dealt over SALTS.
SAMPLE, FREQUENT, HOT, SALTS = 16, 100_000, 1_000, 256


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t or b"", words).view(np.int64)) for t in texts.to_pylist()]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32), np.concatenate(arrays))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("row"), F.col(text_col).cast("binary").alias("text"))


def profiles(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, row, set_id (hash of the set), n (its size), fingerprint, short and long parity sketch (p0 to p7, wide) of every whole text."""

    def parity(s: np.ndarray, bits: int) -> np.ndarray:
        return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = sets_of(part.column(2), words)
                sketch = np.array([parity(s, BITS) for s in sets])
                wide = lists([parity(s, max(BITS, 1 << len(s).bit_length())) for s in sets])
                prints = pa.array([fingerprint(s) for s in sets], pa.int64())
                cols = [*part.columns[:2], pa.array(set_ids(sets)), pa.array([len(s) for s in sets], pa.int32()), prints, *[pa.array(np.ascontiguousarray(c)) for c in sketch.T], wide]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "set_id", "n", "fingerprint", *SKETCH, "wide"])

    return texts.mapInArrow(run, f"doc_id long, row long, set_id long, n int, fingerprint long, {', '.join(f'{p} long' for p in SKETCH)}, wide array<long>")


def frequent_shingles(texts: DataFrame, words: int) -> list[int]:
    """The FREQUENT most frequent shingles of the sampled rows, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets_of(batch.slice(lo, 512).column(2), words)))], names=["h"])

    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long")
    return [r.h for r in sample.groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()]


def prefixes(texts: DataFrame, words: int, similarity: float, frequent: list[int]) -> DataFrame:
    """h, set_id, n, pos: the indexed shingles of every set, once for its copies in one task; ``frequent`` ones come last in the order."""
    t = Fraction(str(similarity))
    by_hash = np.argsort(np.array(frequent, np.int64))
    last, rank = np.array(frequent, np.int64)[by_hash], len(frequent) - by_hash  # 1 for the least frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                sets = sets_of(batch.slice(lo, 512).column(2), words)
                out = []
                for s, i in zip(sets, set_ids(sets).tolist(), strict=True):
                    if not len(s) or i in seen:
                        continue
                    seen.add(i)
                    n, where = len(s), np.zeros(len(s), np.int64)
                    if len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        where = np.where(last[at] == s, rank[at], 0)
                    first = s[np.argsort(where, kind="stable")[: n - math.ceil(t * n) + 1]]
                    out.append((first, np.full(len(first), i), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32)))
                if len(seen) > 1_000_000:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "set_id", "n", "pos"])

    return texts.mapInArrow(run, "h long, set_id long, n int, pos int")


def contents(texts: DataFrame, words: int, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id, hs (the sorted set) of the ``ids`` (set_id), from the texts of their ``nodes``."""
    known = lambda c: F.coalesce(c, F.lit(LAST_ID))
    wanted = stored(nodes.join(ids, "set_id", "left_semi").select("set_id", known(F.col("doc_id")).alias("doc_id"), "row"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted  # 24 bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(sets_of(part.column(1), words))], names=["set_id", "hs"])

    found = texts.withColumn("doc_id", known(F.col("doc_id"))).join(few, ["doc_id", "row"]).select("set_id", "text")
    return found.mapInArrow(run, "set_id long, hs array<long>").dropDuplicates(["set_id"])


def _required(t: float, a: Column, b: Column) -> Column:
    """The shared shingles that two sets of these sizes need."""
    return F.ceil(F.lit(t) * (a + b) / (1 + t) - 1e-9)


def compared(pairs: DataFrame, values: DataFrame, column: str, alike: Callable[[np.ndarray, np.ndarray, int], bool]) -> DataFrame:
    """The ``pairs`` (a, b, most) of which ``alike`` holds for the two ``values`` (set_id, ``column``) and ``most``."""
    side = lambda x, y: values.select(F.col("set_id").alias(x), F.col(column).alias(y))
    whole = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xo), (y, yo) = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[3:]]
            good = [alike(x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]], m) for r, m in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:3]], names=["a", "b", "most"])

    return stored(whole.select("a", "b", "most", "x", "y").mapInArrow(run, "a long, b long, most long"), "compared")


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of the ``pairs`` (a, b; distinct set ids) that are similar enough."""
    side = lambda x: nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in ("set_id", "n", *SKETCH)])
    apart = sum((F.bit_count(F.col(f"l_{p}").bitwiseXOR(F.col(f"r_{p}"))) for p in SKETCH), F.lit(0))
    need = _required(similarity, F.col("l_n"), F.col("r_n"))
    met = pairs.join(side("l"), F.col("a") == F.col("l_set_id")).join(side("r"), F.col("b") == F.col("r_set_id"))
    met = met.withColumn("most", (F.col("l_n") + F.col("r_n") - 2 * need).cast("long"))
    left = stored(met.filter((F.least("l_n", "r_n") >= need) & (apart <= F.col("most"))).select("a", "b", "most"), "candidates")
    t = Fraction(str(similarity))

    def sketches(x: np.ndarray, y: np.ndarray, most: int) -> bool:
        m = min(len(x), len(y))  # powers of two: the longer one folds
        fold = [np.bitwise_xor.reduce(s.reshape(-1, m), axis=0) for s in (x, y)]
        return int(np.bitwise_count((fold[0] ^ fold[1]).view(np.uint64)).sum()) <= most

    def similar(x: np.ndarray, y: np.ndarray, most: int) -> bool:
        same = len(np.intersect1d(x, y, assume_unique=True))
        return same >= t * (len(x) + len(y) - same)

    left = compared(left, nodes.join(both_ends(left), "set_id", "left_semi"), "wide", sketches)
    hs = stored(contents(texts, words, both_ends(left), nodes), "contents")
    return compared(left, hs, "hs", similar).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _spread(entries: DataFrame, value: str, hot: list[int]) -> DataFrame:
    """``entries`` (h, set_id, ...) of the h that hold several values of ``value``, with the least and greatest (lo, hi); stored.

    Entries of the ``hot`` ones meet per salt first, so that no window holds all of one.
    """
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    over = Window.partitionBy("h", "salt")
    dealt = entries.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("set_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    dealt = dealt.withColumn("lo", F.min(value).over(over)).withColumn("hi", F.max(value).over(over))
    kept = stored(dealt.filter(is_hot | (F.col("lo") < F.col("hi"))).dropDuplicates(["h", "salt", "set_id"]).drop("salt"), "entries")
    ends = kept.filter(is_hot).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")  # HOT rows at most
    return kept.filter(~is_hot).unionByName(kept.filter(is_hot).drop("lo", "hi").join(F.broadcast(ends), "h"))


def by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints lie within ``radius`` bits: each fingerprint's least set with that of its neighbours and with its own others."""
    sets = nodes.filter("n > 0").select("fingerprint", "set_id")
    least = stored(sets.groupBy("fingerprint").agg(F.min("set_id").alias("least"), F.count(F.lit(1)).alias("size")), "least")
    near = links(least.select("fingerprint"), radius, 4 if least.count() < MANY else 8, pick=neighbours)
    near = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    end = lambda x, s: least.select(F.col("fingerprint").alias(x), F.col("least").alias(s))
    apart = near.join(end("u", "s"), "u").join(end("v", "t"), "v").select("s", "t")
    same = sets.join(least.filter("size > 1"), "fingerprint").filter("set_id <> least").select("least", "set_id")
    return apart.union(same).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """set_id, label (the smallest set id reachable over ``edges``) of all ``nodes``."""
    return nodes.select("set_id").join(components(edges), F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "set_id").alias("label"))


def _links(texts: DataFrame, words: int, rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges (u, v) between set ids that connect all sets of this similarity."""
    nodes = stored(rows.dropDuplicates(["set_id"]), "nodes")
    close = verified(by_fingerprint(nodes, radius), texts, words, nodes, similarity)
    groups = labelled(nodes, close)

    frequent = frequent_shingles(texts, words)
    hot = frequent[:HOT]
    index = _spread(prefixes(texts, words, similarity, frequent), "set_id", hot)

    stars = index.select(F.col("set_id").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: groups.select(F.col("set_id").alias(x), F.col("label").alias(f"{x}_label"))
    stars = stars.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label").select("a", "b")
    edges = close.union(verified(stars, texts, words, nodes, similarity))

    labels = labelled(nodes, edges)
    open_ = _spread(index.select("h", "set_id", "n", "pos").join(labels, "set_id"), "label", hot).drop("lo", "hi")
    a, b = (open_.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("set_id", "n", "pos", "label")]) for x in "ab")
    # At their first common shingle, what follows must suffice.
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    pairs = a.join(b, "h").filter((F.col("a_set_id") < F.col("b_set_id")) & (F.col("a_label") != F.col("b_label")) & (rest >= _required(similarity, F.col("a_n"), F.col("b_n"))))
    pairs = pairs.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b")).distinct()
    return edges.union(verified(pairs, texts, words, nodes, similarity))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, radius: int) -> DataFrame:
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    texts = texts_of(docs, id_col, text_col)
    rows = stored(profiles(texts, words), "profiles")
    edges = settled(lambda: _links(texts, words, rows, similarity, radius), "links")
    return grouped(rows.select("doc_id", "row", "set_id"), "set_id", edges)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest id reachable over pairs of ``similarity`` or more).

    Similarity is that of the sets of shingles of ``words`` words, lower-cased (A-Z). Shorter texts are one shingle; null and blank texts are
    copies of each other. Repeated rows of one id each give a row, linked by their texts only. Rows with a null id are linked too;
    component_id is null where a whole group has none. An empty table gives no rows; other columns are ignored.
    ``radius`` changes what the fingerprints find before the index, not the result.
    """
    return _grouped(docs, id_col, text_col, words, similarity, radius).select("doc_id", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group, the one of smallest id (null after all others); all columns stay.

    Of several rows of that id in the group, the one whose text has the smallest hash stays, and of equal ones the first.
    """
    return one_each(docs, _grouped(docs, id_col, text_col, words, similarity, radius), id_col, "row", row_key(docs[text_col]))
