"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search, DataFrame operations only.

A document holds a benchmark item if it has at least ``threshold`` of the item's distinct word
shingles, wherever they stand. Items are short and documents long, so signatures of a fixed length would hardly ever
agree. Both sides therefore keep the minima of one random hash order below a bound that items of a size share: items are
partitioned by their number of shingles, and the MinHash sketch of a partition, of items and documents alike, is the shingles whose
order lies in the first ``FRACTIONS`` of the range. An item of n shingles whose sketch there has k may lack at most m = floor((1 -
threshold) n) in a document that holds it, so k - m of its sketch must be in the document's sketch: that is the search, by counts of equal
minima. An item goes to the smallest fraction, from its size on, in which that number is positive and at least ``LEAST_FOUND`` of m, so no pair is lost.
Candidates are verified by exact containment of the shingles themselves, word by word.

Of a document's sketch only minima that may be an item's go to the join: all items' minima are marked in one bitmap of at most ``MOST_BITS`` bits, which is
a constant of the plan, so the few short items that need the whole range don't bring every shingle of every document along. A bitmap that
so many items fill up lets more through and loses nothing; the fractions bound the sketches then.

Sketches, candidates' documents and the shingles of the items found go to the documents as a broadcast while
they have at most ``BROADCAST_ROWS`` rows, which is counted; beyond, Spark shuffles both sides. Equal minima
are counted by (document, item) and combined before the shuffle, so neither a frequent passage nor a frequent item meets in one task.

Words are runs of letters and digits, lower-cased. An item of fewer than five words has one shingle, all
its words, and documents are shingled by that length too. Defined results: null or empty texts on either side
give no pairs; null document or item ids do not join and give none; repeated rows of a document or of an item count once
(repeated ids with different texts are one document that has the shingles of all); texts of any length are
read whole; empty tables give an empty result; other columns are ignored, whatever their names. ``clean`` judges each row by its own
text, so rows without an id, or with an id that others have too, are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evokit.session import cut

WORDS = 5
THRESHOLD = 0.8
#: Size partitions: the least number of shingles from which items may be sketched by so large a part of the hash range.
FRACTIONS = ((1, 1.0), (1, 0.75), (5, 0.5), (32, 0.375))
#: How many of its sketch a document has to hold, at least, as a share of those it may lack.
LEAST_FOUND = 0.25
#: The bitmap of all items' minima has some 64 bits for each, between these bounds; the largest is 128 kB.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 20
#: A row of a broadcast has an id and a hash, so this is a few dozen MB at most.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(word: Column, k: int) -> Column:
    """Hashes of all windows of ``k`` words; ``word`` must be an attribute."""
    n = F.size(word)
    own = lambda i: F.xxhash64(*(F.get(word, i + j) for j in range(k)))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), own)).otherwise(F.array().cast("array<bigint>"))


def _shingle_texts(word: Column, k: int) -> Column:
    """The windows themselves, words parted by a blank, which no word has."""
    n = F.size(word)
    own = lambda i: F.concat_ws(" ", *(F.get(word, i + j) for j in range(k)))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), own)).otherwise(F.array().cast("array<string>"))


def _bound(fraction: float) -> int:
    """The order below which ``fraction`` of the 64-bit range lies."""
    return min(int(-(2.0**63) + fraction * 2.0**64), 2**63 - 1)


def _order(h: Column) -> Column:
    """A second hash: its order is that of the MinHash sketches."""
    return F.xxhash64(F.lit(17), h)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(item, size, h, s): the distinct shingles of each item, with the words in each, its hash and its text."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    return _spelled(rows.withColumn("size", F.least(F.size("w"), F.lit(k))), "item", [F.col("size") == s for s in range(1, k + 1)], list(range(1, k + 1))).distinct()


def _spelled(split: DataFrame, key: str, when: list[Column], sizes: list[int]) -> DataFrame:
    """(key, size, h, s) of every window of each of the sizes, where its condition holds."""
    out = None
    for fits, s in zip(when, sizes, strict=True):
        both = F.arrays_zip(_shingle_hashes(F.col("w"), s).alias("h"), _shingle_texts(F.col("w"), s).alias("s"))
        own = split.where(fits).select(key, F.lit(s).alias("size"), F.explode(both).alias("x")).select(key, "size", F.col("x.h").alias("h"), F.col("x.s").alias("s"))
        out = own if out is None else out.unionByName(own)
    return out


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, size, h, bound, need, n): the MinHash sketch of each item in its partition, and how much of it a document must have.

    Partitions are chosen from counts of the orders below each bound: one sum an item, however many shingles it has.
    """
    bounds = {f: F.lit(_bound(f)) for _, f in FRACTIONS}
    counts = shingles.groupBy("item").agg(F.count("*").alias("n"), *(F.sum((_order(F.col("h")) <= b).cast("int")).alias(f"k{i}") for i, b in enumerate(bounds.values())))
    lacks = F.floor((1 - F.lit(threshold)) * F.col("n") + 1e-9)
    chosen = need = None
    for i, (least, f) in reversed(list(enumerate(FRACTIONS))):
        enough = (F.col("n") >= least) & (F.col(f"k{i}") - lacks >= F.greatest(F.lit(1), F.ceil(LEAST_FOUND * lacks)))
        fits = enough if i else F.lit(True)  # the whole range holds every shingle
        chosen = F.when(fits, bounds[f]) if chosen is None else chosen.when(fits, bounds[f])
        need = F.when(fits, F.col(f"k{i}") - lacks) if need is None else need.when(fits, F.col(f"k{i}") - lacks)
    plan = counts.select("item", "n", chosen.alias("bound"), need.cast("long").alias("need"))
    return shingles.select("item", "size", "h").join(plan, "item").where(_order(F.col("h")) <= F.col("bound"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the counted rows are few, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def marked(sketch: DataFrame) -> tuple[Column, int]:
    """(bitmap, bits): a constant array of 64-bit words in which the low bits of each minimum's order are marked."""
    bits = min(max(1 << (64 * sketch.count()).bit_length(), LEAST_BITS), MOST_BITS)
    at = _order(F.col("h")).bitwiseAND(F.lit(bits - 1))
    words = sketch.select((at / 64).cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    found = {r.k: r.b for r in words.collect()}  # at most bits / 64 rows
    # One text that Catalyst folds into an array once, in place of a literal a word.
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>"), bits


def _sketched(docs: DataFrame, bounds: dict[int, int], bitmap: Column, bits: int) -> DataFrame:
    """(doc, size, h) of the windows in the documents' sketches that may be an item's: for each window size, up to the largest bound that an item of that size has."""
    split = docs.select("doc", words(F.col("text")).alias("w"))
    order = _order(F.col("h"))
    at = order.bitwiseAND(F.lit(bits - 1))
    mark = F.call_function("shiftright", F.get(bitmap, (at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    out = None
    for s, bound in bounds.items():
        own = split.select("doc", F.lit(s).alias("size"), F.explode(_shingle_hashes(F.col("w"), s)).alias("h")).where((order <= F.lit(bound)) & mark)
        out = own if out is None else out.unionByName(own)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every pair at or over the threshold."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where("doc is not null")
    shingles = cut(item_shingles(items, item_id, item_text, k))
    sketch = cut(sketches(shingles, threshold))
    # At most k different sizes: the words in an item's shingles.
    bounds = {r["size"]: r.bound for r in sketch.groupBy("size").agg(F.max("bound").alias("bound")).collect()} or {k: _bound(1.0)}
    met = _sketched(rows, bounds, *marked(sketch)).join(_small(sketch), ["size", "h"]).select("doc", "item", "need", "n", "h").distinct()
    pairs = cut(met.groupBy("doc", "item", "need", "n").agg(F.count("*").alias("k")).where("k >= need").select("doc", "item", "n"))
    suspects = rows.join(_small(pairs.select("doc").distinct()), "doc", "left_semi")
    every = _small(shingles.join(pairs.select("item").distinct(), "item", "left_semi"))
    spelled = _spelled(suspects.select("doc", words(F.col("text")).alias("w")), "doc", [F.lit(True)] * len(bounds), list(bounds))
    found = spelled.join(every, ["size", "h", "s"]).select("doc", "item", "h", "s").distinct()
    counts = found.groupBy("doc", "item").agg(F.count("*").alias("n_found")).join(pairs, ["doc", "item"])
    kept = counts.where(F.col("n_found") >= F.lit(threshold) * F.col("n") - 1e-9)
    return kept.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    own = "text_key"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    # 128 bits of hash stand for a text; equal texts are judged once.
    keyed = docs.withColumn(own, F.struct(F.xxhash64(doc_text).alias("a"), F.xxhash64(F.lit(29), doc_text).alias("b")))
    found = cut(contaminated(keyed, items, threshold, k, own, doc_text, item_id, item_text).select(own).distinct())
    return keyed.join(_small(found), own, "left_anti").select(*docs.columns)
