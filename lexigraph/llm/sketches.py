"""Document fingerprints as threshold-scaled sketches, with DataFrame functions only.

A document's shingles (five words, lower-cased) are hashed, and every hash below a fixed fraction of the range is retained. As the
threshold is the same for all, sketches of very unequal documents compare without bias, and the sketch of a union is the union of
sketches. The least hash of all is kept in a field of its own, whether it is below or not, and merges as a minimum: it tells short
documents apart, none of whose hashes is below. Likeness is the Jaccard index of the retained hashes, containment the share of the
first found in the second; of two documents that retain none, they ask if the least hashes are equal.

For neighbours in the order of ids, texts move once: rows are dealt into ranges of ids of some 16 MB each, the first row of each
range is lent to the range before it, and a window within the range sees the next row. An id that fills several ranges (null, or one
that repeats) is dealt by a hash of the text.

Nulls: a null text is empty; a null id comes after all others. Rows with the same id follow each other by a hash of the text;
rows that are the same are each other's next. A text of any length is read whole. An empty table gives an empty result; a lone
document is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_and_text

WORDS = 5
SCALE = 8
_LEAST = -(2**63)


def sketch(text: Column, *, words: int = WORDS, scale: int = SCALE) -> Column:
    """Struct of `low`, a sorted array of int: of each shingle hash below 1/scale of the range its 32 leading bits below that, and
    `least`, the least hash, null for a text without words; null text: null."""
    parts = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    # `get` is null beyond the end, and the hash passes over nulls: fewer words make one shingle of what there is.
    shingles = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(p, i + k) for k in range(words))))
    bits = scale.bit_length() - 1
    if scale != 1 << bits:
        raise ValueError("the scale is a power of two")
    low = lambda s: F.filter(s, lambda h: h < F.lit(_LEAST + 2**64 // scale))
    # Less the least long a hash is an unsigned number, whose leading bits are zero if it is below.
    short = lambda s: F.transform(s, lambda h: (F.shiftrightunsigned(h.bitwiseXOR(F.lit(_LEAST)), 32 - bits) - F.lit(2**31)).cast("int"))
    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  binds a value once
    none = F.struct(F.array().cast("array<int>").alias("low"), F.lit(None).cast("long").alias("least"))
    return one(parts, lambda p: F.when(F.size(p) == 0, none).otherwise(one(shingles(p), lambda s: F.struct(F.array_sort(F.array_distinct(short(low(s)))).alias("low"), F.array_min(s).alias("least")))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sketches; of two that retain nothing 1 if their least hashes are equal, else 0."""
    both = F.size(F.array_intersect(a["low"], b["low"]))
    either = F.size(a["low"]) + F.size(b["low"]) - both
    return F.when(either == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """The share of the first sketch that the second holds; of one without words 1, of one that retains nothing 1 if the other's least
    hash is the same, else 0."""
    share = F.size(F.array_intersect(a["low"], b["low"])) / F.size(a["low"])
    return F.when(a["least"].isNull(), F.lit(1.0)).when(F.size(a["low"]) == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(share)


def merged(sketches: Column) -> Column:
    """The sketch of a union, from an array of sketches."""
    return F.struct(F.array_sort(F.array_distinct(F.flatten(sketches["low"]))).alias("low"), F.array_min(sketches["least"]).alias("least"))


def printed(a: Column) -> Column:
    """The retained hashes in hexadecimal, or, of a text that has words and retains none, a tilde and the least hash."""
    low = F.array_join(F.transform(a["low"], lambda h: F.lower(F.lpad(F.hex(h.cast("long") + F.lit(2**31)), 8, "0"))), "")
    least = F.concat(F.lit("~"), F.lower(F.lpad(F.hex(a["least"].bitwiseXOR(F.lit(_LEAST))), 16, "0")))
    return F.when(F.size(a["low"]) > 0, low).otherwise(F.coalesce(least, F.lit("")))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: a binary search in the expression."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    where = F.array(*map(F.lit, bounds)) if len(bounds) < 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(where, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def _dealt(key: Column, tie: Column, found: list[int]) -> Column:
    """The range of a row in the order of key and tie. found: the sorted bounds, an id that fills several ranges as often."""
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0).cast("long")
    at = _range_of(key, bounds)
    hot = {b: found.count(b) for b in bounds} if len(bounds) < len(found) else {}
    hot = {b: n for b, n in hot.items() if n > 1}
    if not hot:
        return at.cast("long")
    parts = F.coalesce(F.get(F.from_json(F.lit(str([hot.get(b, 0) for b in bounds])), "array<int>"), at - 1), F.lit(0))
    equal = F.get(F.from_json(F.lit(str(bounds)), "array<bigint>"), at - 1) == key
    # Of the rows of a hot id a part by the tie's place in the range of all; who comes after it in its range, comes after all parts.
    part = F.when(parts == 0, 0).when(equal, F.floor((tie / F.lit(2.0**64) + 0.5) * parts)).otherwise(parts)
    return at.cast("long") * F.lit(1 << 20) + part


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame] = lambda df: df, *, range_bytes: int = 16 << 20, most_ranges: int = 1 << 16) -> DataFrame:
    """The rows (doc_id, text) with the columns that `add` adds to them, and each again as next_*, of the next row by falling id. Beyond
    `most_ranges` ranges (1 TB) ranges grow, and are sorted on disk."""
    key, tie = F.coalesce("doc_id", F.lit(NULL_ID)), F.xxhash64("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(most_ranges, total // range_bytes))
    found = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    rows = docs.withColumn("tie", tie).withColumn("range", _dealt(key, tie, sorted(found or [])))
    # The first row of each range, lent to the range above it; the first of all to the lowest. At most twice `most_ranges` rows.
    tops = rows.groupBy("range").agg(F.max(F.struct(key.alias("k"), "tie")).alias("top"))
    tops = tops.withColumn("to", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())))
    tops = F.broadcast(tops.select(F.col("range").alias("r"), F.col("top.k").alias("k"), F.col("top.tie").alias("t"), "to"))
    lent = rows.join(tops, (F.col("range") == F.col("r")) & (key == F.col("k")) & (F.col("tie") == F.col("t"))).dropDuplicates(["r"])
    lent = lent.withColumn("range", F.col("to")).drop("r", "k", "t", "to").withColumn("lent", F.lit(True))
    every = add(rows.withColumn("lent", F.lit(False)).unionByName(lent))
    order = Window.partitionBy("range").orderBy("lent", key.desc(), F.col("tie").desc())
    # Column by column: a struct would be built before the shuffle and carry every text twice.
    following = {f"next_{c}": F.lead(c).over(order) for c in every.columns if c not in ("lent", "range", "tie")}
    return every.withColumns(following).where(~F.col("lent")).drop("lent", "range", "tie")


def edited_prints(docs: DataFrame, *, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """A row for each row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and contained_edited."""
    docs = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, lambda df: df.withColumn("sketch", sketch(F.col("text"), words=words, scale=scale)))
    n = F.char_length("text")
    moved = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), words=words, scale=scale))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )
