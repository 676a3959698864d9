"""SimHash fingerprints and their Hamming search (DataFrame functions only).

A fingerprint has 128 bits. A text's terms are its pairs of neighbouring words
(white space separates words; a text of one word has that word as its term).
Each occurrence of a term votes with the term's weight, 1 to 4 by its length:
short terms are mostly function words. A bit is 1 where the terms whose hash
has a 1 there weigh more than half of all; a text without words has zeros.

Votes are counted without a column per bit: four bits that are 16 apart share
a long, each in a lane of 16 bits, so 32 sums count 128 bits. Terms are dealt
into chunks of 8,191, whose weight of 32,764 at most leaves the sign bit of the
top lane unset (sums in longs fail on overflow), and chunks are then added in
lanes of 32 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm._common import written

WORD = 64
WORDS = 2
BITS = WORD * WORDS
CHUNK_TERMS = 8_191
#: Of the search: bits that may differ (of near copies mostly 20 at most), and blocks.
RADIUS, BLOCKS = 20, 7
_SPACE = "[\\x20\\x09-\\x0D]+"
_LANES16 = 0x0001000100010001
_LANES32 = 0x0000FFFF0000FFFF


def _terms(text: Column) -> Column:
    """Array of longs: a hash whose two low bits hold the weight less 1."""
    words = F.array_remove(F.split(text, _SPACE), "")

    def term(w: Column, i: Column) -> Column:
        second = F.get(words_col, i + 1)
        weight = F.least(F.lit(3), F.floor((F.octet_length(w) + F.coalesce(F.octet_length(second), F.lit(0))) / 6)).cast("long")
        return F.xxhash64(w, second).bitwiseAND(F.lit(-4)).bitwiseOR(weight)

    words_col = F.col("_words")
    pairs = F.transform(F.slice(words_col, 1, F.greatest(F.size(words_col) - 1, F.lit(1))), term)
    return words, pairs


def fingerprint_columns(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """df's key columns, which together are unique, with the fingerprint of the text as longs f0 and f1."""
    words, pairs = _terms(F.coalesce(F.col(text_col), F.lit("")))
    exploded = df.select(*keys, words.alias("_words")).select(*keys, F.posexplode_outer(pairs).alias("_pos", "_term"))
    weight = F.col("_term").bitwiseAND(3) + 1
    votes = exploded.select(
        *keys, F.floor(F.coalesce(F.col("_pos"), F.lit(0)) / CHUNK_TERMS).cast("int").alias("_chunk"),
        F.coalesce(weight, F.lit(0)).alias("_w"), F.coalesce(F.xxhash64("_term", F.lit(0)), F.lit(0)).alias("_h0"), F.coalesce(F.xxhash64("_term", F.lit(1)), F.lit(0)).alias("_h1"),
    )
    narrow = votes.groupBy(*keys, "_chunk").agg(
        F.sum("_w").alias("_total"),
        *[F.sum(F.shiftright(f"_h{w}", j).bitwiseAND(F.lit(_LANES16)) * F.col("_w")).alias(f"_n{w}_{j}") for w in range(WORDS) for j in range(16)],
    )
    wide = narrow.groupBy(*keys).agg(
        F.sum("_total").alias("_total"),
        *[F.sum(F.shiftrightunsigned(f"_n{w}_{j}", 16 * odd).bitwiseAND(F.lit(_LANES32))).alias(f"_s{w}_{j}_{odd}") for w in range(WORDS) for j in range(16) for odd in range(2)],
    )

    def word(w: int) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(WORD):
            lane, j = divmod(bit, 16)
            count = F.shiftrightunsigned(f"_s{w}_{j}_{lane % 2}", 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
            out = out.bitwiseOR(F.when(count * 2 > F.col("_total"), F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0)))
        return out

    return wide.select(*keys, *[word(w).alias(f"f{w}") for w in range(WORDS)])


def as_hex(*words: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """1 less the share of bits that differ."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1 - differ / F.lit(float(BITS))


def _ranges(df: DataFrame, id_col: str) -> list[int]:
    """Ids that end ranges of about equal size, the largest id last; about as many as the root of the rows.

    So both the ranges and what the driver holds of them grow with the root: 100,000 ends
    for ten thousand million rows.
    """
    n, top = df.agg(F.count(id_col), F.max(id_col)).first()
    if top is None:
        return []
    k = max(1, isqrt(n))
    marks = df.agg(F.percentile_approx(id_col, [i / k for i in range(1, k)] or [0.5], 20 * k)).first()[0] if k > 1 else []
    return sorted({*marks, top})


def _place(ends: list[int], x: Column) -> tuple[Column, Column]:
    """The number of ends below x, by two lookups in about the root of them, and whether x is an end. A null is in range 0."""
    if not ends:
        return F.lit(0), F.lit(False)
    step = max(1, isqrt(len(ends)))
    # Text that is split and cast folds to one literal; a literal for each end would swell the plan.
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda v: v < x))
    whole = below(numbers(ends[step - 1 :: step])) * step
    place = F.coalesce(whole + below(F.slice(numbers(ends), whole + 1, step)), F.lit(0))
    place = F.when(x.isNull(), 0).otherwise(place)
    return place, F.coalesce(F.get(numbers(ends), place) == x, F.lit(False))


def fingerprint_and_edit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_every: int | None = None) -> DataFrame:
    """One row per row of documents: the fingerprints of its text and of its edited text.

    With query_every, rows whose id it divides are searched for among all rows, and
    n_near counts the other rows within the radius and nearest is the fingerprint of
    the closest one (NULL for rows that are no query).

    The edited text has the last floor(n/3) code points replaced by the first as
    many (or all) of the next document in descending id; after the last comes
    the first. The neighbour is found without a global sort in one task: ids
    are cut into ranges by approximate quantiles, each range is a window, and
    the first row of a range is copied to the end of the range above it.

    A null text counts as empty, a null id comes after all others, equal ids are
    ordered by text, and equal rows each stay a row. Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = _ranges(docs, "doc_id")
    last = max(1, len(ends))
    place, at_end = _place(ends, F.col("doc_id"))
    ranged = docs.withColumn("_r", place).withColumn("_at", F.explode(F.when(at_end, F.array(F.struct(F.col("_r").alias("r"), F.lit(False).alias("copy")), F.struct(((F.col("_r") + 1) % last).alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("_r").alias("r"), F.lit(False).alias("copy"))))))
    ranged = ranged.select(F.col("_at.r").alias("r"), F.col("_at.copy").alias("copy"), "doc_id", "text")
    in_order = Window.partitionBy("r").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    rows = ranged.select("r", "copy", "doc_id", "text", F.row_number().over(in_order).alias("rn"), F.lead("text").over(in_order).alias("next")).where(~F.col("copy"))
    # Without any id there are no copies: the first row follows the last one of the only range.
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - k), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), k))
    both = rows.select("r", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    both = both.select("r", "rn", "doc_id", "n_chars", "sha", F.posexplode(F.array("text", "edited")).alias("version", "_text"))
    prints = fingerprint_columns(both, "_text", ["r", "rn", "doc_id", "n_chars", "sha", "version"])
    pick = lambda v, w: F.max(F.when(F.col("version") == v, F.col(f"f{w}"))).alias(f"v{v}_{w}")
    one = prints.groupBy("r", "rn", "doc_id", "n_chars", "sha").agg(*[pick(v, w) for v in range(2) for w in range(WORDS)])
    again = one.withColumn("_at", F.explode(F.when(F.col("rn") == 1, F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("copy")), F.struct(((F.col("r") + 1) % last).alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("copy"))))))
    again = again.select(F.col("_at.r").alias("r"), F.col("_at.copy").alias("copy"), "rn", "doc_id", "n_chars", "sha", *[f"v{v}_{w}" for v in range(2) for w in range(WORDS)])
    in_order = Window.partitionBy("r").orderBy("copy", "rn")
    again = again.select("*", *[F.lead(f"v0_{w}").over(in_order).alias(f"x_{w}") for w in range(WORDS)]).where(~F.col("copy"))
    own, other, following = ([F.col(f"v0_{w}") for w in range(WORDS)], [F.col(f"v1_{w}") for w in range(WORDS)], [F.col(f"x_{w}") for w in range(WORDS)])
    out = again.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), *[c.alias(f"f{w}") for w, c in enumerate(own)], as_hex(*other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
    if query_every:
        # The search reads the fingerprints several times: they are made once.
        out = near_counts(written(out, "prints"), F.coalesce(F.col("doc_id") % query_every == 0, F.lit(False)))
    names = ["edited_fingerprint", "near_edited", "near_next", *["n_near", "nearest"] * bool(query_every)]
    return out.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("f0"), F.col("f1")).alias("fingerprint"), *names)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1) for rows with unique ids."""
    return fingerprint_columns(documents.select(F.col(id_col), F.col(text_col)), text_col, [id_col])


def _block(position: int, blocks: int, words: list[Column] | None = None) -> tuple[Column, int]:
    """The bits of one of the blocks into which the 128 bits are cut, from one or both longs, and their number."""
    lo, hi = BITS * position // blocks, BITS * (position + 1) // blocks
    out = F.lit(0).cast("long")
    for w in range(WORDS):
        a, b = max(lo, w * WORD) - w * WORD, min(hi, (w + 1) * WORD) - w * WORD
        if a < b:
            part = F.shiftrightunsigned(words[w] if words else f"f{w}", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            out = out.bitwiseOR(F.shiftleft(part, w * WORD + a - lo))
    return out, hi - lo


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints of prints within the radius of those of queries: (q0, q1, f0, f1, distance).

    The bits are cut into blocks. If at most radius bits differ, some block differs
    in at most radius // blocks of them, so a table per block, probed with the
    query's block and all values that differ in so few bits, finds all; the
    distance is then checked. Both sides are reduced to distinct fingerprints
    first: groups of copies are one row, and (f0, f1) is the class id by which
    rows join the result.
    """
    if not (0 <= radius <= BITS and 3 <= blocks <= BITS):
        raise ValueError("radius must be 0 to 128, blocks 3 to 128")

    def probes(p: int, flips: int) -> Column:
        value, width = _block(p, blocks)
        masks = [sum(1 << k for k in chosen) for n in range(min(flips, width) + 1) for chosen in combinations(range(width), n)]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m) * blocks + p)

    def tables(df: DataFrame, flips: int) -> DataFrame:
        distinct = df.select("f0", "f1").dropna().distinct()
        return distinct.select("f0", "f1", F.explode(F.flatten(F.array(*[probes(p, flips) for p in range(blocks)]))).alias("key"))

    flips = radius // blocks
    q = tables(queries, flips).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), F.col("key").alias("probe"))
    unlike = [F.col("q0").bitwiseXOR(F.col("f0")), F.col("q1").bitwiseXOR(F.col("f1"))]
    distance = F.bit_count(unlike[0]) + F.bit_count(unlike[1])
    # A pair meets in each block that differs little; the first of them keeps it, so no pair is made twice.
    first = F.lit(blocks)
    for p in reversed(range(blocks)):
        first = F.when(F.bit_count(_block(p, blocks, unlike)[0]) <= flips, F.lit(p)).otherwise(first)
    # Probes are many times the rows from which sizes are guessed, so they must not be broadcast.
    met = q.hint("merge").join(tables(prints, 0), (F.col("probe") == F.col("key")) & (distance <= radius) & (first == F.pmod("key", F.lit(blocks))))
    return met.select("q0", "q1", "f0", "f1", distance.alias("distance"))


def near_counts(rows: DataFrame, is_query: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """rows (f0, f1, ...) with n_near and nearest: for queries, how many other rows lie within the radius, and the
    fingerprint of the closest of them as hex (the least at equal distance, NULL if there is none); else NULL."""
    sizes = rows.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("_m"))
    found = within_radius(rows, rows.where(is_query), radius, blocks).join(sizes, ["f0", "f1"])
    other = F.when((F.col("distance") > 0) | (F.col("_m") > 1), F.struct("distance", as_hex(F.col("f0"), F.col("f1")).alias("hex")))
    counts = found.groupBy("q0", "q1").agg((F.sum("_m") - 1).alias("n_near"), F.min(other)["hex"].alias("nearest"))
    return rows.join(counts, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")) & is_query, "left").drop("q0", "q1")
