"""Near-duplicate groups by SetSketch registers, banding, likelihood and exact verification.

1. Each text's shingle set gives its size, a digest and SetSketch registers:
   truncated exponents of minima of exponentially distributed hashes, so that
   registers of a union are the maxima of registers.
2. Texts with equal sets are one class from here on.
3. Bands of registers make buckets. In each bucket, all members are judged
   against one centre by the joint likelihood of their registers, which is linear
   in the bucket. Members close to the centre join its family; members so close
   that all their links must be close to it too are settled and leave the
   bucket; the rest get another centre. Few remain after some rounds, and those
   are judged in pairs.
4. Families are compared block against block, each block bounded by the shingles
   it holds: pairs that the likelihood allows are verified on their full sets
   unless they are in one component already, and the links that merge components
   are returned, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import discard_since, mark, small_batches, written
from crosstide.llm.components import components
from crosstide.llm.shingles import mix, sequence, shingle_sets

REGISTERS = 144
#: Base, rate and largest exponent of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Chance at most that a pair just at the threshold meets in no band.
MISS = 2e-5
#: Standard errors below the threshold from which a likeliest similarity is verified.
STANDARD_ERRORS = 5.5
#: Likeliest similarities below the threshold of members that are settled by a centre, and the error allowed for of close ones.
SETTLED, ERROR = 0.10, 0.08
#: Centres of a bucket that are tried before its remaining members are judged in pairs.
ROUNDS = 8
#: Candidate pairs that are judged or passed over at once.
JUDGED_TOGETHER = 4096
#: Shingles of a block.
BLOCK_SHINGLES = 400_000

_XOR, _ODD = sequence(REGISTERS, 2), sequence(REGISTERS, 3) | np.uint64(1)


def rows_per_band(threshold: float) -> int:
    """The longest bands that meet MISS."""
    return max((r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= MISS), default=1)


def slack(threshold: float) -> float:
    """How far below the threshold the likeliest similarity of a pair at it may fall."""
    return STANDARD_ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashed elements."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    smallest = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    key = np.arange(REGISTERS // rows, dtype=np.uint64) + np.uint64(1)
    grid = sketch[: rows * len(key)].reshape(-1, rows).astype(np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return key.view(np.int64)


_GRID = np.linspace(0, 1, 101)


def likeliest_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood, for rows of register pairs and known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p_more, p_less = chance(u - v * j), chance(v - u * j)
    log = lambda p: np.log(np.maximum(p, 1e-12))
    score = more[:, None] * log(p_more) + less[:, None] * log(p_less) + same[:, None] * log(1 - p_more - p_less)
    return j[np.arange(len(j)), score.argmax(axis=1)]


def sketches(documents: DataFrame, words: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, registers, bands): the digest is null where the set is empty."""
    small_batches(documents.sparkSession)
    chosen = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n", "digest", "registers", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            made = [registers(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if r is None else r.tobytes() for r in made], pa.binary()),
                    pa.array([None if r is None else bands(r, rows) for r in made], pa.list_(pa.int64())),
                ], names,
            )

    return chosen.mapInArrow(run, "id bigint, n bigint, digest binary, registers binary, bands array<bigint>")


def _judged(pairs: DataFrame, reps: DataFrame, close: float, settled: float) -> DataFrame:
    """(x, y, settled) of the pairs whose registers make them close."""
    side = lambda name: reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))
    rows = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "r_x", "r_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            like = likeliest_similarity(a, b, n_a, n_b)
            keep = pa.array(like >= close)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like >= settled).filter(keep)], ["x", "y", "settled"])

    return rows.mapInArrow(run, "x bigint, y bigint, settled boolean").groupBy("x", "y").agg(F.max("settled").alias("settled"))


def _families(reps: DataFrame, threshold: float) -> DataFrame:
    """(id, label) of classes that are close to others by way of centres."""
    settled = threshold - SETTLED
    close = settled - (1 - threshold) - ERROR
    count = F.count(F.lit(1)).alias("k")
    places = reps.select("id", F.explode("bands").alias("key"))
    centres = written(places.groupBy("key").agg(F.min("id").alias("y"), F.max("id").alias("z"), count).where("y < z"), "centres")
    left = written(places.join(centres.select("key"), "key"), "places")
    edges = None
    for turn in range(ROUNDS + 1):
        if turn == ROUNDS:
            other = left.select("key", F.col("id").alias("y"))
            pairs = left.withColumnRenamed("id", "x").join(other, "key").where("x > y").select("x", "y").distinct()
        else:
            pairs = left.join(centres.select("key", "y"), "key").where("id <> y").select(F.col("id").alias("x"), "y").distinct()
        judged = written(_judged(pairs, reps, close, settled), "judged")
        edges = judged.select("x", "y") if edges is None else edges.unionByName(judged.select("x", "y"))
        if turn == ROUNDS:
            break
        # Of a bucket of two nothing is left to compare.
        rest = left.join(centres.where("k > 2").select("key", "y"), "key").where("id <> y")
        rest = rest.join(judged.where("settled").select(F.col("x").alias("id"), "y"), ["id", "y"], "left_anti").select("key", "id")
        sizes = rest.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("y"), F.min("id").alias("a"), F.max("id").alias("z"), count).where("a < z")
        centres = written(sizes.select("key", "y", "k"), "centres")
        if centres.isEmpty():
            break
        left = written(rest.join(centres.select("key"), "key"), "places")
    return components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _block_links(ids: list[int], blocks: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], share: tuple[int, int], same_block: bool) -> list[tuple[int, int]]:
    """Links that merge the members of a block, or of two blocks, likeliest pairs first.

    Candidates are kept as three numbers each, so a block of near copies takes tens of
    megabytes; those within one component by then are passed over in bulk.
    """
    threshold = share[0] / share[1]
    least = threshold - slack(threshold)
    sizes = np.array([len(s) for s in sets], float)
    likely, left, right = [], [], []
    first = np.arange(len(ids)) if same_block else np.flatnonzero(blocks == blocks.min())
    second = first if same_block else np.flatnonzero(blocks != blocks.min())
    for at, a in enumerate(first):
        others = second[at + 1 :] if same_block else second
        others = others[share[1] * np.minimum(sizes[others], sizes[a]) >= share[0] * np.maximum(sizes[others], sizes[a])]
        equal = (sketch[others] == sketch[a]).mean(axis=1)
        others = others[equal >= least - ERROR]
        for part in np.array_split(others, -(-len(others) // JUDGED_TOGETHER)) if len(others) else ():
            like = likeliest_similarity(np.broadcast_to(sketch[a], (len(part), REGISTERS)), sketch[part], np.full(len(part), sizes[a]), sizes[part])
            good = like >= least
            likely.append(like[good].astype(np.float32))
            right.append(part[good].astype(np.int32))
            left.append(np.full(int(good.sum()), a, np.int32))
    if not likely:
        return []
    likely, left, right = (np.concatenate(c) for c in (likely, left, right))
    order = np.argsort(-likely, kind="stable")
    # Equal ids (rows of one document with different texts) are one from the start.
    label = np.unique(np.array(ids), return_inverse=True)[1]
    members: dict[int, list[int]] = {}
    for k, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(k)
    out = []
    for at in range(0, len(order), JUDGED_TOGETHER):
        part = order[at : at + JUDGED_TOGETHER]
        for k in part[label[left[part]] != label[right[part]]].tolist():
            a, b = int(left[k]), int(right[k])
            x, y = int(label[a]), int(label[b])
            if x == y:
                continue
            small, big = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
            if share[1] * both >= share[0] * (len(small) + len(big) - both):
                x, y = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
                label[members[y]] = x
                members[x] += members.pop(y)
                out.append((ids[a], ids[b]))
    return out


def _links(families: DataFrame, reps: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): verified links that join each family's components."""
    members = families.join(reps.select("id", "n", "registers"), "id")
    blocks = members.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(texts, "id")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))
    rows = placed.withColumn("m", F.explode(meets)).select("label", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "block", "id", "registers", "text")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, blocks, sketch, sets = zip(*held)
            return _block_links(list(ids), np.array(blocks), np.stack(sketch), list(sets), share, key[1] == key[2])

        for batch in batches:
            labels, i, j, block, ids, sketch, text = (c.to_pylist() for c in batch.columns)
            sets = shingle_sets(text, words)
            out: list[tuple[int, int]] = []
            for k, own in enumerate(zip(labels, i, j)):
                if own != key:
                    out += done()
                    held, key = [], own
                held.append((ids[k], block[k], np.frombuffer(sketch[k], np.uint16), sets[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of documents.

    Two documents are linked if share[1] * |intersection| >= share[0] * |union| of
    their sets of word shingles. component_id is the smallest id that links
    reach. Null and empty texts, and texts without words, are linked with
    nothing. Equal rows each stay a row; rows of one id with different texts
    count as one document with all their links. A null id keeps null.
    """
    threshold, start = share[0] / share[1], mark()
    rows = rows_per_band(threshold)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = written(sketches(docs, words, rows, "id"), "sketches")
    keyed = F.col("digest").isNotNull() & F.col("id").isNotNull()
    # As a table of its own the classes are a plain side of the join: adaptive execution can then split a common digest.
    classes = written(table.where(keyed).groupBy("digest").agg(F.min("id").alias("rep")), "digests")
    alone = table.where(~keyed).select("id", "n", F.lit(None).cast("bigint").alias("rep"))
    members = written(table.where(keyed).select("id", "n", "digest").join(classes, "digest").select("id", "n", "rep").unionByName(alone), "members")
    firsts = members.where("id = rep").select("id").distinct()
    reps = written(table.where("digest is not null").join(firsts, "id").dropDuplicates(["id", "digest"]).select("id", "n", "registers", "bands"), "classes")
    # A document whose rows have different texts belongs to several classes, which it links.
    several = members.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    joined = members.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    families = _families(reps, threshold)
    labels = components(_links(families, reps, docs.where("text is not null"), words, share).unionByName(joined))
    discard_since(start, members, labels)
    out = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
