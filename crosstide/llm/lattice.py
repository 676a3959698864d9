"""Embedding near-duplicates: E8 lattice hashing with probes, exact cosines, components and link counts.

1. Vectors of finite components and some length are scaled to length 1; equal
   vectors are one class from here on.
2. In each of several tables random projections to one or more blocks of eight
   dimensions, shifted, are decoded to the nearest E8 points, which together are
   the vector's cell. The nearest of the 240 neighbours of each point are probed
   too. Blocks, cell size, probes and tables follow the number of vectors (design):
   the more there are, the finer the cells, so that the pairs that a vector meets
   by chance do not grow with the table.
3. Within a cell all members are compared with one centre (linear in the cell).
   Pairs across the resulting components that meet in a cell or probe follow.
   128 random hyperplanes rule out pairs that are far apart, with a margin of
   over five standard deviations; the rest are verified by cosine in double.
4. Links join vectors only within components, so each component is counted in
   blocks, each pair of blocks once for both sides: every link in it is counted,
   none is emitted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import discard_since, mark, small_batches, written
from crosstide.llm.components import components
from crosstide.llm.shingles import mix

SEED = 20240607
#: Chance at most that a pair at the threshold meets in no table.
MISS = 0.001
#: What design() chooses from: blocks of eight dimensions, cell sizes and probes of each block.
BLOCKS, CELLS, PROBES = (1, 2, 3), (0.85, 1.0, 1.2, 1.5, 1.8, 2.2), (2, 4, 8)
#: Pairs of simulated vectors by which it measures how often a pair at the threshold meets.
SIMULATED = 6000
#: Rows of a block of a component.
BLOCK_ROWS = 1024


@lru_cache(1)
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] > 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: integers of even sum, or those shifted by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@dataclass(frozen=True)
class Design:
    blocks: int
    cell: float
    probes: int
    tables: int


def _nearest(offsets: np.ndarray, probes: int) -> np.ndarray:
    """The neighbours (by number) to which each offset from its point leans most."""
    return np.argpartition(-(offsets @ _neighbours().T), probes - 1, axis=1)[:, :probes]


@lru_cache(64)
def _meets(cell: float, probes: int, threshold: float) -> float:
    """Chance that one block of two vectors at the threshold meets, by the cell of either among those that the other probes."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    x = rng.random((SIMULATED, 8)) * 4
    y = x + rng.normal(size=x.shape) * np.sqrt(max(2 - 2 * threshold, 0.0)) / cell
    a, b = decode(x), decode(y)
    met = (a == b).all(axis=1)
    for own, other, offsets in ((a, b, x - a), (b, a, y - b)):
        near = _nearest(offsets, probes)
        for k in range(probes):
            met |= (own + _neighbours()[near[:, k]] == other).all(axis=1)
    return float(met.mean())


def design(n: int, threshold: float) -> Design:
    """The cheapest tables for n vectors that miss at most MISS of the pairs at the threshold.

    The cost is what a vector makes: its cells and probes, and the pairs that it meets
    by chance, which for vectors in unrelated directions are n times the density of
    their difference at a cell of volume 1.
    """
    best = None
    for blocks, cell, probes in itertools.product(BLOCKS, CELLS, PROBES):
        meets = _meets(cell, probes, threshold) ** blocks
        if meets < 1e-3:
            continue
        tables = int(np.ceil(np.log(MISS) / np.log1p(-min(meets, 0.999))))
        spread = 2.0 / cell**2  # variance of a coordinate of the difference
        chance = (2 * np.pi * spread) ** -4 * (1 + probes * np.exp(-1 / spread))
        cost = tables * ((1 + probes) ** blocks + 2 * n * min(chance, 1.0) ** blocks)
        if best is None or cost < best[0]:
            best = (cost, Design(blocks, cell, probes, tables))
    return best[1]


def _key(points: np.ndarray, table: int, block: int, dims: int) -> np.ndarray:
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = np.full(len(points), np.uint64(table * 4096 + block * 64 + 1) + np.uint64(dims) * np.uint64(1 << 32), np.uint64)
    for i in range(8):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + twice[:, i])
    return key


@lru_cache(8)
def _projections(dims: int, tables: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED + dims))
    signs = rng.normal(size=(dims, 128))
    return rng.normal(size=(tables, blocks, dims, 8)), rng.random((tables, blocks, 8)), signs


def cells(unit: np.ndarray, plan: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cells (n x tables), probed cells (n x tables * probes) and signs (n x 2) of unit vectors."""
    dims = unit.shape[1]
    planes, shifts, signs = _projections(dims, plan.tables, plan.blocks)
    own, probed = [], []
    for t in range(plan.tables):
        choices = []
        for b in range(plan.blocks):
            x = unit @ planes[t, b] / plan.cell + shifts[t, b]
            point = decode(x)
            near = _nearest(x - point, plan.probes)
            choices.append([_key(point, t, b, dims), *(_key(point + _neighbours()[near[:, k]], t, b, dims) for k in range(plan.probes))])
        keys = [np.bitwise_xor.reduce([part * np.uint64(2 * b + 3) for b, part in enumerate(chosen)]).view(np.int64) for chosen in itertools.product(*choices)]
        own.append(keys[0])
        probed += keys[1:]
    bits = np.packbits(unit @ signs > 0, axis=1).view(np.int64)
    return np.column_stack(own), np.column_stack(probed), bits


def sign_limit(threshold: float) -> int:
    """Hyperplanes at most that separate vectors at the threshold."""
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(128 * p + 5.5 * np.sqrt(128 * p * (1 - p))))


def _unit(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors count, and those scaled to length 1 in double precision."""
    good, out = np.zeros(len(vectors), bool), []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.asarray(v, dtype=np.float64)  # a null component becomes NaN
        top = np.abs(x).max() if np.isfinite(x).all() else 0.0
        if top > 0:
            x = x / top
            good[i] = True
            out.append(x / np.sqrt(x @ x))
    return good, out


def _hashed(vectors: DataFrame, plan: Design) -> DataFrame:
    """(id, unit: doubles as bytes, own, probes, s0, s1) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = _unit(batch.column(1).to_pylist())
            ids = np.array(batch.column(0).to_pylist(), dtype=object)[good]
            sizes = np.array([len(u) for u in units], np.int64)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                x = np.stack([units[i] for i in at])
                own, probed, bits = cells(x, plan)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(ids[at]), pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(probed), pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                    ["id", "unit", "own", "probes", "s0", "s1"],
                )

    return vectors.mapInArrow(run, "id bigint, unit binary, own array<bigint>, probes array<bigint>, s0 bigint, s1 bigint")


def _verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    rows = pairs.join(reps.select(F.col("id").alias("x"), F.col("unit").alias("u_x")), "x").join(reps.select(F.col("id").alias("y"), F.col("unit").alias("u_y")), "y").select("x", "y", "u_x", "u_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(a) == len(b) and float(np.frombuffer(a) @ np.frombuffer(b)) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _apart(a0: Column, b0: Column, a1: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def _link_counts(reps: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, others): for classes in components, the vectors of other classes that are linked with them.

    A component's classes are dealt into blocks; block i meets the blocks i to the last, and counts for both sides.
    """
    inside = reps.select("id", "unit", "copies").join(labels, "id")
    sizes = labels.groupBy("label").agg(F.ceil(F.count("id") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = inside.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))
    rows = placed.withColumn("m", F.explode(meets)).select("label", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "block", "id", "unit", "copies")
    # Pairs of blocks are dealt whole; a small component is one of them.
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")

    def counted(key: tuple[int, int, int], block: np.ndarray, ids: np.ndarray, units: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vectors, out = [np.frombuffer(u) for u in units], np.zeros(len(ids), np.int64)
        lengths = np.array([len(v) for v in vectors])
        for dims in np.unique(lengths):
            a, b = (np.flatnonzero((block == at) & (lengths == dims)) for at in key[1:])
            if not len(a) or not len(b):
                continue
            near = np.stack([vectors[k] for k in a]) @ np.stack([vectors[k] for k in b]).T >= threshold
            if key[1] == key[2]:
                np.fill_diagonal(near, False)
                out[a] += near @ copies[b]
            else:
                out[a] += near @ copies[b]
                out[b] += copies[a] @ near
        return ids, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                block, ids, units, copies = zip(*held)
                found = counted(key, np.array(block), np.array(ids), list(units), np.array(copies))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["id", "others"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for label, i, j, *row in zip(*columns):
                if (label, i, j) != key:
                    yield from done()
                    held, key = [], (label, i, j)
                held.append(row)
        yield from done()

    return rows.mapInArrow(run, "id bigint, others bigint").groupBy("id").agg(F.sum("others").alias("others"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty or zero or hold null or non-finite components
    link with nothing; vectors of different dimension do not link. Rows that
    repeat an id with the same vector count once as a document and stay rows;
    rows of one id with different vectors share the links of the first class.
    """
    start = mark()
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    small_batches(rows.sparkSession)
    hashed = written(_hashed(rows.where("id is not null"), design(max(1, rows.count()), threshold)), "vectors")
    members = hashed.select("id", "unit").distinct().withColumn("digest", F.sha2("unit", 256)).select("id", "digest")
    classes = members.groupBy("digest").agg(F.min("id").alias("rep"), F.count("id").alias("copies"))
    member = written(members.join(classes, "digest").groupBy("id").agg(F.min("rep").alias("rep")), "members")
    firsts = classes.groupBy("rep").agg(F.max("copies").alias("copies"))
    reps = written(hashed.join(firsts.withColumnRenamed("rep", "id"), "id").dropDuplicates(["id"]), "classes")
    limit = sign_limit(threshold)
    own = reps.select(F.explode("own").alias("key"), "id", "s0", "s1")
    every = reps.select(F.explode(F.concat("own", "probes")).alias("key"), "id", "s0", "s1")
    centre = own.groupBy("key").agg(F.min_by(F.struct("id", "s0", "s1"), "id").alias("c"), F.count("id").alias("k")).where("k > 1").select("key", "c")
    star = own.join(centre, "key").where((F.col("id") != F.col("c.id")) & (_apart(F.col("s0"), F.col("c.s0"), F.col("s1"), F.col("c.s1")) <= limit))
    links = written(_verified(star.select(F.col("id").alias("x"), F.col("c.id").alias("y")).distinct(), reps, threshold), "links")
    labels = components(links)
    label = lambda df: df.join(labels, "id", "left").select("key", "id", "s0", "s1", F.coalesce("label", "id").alias("label"))
    own, every = written(label(own), "own"), written(label(every), "every")
    common = every.groupBy("key", "label").agg(F.count("id").alias("k")).groupBy("key").agg(F.max_by("label", "k").alias("common"), F.count("label").alias("labels")).where("labels > 1").select("key", "common")
    # A pair across components has a member outside the commonest one of its cell.
    rare = lambda df: df.join(common, "key").where("label <> common").drop("common")

    def across(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("key", *[F.col(c).alias(f"{c}_y") for c in ("id", "s0", "s1", "label")])
        met = a.join(b, "key").where((F.col("label") != F.col("label_y")) & (_apart(F.col("s0"), F.col("s0_y"), F.col("s1"), F.col("s1_y")) <= limit))
        return met.select(F.least("id", "id_y").alias("x"), F.greatest("id", "id_y").alias("y"))

    rest = across(rare(own), every).union(across(own, rare(every))).distinct()
    links = links.unionByName(written(_verified(rest, reps, threshold), "links"))
    labels = components(links)
    counts = written(_link_counts(reps, labels, threshold), "counts")
    discard_since(start, hashed, member, labels, counts)
    known = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(firsts, "rep", "left")
    known = known.select("id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    out = rows.select("id").join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
