"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only the histogram of piece lengths (at most one entry per length up to the
capacity) reaches the driver. On it the linear grouping scheme runs: lengths
above a share of the capacity are cut into few groups of equal cardinality and
rounded up to the longest of their group; configurations over these few sizes
are optimised by the linear programme of least lost room, whose columns are
generated by a knapsack; actual lengths take the places of the rounded ones; and
the rest and all short pieces go by best fit into the gaps that remain, where a
gap's last one to three pieces are such that they fill it, if there are any. The plan says
which ranks of which length go to which sequences at which offset. Its size
depends on lengths and groups, not on the number of documents. Pieces are
numbered within their length in salted parts, so that no length, however
common, is numbered in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm._common import small_batches, written

CAPACITY = 4096
END_ID = 1
#: Groups of large lengths at most, pieces that a group holds at least, and the shares of the capacity above which a length is large that are tried.
GROUPS, GROUP_PIECES, SHARES = 64, 8, (4, 3, 2)
#: Share of the short pieces that are shorter than a gap that counts as usable.
USABLE = 0.2
#: Columns at most that the linear programme is given; further ones would hardly change its optimum.
COLUMNS = 1500
CACHE_ENTRIES = 1 << 19
RANKED_TOGETHER = 2000

#: The vocabulary's split pattern, for texts of the plain range below.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ɏ]|<\|")


class WordTokenizer(dict):
    """Ids (little-endian unsigned 32-bit) of lower-cased split words, cached within a bound."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        out = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """As the tokenizer encodes the text; the short way holds where its normaliser only lower-cases."""
        if _NOT_PLAIN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self[w] for w in _SPLIT.findall(text.lower())])


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): documents as ids and END_ID, cut only beyond the capacity.

    A null text counts as empty: its one piece is END_ID. Repeated rows stay.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    end = struct.pack("<I", END_ID)
    kinds = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    return chosen.mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids).withColumnRenamed("id", id_col)


class _Plan:
    """Placements of runs: count pieces of a length, by rank, one in each of count sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, offset, count
        self.used: dict[int, int] = {}
        self.gaps: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, count)

    def place(self, length: int, first: int, offset: int, count: int) -> None:
        rank = self.used.get(length, 0)
        self.used[length] = rank + count
        self.rows.append((length, rank, first, offset, count))

    def leave(self, gap: int, first: int, count: int) -> None:
        if gap <= 0 or not count:
            return
        if gap not in self.runs:
            insort(self.gaps, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, count))

    def take(self, gap: int) -> tuple[int, int] | None:
        """Some of the sequences with this gap: (first sequence, count)."""
        runs = self.runs.get(gap)
        if not runs:
            return None
        out = runs.pop()
        if not runs:
            del self.runs[gap], self.gaps[bisect_left(self.gaps, gap)]
        return out


    def fit(self, length: int, count: int) -> None:
        """Best fit: each piece goes into the smallest gap that holds it, or opens sequences."""
        while count:
            at = bisect_left(self.gaps, length)
            if at < len(self.gaps):
                gap = self.gaps[at]
                first, n = self.take(gap)
            else:
                gap, first, n = self.capacity, self.bins, count
                self.bins += n
            t = min(n, count)
            if gap == self.capacity:  # as many side by side as a new sequence holds
                each = min(gap // length, count)
                t = count // each
                for k in range(each):
                    self.place(length, first, k * length, t)
                self.leave(gap - each * length, first, t)
                count -= t * each
                self.bins -= n - t
                continue
            self.place(length, first, self.capacity - gap, t)
            self.leave(gap - length, first, t)
            self.leave(gap, first + t, n - t)
            count -= t


class _Stock:
    """Lengths with their counts that are still to be placed."""

    #: Longest lengths that are tried as the first of three.
    FIRSTS = 32

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.lengths = sorted(counts)
        self.has = np.zeros(capacity + 1, bool)
        self.has[self.lengths] = True

    def use(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length], self.lengths[bisect_left(self.lengths, length)]
            self.has[length] = False

    def pair(self, gap: int) -> list[int]:
        """Two lengths that fill the gap, the shorter one as long as can be: the shortest pieces fill the last gaps."""
        for a in np.flatnonzero(self.has[: gap // 2 + 1] & self.has[gap - gap // 2 : gap + 1][::-1])[:-3:-1].tolist():
            if 2 * a != gap or self.left[a] > 1:
                return [gap - a, a]
        return []

    def best(self, gap: int) -> list[int]:
        """What goes into a gap next: one, two or three lengths that fill it, else the longest that fits."""
        if self.has[gap]:
            return [gap]
        at = bisect_right(self.lengths, gap)
        if not at:
            return []
        longest = self.lengths[at - 1]
        if gap <= 3 * longest:
            if gap <= 2 * longest and (found := self.pair(gap)):
                return found
            for a in self.lengths[max(0, at - self.FIRSTS) : at][::-1]:
                found = self.pair(gap - a)
                if found and self.left[a] > found.count(a):
                    return [a, *found]
        return [longest]


def _fill(plan: _Plan, counts: dict[int, int]) -> None:
    """Best fit of the short pieces: into the largest gaps first, then into new sequences."""
    stock = _Stock(counts, plan.capacity)
    tried = plan.capacity + 1
    while stock.left:
        at = bisect_left(plan.gaps, tried) - 1
        if at >= 0:
            gap = plan.gaps[at]
            first, n = plan.take(gap)
        else:
            # Each new sequence holds the longest piece that is left at least.
            tried, gap, first = plan.capacity + 1, plan.capacity, plan.bins
            n = max(1, stock.left[stock.lengths[-1]] // max(1, plan.capacity // stock.lengths[-1]))
            plan.bins += n
        chosen = stock.best(gap)
        if not chosen:
            plan.leave(gap, first, n)
            tried = gap  # nothing fits into smaller gaps either
            if at >= 0 and stock.lengths[0] > gap:
                tried = 0
            continue
        tried = plan.capacity + 1
        t = min(n, *(stock.left[c] // chosen.count(c) for c in chosen))
        plan.leave(gap, first + t, n - t)
        offset = plan.capacity - gap
        for c in chosen:
            plan.place(c, first, offset, t)
            stock.use(c, t)
            offset += c
        plan.leave(plan.capacity - offset, first, t)


def _groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count], longest first, cut into groups of equal cardinality."""
    total = sum(counts.values())
    each, out, room = max(1, -(-total // groups)), [[]], 0
    room = each
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            t = min(left, room)
            out[-1].append([length, t])
            left, room = left - t, room - t
    return [g for g in out if g]


def _knapsack(sizes: list[int], worth: np.ndarray, lost: np.ndarray) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth less the room that it loses: by the number of pieces, the best last piece for every load."""
    capacity = len(lost) - 1
    value, last = np.full(capacity + 1, -np.inf), []
    value[0] = 0.0
    for _ in range(capacity // min(sizes)):
        better, piece = value.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            gain = value[:-size] + worth[i]
            more = gain > better[size:] + 1e-12
            better[size:][more] = gain[more]
            piece[size:][more] = i
        value = better
        last.append(piece)
    load = int((value - lost[::-1]).argmax())
    best = float(value[load] - lost[capacity - load])
    out = np.zeros(len(sizes))
    for piece in reversed(last):
        if piece[load] >= 0:
            out[piece[load]] += 1
            load -= sizes[piece[load]]
    return best, out


def _configurations(sizes: list[int], demand: list[int], capacity: int, usable: int) -> list[tuple[int, list[int]]]:
    """(uses, multiplicities): configurations that cover the demand, as far as whole uses allow, and lose least room.

    A configuration costs its load and its gap, if that is too narrow to be of use to
    short pieces. The linear programme starts from configurations of one size; each
    round the knapsack prices a better one, which replaces the one that it drives out.
    """
    m = len(sizes)
    need, size = np.array(demand, float), np.array(sizes, float)
    gaps = np.arange(capacity + 1)
    lost = np.where(gaps < usable, gaps, 0) / capacity
    cost = lambda column: column @ size / capacity + lost[capacity - int(column @ size)]
    basis = np.diag([float(capacity // x) for x in sizes])
    costs = np.array([cost(c) for c in basis.T])
    for _ in range(COLUMNS):
        inverse = np.linalg.inv(basis)
        better, column = _knapsack(sizes, costs @ inverse - size / capacity, lost)
        if better <= 1e-9:
            break
        uses, way = inverse @ need, inverse @ column
        ratio = np.where(way > 1e-9, np.maximum(uses, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], costs[out] = column, cost(column)
    uses = np.maximum(np.linalg.solve(basis, need), 0)
    left, chosen = list(demand), []

    def cover(column: list[int], times: int) -> None:
        if times > 0:
            chosen.append((times, column))
            for i in range(m):
                left[i] -= column[i] * times

    for j in np.argsort(-uses, kind="stable"):
        column = [int(x) for x in basis[:, j]]
        cover(column, min(int(uses[j] + 1e-6), *(left[i] // n for i, n in enumerate(column) if n)))
    return chosen


def _usable(small: dict[int, int]) -> int:
    """The gap from which short pieces are likely to fill it: the length that USABLE of them do not reach; 0 without any."""
    total, seen = sum(small.values()), 0
    for length in sorted(small):
        seen += small[length]
        if seen >= USABLE * total:
            return length
    return 0


def _plan(counts: dict[int, int], capacity: int, share: int, scarce: bool) -> _Plan:
    plan = _Plan(capacity)
    large = {n: c for n, c in counts.items() if n > capacity // share}
    stock = _groups(large, max(1, min(GROUPS, sum(large.values()) // GROUP_PIECES))) if large else []
    sizes, demand = [g[0][0] for g in stock], [sum(c for _, c in g) for g in stock]
    small = {n: c for n, c in counts.items() if n not in large}
    # Where short pieces are scarce, gaps of any width are lost.
    usable = capacity + 1 if scarce else _usable(small)
    for times, chosen in _configurations(sizes, demand, capacity, usable) if stock else ():
        slots = []  # the actual runs that take each rounded place
        for i, n in enumerate(chosen):
            for _ in range(n):
                need, runs = times, []
                while need:
                    head = stock[i][0]
                    t = min(need, head[1])
                    runs.append([head[0], t])
                    head[1] -= t
                    need -= t
                    if not head[1]:
                        stock[i].pop(0)
                slots.append(runs)
        done = 0
        while done < times:
            t = min(runs[0][1] for runs in slots)
            offset = 0
            for runs in slots:
                plan.place(runs[0][0], plan.bins + done, offset, t)
                offset += runs[0][0]
                runs[0][1] -= t
                if not runs[0][1]:
                    runs.pop(0)
            plan.leave(capacity - offset, plan.bins + done, t)
            done += t
        plan.bins += times
    # What whole uses leave of the large ones goes by best fit, too.
    for length, n in sorted((run for group in stock for run in group), reverse=True):
        plan.fit(length, n)
    if scarce:  # each gap counts: all in order of length, into the narrowest gap
        for length in sorted(small, reverse=True):
            plan.fit(length, small[length])
    else:
        _fill(plan, small)
    return plan


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset, count) by length and rank; the number of sequences.

    The scheme runs with each of SHARES and with programmes that do or do not count on
    short pieces for the wider gaps, until a plan needs no more than the bound by
    tokens; the best one stands.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be 1 to the capacity")
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    plan = None
    for share in SHARES:
        for scarce in (False, True):
            if plan is None or plan.bins > least:
                made = _plan(counts, capacity, share, scarce)
                plan = made if plan is None or made.bins < plan.bins else plan
    return np.array(sorted(plan.rows), np.int64).reshape(-1, 5), plan.bins


def rank_within_length(pieces: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """pieces with rank: 0, 1, ... within each length. Common lengths are numbered in salted parts."""
    spark = pieces.sparkSession
    parts = [(int(n), -(-c // RANKED_TOGETHER)) for n, c in counts.items() if c > RANKED_TOGETHER]
    salts = F.lit(1)
    if parts:
        pairs = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in parts]).cast("array<bigint>"), F.array(*[F.lit(p) for _, p in parts]).cast("array<bigint>"))
        salts = F.coalesce(F.try_element_at(pairs, F.col("length")), F.lit(1))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), salts))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    return salted.withColumn("_own", own).join(sums, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before")


def pack(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; rows that repeat are packed
    each; an empty table gives no rows; other columns are ignored.
    """
    pieces = written(tokenise(documents, path, id_col, text_col, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan_packing(counts, capacity)
    ranked = rank_within_length(pieces, counts, [id_col, "piece", "start", "ids_crc32"]).select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32", "rank")
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, "right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(rows[at, 3], pa.int64())], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
