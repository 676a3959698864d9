"""Byte-level BPE: pre-tokenisation by scans over code-point classes, then cached pair merging.

The rank files' split pattern is a small automaton once two facts about the
next character are folded into a character's class (white space that a word
follows; r, v and l that complete a contraction). A character is then a
transition function over eight states. Composition of such functions is
associative, and only a few dozen functions arise, so a table of their products
turns the automaton into a blocked prefix scan over arrays: no regex, and no
Python step per character. The slices between boundaries are merged once each
and kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import small_batches

#: Characters scanned at once; a longer text is scanned on its own.
SCAN_CHARS = 1_000_000
CACHE_ENTRIES = 1 << 19
BLOCK = 64

END, WS, SPACE, WS_LAST, LETTER, SUFFIX1, SUFFIX2, NUMBER, OTHER, QUOTE = range(10)
FRESH, IN_WS, AFTER_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_QUOTE, IN_SUFFIX = range(8)

#: Code points that the pattern's \s matches.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(kind: int, state: int) -> tuple[int, bool]:
    """State after a character of this kind, and whether a slice starts at it."""
    letters = (LETTER, SUFFIX1, SUFFIX2)
    if kind == END:
        return FRESH, True
    if kind == WS:
        return IN_WS, state != IN_WS
    if kind == SPACE:
        return AFTER_SPACE, True
    if kind == WS_LAST:
        return FRESH, True
    if kind in letters and state == IN_SUFFIX:
        return FRESH, False
    if kind == SUFFIX1 and state == AFTER_QUOTE:
        return FRESH, False
    if kind == SUFFIX2 and state == AFTER_QUOTE:
        return IN_SUFFIX, False
    if kind in letters:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    joins = state in (IN_OTHER, AFTER_SPACE, AFTER_QUOTE)
    return (AFTER_QUOTE if kind == QUOTE and not joins else IN_OTHER), not joins


@lru_cache(1)
def _code_point_classes() -> np.ndarray:
    """Class of every code point, before the next character is looked at."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = WS
    out[ord("'")] = QUOTE
    for c in "stmd":
        out[ord(c)] = SUFFIX1
    return out


@lru_cache(1)
def _algebra() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transition functions closed under composition: index by kind, products, values by state, slice starts."""
    one = [tuple(_step(k, s)[0] for s in range(8)) for k in range(10)]
    found = list(dict.fromkeys(one))
    index = {f: i for i, f in enumerate(found)}
    for f in found:  # grows while it is walked
        for g in one:
            for h in (tuple(g[s] for s in f),):
                if h not in index:
                    index[h] = len(found)
                    found.append(h)
    product = np.array([[index[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    return np.array([index[f] for f in one], np.uint16), product, np.array(found, np.uint8), np.array([[_step(k, s)[1] for s in range(8)] for k in range(10)])


def _prefix_products(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive scan of composition, in blocks: within blocks, across blocks, then combined."""
    n, size = len(functions), len(product)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, functions.dtype)
    padded[:n] = functions
    local = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat = product.ravel()
    for j in range(1, BLOCK):
        local[j] = flat[local[j - 1].astype(np.int32) * size + local[j]]
    before = _prefix_products(local[-1], product)[:-1].astype(np.int32) * size
    local[:, 1:] = flat[before[None, :] + local[:, 1:]]
    return np.ascontiguousarray(local.T).ravel()[:n]


def slice_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point; ends are the places of separators between texts."""
    kinds = _code_point_classes()[points]
    following = np.empty_like(points)
    following[:-1], following[-1] = points[1:], ord("\n")
    white = kinds == WS
    next_white = np.empty_like(white)
    next_white[:-1], next_white[-1] = white[1:], True
    kinds[white & ~next_white] = WS_LAST
    kinds[white & ~next_white & (points == 0x20)] = SPACE
    kinds[(((points == ord("r")) | (points == ord("v"))) & (following == ord("e"))) | ((points == ord("l")) & (following == ord("l")))] = SUFFIX2
    kinds[ends] = END
    generator, product, values, starts = _algebra()
    after = values[_prefix_products(generator[kinds], product), FRESH]
    before = np.empty_like(after)
    before[1:], before[0] = after[:-1], FRESH
    return starts[kinds, before]


class Encoder(dict):
    """Ids of a slice, as little-endian unsigned 32-bit integers; a cache that computes what it misses."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        rank = self.ranks.get(piece)
        out = np.array([rank] if rank is not None else self.merge(piece), "<u4").tobytes()
        if len(piece) <= 256:
            self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbours of lowest rank, the leftmost first, until none can be joined."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that begins here
        back = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := back[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for t in texts:
            if group and held + len(t) > SCAN_CHARS:
                out += self._encode(group)
                group, held = [], 0
            group.append(t)
            held += len(t) + 1
        return out + (self._encode(group) if group else [])

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(slice_starts(points, ends))
        data = joined.encode()
        if len(data) == len(points):
            at = starts
        else:
            at = (np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64) - 1)[starts]
            # the running sum counts a character whole: back to its first byte
            at -= ((points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))[starts]
        at = at.tolist()
        out, lo = [], 0
        for hi in np.searchsorted(starts, ends).tolist():
            out.append(b"".join([self[data[a:b]] for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])]))
            lo = hi + 1
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes) -> np.ndarray:
        """First byte of each token in the decoded bytes, so that any range of tokens decodes alone."""
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))[np.frombuffer(ids, "<u4")]
        return np.cumsum(sizes) - sizes


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False, with_decoded: bool = False) -> DataFrame:
    """(id, ids) with the ids as little-endian unsigned 32-bit integers, one row per row.

    path names a rank file on the executors. A null text counts as empty and has
    no ids; other columns are ignored. with_offsets adds the tokens' first bytes,
    with_decoded the bytes that the ids decode to.
    """
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(chosen.dtypes)['id']}, ids binary" + ", offsets array<bigint>" * with_offsets + ", decoded binary" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if with_offsets:
                columns.append(pa.array([own.offsets(x) for x in ids], pa.list_(pa.int64())))
            if with_decoded:
                columns.append(pa.array(map(own.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", *["offsets"] * with_offsets, *["decoded"] * with_decoded])

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for ids as encode() returns them; null ids decode to nothing."""
    small_batches(df.sparkSession)
    chosen = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, decoded binary").withColumnRenamed("id", id_col)
