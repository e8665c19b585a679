"""Near joins of 64-bit picture hashes without comparing all pairs.

Two hashes that differ in at most t bits agree on at least b-t of b disjoint
blocks of bits.  Every choice of b-t blocks is a mask; both sides are joined on
(mask, hash & mask) and the distance is checked inside the join.  Blocks are made
of every b-th bit, since neighbouring bits of a picture hash are correlated.

The join has a merge hint: Spark takes a table exploded by the masks for no larger
than its hashes, and would send up to a few hundred rows a hash through the driver.

Above ``JOINED_DISTANCE`` bits (or ``joined``) the masks of such a join are too many (45 to 495 rows a
hash for 8 bits), so the values of one column are then shuffled by single blocks, t+1
rows a hash, and the pairs within a block are looked for in Python (NumPy).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import ship_package

#: Up to this distance pairs are found by the masked join.
JOINED_DISTANCE = 5
#: In larger buckets near values are looked up by blocks of at most KEY_BITS bits, at LOOKUP_COST comparisons a candidate.
COMPARED_AT_ONCE, KEY_BITS, LOOKUP_COST = 2048, 16, 4
CELLS, CANDIDATES, OUT_ROWS = 1 << 17, 1 << 14, 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, agree: int) -> list[int]:
    """One signed 64-bit mask for each choice of ``agree`` of the blocks."""
    block = [sum(1 << i for i in range(k, 64, blocks)) for k in range(blocks)]
    return [signed(sum(block[k] for k in choice)) for choice in combinations(range(blocks), agree)]


def plan_masks(distinct: int, max_distance: int, *, pair_cost: float = 0.1) -> list[int]:
    """The masks with the least expected work for that many distinct hashes.

    Rows moved are distinct * masks; pairs compared are masks * distinct**2 / 2**bits.
    Any plan finds every pair; the choice only trades rows for comparisons.
    """
    def cost(blocks: int) -> float:
        agree = blocks - max_distance
        masks, bits = comb(blocks, agree), 64 * agree / blocks
        return masks * (distinct + pair_cost * distinct * distinct / 2 ** (bits + 1))

    best = min(range(max_distance + 1, max_distance + 6), key=cost)
    return block_masks(best, best - max_distance)


def masked(df: DataFrame, value: str, masks: list[int]) -> DataFrame:
    """One row for each mask: ``_mask`` (its number) and ``_sig`` (the bits under it)."""
    sigs = F.array(*[F.col(value).bitwiseAND(F.lit(m)) for m in masks])
    return df.select("*", F.posexplode(sigs).alias("_mask", "_sig"))


def hamming_pairs(hashes: DataFrame, value: str, max_distance: int, *, n_distinct: int | None = None, joined: int = JOINED_DISTANCE) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different values at most max_distance apart, each once.

    ``hashes`` must hold distinct non-null BIGINT values.  Pairs of up to ``joined`` bits are found by the masked join.
    """
    if max_distance > joined:
        pairs = bucket_pairs(hashes, value, max_distance)
        return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    n = hashes.count() if n_distinct is None else n_distinct
    m = masked(hashes.select(value), value, plan_masks(n, max_distance))
    a = m.select("_mask", "_sig", F.col(value).alias("a"))
    b = m.select("_mask", "_sig", F.col(value).alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    pairs = a.join(b.hint("merge"), ["_mask", "_sig"]).where(close).select("a", "b").distinct()
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))


def bucket_pairs(hashes: DataFrame, value: str, max_distance: int) -> DataFrame:
    """(a, b), a < b, as hamming_pairs finds them: values that agree on one of t+1 blocks share a bucket, which one task searches."""
    spark = hashes.sparkSession
    ship_package(spark)
    masks = block_masks(max_distance + 1, 1)
    m = masked(hashes.select(value), value, masks).select("_mask", "_sig", F.col(value).alias("_value"))
    # by number: few bytes a bucket, but much work, so its partitions must not be coalesced
    m = m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_mask", "_sig").sortWithinPartitions("_mask", "_sig")
    return m.mapInArrow(_search(masks, max_distance), "a bigint, b bigint")


def _search(masks: list[int], max_distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    blocks = [m & (1 << 64) - 1 for m in masks]

    def found(mask: int, pieces: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        v = np.concatenate(pieces)
        for a, b in near_within(v, ~blocks[mask] & (1 << 64) - 1, max_distance):
            first = _differ(a ^ b, blocks[:mask])
            yield a[first], b[first]

    def batch_of(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in out]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for mask, pieces in _buckets(batches):
            for pair in found(mask, pieces):
                out.append(pair)
                n += len(pair[0])
                if n >= OUT_ROWS:
                    yield batch_of(out)
                    out, n = [], 0
        if n:
            yield batch_of(out)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(mask, parts of its values) of each bucket of more than one value; a bucket may go on over several batches."""
    at, pieces = None, []
    for batch in batches:
        mask, sig, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(v):
            continue
        v = v.astype(np.int64).view(np.uint64)
        cuts = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (sig[1:] != sig[:-1])) + 1).tolist(), len(v)]
        for lo, hi in zip(cuts, cuts[1:]):
            key = (int(mask[lo]), int(sig[lo]))
            if key != at:
                if sum(map(len, pieces)) > 1:
                    yield at[0], pieces
                at, pieces = key, []
            pieces.append(v[lo:hi])
    if sum(map(len, pieces)) > 1:
        yield at[0], pieces


def near_within(v: np.ndarray, free: int, max_distance: int, *, at_once: int = COMPARED_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the distinct 64-bit values at most max_distance apart, each once; they agree on the bits outside ``free``.

    Of t//2+1 blocks of the free bits one differs in a bit at most: many values are looked
    up by the bits of a block, as they are and with each one turned.
    """
    bits = [k for k in range(64) if free >> k & 1]
    n_blocks = max(max_distance // 2 + 1, -(-len(bits) // KEY_BITS))
    if len(v) > at_once and len(bits) >= n_blocks:
        turned = max_distance >= n_blocks
        cuts = [_cut(v, bits[k::n_blocks]) for k in range(n_blocks)]
        # values that mostly agree are not looked up: it would cost more than comparing them all
        if LOOKUP_COST * sum(_candidates(at, turned) for *_, at in cuts) < len(v) ** 2 / 2:
            blocks = [sum(1 << b for b in bits[k::n_blocks]) for k in range(n_blocks)]
            for k, cut in enumerate(cuts):
                for a, b in _looked_up(v, *cut, turned, max_distance):
                    first = _differ(a ^ b, blocks[:k], int(turned))
                    yield a[first], b[first]
            return
    step = max(1, CELLS // len(v))
    for i in range(0, len(v) - 1, step):
        head, tail = v[i : i + step], v[i + 1 :]
        cells = np.flatnonzero(np.bitwise_count(head[:, None] ^ tail) <= max_distance)
        r, c = np.divmod(cells, len(tail))
        later = c >= r
        yield head[r[later]], tail[c[later]]


def _cut(v: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the values by the number that these bits make, the numbers in that order, and where each begins in it."""
    key = np.zeros(len(v), np.uint16)
    for j, b in enumerate(bits):
        key |= (v >> np.uint64(b) & np.uint64(1)).astype(np.uint16) << np.uint16(j)
    order = np.argsort(key, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << len(bits)))])
    return order, key[order].astype(np.int64), at


def _candidates(at: np.ndarray, turned: bool) -> int:
    """How many pairs of values have the same number or, if ``turned``, one with one other bit."""
    n = np.diff(at)
    same = int((n * (n - 1)).sum()) // 2
    pairs = [n.reshape(-1, 2, 1 << j) for j in range((len(n) - 1).bit_length())] if turned else []
    return same + sum(int((p[:, 0] * p[:, 1]).sum()) for p in pairs)


def _looked_up(v: np.ndarray, order: np.ndarray, key: np.ndarray, at: np.ndarray, turned: bool, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    v = v[order]
    yield from _close(v, np.arange(len(v)), np.arange(len(v)) + 1, at[key + 1], max_distance)
    for j in range((len(at) - 2).bit_length() if turned else 0):
        i = np.flatnonzero(key >> j & 1 == 0)
        other = key[i] | 1 << j
        yield from _close(v, i, at[other], at[other + 1], max_distance)


def _close(v: np.ndarray, i: np.ndarray, lo: np.ndarray, hi: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of v[i] with v[lo:hi], for each i, at most max_distance apart."""
    n = hi - lo
    ends = np.cumsum(n)
    done = 0
    while done < len(n):  # at most CANDIDATES at once, unless one value has more
        before = int(ends[done - 1]) if done else 0
        to = max(done + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
        m = n[done:to]
        b = v[np.arange(int(ends[to - 1]) - before) + np.repeat(lo[done:to] - (ends[done:to] - m - before), m)]
        a = np.repeat(v[i[done:to]], m)
        near = np.flatnonzero(np.bitwise_count(a ^ b) <= max_distance)
        yield a[near], b[near]
        done = to


def _differ(x: np.ndarray, blocks: list[int], more_than: int = 0) -> np.ndarray:
    """Where the differences x have a bit, or more than so many, in each of the blocks."""
    out = np.ones(len(x), bool)
    for block in blocks:
        out &= np.bitwise_count(x & np.uint64(block)) > more_than
    return out


def hamming_cross_pairs(left: DataFrame, right: DataFrame, value: str, max_distance: int, *, n_distinct: int) -> DataFrame:
    """(a, b): different values a of left and b of right at most max_distance apart, each once."""
    masks = plan_masks(n_distinct, max_distance)
    a = masked(left.select(value), value, masks).select("_mask", "_sig", F.col(value).alias("a"))
    b = masked(right.select(value), value, masks).select("_mask", "_sig", F.col(value).alias("b"))
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    return a.join(b.hint("merge"), ["_mask", "_sig"]).where(close).select("a", "b").distinct()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)
