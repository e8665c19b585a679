"""Filling containers of fixed capacity with texts, neighbours together."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import Scratch, ship_package

CAPACITY = 2048
#: texts a container chooses from, the most it may look at, and the part to be filled that ends the search
WINDOW, FARTHEST, ENOUGH = 64, 4096, 0.998
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_DIMS, _BITS = 3, 10


def load_tokenizer(path: str):
    """A public byte-level vocabulary of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(points: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """The place along the Hilbert curve of each point (rows of whole numbers below 2**bits).

    The bits of the coordinates are undone from the highest down: where a bit is set the
    lower bits of the first axis are inverted, else exchanged with those of that axis;
    a Gray code over the axes then gives the digits of the key.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            is_set = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(is_set, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def measured(documents: DataFrame, *, tokenizer: str = TOKENIZER, seed: int = 5) -> DataFrame:
    """(doc_id, tokens, key, x, y, z): size of each text, its place on the curve, and its projected point; null and empty texts, and rows without a doc_id, have no row.

    The hashed vector of a text is the count of each token; it is projected to three
    dimensions by fixed random signs, scaled by its length, and each dimension mapped
    to 2**10 steps by the normal distribution.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(tokenizer)
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(enc.n_vocab + 1, _DIMS)).astype(np.float32)
        for batch in batches:
            sizes, points = np.zeros(len(batch), dtype=np.int64), np.zeros((len(batch), _DIMS))
            for k, text in enumerate(batch["text"]):
                ids = enc.encode_to_numpy(text, disallowed_special=())
                sizes[k] = len(ids)
                v = signs[ids].sum(axis=0)
                points[k] = v / max(1.0, float(np.sqrt((np.square(np.unique(ids, return_counts=True)[1])).sum())))
            steps = np.clip((1 / (1 + np.exp(-1.702 * points))) * (1 << _BITS), 0, (1 << _BITS) - 1)
            steps = steps.astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes, "key": hilbert_key(steps), "x": steps[:, 0], "y": steps[:, 1], "z": steps[:, 2]})

    ship_package(documents.sparkSession)
    texts = documents.select("doc_id", "text").where("text is not null and text != '' and doc_id is not null")
    return texts.mapInPandas(measure, "doc_id bigint, tokens bigint, key bigint, x bigint, y bigint, z bigint").where("tokens > 0")


def best_subset(sizes: list[int], room: int) -> list[int]:
    """The places of the items whose total is the greatest that fits, the earliest items among equals.

    Bit t of an integer says whether the items from a place on can reach the total t.
    """
    mask, reach = (1 << (room + 1)) - 1, [1]
    for size in reversed(sizes):
        r = reach[-1]
        reach.append((r | r << size) & mask if size <= room else r)
    rest, taken, n = reach[-1].bit_length() - 1, [], len(sizes)
    for k, size in enumerate(sizes):
        if not rest:
            break
        if size <= rest and reach[n - k - 1] >> (rest - size) & 1:
            taken.append(k)
            rest -= size
    return taken


def pack_along(pieces: Iterator[tuple[int, int, int, int]], capacity: int, window: int, farthest: int, enough: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(box, doc_id, part, start, tokens) of pieces (doc_id, part, start, tokens) that come along the curve.

    A container begins with the first piece left and takes, of the next ``window`` pieces,
    those that fill it best; where that is less than ``enough`` of the capacity, of four
    times as many and so on, up to ``farthest``.  What it passes over stays in line.
    """
    waiting: deque[tuple[int, int, int, int]] = deque()
    box, more = 0, True
    while more or waiting:
        while more and len(waiting) <= farthest:
            piece = next(pieces, None)
            more = piece is not None
            if more:
                waiting.append(piece)
        if not waiting:
            return
        first = waiting.popleft()
        yield (box, *first)
        room, look, taken = capacity - first[3], window, []
        while room and waiting:
            sizes = [p[3] for p in islice(waiting, look)]
            taken = best_subset(sizes, room)
            left = room - sum(sizes[k] for k in taken)
            if left <= (1 - enough) * capacity or look >= farthest or look >= len(waiting):
                break
            look *= 4
        for k in taken:
            yield (box, *waiting[k])
        for k in reversed(taken):
            del waiting[k]
        box += 1


def packed(sizes: DataFrame, *, capacity: int = CAPACITY, window: int = WINDOW, farthest: int = FARTHEST, enough: float = ENOUGH, per_range: int = 10_000, n_docs: int | None = None) -> DataFrame:
    """(container_id, doc_id, part, start, tokens): what lies in each container.

    sizes: doc_id, tokens, key.  Texts are sorted by their place on the curve into ranges
    of about ``per_range`` texts, at most 20,000 ranges (equal keys, such as copies, by a hash of doc_id, so a
    hot key is cut into ranges too), and each range is packed along the curve, looking
    ahead at ``window`` texts, or up to ``farthest`` where those leave too much room:
    containers hold neighbours, and a task holds what it looks at, not a range.  A text larger than the capacity is cut into full containers and a rest; no
    other text is divided.
    """
    n = sizes.count() if n_docs is None else n_docs
    ranges = max(1, min(-(-n // per_range), 20_000))  # a longer range costs no more memory
    spread = F.xxhash64("doc_id")
    d = sizes.select("key", spread.alias("spread"), "doc_id", "tokens").repartitionByRange(ranges, "key", "spread", "doc_id").sortWithinPartitions("key", "spread", "doc_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_no = TaskContext.get().partitionId()

        def pieces() -> Iterator[tuple[int, int, int, int]]:
            for batch in batches:
                for doc, tokens in zip(batch["doc_id"].tolist(), batch["tokens"].tolist()):
                    if tokens <= capacity:
                        yield doc, 0, 0, tokens
                    else:
                        for part in range(-(-tokens // capacity)):
                            yield doc, part, part * capacity, min(capacity, tokens - part * capacity)

        got = pack_along(pieces(), capacity, window, farthest, enough)
        while rows := list(islice(got, 50_000)):
            out = pd.DataFrame(rows, columns=["box", "doc_id", "part", "start", "tokens"])
            out.insert(0, "range", part_no)
            yield out

    out = d.select("doc_id", "tokens").mapInPandas(pack, "range bigint, box bigint, doc_id bigint, part bigint, start bigint, tokens bigint")
    return out.select(F.concat_ws("-", "range", "box").alias("container_id"), "doc_id", "part", "start", "tokens")


def fill_containers(documents: DataFrame, *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, window: int = WINDOW, farthest: int = FARTHEST, enough: float = ENOUGH, per_range: int = 10_000) -> DataFrame:
    """Documents measured, ordered along the curve and packed; see ``measured`` and ``packed``."""
    scratch = Scratch(documents.sparkSession, "packing")
    return packed(scratch.keep(measured(documents, tokenizer=tokenizer), "sizes"), capacity=capacity, window=window, farthest=farthest, enough=enough, per_range=per_range)


def fill_report(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least_containers, fill): one row."""
    boxes = pieces.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    total = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.try_divide("tokens", F.col("containers") * capacity).alias("fill"))


def locality_report(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """(texts, spread): one row; the mean squared distance of the texts of a container, as a share of that in random order.

    sizes: doc_id, and the projected point x, y, z of each text.  The squares within a
    container are summed about its mean and divided by what as many containers of the same
    numbers of texts would have if texts were drawn at random.
    """
    axes = ("x", "y", "z")
    rows = pieces.select("container_id", "doc_id").distinct().join(sizes.select("doc_id", *axes).dropDuplicates(["doc_id"]), "doc_id")
    squares = lambda n: [(F.sum(F.pow(a, F.lit(2))) - F.sum(a) * F.sum(a) / n) for a in axes]
    count = F.count("*")
    inside = rows.groupBy("container_id").agg(count.alias("n"), sum(squares(count), F.lit(0.0)).alias("s"))
    all_ = rows.agg(count.alias("_n"), sum(squares(F.greatest(count, F.lit(1))), F.lit(0.0)).alias("_s"))
    got = inside.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.sum("s").alias("s"), F.sum(F.col("n") - 1).alias("free"))
    by_chance = F.try_divide(F.col("_s"), F.col("_n") - 1) * F.col("free")
    return got.join(F.broadcast(all_)).select("texts", F.round(F.try_divide("s", by_chance), 4).alias("spread"))  # one row
