"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import WordIds, encode, gram_keys, slices, words
from larder.session import ship_package

RUN, BUDGET = 13, 2
_CHUNK = 50_000


def bit_parallel_distance(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least edit distance of each pattern (row, at most 62 words) to any stretch of its text.

    Bit-vector dynamic programming over the columns of the text, all rows at once:
    vertical differences are kept in two words of bits, and the score of the last row
    of the matrix is followed along the text.
    """
    n, m = pattern.shape
    one, last = np.int64(1), np.int64(1) << np.int64(m - 1)
    full = (np.int64(1) << np.int64(m)) - 1
    plus, minus = np.full(n, full, dtype=np.int64), np.zeros(n, dtype=np.int64)
    score = np.full(n, m, dtype=np.int64)
    best = score.copy()
    weight = one << np.arange(m, dtype=np.int64)
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * weight).sum(axis=1)
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) & full) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        score += ((up & last) != 0).astype(np.int64) - ((down & last) != 0).astype(np.int64)
        np.minimum(best, score, out=best)
        up, down = (up << one) & full, (down << one) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return best


class PassageIndex:
    """The passages (all runs of ``run`` words) of test items, and their pieces.

    Each passage is cut into budget+1 pieces; with at most ``budget`` words changed,
    left out or put in, one piece is unchanged.  Words are kept once, passages as the
    places where they begin: about 50 bytes a word.
    """

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int):
        if not 0 <= budget < run <= 62:
            raise ValueError("a passage has 1 to 62 words, and fewer edits than words")
        self.run, self.budget = run, budget
        self.vocabulary: dict[str, int] = {}
        all_words, starts, owners = [], [], []
        for ident, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            first = range(len(all_words), len(all_words) + len(own) - run + 1)
            starts += first
            owners += [ident] * len(first)
            all_words += own
        self.words, self.starts, self.eval_ids = np.asarray(all_words, dtype=np.int32), np.asarray(starts, dtype=np.int64), np.asarray(owners, dtype=np.int64)
        cuts = [run * k // (budget + 1) for k in range(budget + 2)]
        self.pieces = []
        for a, b in zip(cuts, cuts[1:]):
            keys = gram_keys(self.words.astype(np.int64), b - a)[self.starts + a]
            order = np.argsort(keys, kind="stable")
            self.pieces.append((a, b - a, keys[order], order))

    def passages(self, number: np.ndarray) -> np.ndarray:
        return self.words[self.starts[number][:, None] + np.arange(self.run)]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place where the passage would begin, passage) for each exact piece found in the words, a bounded number at a time."""
        grams = {size: gram_keys(ids, size) for size in {p[1] for p in self.pieces}}
        inside = {size: np.flatnonzero(at) for size, at in grams.items()}
        for offset, size, keys, order in self.pieces:
            at, place = grams[size], inside[size]
            low = np.searchsorted(keys, at[place], "left")
            n = np.searchsorted(keys, at[place], "right") - low
            place, low, n = place[n > 0], low[n > 0], n[n > 0]
            upto = np.cumsum(n)
            for first in range(0, int(upto[-1]) if len(upto) else 0, _CHUNK):
                # the hits first .. first + _CHUNK in the order of places
                hit = np.arange(first, min(first + _CHUNK, int(upto[-1])))
                each = np.searchsorted(upto, hit, "right")
                yield place[each] - offset, order[low[each] + hit - (upto[each] - n[each])]

    def close(self, padded: np.ndarray, begin: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, passage, distance) of the pairs within the budget; padded: the words with run + budget of none at either end.

        First the words of the passage that lie at their place in the text, give or take
        the budget, are counted: where too many lie nowhere, the edits are too many.
        """
        at, own = begin + self.run, self.starts[passage]  # the first place of the window in the padded words
        columns = [padded[at + k] for k in range(self.run + 2 * self.budget)]
        placed = np.zeros(len(begin), dtype=np.int8)
        for k in range(self.run):
            word = self.words[own + k]
            hit = columns[k] == word
            for shift in range(1, 2 * self.budget + 1):
                hit |= columns[k + shift] == word
            placed += hit
        ok = np.flatnonzero(placed >= self.run - self.budget)
        begin, passage = begin[ok], passage[ok]
        text, pattern = np.stack([c[ok] for c in columns], axis=1), self.passages(passage)
        distance = np.zeros(len(begin), dtype=np.int64)
        edited = (text[:, self.budget : self.budget + self.run] != pattern).any(axis=1)
        distance[edited] = bit_parallel_distance(pattern[edited], text[edited])
        ok = distance <= self.budget
        return begin[ok], passage[ok], distance[ok]

    def search(self, ids: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
        """(doc, eval_id, distance, passages): the least distance of any passage of the item, and how many passages match."""
        got, none = [], np.full(self.run + self.budget, -1, dtype=np.int32)
        padded = np.concatenate([none, ids.astype(np.int32), none])
        for begin, passage in self.hits(ids):
            begin, passage, distance = self.close(padded, begin, passage)
            # a passage may begin a little before its text; the middle lies inside
            where = np.clip(begin + self.run // 2, 0, len(ids) - 1)
            got.append(pd.DataFrame({"doc": doc[where], "eval_id": self.eval_ids[passage], "passage": passage, "distance": distance}))
        if not got:
            return pd.DataFrame({"doc": [], "eval_id": [], "distance": [], "passages": []})
        return pd.concat(got).groupby(["doc", "eval_id"], as_index=False).agg(distance=("distance", "min"), passages=("passage", "nunique"))


def leaked_passages(
    documents: DataFrame, evals: DataFrame, *, run: int = RUN, budget: int = BUDGET, block_chars: int = 8_000_000
) -> DataFrame:
    """(doc_id, eval_id, distance, passages): documents that hold a passage of a test item.

    A passage is ``run`` consecutive words; it is held if some stretch of the document
    differs from it by at most ``budget`` words.  distance is the least found (0: word
    for word), passages how many passages of the item are held.  Items with fewer than
    ``run`` words, null or empty texts, and rows without a doc_id, hold and are held by nothing.

    The test items form the query set: an index of all of them goes to the tasks, in
    blocks of at most ``block_chars`` characters (about 90 MB of index); documents are
    read once, or once for each such block, in Arrow batches, and never shuffled.  A
    document with several rows of the same doc_id gives a row for each.
    """
    spark = documents.sparkSession
    ship_package(spark)
    total = evals.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-total // block_chars))
    found = None
    for b in range(blocks):
        part = evals.where(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == b).select("eval_id", "text").where("text is not null and eval_id is not null")
        items = [(r["eval_id"], r["text"]) for r in part.collect()]  # one block, at most about block_chars
        index = spark.sparkContext.broadcast(PassageIndex(items, run, budget))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = index.value
            numbers = WordIds(own.vocabulary)
            for batch in batches:
                texts, names = batch["text"].tolist(), batch["doc_id"].to_numpy()
                for part in slices(texts):
                    ids, doc = encode(texts[part], numbers, gap=own.run + 2 * own.budget)
                    hits = own.search(ids, doc)
                    hits.insert(0, "doc_id", names[part][hits["doc"].to_numpy(dtype=np.int64)])
                    yield hits[["doc_id", "eval_id", "distance", "passages"]].astype({"eval_id": "int64", "distance": "int64", "passages": "int64"})

        one = documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(search, "doc_id bigint, eval_id bigint, distance bigint, passages bigint")
        found = one if found is None else found.unionByName(one)
    return found


def word_for_word(leaks: DataFrame) -> DataFrame:
    """(doc_id, eval_id): the leaks that share a whole run of words."""
    return leaks.where("distance = 0").select("doc_id", "eval_id").distinct()


def leak_report(leaks: DataFrame, documents: DataFrame, evals: DataFrame) -> DataFrame:
    """(suite, source, items, documents, exact_documents): what leaked, by suite and source of the document."""
    docs = documents.select("doc_id", "source")
    suites = evals.select("eval_id", "suite")
    joined = leaks.join(docs, "doc_id").join(suites, "eval_id")
    return joined.groupBy("suite", "source").agg(
        F.countDistinct("eval_id").alias("items"), F.countDistinct("doc_id").alias("documents"),
        F.countDistinct(F.when(F.col("distance") == 0, F.col("doc_id"))).alias("exact_documents"))
