"""Deduplicating new batches against all history."""

from __future__ import annotations

import json
from itertools import combinations
from math import ceil, comb, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators.hamming import block_masks, signed
from larder.operators.skew import hot_salted_join
from larder.session import Scratch

NEAR = 5
_POSTING = "kind tinyint, tok bigint, chk bigint, at timestamp_ntz, seq int, part int"
#: comparing a posting costs about so much of making and moving a token
_COMPARE = 0.2
#: tokens of a probe that are sent to all executors instead of exchanging the postings, at most (about 10 MB)
_SEND = 200_000


def _shares(budget: int, blocks: int) -> list[int]:
    """budget units dealt evenly to the blocks, the first ones taking the rest."""
    return [budget // blocks + (k < budget % blocks) for k in range(blocks)]


def _flips(width: int, units: int) -> int:
    """Tokens within units-1 bits of one of so many bits; none for no unit."""
    return sum(comb(width, j) for j in range(units))


def _width(blocks: int, k: int) -> int:
    return len(range(k, 64, blocks))


def probe_tokens(max_distance: int, blocks: int, skip: int | None = None) -> int:
    """Tokens that a probe asks for, with one block left out or none."""
    used = [k for k in range(blocks) if k != skip]
    return sum(_flips(_width(blocks, k), u) for k, u in zip(used, _shares(max_distance + 1, len(used))))


def plan_blocks(values: int, max_distance: int) -> int:
    """The number of blocks that costs a probe least against so many hashes; any number finds all."""
    cost = lambda m: probe_tokens(max_distance, m) * (1 + _COMPARE * values / 2 ** (64 / m))
    return min(range(2, max_distance + 2), key=cost)


def hot_limit(values: int, max_distance: int, blocks: int) -> float:
    """Postings of a token from which a probe does better to leave its block out and to look further around the others.

    At most blocks * values / limit tokens are so frequent, some ten thousand whatever the
    number of values, since the limit grows with it.
    """
    if blocks < 3:
        return float("inf")
    extra = probe_tokens(max_distance, blocks, 0) - probe_tokens(max_distance, blocks)
    return max(extra, 1) * (1 + _COMPARE * values / 2 ** (64 / blocks)) / _COMPARE


def _long(x: int) -> str:
    x = signed(x) if x >= 0 else x
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def _asked(max_distance: int, blocks: int, skip: int | None) -> list[tuple[int, int, int]]:
    """(kind, mask, turned bits) of the tokens of a probe."""
    used = [k for k in range(blocks) if k != skip]
    masks, out = block_masks(blocks, 1), []
    for k, units in zip(used, _shares(max_distance + 1, len(used))):
        bits = range(k, 64, blocks)
        out += [(2 + k, masks[k], sum(1 << i for i in turned)) for j in range(units) for turned in combinations(bits, j)]
    return out


def _constant(rows: list[tuple[int, int, int]]) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('k', {k}Y, 'mask', {_long(m)}, 'turn', {_long(t)})" for k, m, t in rows) + ")")


class HistoryIndex:
    """An inverted index of what is known so far, kept in a folder and opened again by later runs.

    A row is a set of tokens: its digest, its address, and the blocks of its picture hash
    (every b-th bit; each block with its place).  Copies share one posting, which holds
    the earliest time of acceptance and the earliest batch of its value.

    Of two hashes at most t bits apart and cut into b blocks, whose blocks are given t+1
    units in all, one block differs in fewer bits than its units: a probe asks for each of
    its blocks within that many bits less one.  Units go to the rarer tokens: where the
    most frequent block of a hash has more postings than looking further around the others
    costs, it is given none, so the prefix of rare tokens is all that is asked for.  The
    frequent tokens of a segment are counted when it is written.

    Postings lie in segments, one for each addition, hashed by token into parts; width of
    blocks and number of parts follow the size of the segment.  A probe reads postings
    (four to seven narrow rows a value), never the history, and only the parts its tokens
    fall into.  Segments of like size are merged, ``fan`` at a time, so a posting is
    rewritten a logarithmic number of times.  A manifest names the segments; it is written
    last, so a job that fails leaves the index as it was.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, max_distance: int = NEAR, blocks: int | None = None, limit: float | None = None, per_part: int = 250_000, fan: int = 8):
        self.spark, self.path, self.max_distance, self.blocks, self.limit, self.per_part, self.fan = spark, path.rstrip("/"), max_distance, blocks, limit, per_part, fan
        self.segments: list[dict] = []
        self.last_seq: int | None = None
        self.version = 0
        #: parts read by the last probe and parts there are
        self.parts_read = self.parts = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> HistoryIndex:
        """The index in a folder, empty if there is none yet."""
        index = cls(spark, path, **options)
        fs, at = index._fs(index.path)
        if fs.exists(at):
            found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("manifest-")]
            if found:
                stream = fs.open(max(found, key=lambda p: p.getName()))
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                held = json.loads(text)
                if held["max_distance"] != index.max_distance:
                    raise ValueError(f"the index was made for {held['max_distance']} bits")
                index.segments, index.last_seq, index.version = held["segments"], held["last_seq"], held["version"]
        return index

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _publish(self) -> None:
        self.version += 1
        text = json.dumps({"max_distance": self.max_distance, "segments": self.segments, "last_seq": self.last_seq, "version": self.version})
        fs, draft = self._fs(f"{self.path}/draft-{self.version:09d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(draft, self._fs(f"{self.path}/manifest-{self.version:09d}.json")[1])

    @staticmethod
    def values(rows: DataFrame, *carry: str) -> DataFrame:
        """(carry, kind, v1, v2) for each digest (0), address (1) and hash (2) of the rows.

        rows: sha (64 hex digits), url (as read), ph (bits), any of them null.  Digests and
        addresses are carried as 128 bits of hash.
        """
        kind = lambda n, c, a, b: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).cast("tinyint").alias("kind"), a.alias("v1"), b.alias("v2")))
        each = F.array(
            kind(0, "sha", F.xxhash64("sha"), F.xxhash64(F.lit("larder"), "sha")),
            kind(1, "url", F.xxhash64("url"), F.xxhash64(F.lit("larder"), "url")),
            kind(2, "ph", F.col("ph"), F.col("ph")),
        )
        return rows.select(*carry, F.explode(F.array_compact(each)).alias("v")).select(*carry, "v.*")

    def _tokens(self, values: DataFrame, of_hash: Column, parts: int, *carry: str) -> DataFrame:
        """One row for each token: (kind, tok, chk, part, base, v1, carry)."""
        each = F.when(F.col("kind") == 0, _constant([(0, -1, 0)])).when(F.col("kind") == 1, _constant([(1, -1, 0)])).otherwise(of_hash)
        t = values.select(F.col("kind").alias("base"), "v1", F.col("v2").alias("chk"), *carry, F.explode(each).alias("t"))
        token = F.col("v1").bitwiseAND(F.col("t.mask")).bitwiseXOR(F.col("t.turn"))
        t = t.select("base", "v1", F.col("t.k").alias("kind"), token.alias("tok"), "chk", *carry)
        return t.withColumn("part", F.pmod(F.xxhash64("kind", "tok"), F.lit(parts)).cast("int"))

    def _write(self, values: DataFrame, count: int, hashes: int) -> dict:
        """A new segment of distinct values (kind, v1, v2, at, seq)."""
        blocks = self.blocks or plan_blocks(hashes, self.max_distance)
        parts = max(1, min(4096, ceil((count + hashes * (blocks - 1)) / self.per_part)))
        own = [(2 + k, mask, 0) for k, mask in enumerate(block_masks(blocks, 1))]
        name = f"segment-{self.version + 1:09d}-{len(self.segments)}"
        postings = self._tokens(values, _constant(own), parts, "at", "seq").select("kind", "tok", "chk", "at", "seq", "part")
        postings.repartition(parts, "part").sortWithinPartitions("part", "kind", "tok").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")
        limit = self.limit if self.limit is not None else hot_limit(hashes, self.max_distance, blocks)
        hot = 0
        if limit < hashes:
            frequent = self._read(name).where("kind >= 2").groupBy("kind", "tok").agg(F.count("*").alias("n")).where(F.col("n") > limit)
            frequent.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}-hot")
            hot = self.spark.read.parquet(f"{self.path}/{name}-hot").count()
        return {"name": name, "blocks": blocks, "parts": parts, "values": count, "hot": hot}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_POSTING).parquet(f"{self.path}/{name}")

    def append(self, rows: DataFrame) -> None:
        """rows: sha, url, ph, at (time of acceptance) or seq (number of the batch), the other one null.

        A row with neither is known to no probe and is left out.
        """
        scratch = Scratch(self.spark, "history-values")
        values = self.values(rows.where("at is not null or seq is not null"), "at", "seq").groupBy("kind", "v1", "v2").agg(F.min("at").alias("at"), F.min("seq").alias("seq"))
        values = scratch.keep(values, "values")
        self._add(values)
        scratch.drop(values)
        self._publish()
        self._merge()

    def _add(self, values: DataFrame) -> None:
        counted = values.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 2).alias("h")).first()
        if counted["n"]:
            self.segments.append(self._write(values, counted["n"], counted["h"]))

    def _merge(self) -> None:
        """Merge ``fan`` segments of one order of size into one."""
        level = lambda s: int(log(max(s["values"], 1), self.fan))
        while True:
            by: dict[int, list[dict]] = {}
            for s in self.segments:
                by.setdefault(level(s), []).append(s)
            full = next((v for v in by.values() if len(v) >= self.fan), None)
            if full is None:
                return
            scratch, old = Scratch(self.spark, "history-merge"), None
            for s in full:
                p = self._read(s["name"])
                # each hash once: by its first block
                kind = F.least(F.col("kind"), F.lit(2)).cast("tinyint")
                v = p.where("kind <= 2").select(kind.alias("kind"), F.when(F.col("kind") < 2, F.col("tok")).otherwise(F.col("chk")).alias("v1"), F.col("chk").alias("v2"), "at", "seq")
                old = v if old is None else old.unionByName(v)
            values = scratch.keep(old.groupBy("kind", "v1", "v2").agg(F.min("at").alias("at"), F.min("seq").alias("seq")), "values")
            kept = [s for s in self.segments if s not in full]
            self.version += 1  # a name of its own
            self.segments = kept
            self._add(values)
            scratch.drop(values)
            self._publish()
            for s in full:
                for name in (s["name"], f"{s['name']}-hot"):
                    fs, at = self._fs(f"{self.path}/{name}")
                    fs.delete(at, True)

    def _probe(self, segment: dict, values: DataFrame, count: int) -> DataFrame:
        """(kind, v1, v2, at, seq): those of the distinct values that an earlier posting of the segment meets; the search of a value ends with its first hit."""
        m, parts = segment["blocks"], segment["parts"]
        of_hash = _constant(_asked(self.max_distance, m, None))
        if segment["hot"]:
            hot = self.spark.read.schema("kind tinyint, tok bigint, n bigint").parquet(f"{self.path}/{segment['name']}-hot")
            for k, mask in enumerate(block_masks(m, 1)):
                own = hot.where(F.col("kind") == 2 + k).select(F.col("tok").alias("_t"), F.col("n").alias(f"_f{k}"))
                values = values.join(F.broadcast(own), (F.col("kind") == 2) & (F.col("v1").bitwiseAND(F.lit(mask)) == F.col("_t")), "left").drop("_t")  # at most hot_limit's bound
            most = F.greatest(*[F.coalesce(F.col(f"_f{k}"), F.lit(0)) for k in range(m)])
            for k in range(m):
                of_hash = F.when((most > 0) & (F.col(f"_f{k}") == most), _constant(_asked(self.max_distance, m, k))).otherwise(of_hash)
        probes = self._tokens(values, of_hash, parts, "at", "seq").alias("p")
        index = self._read(segment["name"])
        asked = count * probe_tokens(self.max_distance, m)
        self.parts += parts
        if asked < 3 * parts:  # else they fall into nearly all parts
            wanted = sorted(r[0] for r in probes.select("part").distinct().collect())  # at most ``parts`` numbers
            index = index.where(F.col("part").isin(*wanted)) if len(wanted) < parts else index
            self.parts_read += len(wanted)
        else:
            self.parts_read += parts
        index = index.alias("i")
        same = (F.col("p.part") == F.col("i.part")) & (F.col("p.kind") == F.col("i.kind")) & (F.col("p.tok") == F.col("i.tok"))
        length = F.abs(F.bit_count("p.chk").cast("int") - F.bit_count("i.chk").cast("int")) <= self.max_distance
        near = length & (V.hamming(F.col("p.chk"), F.col("i.chk")) <= self.max_distance)
        verified = F.when(F.col("p.kind") < 2, F.col("p.chk") == F.col("i.chk")).otherwise(near)
        older = F.coalesce(F.col("i.at") < F.col("p.at"), F.lit(False)) | F.coalesce(F.col("i.seq") < F.col("p.seq"), F.lit(False))
        out = [F.col("p.base").alias("kind"), F.col("p.v1").alias("v1"), F.col("p.chk").alias("v2"), F.col("p.at").alias("at"), F.col("p.seq").alias("seq")]
        if asked <= _SEND and not segment["hot"]:  # at most _SEND rows are sent
            return index.join(F.broadcast(probes), same & verified & older).select(*out)
        return probes.join(index, same & verified & older, "left_semi").select(*out)

    def known(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(id): rows (id, sha, url, ph, at, seq) met by a value accepted before their ``at`` or by one of a batch before their ``seq``.

        Equal values of a batch are probed once, so a hot picture is one probe.
        """
        if not self.segments:
            return rows.select(id_col).limit(0)
        scratch = Scratch(self.spark, "history-probe")
        never = [F.coalesce("at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), F.coalesce("seq", F.lit(-(1 << 31))).alias("seq")]
        own = scratch.keep(self.values(rows, id_col, "at", "seq").select(id_col, "kind", "v1", "v2", *never), "own")
        values = scratch.keep(own.select("kind", "v1", "v2", "at", "seq").distinct(), "probes")
        count = values.count()
        self.parts_read = self.parts = 0
        met = None
        for s in self.segments:
            one = self._probe(s, values, count)
            met = one if met is None else met.unionByName(one)
        return hot_salted_join(met.distinct(), own, ["kind", "v1", "v2", "at", "seq"], spread=F.col(id_col)).select(id_col).distinct()

    def process(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(id): known rows of one or more new batches (id, sha, url, ph, at, seq), which are then part of the index.

        Each batch is checked against what was accepted before it and the batches before
        it, those of the same call included: their postings bear the number of the batch.
        """
        self.append(rows.select("sha", "url", "ph", F.lit(None).cast("timestamp_ntz").alias("at"), "seq"))
        top = rows.agg(F.max("seq")).first()[0]
        if top is not None:
            self.last_seq = max(top, self.last_seq if self.last_seq is not None else top)
            self._publish()
        return self.known(rows, id_col)


def read_pictures(rows: DataFrame, *keep) -> DataFrame:
    """The columns to keep, and sha, ph and url as read."""
    url = V.read_image_url("image_url") if "image_url" in rows.columns else F.lit(None).cast("string")
    return rows.select(*keep, V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"), url.alias("url"))


def known_candidates(candidates: DataFrame, accepted: DataFrame, *, max_distance: int = NEAR, index: HistoryIndex | None = None) -> DataFrame:
    """(candidate_id): candidates already known when their batch came.

    Pictures newly accepted are added to the index with their times, then the batches that
    the index does not hold yet are checked and added; batches it holds are not read.
    Without an index a new one takes all.  A picture not accepted yet (null time) knows
    nothing.  Candidates without a batch_no are checked against the pictures alone;
    without batch_at no picture is older.  Rows without an id are left out.
    """
    spark = candidates.sparkSession
    scratch = Scratch(spark, "history")
    index = index or HistoryIndex(spark, scratch.path("index"), max_distance=max_distance)
    index.append(read_pictures(accepted.where("accepted_at is not null"), F.col("accepted_at").alias("at"), F.lit(None).cast("int").alias("seq")))
    new = candidates.where("candidate_id is not null")
    if index.last_seq is not None:
        new = new.where(F.col("batch_no").isNull() | (F.col("batch_no") > index.last_seq))
    rows = scratch.keep(read_pictures(new, "candidate_id", F.col("batch_at").alias("at"), F.col("batch_no").cast("int").alias("seq")), "candidates")
    return scratch.keep(index.process(rows, "candidate_id"), "known")
