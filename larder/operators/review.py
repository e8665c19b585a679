"""Logs of a review tool, replayed: done marks, undo, locations, pages to browse; ledgers and ratings as event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def done_items(log: DataFrame, item: str, note: str, seq: list[str], *, undo: str = "undo_done") -> DataFrame:
    """(item, note): items whose last event is not the undo; blank items are skipped."""
    rows = log.where(F.col(item).rlike(r"\S"))
    return rows.groupBy(item).agg(F.max_by(note, F.struct(*seq)).alias(note)).where(F.coalesce(F.col(note) != undo, F.lit(True)))


def undo_target(log: DataFrame, item: str, action: str, done: DataFrame, seq: list[str]) -> DataFrame:
    """The newest action that can still be undone: a mark whose item is still done, or a move; one row at most, found by an aggregation."""
    rows = log.where(F.col(action) != "undo").join(done.select(item).withColumn("_done", F.lit(True)), item, "left")
    rows = rows.where((F.col(action) != "mark_done") | F.col("_done"))
    top = rows.agg(F.max(F.struct(*seq, F.col(action).alias("_a"), F.col(item).alias("_i"))).alias("m")).where("m is not null")
    return top.select(*[F.col(f"m.{s}").alias(s) for s in seq], F.col("m._a").alias(action), F.col("m._i").alias(item))


def latest_rows(events: DataFrame, key: str, seq: list[str], values: list[str]) -> DataFrame:
    """(key, values, first_<seq>): the last values of each key and when it first came; an upsert read back."""
    first = F.min(F.struct(*seq))
    last = F.max(F.struct(*seq, *values))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("l"), first.alias("f")).select(key, *[F.col(f"l.{v}").alias(v) for v in values], F.col(f"f.{seq[0]}").alias(f"first_{seq[0]}"))


def ledger_balance(entries: DataFrame, account: str, delta: str, idempotency_key: str, seq: list[str]) -> DataFrame:
    """(account, entries, balance): each idempotency key is applied once, with its first entry; null deltas count as 0."""
    once = entries.groupBy(idempotency_key).agg(F.min(F.struct(*seq, account, delta)).alias("m")).select(f"m.{account}", f"m.{delta}")
    return once.groupBy(account).agg(F.count("*").alias("entries"), F.coalesce(F.sum(delta), F.lit(0)).alias("balance"))


def rating_summary(ratings: DataFrame, item: str, label: str, stars: str, seq: list[str]) -> DataFrame:
    """(label, n, average): over the last rating of each item, rounded half up to two digits."""
    last = latest_rows(ratings, item, seq, [label, stars])
    return last.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(stars), 2).alias("average"))


def browse_page(items: DataFrame, done: DataFrame, item: str, order: str, *, page: int, size: int, where: Column | None = None) -> DataFrame:
    """One page of the items not done, in order; the limit is the feature (top-k of the sort)."""
    rows = items if where is None else items.where(where)
    return rows.join(done.select(item), item, "left_anti").orderBy(order, item).offset(page * size).limit(size)


def browse_counts(items: DataFrame, done: DataFrame, item: str, group: str) -> DataFrame:
    """(group, total, hidden_done, shown)."""
    marked = items.join(done.select(F.col(item)).withColumn("_done", F.lit(1)), item, "left")
    n = marked.groupBy(group).agg(F.count("*").alias("total"), F.count("_done").alias("hidden_done"))
    return n.select(group, "total", "hidden_done", (F.col("total") - F.col("hidden_done")).alias("shown"))


def phone_keys(raw: Column) -> Column:
    """A Vietnamese phone number as 10 digits from 0: other characters dropped, 84 and nine digits read as 0...; null if it is none."""
    d = F.regexp_replace(raw, "[^0-9]", "")
    d = F.when((F.length(d) == 11) & d.startswith("84"), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)
    return F.when(d.rlike("^0[0-9]{9}$"), d)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest in hex, from the two padded SHA-256 passes; the key does not reach the data."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def undo_target_of_files(log: DataFrame, item: str, action: str, source: str, output: str, done: DataFrame, files: DataFrame, seq: list[str]) -> DataFrame:
    """As ``undo_target``, but a move can be undone only while its file lies at the output and none at the source.

    files: path.  Paths that are null lie nowhere.
    """
    there = files.select(F.col("path").alias("_path")).where("_path is not null").distinct()
    rows = log.where(F.col(action) != "undo").join(done.select(item).distinct().withColumn("_done", F.lit(True)), item, "left")
    rows = rows.join(there.withColumn("_at_output", F.lit(True)), F.col(output) == F.col("_path"), "left").drop("_path")
    rows = rows.join(there.withColumn("_at_source", F.lit(True)), F.col(source) == F.col("_path"), "left")
    open_ = F.when(F.col(action) == "mark_done", F.col("_done")).otherwise(F.col("_at_output") & F.col("_at_source").isNull())
    top = rows.where(open_).agg(F.max(F.struct(*seq, F.col(action).alias("_a"), F.col(item).alias("_i"))).alias("m")).where("m is not null")
    return top.select(*[F.col(f"m.{s}").alias(s) for s in seq], F.col("m._a").alias(action), F.col("m._i").alias(item))


def plan_moves(requests: DataFrame, files: DataFrame, item: str, source: str, target: str) -> DataFrame:
    """(item, source, target, status): what each move of a batch would do; one that fails does not stop the others.

    missing: no file at the source; exists: the target is taken; repeated: an item asked
    for more than once, beyond its least target; taken: a target that an earlier item
    (least) of the batch goes to; else moved.
    """
    there = files.select(F.col("path").alias("_path")).where("_path is not null").distinct()
    r = requests.select(item, source, target)
    r = r.join(there.withColumn("_s", F.lit(True)), F.col(source) == F.col("_path"), "left").drop("_path")
    r = r.join(there.withColumn("_t", F.lit(True)), F.col(target) == F.col("_path"), "left").drop("_path")
    able = r.where("_s and _t is null")
    first = able.groupBy(F.col(item).alias("_item")).agg(F.min(target).alias("_first"))
    lead = able.join(first, (F.col(item) == F.col("_item")) & (F.col(target) == F.col("_first"))).groupBy(F.col(target).alias("_target")).agg(F.min(item).alias("_lead"))
    r = r.join(first, F.col(item) == F.col("_item"), "left").join(lead, F.col(target) == F.col("_target"), "left")
    status = F.when(F.col("_s").isNull(), "missing").when(F.col("_t"), "exists").when(F.col(target) != F.col("_first"), "repeated").when(F.col(item) != F.col("_lead"), "taken").otherwise("moved")
    return r.select(item, source, target, status.alias("status"))
