"""Mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.llm.subset import closest_subset
from larder.operators.skew import spread_rank
from larder.session import Scratch


@dataclass
class SourcePlan:
    """What one source gives to a mixture.

    counts: rows by exact size.  All rows are used ``full`` times and ``extra`` of each
    size once more, ``reached`` units in all; ``short`` says that even all rows used
    max_repeats times stay below the target.
    """

    name: str
    weight: int
    max_repeats: int
    counts: dict[int, int] = field(default_factory=dict)
    target: Fraction = Fraction(0)
    full: int = 0
    extra: dict[int, int] = field(default_factory=dict)
    reached: int = 0
    short: bool = False

    @property
    def size(self) -> int:
        return sum(s * c for s, c in self.counts.items())

    def fit(self, budget: int, seed: int, *, below_only: bool) -> None:
        """Bounded knapsack over the counts: whole rounds first, then the subset of rows that fits the rest best."""
        own = self.size
        self.full = min(budget // own, self.max_repeats) if own else 0
        rest = budget - self.full * own
        self.extra = closest_subset(self.counts, rest, seed=seed, below_only=below_only) if own and self.full < self.max_repeats else {}
        self.reached = self.full * own + sum(s * k for s, k in self.extra.items())
        self.short = self.reached < self.target and self.reached == own * self.max_repeats


def sized(rows: DataFrame, ident: str, size: Column | None = None) -> DataFrame:
    """(id, name, size) of the rows with an id, a name and a size of at least 1 (1 where no size is given)."""
    unit = (size if size is not None else F.lit(1)).cast("bigint")
    named = rows.select(F.col(ident), V.read_name("source_name").alias("name"), unit.alias("size"))
    return named.where(F.col(ident).isNotNull() & F.col("name").isNotNull() & (F.col("size") > 0))


def read_spec(spec: DataFrame) -> list[SourcePlan]:
    """One entry for each source of the spec.

    A weight that is null or below 1 counts as 1, max_repeats likewise.  Where a name
    comes twice, the row with the better (lower) priority holds.
    """
    one = F.lit(1)
    keep = F.struct(F.coalesce("priority", F.lit(1 << 30)), F.coalesce("root", F.lit("")))
    named = spec.select(V.read_name("name").alias("name"), F.greatest(F.coalesce("train_weight", one), one).cast("bigint").alias("weight"), F.greatest(F.coalesce("max_repeats", one), one).cast("bigint").alias("max_repeats"), keep.alias("k"))
    named = named.where("name is not null").groupBy("name").agg(F.min_by(F.struct("weight", "max_repeats"), F.struct("k", -F.col("weight"))).alias("s")).select("name", "s.*")
    return [SourcePlan(r["name"], r["weight"], r["max_repeats"]) for r in sorted(named.collect())]  # a small table of sources, one row each


def plan_mix(named: DataFrame, spec: DataFrame, *, total: int | None = None, exact_shares: bool = False, whole_targets: bool = True, seed: int = 11) -> list[SourcePlan]:
    """The plan of each source of the spec; named: as by ``sized``, rows of other sources do not count.

    Rows are counted by source and exact size, which is all that reaches the driver.
    ``total`` is by default the size of all rows of listed sources, and a source's target
    is total * weight / sum of weights.  With ``exact_shares`` the total is cut to the
    greatest at which no source is short, so that all shares are met; sources without any
    row then stand outside the shares.  With ``whole_targets`` targets are rounded down,
    the units left over going to the largest fractions, and never exceeded; without, the
    plan comes closest to the target rounded up, which shows whether it can be reached.
    """
    plan = read_spec(spec)
    by = {p.name: p for p in plan}
    # exact sizes with their counts: bounded by the number of different sizes
    for r in named.groupBy("name", "size").agg(F.count("*").alias("n")).where(F.col("name").isin(*by)).collect():
        by[r["name"]].counts[r["size"]] = r["n"]
    sharing = [p for p in plan if p.size or not exact_shares]
    weights = sum(p.weight for p in sharing) or 1
    n = total if total is not None else sum(p.size for p in plan)
    if exact_shares:
        n = min([n, *(p.size * p.max_repeats * weights // p.weight for p in sharing)]) if sharing else 0
    for p in plan:
        p.target = Fraction(n * p.weight, weights) if p in sharing else Fraction(0)
    budget = {p.name: int(p.target) if whole_targets else ceil(p.target) for p in plan}
    if whole_targets:
        spare = n - sum(budget[p.name] for p in sharing)
        for p in sorted(sharing, key=lambda p: (int(p.target) - p.target, p.name))[:spare]:
            budget[p.name] += 1
    for k, p in enumerate(plan):
        p.fit(budget[p.name], seed + k, below_only=whole_targets)
        p.short = p.short or (exact_shares and not p.size)
    return plan


def short_sources(rows: DataFrame, spec: DataFrame, ident: str, *, total: int | None = None, size: Column | None = None) -> DataFrame:
    """(name): sources whose knapsack cannot reach their share, however often their rows may be repeated."""
    plan = plan_mix(sized(rows, ident, size), spec, total=total, whole_targets=False)
    return rows.sparkSession.createDataFrame([(p.name,) for p in plan if p.short], "name string")


def mix_sources(rows: DataFrame, spec: DataFrame, ident: str, *, total: int | None = None, size: Column | None = None, exact_shares: bool = False, seed: int = 11) -> DataFrame:
    """(id, name, size, copies): the rows of the mixture, copies >= 1.

    Each source gives all its rows as many whole times as fit its target, then the subset
    of rows whose sizes come closest to the rest without exceeding it: the bounded
    knapsack of ``plan_mix`` says how many of each size, and a seeded hash which.  A
    source below its target is repeated max_repeats times and stays short; its share is
    not given to others (see ``exact_shares``).  Rows without an id or with a size below 1
    are not drawn.
    """
    scratch = Scratch(rows.sparkSession, "mixing")
    named = scratch.keep(sized(rows, ident, size), "named")
    return _drawn(named, plan_mix(named, spec, total=total, exact_shares=exact_shares, seed=seed), ident, seed)


def _drawn(named: DataFrame, plan: list[SourcePlan], ident: str, seed: int) -> DataFrame:
    quota = [(p.name, s, p.full, p.extra.get(s, 0)) for p in plan for s in p.counts]
    q = named.sparkSession.createDataFrame(quota, "_name string, _size bigint, full bigint, extra bigint").where("full > 0 or extra > 0")
    ranked = spread_rank(named, ["name", "size"], F.xxhash64(F.lit(seed), F.col(ident)), ident)
    got = ranked.join(q, (F.col("name") == F.col("_name")) & (F.col("size") == F.col("_size")))
    copies = F.col("full") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return got.select(F.col(ident), "name", "size", copies.alias("copies")).where("copies > 0")


def mix_report(rows: DataFrame, spec: DataFrame, ident: str, *, total: int | None = None, size: Column | None = None, exact_shares: bool = False, seed: int = 11) -> DataFrame:
    """(name, target_share, rows_used, size_used, share, max_copies, short): the shares really reached, counted from the mixture drawn."""
    scratch = Scratch(rows.sparkSession, "mixing")
    named = scratch.keep(sized(rows, ident, size), "named")
    plan = plan_mix(named, spec, total=total, exact_shares=exact_shares, seed=seed)
    weights = sum(p.target for p in plan)
    table = named.sparkSession.createDataFrame([(p.name, float(p.target / weights) if weights else None, p.short) for p in plan], "name string, target_share double, short boolean")
    used = _drawn(named, plan, ident, seed).groupBy("name").agg(F.count("*").alias("rows_used"), F.sum(F.col("size") * F.col("copies")).alias("size_used"), F.max("copies").alias("max_copies"))
    used = scratch.keep(used, "used")
    joined = table.join(used, "name", "left").na.fill(0, ["rows_used", "size_used", "max_copies"])
    total_used = used.agg(F.sum("size_used").alias("_u"))
    return joined.join(F.broadcast(total_used)).select(  # one row
        "name", "target_share", "rows_used", "size_used", F.try_divide("size_used", "_u").alias("share"), "max_copies", "short")
