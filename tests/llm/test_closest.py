"""Subset totals against the best of all sums."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import mixing, splits
from larder.llm.subset import closest_subset


def total(taken):
    return sum(s * k for s, k in taken.items())


def all_sums(counts):
    sums = {0}
    for s, c in counts.items():
        sums = {t + s * k for t in sums for k in range(c + 1)}
    return sums


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=5), st.integers(0, 900), st.booleans(), st.sampled_from([1, 7]))
def test_closest_of_all_sums(counts, target, below, unit):
    counts = {s * unit: c for s, c in counts.items()}
    got = closest_subset(counts, target, below_only=below)
    assert all(0 < k <= counts[s] for s, k in got.items())
    goal = min(target, total(counts))
    assert total(got) == min((t for t in all_sums(counts) if not below or t <= goal), key=lambda t: (abs(goal - t), t))


def test_few_sizes_and_large_sets():
    assert total(closest_subset({6: 1000, 10: 1000}, 1614)) == 1614
    assert total(closest_subset({5_000_000: 1, 3_000_000: 1, 2_000_000: 2}, 4_000_000)) == 4_000_000
    assert total(closest_subset({1_500_001: 1, 2_499_999: 1, 3_000_000: 1}, 4_000_000)) == 4_000_000
    got = closest_subset({6: 1000, 10: 1000}, 1614)
    assert all(90 <= k <= 110 for k in got.values())  # still like the whole


def test_operators_take_the_closest(spark):
    sizes = [6] * 100 + [10] * 100
    records = [(1000 * g + i, "d", "train", f"g{g}", "x/a.jpg", 1, None) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(records, "record_id bigint, dataset string, split string, source_group string, image_path string, variant_count int, sha256 string")
    whole = len(records)
    ratio = spark.createDataFrame([("train", 1 - 136 / whole), ("test", 136 / whole)], "split string, ratio double")
    got = {r["split"]: r["records"] for r in splits.split_shares(df, ratio).collect()}
    assert got == {"test": 136, "train": whole - 136}
    rows = spark.createDataFrame([(g, "a", n) for g, n in enumerate(sizes)], "item_id bigint, source_name string, n int")
    spec = spark.createDataFrame([("a", "r", 1, 1, 1)], "name string, root string, train_weight int, priority int, max_repeats int")
    assert mixing.mix_sources(rows, spec, "item_id", total=136, size=F.col("n")).agg(F.sum("size")).first()[0] == 136
