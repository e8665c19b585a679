"""Variants of the smallest test tables: empty, with rows of nulls, with columns of clashing names."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
CLASHING = ["node", "root", "rank", "n", "a", "b", "k", "v", "id", "label", "sha", "ph", "unit", "name", "size", "split_", "kept", "sub", "cell", "total", "either", "_n", "tokens", "at", "url"]


def write_variant(to: str, change) -> str:
    os.makedirs(to, exist_ok=True)
    for f in os.listdir(SMALL):
        pq.write_table(change(f.split(".")[0], pq.read_table(f"{SMALL}/{f}")), f"{to}/{f}")
    return to


def emptied(_, t):
    return t.slice(0, 0)


def only_nulls(_, t):
    return pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([f.with_nullable(True) for f in t.schema]))


def with_nulls(_, t):
    flat = pa.schema([f.with_nullable(True) for f in t.schema])
    return pa.concat_tables([t.cast(flat), pa.table({f.name: pa.nulls(2, f.type) for f in flat}, schema=flat)])


def with_clashes(_, t):
    for c in CLASHING:
        if c not in t.column_names:
            t = t.append_column(c, pa.array(["x"] * len(t)))
    return t


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols]) for r in df.collect())
