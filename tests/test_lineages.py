"""Upstream trees against plain Python, at several bounds."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, lineages


def _layers(spark, n, wide):
    """Nodes in layers, each with all of the layer above as parents, and a cycle and a missing parent."""
    rows = [(f"{k}.{i}", [f"{k + 1}.{j}" for j in range(wide)] if k < n else (["0.0", "gone"] if i == 0 else [])) for k in range(n + 1) for i in range(wide)]
    return spark.createDataFrame(rows, "id string, derived_from array<string>"), dict(rows)


@pytest.mark.parametrize(("most_nodes", "at_once"), [(200_000, 1 << 16), (200_000, 7), (5, 1 << 16), (1, 3)])
def test_lineage_is_whole_at_any_bound(spark, monkeypatch, most_nodes, at_once):
    monkeypatch.setattr(lineages, "MOST_NODES", most_nodes)
    monkeypatch.setattr(lineages, "ROWS_AT_ONCE", at_once)
    df, parents = _layers(spark, 3, 3)
    roots = [("0.0",), ("0.0",), ("2.1",), ("3.2",)]

    def tree(x, place, path):
        yield x, place, len(place) == 4 and bool(parents[x])
        for i, p in enumerate(parents[x]) if len(place) < 4 else ():
            if p in parents and p not in path:
                yield from tree(p, (*place, i), (*path, p))

    want = sorted((r, *x) for (r,) in roots for x in tree(r, (), (r,)))
    table = spark.createDataFrame(roots, "id string")
    got = catalog.lineage(df, table, max_depth=4).collect()
    assert sorted((r.root, r.id, tuple(r.ordinals), r.truncated) for r in got) == want and all(r.depth == len(r.ordinals) for r in got)
    flat = sorted((r.root, tuple(r.ids)) for r in catalog.flat_lineage(df, table, max_depth=4).collect())
    assert flat == sorted((r, tuple(x for x, _, _ in tree(r, (), (r,)))) for (r,) in roots)


def test_lineage_writes_no_tree_to_the_shared_folder(spark):
    # 40 nodes above a root, 88,573 rows in its tree.
    df, _ = _layers(spark, 10, 3)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    roots = spark.createDataFrame([("0.0",)], "id string")
    assert catalog.lineage(df, roots).count() == sum(3**k for k in range(11))
    assert catalog.flat_lineage(df, roots).select(F.size("ids")).first()[0] == sum(3**k for k in range(11))
    assert sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) - before < 1_000_000
