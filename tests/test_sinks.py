"""Sinks of the catalog."""

import pytest

from tessera import schemas
from tessera.sources.sinks import drop_namespace, replace_partitions, upsert_artifacts, write_sidecars

SCHEMA = "id string, namespace string, kind string, path string"


def test_catalog_upserts_once(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = spark.createDataFrame([("a", "n", "document", "/a"), ("b", "n", "image", "/b"), ("a", "n", "document", "/a")], SCHEMA)
    assert upsert_artifacts(rows, path) == 2 and upsert_artifacts(rows, path) == 0
    with pytest.raises(ValueError, match="held by another"):
        upsert_artifacts(spark.createDataFrame([("a", "m", "document", "/a"), ("c", "m", "document", "/c")], SCHEMA), path)
    assert upsert_artifacts(spark.createDataFrame([("c", "m", "document", "/c")], SCHEMA), path) == 1
    moved = spark.createDataFrame([("b", "n", "image", "/moved/b")], SCHEMA)
    replace_partitions(moved, path)
    assert {r.id: r.path for r in spark.read.parquet(path).collect()} == {"a": "/a", "b": "/moved/b", "c": "/c"}
    assert drop_namespace(spark, path, "n") == 2 and [r.id for r in spark.read.parquet(path).collect()] == ["c"]


def test_sidecars_and_schemas(spark, tmp_path):
    write_sidecars(spark.createDataFrame([("a", "n", "document", None)], SCHEMA), str(tmp_path / "side"))
    assert spark.read.json(str(tmp_path / "side")).columns == ["id", "path", "namespace", "kind"]
    for name in schemas.TABLES:
        assert spark.createDataFrame([], schemas.schema(name)).count() == 0
