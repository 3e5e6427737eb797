"""Queries and maintenance of the artifact catalog (tables of artifacts, runs and jobs).

Artifacts: ``id, kind, path, namespace, created (seconds), size, ephemeral,
produced_by, derived_from``. Maintenance returns the new snapshot of a table; the
caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import lineages
from tessera.operators.prefix import running_sum
from tessera.runtime import cut


def list_artifacts(df: DataFrame, *, namespace: str | None = None, kind: str | None = None, since: int | None = None, hide_ephemeral: bool = True, newest: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filtered artifacts, by time and then id. Without a limit the order is left to the reader."""
    if namespace is not None:
        df = df.filter(F.col("namespace") == namespace)
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    if since is not None:
        df = df.filter(F.col("created") >= since)
    if hide_ephemeral:
        df = df.filter(~F.coalesce(F.col("ephemeral"), F.lit(False)))
    if limit is None and not offset:
        return df
    df = df.orderBy(F.desc("created") if newest else F.asc("created"), "id").offset(offset)
    return df if limit is None else df.limit(limit)


def page(df: DataFrame, *, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and ``next_offset`` (null on the last page): a surplus row tells whether more follow."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    more = F.max("_n").over(Window.partitionBy()) > limit
    return numbered.withColumn("next_offset", F.when(more, F.lit(offset + limit))).filter(F.col("_n") <= limit).drop("_n")


def page_after(df: DataFrame, *, created: int, id: str, limit: int) -> DataFrame:
    """The page of artifacts after a given one, newest first: deep pages need no deep sort."""
    later = (F.col("created") < created) | ((F.col("created") == created) & (F.col("id") > id))
    return df.filter(later).orderBy(F.desc("created"), "id").limit(limit)


def get_by_ids(df: DataFrame, ids: DataFrame, namespace: str) -> DataFrame:
    """One row per wanted id with ``found`` and the artifact's kind and path."""
    own = df.filter(F.col("namespace") == namespace).select("id", "kind", "path", F.lit(True).alias("found"))
    return ids.select("id").distinct().join(own, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def resolve_prefix(df: DataFrame, prefixes: DataFrame, least: int = 4) -> DataFrame:
    """``prefix, status, ids``: miss, unique, ambiguous (the first five ids) or short."""
    wanted = prefixes.select("prefix").distinct()
    keyed = df.select("id", F.substring("id", 1, least).alias("_head"))
    hits = wanted.filter(F.length("prefix") >= least).join(keyed, F.substring("prefix", 1, least) == F.col("_head")).filter(F.col("id").startswith(F.col("prefix")))
    # The five least ids: rank before collecting, so that a short prefix gathers no long list.
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("prefix").orderBy("id"))).filter("_n <= 5")
    found = first.groupBy("prefix").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    status = F.when(F.length("prefix") < least, "short").when(F.col("ids").isNull(), "miss").when(F.size("ids") == 1, "unique").otherwise("ambiguous")
    return wanted.join(found, "prefix", "left").select("prefix", status.alias("status"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def mark_ephemeral(df: DataFrame, ids: DataFrame, namespace: str) -> DataFrame:
    """New snapshot with ``ephemeral`` set for the given ids of a namespace, and ``touched``."""
    marks = ids.select(F.col("id").alias("_id")).distinct()
    joined = df.join(marks, F.col("id") == F.col("_id"), "left")
    touched = F.col("_id").isNotNull() & (F.col("namespace") == namespace)
    return joined.withColumn("touched", touched).withColumn("ephemeral", F.when(F.col("touched"), True).otherwise(F.col("ephemeral"))).drop("_id")


def purge_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, namespace, rows``: what a purge of each namespace would remove."""
    parts = [t.groupBy("namespace").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "namespace", "rows") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge_namespace(df: DataFrame, namespace: str) -> DataFrame:
    """The rows that survive. On a table partitioned by namespace this prunes to the other partitions."""
    return df.filter(~F.col("namespace").eqNullSafe(namespace))


def migrate_paths(df: DataFrame, old: str, new: str) -> DataFrame:
    """Paths equal to ``old`` or below it move to ``new``; sibling prefixes stay."""
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return df.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 2**31 - 1))).otherwise(F.col("path")))


def storage_by_kind(df: DataFrame, kinds: list[str]) -> DataFrame:
    """``kind, files, bytes`` of every kind, also those without artifacts."""
    known = df.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    sums = df.groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return known.join(sums, "kind", "left").select("kind", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def storage_by_age(df: DataFrame, now: int) -> DataFrame:
    """``bucket, files, bytes`` by age: under an hour, a day, a week, 30 days, older."""
    age = F.lit(now) - F.col("created")
    bucket = F.when(age < 3600, "<1h").when(age < 86400, "<24h").when(age < 7 * 86400, "<7d").when(age < 30 * 86400, "<30d").otherwise("older")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def storage_by_op(df: DataFrame, runs: DataFrame) -> DataFrame:
    """``op_name, files, bytes``; artifacts without a producer are uploads."""
    ops = runs.select(F.col("run_id").alias("produced_by"), "op_name")
    named = df.join(ops, "produced_by", "left")
    op = F.when(F.col("produced_by").isNull(), "(upload)").otherwise(F.coalesce("op_name", F.lit("(unknown)")))
    return named.groupBy(op.alias("op_name")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def eviction_plan(df: DataFrame, cap: int, protected: list[str]) -> DataFrame:
    """Artifacts to evict so that each namespace fits ``cap`` bytes: oldest first, protected kinds never."""
    total = df.groupBy("namespace").agg(F.sum("size").alias("total"))
    open_ = running_sum(df.filter(~F.col("kind").isin(protected)).select("namespace", "created", "id", "kind", "size"), ["namespace"], ["created", "id"], "size")
    return open_.join(total, "namespace").filter(F.col("total") - F.col("before") > cap).drop("before", "total")


def drop_referencing_runs(runs: DataFrame, evicted: DataFrame) -> DataFrame:
    """Runs that name no evicted id among inputs or outputs."""
    named = runs.select("run_id", F.explode(F.concat("input_ids", "output_ids")).alias("id"))
    return runs.join(named.join(evicted.select("id"), "id", "left_semi").select("run_id").distinct(), "run_id", "left_anti")


def parents_of(df: DataFrame) -> DataFrame:
    """``child, id, kind`` of every parent that exists."""
    edges = df.select(F.col("id").alias("child"), F.explode("derived_from").alias("id"))
    return edges.join(df.select("id", "kind"), "id").select("child", "id", "kind")


def dangling_edges(df: DataFrame) -> DataFrame:
    """``child, id`` of parents that do not exist."""
    edges = df.select(F.col("id").alias("child"), F.explode("derived_from").alias("id"))
    return edges.join(df.select("id"), "id", "left_anti").select("child", "id")


def lineage(df: DataFrame, roots: DataFrame, max_depth: int = 10, runs: DataFrame | None = None) -> DataFrame:
    """``root, id, depth, ordinals, truncated, run``: the upstream tree of every root.

    A node already on its own path is dropped, so cycles end; diamonds repeat.
    ``ordinals`` is the place in the tree, and ordering by it gives pre-order.
    ``truncated`` marks nodes at the depth limit that have parents left. ``run`` is the run
    that produced a node, as a struct of the columns of ``runs``, or null; without ``runs``
    it is the name of the run.

    What is moved are the distinct nodes above each root; a tree, which repeats them, is made
    where its nodes are. Roots with very many nodes above them advance level by level instead.
    """
    found = lineages.gather(df, roots, max_depth, runs)
    out = lineages.trees(found, max_depth)
    wide = lineages.trees_by_level(found, max_depth)
    return out if wide is None else out.unionByName(wide.drop("tree"))


def flat_lineage(df: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """``root, ids``: the ids of the upstream tree of every root in pre-order. No row of a tree leaves its task."""
    found = lineages.gather(df, roots, max_depth)
    out = lineages.flat_trees(found, max_depth)
    wide = lineages.trees_by_level(found, max_depth)
    return out if wide is None else out.unionByName(flatten_ids(wide.withColumn("root", F.struct("tree", "root"))).select("root.root", "ids"))


def flatten_ids(tree: DataFrame) -> DataFrame:
    """``root, ids``: the ids of each tree in pre-order."""
    return tree.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinals", "id"))), lambda x: x["id"]).alias("ids"))


def list_jobs(jobs: DataFrame, *, status: str | None = None, namespace: str | None = None, limit: int = 50) -> DataFrame:
    """Newest jobs first."""
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    if namespace is not None:
        jobs = jobs.filter(F.col("namespace") == namespace)
    return jobs.orderBy(F.desc("submitted"), "job_id").limit(limit)


def fail_orphans(jobs: DataFrame) -> DataFrame:
    """Running and pending jobs become failed with an error; ``orphaned`` marks them."""
    orphan = F.col("status").isin("running", "pending")
    return jobs.withColumn("orphaned", orphan).withColumn("error", F.when(orphan, "InterruptedRun").otherwise(F.col("error"))).withColumn("status", F.when(orphan, "failed").otherwise(F.col("status")))


def job_status(outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, status``: nodes below a failure fail with it. outcomes: node, ok; edges: node, needs.

    The set of failed nodes grows one level a round, by a join on the frontier only.
    """
    failed = cut(outcomes.filter(~F.col("ok")).select("node").distinct())
    frontier = failed
    while not frontier.isEmpty():
        below = edges.join(frontier.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct()
        frontier = cut(below.join(failed, "node", "left_anti"))
        failed = cut(failed.union(frontier))
    marked = outcomes.join(failed.withColumn("_failed", F.lit(True)), "node", "left")
    status = F.when(~F.col("ok"), "failed").when(F.col("_failed"), "dependency_failed").otherwise("completed")
    return marked.select("node", status.alias("status"))
