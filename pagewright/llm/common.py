"""What the corpus operators share: shared storage, bounded batches, salted joins and components.

Rules kept by everything here: lineage is cut by a Parquet table in the folder that the cluster
names in ``spark.checkpoint.dir``; hot keys are salted; no group of rows is gathered in one task
or on the driver.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.arrow import bounded  # noqa: F401  (for the operators)
from pagewright.sources.storage import new_path, release, remove, written  # noqa: F401

#: What separates words, as a Java and RE2 character class body and as the bytes that
#: ``bytes.split()`` splits on: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Lets Spark remove the shuffle files of a query as it ends, and not when its plan happens to be collected as garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again, which cuts its lineage.

    The files outlive any executor, and their sizes let the optimizer choose join strategies. They stay until ``discard`` or ``release``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._pagewright_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._pagewright_path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Equality join of a large ``left`` whose keys may be hot with a ``right`` that has one row a key.

    Every row of ``left`` goes to one of ``salts`` shares of its key, chosen by a hash of its columns
    ``by``; ``right`` is repeated for each share. No key brings more than 1/salts of its rows to
    one task, whatever its share of the table. Keys must not be null (such rows find nothing).
    It is a merge join: Spark knows the size of ``right`` before it is repeated, and might send ``salts`` times what it means to.
    """
    salt = "__pw_salt"
    left = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, salt], how).drop(salt)


def _forest(batches):
    """Each partition's edges, reduced to one star for each of their components (fewer than its nodes)."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def stars():
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
        if len(parent) > 500_000:  # bounded memory: pass on what is known and start anew
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; ``root`` is the smallest node it can reach.

    ``edges`` has two long columns. Every partition first reduces its edges to a spanning forest.
    Then large-star and small-star steps alternate until nothing changes: O(log n) rounds of
    aggregations and salted joins, each round written to the shared folder. Loops and repeated
    edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = materialize(pairs.mapInArrow(_forest, "a long, b long"), tag)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both.where("b > a"), low, ["a"], ["b"], how="inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), tag)
        before = now
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, ["a"], ["b"], how="inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), tag)
        discard(large, before)
        if (is_now := mark(now)) == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())


def word_count(text: Column) -> Column:
    """Words of a text by WORD_PATTERN; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
