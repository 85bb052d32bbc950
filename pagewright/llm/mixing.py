"""Mixing sources to target weights, with DataFrame functions only.

Sizes are aggregated per source. Targets share out a budget by weight; no target exceeds
``max_repeats`` times its source, and what that cuts off is shared again by weight among the others
until none is above. A source's repetition rate is its target over its size, and each document
is emitted floor(rate) times plus one copy more if its hash, read as a number in [0, 1), is below
the rate's fraction. Rows that repeat doc_id, source and text have one hash; they are numbered, and row k takes the copy that lies between
k and k + 1 fractions, shifted by the hash: each is as likely as before, and n of them take n fractions, rounded up or down. Reruns agree as nothing else is random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, salted_join, word_count

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Rows that may be sent to all tasks, and bytes of their texts, about 10 MB.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
#: Parts that the rows of a repeated document are numbered in.
SHARES = 64


def row_key(seed: str = SEED) -> Column:
    """A 128-bit digest of doc_id, source and text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), text)
    return F.md5(key.cast("binary"))


def draw(key: Column) -> Column:
    """A number in [0, 1): the first 32 bits of a digest."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _small(table: DataFrame, text: str) -> bool:
    """Whether a table may be sent to all tasks, by its rows and the bytes of its text column."""
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def numbered(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Adds ``__pw_k`` to ``rows`` with ``__pw_key``: 0, 1, ... among the rows of a key of ``repeats`` (__pw_key), 0 for all others.

    A key's rows are dealt to SHARES parts and numbered within each; the parts' counts, at most SHARES a key, say where each begins. So no key is one task.
    """
    known = repeats.withColumn("__pw_again", F.lit(True))
    marked = rows.join(F.broadcast(known), "__pw_key", "left") if _small(repeats, "__pw_key") else salted_join(rows, known, ["__pw_key"], ["__pw_key"])
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARES)).cast("int")
    again = materialize(marked.where("__pw_again").drop("__pw_again").withColumn("__pw_share", share), "mix-repeated")
    keys = ["__pw_key", "__pw_share"]
    counts = again.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__pw_key").orderBy("__pw_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select(*keys, before.alias("__pw_before"))
    within = again.withColumn("__pw_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)
    told = within.join(begins.hint("merge"), keys).withColumn("__pw_k", (F.col("__pw_before") + F.col("__pw_place")).cast("long"))
    once = marked.where("__pw_again is null").withColumn("__pw_k", F.lit(0).cast("long"))
    columns = [*rows.columns, "__pw_k"]
    return once.select(*columns).union(told.select(*columns))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(__pw_null, __pw_source, source_size, target) of ``sizes`` (__pw_null, __pw_source, source_size), one row a source.

    Sources take the weights in turn, in code point order, null last. In the order of
    source size over weight, sources below the common level are full at ``max_repeats`` times their size;
    the level is what is left of the budget over the weight that is left, at the first source where
    it no longer exceeds that source's own limit. The rows are sources, not documents, so
    the ordered windows hold one row for each.
    """
    order = Window.orderBy("__pw_null", "__pw_source")
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("bound", F.col("cap") / F.col("weight"))
    before = Window.orderBy("bound", "__pw_null", "__pw_source").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("at", F.col("left") / F.col("weight_left"))
    level = F.min(F.when(F.col("at") <= F.col("bound"), F.struct("bound", "at"))).over(every)["at"]
    df = df.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))))
    return df.select("__pw_null", "__pw_source", "source_size", "target")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: str = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document with size, source_size, target, rate and copies.

    A null text has size 0, a null source is a source of its own; a source whose sizes are all 0
    has target 0 and its documents are not copied. Rows draw by doc_id, source and text, so documents
    without a doc_id draw apart; rows that repeat all three are numbered and together take their share. Texts of any length are
    read whole, in the JVM, a row at a time. An empty table gives no rows. Targets, and the keys of repeated rows, are sent to the documents if their rows and bytes are few;
    beyond that documents meet them in a salted join. A source, or the copies of a row, may be any share of the rows.
    """
    key, source = row_key(seed), F.coalesce("source", F.lit(""))
    rows = docs.select(*[F.col(c) for c in keep], F.col("source").isNull().alias("__pw_null"), source.alias("__pw_source"), word_count(F.col("text")).alias("size"), key.alias("__pw_key"))
    totals = docs.select(F.col("source").isNull().alias("__pw_null"), source.alias("__pw_source"), word_count(F.col("text")).alias("size"))
    totals = totals.groupBy("__pw_null", "__pw_source").agg(F.sum("size").alias("source_size"))
    keys, goals = ["__pw_null", "__pw_source"], materialize(targets(totals, weights, share, max_repeats), "mix-targets")
    repeats = materialize(docs.select(key.alias("__pw_key")).groupBy("__pw_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__pw_key"), "mix-repeats")
    sized = rows.withColumn("__pw_k", F.lit(0).cast("long")) if repeats.isEmpty() else numbered(rows, repeats)
    out = sized.join(F.broadcast(goals), keys, "left") if _small(goals, "__pw_source") else salted_join(sized, goals, keys, ["__pw_key"], salts=64)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("rate", rate).withColumn("__pw_part", F.col("rate") - F.floor("rate")).withColumn("__pw_draw", draw(F.col("__pw_key")))
    upto = lambda k: F.ceil(k * F.col("__pw_part") - F.col("__pw_draw"))
    copies = F.floor("rate") + upto(F.col("__pw_k") + 1) - upto(F.col("__pw_k"))
    return out.withColumn("copies", copies.cast("long")).select(*keep, "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as many times as its plan says.

    The plan is made with the row packed into one struct, so columns of ``docs`` may have any names.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__pw_row"))
    chosen = plan(packed, keep=("__pw_row",), **options).where("copies > 0")
    return chosen.select("__pw_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__pw_copy")).select("__pw_row.*")
