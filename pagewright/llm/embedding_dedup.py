"""Embedding near-duplicates by sorted projection passes.

A vector's signature in a pass is the signs of its products with that pass's random directions,
concatenated into one number. Every pass orders all vectors by signature, so vectors at a small angle tend to
share a long prefix and to lie close together. Each vector is compared with the ``WINDOW`` that follow
it; pairs of cosine >= ``least`` are links, and links of all passes are united into components.
The first log2(vectors / window) bits of a signature, rounded up, name a run. Runs of evenly spread vectors
fit a window; a run that holds more (a group of similar vectors crowds it) is compared whole, in blocks of at
most ``BLOCK`` by ``BLOCK`` vectors. So every pair that shares a run in any pass is compared, however
vectors are spread, and the number of passes follows the number of vectors so that a pair right at the threshold, which
shares each bit with probability 1 - angle / pi, shares a run with probability ``RECALL``.

Equal vectors are collapsed before the passes. A window is bounded but a group is not: the links of
each vector are therefore counted afterwards among all members of its component, without emitting pairs.
Members within half the threshold's angle of the component's mean direction (its core) are all linked to each
other, by the triangle inequality, and only their number counts; the others are compared with every
member, in blocks of at most ``BLOCK`` by ``BLOCK`` vectors.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded, connected_components, discard, materialize, salted_join

LEAST = 0.9
WINDOW = 256
#: Windows of rows that a task has on average, so that none has less than one although ranges are sampled.
PART_WINDOWS = 8
BITS = 40
RECALL = 0.98
BLOCK = 1024
#: Vectors that say where ranges are cut, for each range.
SAMPLE = 32
#: Passes that are sorted at a time.
PASSES_AT_ONCE = 2
SEED = 7
_MARGIN = 1e-9


def run_bits(vectors: int, window: int = WINDOW) -> int:
    """Leading bits of a signature that name a run: of evenly spread vectors, no more than a window share them."""
    return min(BITS, max(0, math.ceil(math.log2(max(vectors, 1) / window))))


def passes_for(vectors: int, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes in which a pair at the threshold shares a run with probability ``recall``."""
    once = (1 - math.acos(least) / math.pi) ** run_bits(vectors, window)
    return 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log1p(-once))


def _matrix(column, dtype=float):
    """The vectors of an Arrow list column, all of one dimension, as rows of unit length in double precision."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # no overflow in squares
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def valid(vector: Column) -> Column:
    """True for a vector of finite components that aren't all 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _runs(*columns):
    """(start, end) of the runs in which all arrays stay the same."""
    import numpy as np

    n = len(columns[0])
    cuts = [0, *(np.nonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))[0] + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _place(dim: int, turn: int, sign, cid, cuts: list[tuple]):
    """For each (dim, pass, sign, cid) of one dim and pass how many of the sorted ``cuts`` are not above it: the range that it belongs to."""
    import numpy as np

    before = sum(c[:2] < (dim, turn) for c in cuts)
    own = [c for c in cuts if c[:2] == (dim, turn)]
    signs = np.array([c[2] for c in own], np.int64)
    place = np.searchsorted(signs, sign, side="left")
    for value in np.unique(signs[np.isin(signs, sign)]):  # cuts inside a run of one signature
        here = np.flatnonzero(sign == value)
        place[here] += np.searchsorted(np.array([c[3] for c in own if c[2] == value], np.int64), cid[here], side="right")
    return place + before


def signatures(classes: DataFrame, passes: range, bits: int = BITS, cuts: list[tuple] | None = None) -> DataFrame:
    """(dim, pass, sign, cid, vector, place): each vector of ``classes`` (cid, vector) once for each of ``passes``, with the number of the range between ``cuts`` that it belongs to."""
    import pyarrow as pa

    names = ["dim", "pass", "sign", "cid", "vector", "place"]

    def run(batches):
        import numpy as np

        planes = {}
        weight = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
        for batch in bounded(batches, 10_000):
            sizes = batch.column(2).to_numpy()
            for dim in np.unique(sizes):
                dim = int(dim)
                own = batch.take(pa.array(np.nonzero(sizes == dim)[0]))
                unit, cid = _matrix(own.column(1)), own.column(0).to_numpy()
                for k in passes:
                    if (dim, k) not in planes:
                        planes[dim, k] = np.random.default_rng([SEED, dim, k]).standard_normal((dim, bits))
                    sign = ((unit @ planes[dim, k]) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(unit), pa.int32()), pa.array([k] * len(unit), pa.int32()), pa.array(sign), own.column(0), own.column(1), pa.array(_place(dim, k, sign, cid, cuts or []), pa.int32())], names)

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("cid", "vector", F.size("vector").alias("dim")).mapInArrow(run, f"dim int, pass int, sign long, cid long, vector {kind}, place int")


def cut_points(classes: DataFrame, count: int, passes: range, parts: int) -> list[tuple]:
    """Sorted (dim, pass, sign, cid) that cut the vectors of all ``passes`` into ``parts`` ranges of about the same size, from the signatures of about SAMPLE vectors for each range; the driver holds no more than these."""
    stride = max(1, count // (SAMPLE * parts))
    some = signatures(classes.where(F.pmod(F.xxhash64("cid"), F.lit(stride)) == 0), passes).select("dim", "pass", "sign", "cid")
    rows = sorted(map(tuple, some.collect()))
    return sorted({rows[len(rows) * k // parts] for k in range(1, parts)}) if rows else []


class _Union:
    """A spanning forest of the links seen; what it yields has fewer rows than vectors."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(ids, unit, least: float, window: int, joined: _Union):
    """New links (a, b) of rows no more than ``window`` apart."""
    import numpy as np

    step = 256
    for at in range(0, len(ids), step):
        cosine = unit[at : at + step] @ unit[at : at + step + window].T
        i, j = np.nonzero(cosine >= least)
        near = (j > i) & (j - i <= window)
        for a, b in zip(ids[at + i[near]].tolist(), ids[at + j[near]].tolist()):
            if joined.join(a, b):
                yield a, b


def window_links(classes: DataFrame, count: int, passes: range, least: float = LEAST, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(links, crowded) of ``classes`` (cid, vector), ``count`` rows, in ``passes``: links (a, b) are verified and connect what the windows of all passes connect, crowded (dim, pass, run, rows) are runs of more than ``window`` vectors.

    Vectors are dealt to ranges, cut by a sample, and sorted by dimension, pass and signature; their signatures are computed in the same pass over them that deals them, and only there. A task slides its window over its
    sorted rows, in parts with an overlap of one window, and counts the rows of each run; its first and last rows are set aside and
    meet those of the neighbouring tasks afterwards, two windows at a time. Tasks are so few that each has
    several windows of rows, as only neighbours meet.
    """
    import pyarrow as pa

    spark = classes.sparkSession
    kind = classes.schema["vector"].dataType.simpleString()
    order, bits = ["dim", "pass", "sign", "cid"], run_bits(count, window)
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(passes) // (PART_WINDOWS * window)))
    cuts = cut_points(classes, count, passes, tasks) if tasks > 1 else []
    ranged = signatures(classes, passes, cuts=cuts).repartitionById(len(cuts) + 1, F.col("place")).sortWithinPartitions(*order)
    names = ["a", "b", "border", "dim", "pass", "sign", "cid", "vector"]
    schema = f"a long, b long, border long, dim int, pass int, sign long, cid long, vector {kind}"

    def links_of(table, joined, window_of):
        import numpy as np

        ids = table.column("cid").to_numpy(zero_copy_only=False)
        dim, turn = (table.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "pass"))
        for a, b in _runs(dim, turn):
            unit = _matrix(table.column("vector").slice(a, b - a).combine_chunks())
            yield from _compare(ids[a:b], unit, least, window_of, joined)

    def edges(found, vector_type):
        n = len(found)
        nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), vector_type)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), *nothing], names)

    def borders(rows, border):
        n = rows.num_rows
        fixed = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int64())]
        rows = rows.combine_chunks()
        return pa.RecordBatch.from_arrays([*fixed, *[rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in order], rows.column("vector").combine_chunks()], names)

    def counted(rows, vector_type):
        n = len(rows)
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *columns, pa.nulls(n, vector_type)], names)

    def slide(batches):
        held, head, joined, part, run = None, None, _Union(), None, None
        for batch in bounded(batches, 10_000):
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            table = pa.Table.from_batches([batch.select(["dim", "pass", "sign", "cid", "vector"])])
            keys = [batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy() >> (BITS - bits)]
            own = [[*(int(k[a]) for k in keys), b - a] for a, b in _runs(*keys)]
            if run and run[:3] == own[0][:3]:
                own[0][3] += run[3]
            elif run:
                own.insert(0, run)
            run = own.pop()
            if own:
                yield counted(own, table.schema.field("vector").type)
            if head is None or head.num_rows < window:
                more = table.slice(0, window - (head.num_rows if head is not None else 0))
                head = more if head is None else pa.concat_tables([head, more])
            table = table if held is None else pa.concat_tables([held, table])
            found = list(links_of(table, joined, window))
            if found:
                yield edges(found, table.schema.field("vector").type)
            held = table.slice(max(0, table.num_rows - window))
            if len(joined.up) > 500_000:
                joined = _Union()
        if held is not None:
            yield counted([run], held.schema.field("vector").type)
            yield borders(head, part)  # met by the end of the task before
            yield borders(held, part + 1)

    parts = materialize(ranged.select(F.spark_partition_id().cast("long").alias("part"), *order, "vector").mapInArrow(slide, schema), "vector-links")

    def meet(table):
        table = table.sort_by([(c, "ascending") for c in order])
        found = list(links_of(table, _Union(), window))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    between = parts.where("border is not null").select("border", *order, "vector").groupBy("border").applyInArrow(meet, "a long, b long")
    links = materialize(parts.where("a is not null").select("a", "b").union(between), "vector-pass")
    runs = parts.where("a is null and border is null").groupBy("dim", "pass", F.col("sign").alias("run")).agg(F.sum("cid").alias("rows"))
    crowded = materialize(runs.where(F.col("rows") > window), "vector-runs")
    discard(parts)
    return links, crowded


def _forest_of(linked):
    """Places (i, j) of a spanning forest of a bipartite graph, from its boolean matrix; each row is expanded once."""
    import numpy as np

    rows, columns = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        frontier = np.nonzero(rows)[0][:1]
        while len(frontier):
            rows[frontier] = False
            near = linked[frontier] & columns
            new = np.nonzero(near.any(axis=0))[0]
            yield from zip(frontier[near[:, new].argmax(axis=0)].tolist(), new.tolist())
            columns[new] = False
            more = linked[:, new] & rows[:, None]
            frontier = np.nonzero(more.any(axis=1))[0]
            yield from zip(frontier.tolist(), new[more[frontier].argmax(axis=1)].tolist() if len(frontier) else [])


def run_links(classes: DataFrame, passes: range, crowded: DataFrame, bits: int, least: float = LEAST) -> DataFrame | None:
    """(a, b): verified links that connect what links within the runs of ``crowded`` (dim, pass, run, rows) connect; None if there are no such runs."""
    import pyarrow as pa

    keys = ["dim", "pass", "run"]
    if crowded.isEmpty():
        return None
    wanted = crowded.select(*keys, F.ceil(F.col("rows") / BLOCK).cast("int").alias("m"))
    signed = signatures(classes, passes).drop("place").withColumn("run", F.shiftright("sign", BITS - bits))
    met = salted_join(signed, wanted, keys, ["cid"], how="inner").withColumn("own", F.pmod(F.xxhash64("cid", "pass"), F.col("m")).cast("int"))
    dealt = met.select(*keys, "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"), "cid", "vector")
    dealt = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "vector")

    def compare(table):
        import numpy as np

        ids, own = (table.column(c).to_numpy() for c in ("cid", "own"))
        unit = _matrix(table.column("vector").combine_chunks())
        left = own == table.column("i")[0].as_py()
        right = own == table.column("j")[0].as_py()
        linked = (unit[left] @ unit[right].T >= least) & (ids[left][:, None] != ids[right][None])
        found = list(_forest_of(linked))
        return pa.table({"a": pa.array(ids[left][[x[0] for x in found]] if found else [], pa.int64()), "b": pa.array(ids[right][[x[1] for x in found]] if found else [], pa.int64())})

    return materialize(dealt.groupBy(*keys, "i", "j").applyInArrow(compare, "a long, b long"), "vector-run-links")


def pass_links(classes: DataFrame, count: int, passes: int, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """(a, b): the links of all passes. PASSES_AT_ONCE of them are sorted at a time and their shuffles removed before the next, so that disk holds the vectors so many times and not once for each pass."""
    found = []
    for at in range(0, passes, PASSES_AT_ONCE):
        now = range(at, min(passes, at + PASSES_AT_ONCE))
        links, crowded = window_links(classes.select("cid", "vector"), count, now, least, window)
        found += [links, *filter(None, [run_links(classes.select("cid", "vector"), now, crowded, run_bits(count, window), least)])]
        discard(crowded)
    links = materialize(reduce(DataFrame.union, found), "vector-all-links")
    discard(*found)
    return links


def mean_directions(members: DataFrame) -> DataFrame:
    """(root, mean array<double>): the sum of the members' unit vectors, added up in parts."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = members.select("root", F.posexplode("vector").alias("k", "x"), length.alias("length")).groupBy("root", "k").agg(F.sum(F.col("x").cast("double") / F.col("length")).alias("x"))
    return parts.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))


def link_counts(members: DataFrame, least: float = LEAST) -> DataFrame:
    """(cid, others): for ``members`` (root, cid, n, vector), how many rows of other classes of its component each class links with.

    A class stands for n equal vectors. Core members link with the whole core. Each of the others meets
    every member once, in the block pair of both, and only sums leave a block pair.
    """
    import pyarrow as pa

    spark = members.sparkSession
    half = math.cos(math.acos(least) / 2) + _MARGIN
    means = materialize(mean_directions(members), "vector-means")
    met = salted_join(members, means, ["root"], ["cid"], how="inner")
    dot = F.aggregate(F.zip_with("vector", "mean", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    core = F.coalesce(dot >= half * norm("vector") * norm("mean"), F.lit(False)) & (norm("mean") > 0)
    placed = materialize(met.select("root", "cid", "n", "vector", core.alias("core")), "vector-core")
    sizes = placed.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_rows"), F.count(F.lit(1)).alias("members"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("rim"))
    sizes = materialize(sizes.withColumn("m", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("r", F.ceil(F.col("rim") / BLOCK).cast("int")), "vector-sizes")
    of_core = salted_join(placed.where("core").select("root", "cid", "n"), sizes.select("root", "core_rows"), ["root"], ["cid"], how="inner").select("cid", (F.col("core_rows") - F.col("n")).alias("others"))
    rimmed = salted_join(placed, sizes.where("rim > 0").select("root", "m", "r"), ["root"], ["cid"], how="inner")
    own = F.pmod(F.xxhash64("cid"), F.col("m")).cast("int")
    left = rimmed.where("not core").select("root", F.pmod(F.xxhash64("cid"), F.col("r")).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("mb"), "cid", "n", "vector")
    right = rimmed.select("root", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("rb"), own.alias("mb"), "cid", "n", "vector", "core")

    def block(rim, all_):
        import numpy as np

        if not rim.num_rows or not all_.num_rows:
            return pa.table({"cid": pa.array([], pa.int64()), "others": pa.array([], pa.int64())})
        a, b = _matrix(rim.column("r_vector").combine_chunks()), _matrix(all_.column("vector").combine_chunks())
        x, y = rim.column("r_cid").to_numpy(), all_.column("cid").to_numpy()
        nx, ny = rim.column("r_n").to_numpy(), all_.column("n").to_numpy()
        core = all_.column("core").to_numpy(zero_copy_only=False)
        linked = (a @ b.T >= least) & (x[:, None] != y[None])
        return pa.table({"cid": pa.array(np.concatenate([x, y[core]])), "others": pa.array(np.concatenate([linked @ ny, nx @ linked[:, core]]).astype(np.int64))})

    keys = ["root", "rb", "mb"]
    left = left.select(*[F.col(c).alias(f"r_{c}") for c in left.columns])
    of_rim = left.groupBy(*[f"r_{c}" for c in keys]).cogroup(right.groupBy(*keys)).applyInArrow(block, "cid long, others long")
    return of_core.union(of_rim).groupBy("cid").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, least: float = LEAST, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding; other columns are ignored).

    ``n_links`` counts the other rows of cosine >= ``least`` in the row's component, ``component_id`` is the
    smallest vec_id that links reach, ``kept`` says whether that is the row's own. Vectors that are
    null, empty or zero, or have null or non-finite components, link with nothing; vectors of
    different dimensions neither. Repeated rows link with each other. Null vec_ids take part but name
    a component only if it has no other. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).withColumn("valid", valid(F.col("vector")))
    grouped = rows.where("valid").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "vector", "first", "n"), "vector-classes")
    count = classes.count()
    passes = passes or passes_for(count, least, window)
    links = pass_links(classes, count, passes, least, window)
    roots = materialize(connected_components(links, "vector-components"), "vector-roots")
    discard(links)
    members = materialize(classes.join(roots, classes.cid == roots.node).select("root", "cid", "n", "first", "vector"), "vector-members")
    lowest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(members.select("root", "cid", "n", "vector"), lowest, ["root"], ["cid"], how="inner")
    linked = named.join(link_counts(members.drop("first"), least), "cid", "left").select("vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = classes.join(roots, classes.cid == roots.node, "left_anti").where("n > 1").select("vector", (F.col("n") - 1).alias("n_links"), F.col("first").alias("component_id"))
    known = materialize(linked.union(alone), "vector-known")
    out = salted_join(rows.where("valid"), known, ["vector"], ["vec_id"]).select("vec_id", "n_links", "component_id").union(rows.where("not valid").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
