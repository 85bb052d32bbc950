"""Quality rules: word statistics, and perplexity under a modified Kneser-Ney n-gram model.

The model is one of characters, two for each language, counted by Spark over all documents that are fit to teach: those that pass the base rules and have no more than one mark (``SYMBOL_MARKS``) in
``MARK_WORDS`` words. Every distinct text counts once, and teaches one of the two models, as a hash of the text says; it is scored by the other. So no document, and none of its copies, is scored by what it
taught itself, and a copy moves no verdict. Runs of white space become one space, digits become one digit; code points are kept otherwise. Each character, and the end of the text, is
predicted from the ORDER - 1 before it, across the borders of words; before a text stands a symbol of its own.
An n-gram is exact: two longs of three code points each. Workers count the n-grams of the highest order and send each once with its
count; Spark sums them, derives continuation counts, counts of counts, discounts, probabilities and back-off weights. The result is
written as sorted arrays of 64-bit hashes with their values, in files by model. A worker reads the files of the models that
it meets, and finds n-grams by their hashes' first bits. Nothing of the model passes through the driver, and it grows with the corpus.

A document's log-perplexity is the mean over its symbols. Each model has its own band around the
median of what it scores: documents above it (noise) or below it (repetition) are rejected.
"""

from __future__ import annotations

import math
import re
from contextlib import suppress
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bounded, discard, materialize, new_path, salted_join

ORDER = 6
_BITS, _ONE = 21, (1 << 21) - 1
#: Symbols that are no characters; texts that hold these code points have the third in their place.
_BEFORE, _END, _OTHER = 0, 1, 2
#: Symbols that are looked at at once, and scored at once; n-grams that a worker holds before it sums equal ones, and sums, twice as many, before it passes them on; bytes of texts that are handed to it at once.
SLICE = 1 << 20
SCORED = 1 << 18
MOST_GRAMS = 1 << 20
BATCH_BYTES = 4 << 20
#: Bytes of models that a worker keeps beside the one it needs.
MODEL_BYTES = 256 << 20

#: Digests that may be sent to all tasks, about 10 MB.
BROADCAST_ROWS = 150_000
#: N-grams of so many symbols or more must stand so often to be in a model, whatever the corpus. A least share of all that taught it can be asked for too, as a bound for workers' memory;
#: none is by default, as what is in a model would then depend on the corpus's size.
PRUNED = 3
LEAST_COUNT = 2
LEAST_SHARE = 0.0

#: A document teaches if it has no more than one mark in so many words.
MARK_WORDS = 20
#: Separates a language's name from the number of its model.
_OF = "\x1f"

LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED = 30  # per cent of words
SYMBOL_MARKS = "#*$%&|<>"

#: A band reaches LOWER robust standard deviations (1.4826 times the median deviation) below the median and UPPER above it,
#: but no less than LEAST_SPREAD each. A language's deviation is averaged with that of all languages, which weighs as much as PRIOR documents.
LOWER = 12.0
UPPER = 8.0
LEAST_SPREAD = 0.02
PRIOR = 30


def _give_back() -> None:
    """Returns to the system what this process has freed and still keeps; Spark's workers live on between tasks, beside whatever comes next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def symbols(texts: list[str]):
    """(code points as uint32, the number of each text's symbols): texts laid end to end, ORDER - 1 times _BEFORE before each, _END behind it."""
    import numpy as np

    clean = [t.strip(" \t\n\x0b\f\r") for t in texts]
    clean = [re.sub("[\0\1]", "\2", t) if "\0" in t or "\1" in t else t for t in clean]
    code = np.frombuffer("".join([f"{'\0' * (ORDER - 1)}{t}\1" for t in clean]).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    again = space.copy()
    again[1:] &= space[:-1]
    again[:1] = False
    code = np.where(space, np.uint32(32), np.where((code >= 48) & (code <= 57), np.uint32(48), code))
    size = np.array([len(t) for t in clean], np.int64) + ORDER
    begins = np.cumsum(size) - size
    return code[~again], size - np.add.reduceat(again, begins, dtype=np.int64) if len(size) else size


def triples(code, most: int | None = None):
    """(place, told, three) of slices of ``most`` symbols (SLICE): the longs of all runs of three, and which of them begin the n-gram of a predicted symbol; three runs later, its newer half. ``place`` is where the symbol of the first would be."""
    import numpy as np

    most = most or SLICE
    for at in range(0, max(0, len(code) - ORDER + 1), most):
        part = code[at : at + most + ORDER - 1].astype(np.uint64)
        three = part[:-2] << np.uint64(2 * _BITS) | part[1:-1] << np.uint64(_BITS) | part[2:]
        told = np.nonzero(part[ORDER - 1 :] != _BEFORE)[0]
        yield at + ORDER - 1, told, three


def windows(code, most: int | None = None):
    """(place, older, newer) of slices of ``most`` symbols (SLICE): for every predicted symbol its place and the two longs of the n-gram that ends there."""
    for place, told, three in triples(code, most):
        yield place + told, three[:-3][told], three[3:][told]


def hashed(lang: int, n: int, kind: int, a, b):
    """64-bit hashes of n-grams (older, newer) of a language; ``kind`` 0 is for probabilities, 1 for weights of contexts."""
    import numpy as np
    import xxhash

    h = (a ^ np.uint64(xxhash.xxh3_64_intdigest(f"{n}|{kind}|{lang}"))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def distinct(h):
    """(index, place): for each hash the number of its value, and for each value a place where it stands."""
    import numpy as np
    import pandas as pd

    index, values = pd.factorize(h)
    place = np.empty(len(values), np.int64)
    place[index] = np.arange(len(h))
    return index, place


def _runs(key):
    """Where each value of sorted ``key`` begins."""
    import numpy as np

    return np.nonzero(np.append(True, key[1:] != key[:-1])[: len(key)])[0]


def counted(told, three):
    """(a, b, count): the n-grams of a slice's ``triples``, each once, in their order."""
    import numpy as np
    import pandas as pd

    number, values = pd.factorize(three, sort=True)
    key = (number[:-3] << 32 | number[3:])[told]
    key.sort()
    first = _runs(key)
    return values[key[first] >> 32], values[key[first] & 0xFFFFFFFF], np.diff(first, append=len(key))


def summed(parts: list[tuple]):
    """What ``counted`` gives of several slices, as one."""
    import numpy as np
    import pandas as pd

    a, b, count = map(np.concatenate, zip(*parts))
    (i, older), (j, newer) = pd.factorize(a, sort=True), pd.factorize(b, sort=True)
    i <<= 32
    i |= j
    del j
    order = np.argsort(i)
    key = i[order]
    first = _runs(key)
    return older[key[first] >> 32], newer[key[first] & 0xFFFFFFFF], np.add.reduceat(count[order], first) if len(key) else count


def _by_language(langs: list[str], texts: list[str]):
    """(language, numbers of its texts) in parts of about SLICE characters."""
    groups: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        groups.setdefault(lang, []).append(k)
    for lang, numbers in groups.items():
        part, size = [], 0
        for k in numbers:
            part.append(k)
            size += len(texts[k])
            if size > SLICE:
                yield lang, part
                part, size = [], 0
        if part:
            yield lang, part


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def number_of(model: str) -> int:
    """What a model is called in tables: a digest of its name, so that rows and keys hold no texts."""
    import xxhash

    return xxhash.xxh3_64_intdigest(model.encode("utf-8", "surrogatepass")) - (1 << 63)


def half_of(text: str) -> int:
    """0 or 1: the model that a text teaches; the other one scores it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & 1


def _teaches(texts: list[str]):
    """Whether each text passes the base rules and has few marks."""
    import numpy as np

    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n, marks = np.array([len(w) for w in words], np.int64), np.array([sum(map(t.count, SYMBOL_MARKS)) for t in texts], np.int64)
    return (n >= LEAST_WORDS) & (100 * _batch_statistics(words) <= MOST_REPEATED * n) & (MARK_WORDS * marks <= n)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text): every text of a language once. Only texts that are there several times are shuffled, each once from a task; the digests that name them are sent to all tasks if they are few."""
    rows = docs.select(_language().alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.md5(F.concat_ws(_OF, "lang", "text").cast("binary")))
    copied = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("again")), "quality-copied")
    if copied.count() <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(copied), "key", "left")
    else:
        marked = salted_join(rows.withColumn("uid", F.monotonically_increasing_id()), copied, ["key"], ["uid"])
    once = marked.where("again is null").select("lang", "text")
    return once.union(marked.where("again").groupBy("key").agg(F.any_value("lang").alias("lang"), F.any_value("text").alias("text")).select("lang", "text"))


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, a, b, count): the n-grams of the highest order of the distinct texts that teach; ``lang`` names a language's model."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("count", pa.int64())])

    def run(batches):
        import numpy as np

        _held.clear()  # models of an earlier fit
        held: dict[str, list] = {}
        done = new = 0  # n-grams that are summed, and those that aren't

        def passed():
            for lang, parts in held.items():
                a, b, count = parts[0]  # in order: neighbours share symbols, so what is shuffled takes less room
                for at in range(0, len(a), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(number_of(lang), pa.int64()), len(a[part])), pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64)), pa.array(count[part])], schema=schema)
            held.clear()

        def compact():
            for lang, parts in held.items():
                if len(parts) > 1:
                    held[lang] = [summed(parts)]
            return sum(len(parts[0][0]) for parts in held.values()), 0

        for batch in bounded(batches, most=BATCH_BYTES):
            langs, texts = batch.column(0).to_pylist(), [t.as_py() for t in batch.column(1)]
            fit = [k for k, good in enumerate(_teaches(texts)) if good]
            langs, texts = [f"{langs[k]}{_OF}{half_of(texts[k])}" for k in fit], [texts[k] for k in fit]
            for lang, numbers in _by_language(langs, texts):
                code, _ = symbols([texts[k] for k in numbers])
                for _, told, three in triples(code):
                    held.setdefault(lang, []).append(counted(told, three))
                    new += len(held[lang][-1][0])
                    if new > MOST_GRAMS:
                        done, new = compact()
                        if done > 2 * MOST_GRAMS:
                            yield from passed()
                            done = 0
            _give_back()
        compact()
        yield from passed()
        _give_back()

    parts = distinct_texts(docs).mapInArrow(run, "lang long, a long, b long, count long")
    parts = parts.repartition("lang", "a", "b")  # they are summed in their tasks, which needn't be tried again before they are shuffled
    return parts.groupBy("lang", "a", "b").agg(F.sum("count").alias("count"))


def _newest(n: int, a, b, zero):
    """The newest ``n`` symbols of n-grams, as Columns or as arrays."""
    if n > 3:
        return a & ((1 << _BITS * (n - 3)) - 1), b
    return zero, b & ((1 << _BITS * n) - 1)


def _suffix(n: int) -> tuple[Column, Column]:
    """The n-gram without its oldest symbol."""
    a, b, zero = F.col("a"), F.col("b"), F.lit(0).cast("long")
    if n - 1 > 3:
        return a.bitwiseAND(F.lit((1 << _BITS * (n - 4)) - 1).cast("long")), b
    return zero, b.bitwiseAND(F.lit((1 << _BITS * (n - 1)) - 1).cast("long"))


def adjusted_counts(grams: DataFrame) -> DataFrame:
    """(lang, n, a, b, adj, raw) for n = 1 to ORDER: how often an n-gram stands (raw); adj is that in the highest order, else the number of symbols that stand before."""
    last = grams.select("lang", F.lit(ORDER).alias("n"), "a", "b", F.col("count").alias("adj"), F.col("count").alias("raw"))
    out = last
    for n in range(ORDER - 1, 0, -1):
        a, b = _suffix(n + 1)
        last = last.select("lang", a.alias("a"), b.alias("b"), "raw").groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("adj"), F.sum("raw").alias("raw")).select("lang", F.lit(n).alias("n"), "a", "b", "adj", "raw")
        out = out.union(last)
    return out


def estimate(grams: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(values, tables): values (lang, n, kind, a, b, value) are natural logarithms of modified Kneser-Ney probabilities (kind 0) and back-off weights of contexts (kind 1).

    Counts and discounts are those of all n-grams; an n-gram of PRUNED symbols or more that stands fewer than LEAST_COUNT times, or is a smaller share than LEAST_SHARE, is no evidence but of
    itself, and its probability goes to its context's back-off weight. The row of n = 0 and kind 0 has what a character that the language never has gets.
    ``grams`` is what ``count_grams`` counts, stored; it is removed as soon as it is read, and so are the tables in between. ``tables`` are those that values are read from. All sums, joins and windows are
    Spark's; a window holds the symbols that follow one context.
    """
    adjusted = materialize(adjusted_counts(grams), "grams-adjusted")
    discard(grams)
    t = [F.count_if(F.col("adj") == k) for k in (1, 2, 3, 4)]
    tallies = adjusted.groupBy("lang", "n").agg(*[x.cast("double").alias(f"t{k}") for k, x in enumerate(t, 1)], F.count(F.lit(1)).alias("kinds"))
    y = F.when(F.col("t1") + F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
    discount = lambda k: F.when(F.col(f"t{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"t{k + 1}") / F.nullif(f"t{k}", F.lit(0.0)), F.lit(0.05)), F.lit(k - 0.05))).otherwise(0.5)
    all_ = adjusted.where("n = 1").groupBy("lang").agg(F.sum("raw").alias("all"))
    rates = materialize(tallies.join(all_, "lang").select("lang", "n", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)], "kinds", F.greatest(F.lit(float(LEAST_COUNT)), F.col("all") * LEAST_SHARE).alias("least")), "grams-discounts")
    older = F.shiftright("a", _BITS)
    newer = F.shiftright("b", _BITS).bitwiseOR(F.shiftleft(F.col("a").bitwiseAND(F.lit(_ONE).cast("long")), 2 * _BITS))
    context = Window.partitionBy("lang", "n", "ca", "cb")
    seen = adjusted.join(rates, ["lang", "n"]).withColumn("ca", older).withColumn("cb", newer)
    d = F.when(F.col("adj") == 1, F.col("d1")).when(F.col("adj") == 2, F.col("d2")).otherwise(F.col("d3"))
    stays = (F.col("n") < PRUNED) | (F.col("raw") >= F.col("least"))
    seen = seen.withColumn("total", F.sum("adj").over(context)).withColumn("own", F.when(stays, (F.col("adj") - d) / F.col("total")))
    seen = seen.withColumn("spare", 1 - F.sum("own").over(context)).where("own is not null")
    parts = materialize(seen.select("lang", "n", "a", "b", "ca", "cb", "own", "spare", "kinds"), "grams-parts")
    discard(adjusted, rates)
    level = parts.where("n = 1").select("lang", "n", "a", "b", (F.col("own") + F.col("spare") / (F.col("kinds") + 1)).alias("p"))
    levels = [materialize(level, "grams-1")]
    for n in range(2, ORDER + 1):
        a, b = _suffix(n)
        lower = levels[-1].select("lang", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("lower"))
        level = parts.where(F.col("n") == n).withColumn("sa", a).withColumn("sb", b).join(lower, ["lang", "sa", "sb"])  # an n-gram stands no more often than its suffix
        levels.append(materialize(level.select("lang", "n", "a", "b", (F.col("own") + F.col("spare") * F.col("lower")).alias("p")), f"grams-{n}"))
    row = lambda df, n, kind, a, b, value: df.select("lang", n.alias("n"), F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), F.log(value).alias("value"))
    out = row(parts.where("n = 1").groupBy("lang").agg(F.max(F.col("spare") / (F.col("kinds") + 1)).alias("p"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), F.lit(0), 0, "a", "b", F.col("p"))
    for level in levels:
        out = out.union(row(level, F.col("n"), 0, "a", "b", F.col("p")))
    weights = parts.where("n > 1").groupBy("lang", "n", "ca", "cb").agg(F.max("spare").alias("spare"))
    return out.union(row(weights, F.col("n") - 1, 1, "ca", "cb", F.col("spare"))), [parts, *levels]


def write_model(values: DataFrame) -> Model:
    """Writes what ``estimate`` returns as arrays of hashes and values, in files by model and by the hashes' first bits, sorted within each."""
    import pyarrow as pa

    spark, path = values.sparkSession, new_path(values.sparkSession, "grams-model")

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            kinds = pa.Table.from_batches([batch]).group_by(["lang", "n", "kind"]).aggregate([])
            for lang, n, kind in zip(*[kinds.column(c).to_pylist() for c in ("lang", "n", "kind")]):
                own = batch.filter(pc.and_(pc.equal(batch.column(0), lang), pc.and_(pc.equal(batch.column(1), n), pc.equal(batch.column(2), kind))))
                h = hashed(lang, n, kind, *[own.column(c).to_numpy().view(np.uint64) for c in (3, 4)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.int64()), len(h)), pa.array(h), own.column(5).cast(pa.float32())], ["model", "key", "value"])

    keyed = values.select("lang", "n", "kind", "a", "b", F.col("value").cast("double").alias("value")).mapInArrow(run, "model long, key long, value float")
    keyed.repartition("model", F.shiftright("key", 60)).sortWithinPartitions("model", "key").write.parquet(path)
    stored = spark.read.schema("model long, key long, value float").parquet(path)
    files: dict[int, list[str]] = {}
    for row in stored.select("model", F.col("_metadata.file_path").alias("file")).distinct().collect():  # no more rows than files and models
        files.setdefault(row.model, []).append(row.file)
    names = sorted({name for own in files.values() for name in own})
    return Model(files, None if _is_known(names) else _handed_out(spark, names))


def _is_known(names: list[str]) -> bool:
    """Whether workers can open these files by themselves."""
    from pyarrow import fs

    try:
        return not names or bool(fs.FileSystem.from_uri(names[0]))
    except Exception:  # a scheme that only Spark knows, or one that asks for what only Spark was told
        return False


def _handed_out(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """Has Spark fetch files to every machine, with its own access to the store: their names there by their URIs."""
    for name in names:
        spark.sparkContext.addFile(name)
    return {name: name.rsplit("/", 1)[1] for name in names}


def indexed(parts: list[tuple]):
    """(keys, values, first) of arrays of keys with their values, sorted by key. ``first`` has for every value of the keys' first bits, of which there are as many as keys or up to twice that, where such
    keys begin. A last key is added, beyond which no search goes."""
    import numpy as np

    keys = np.concatenate([*[p[0] for p in parts], np.full(1, np.iinfo(np.int64).max)])
    values = np.concatenate([*[p[1] for p in parts], np.zeros(1, np.float32)])
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del order
    bits = len(keys).bit_length()
    ends = np.zeros((1 << bits) + 1, np.uint32 if len(keys) < 1 << 32 else np.int64)
    for at in range(0, len(keys) - 1, SCORED):
        bucket = (keys[:-1][at : at + SCORED] >> 64 - bits) + (1 << bits - 1)
        n = np.bincount(bucket - bucket[0]).astype(ends.dtype)
        ends[bucket[0] + 1 : bucket[0] + 1 + len(n)] += n
    return keys, values, np.cumsum(ends, dtype=ends.dtype, out=ends)[:-1]


def look_up(arrays: tuple, h):
    """(whether it is there, its value or 0) of each hash."""
    import numpy as np

    keys, values, first = arrays
    bits = len(first).bit_length() - 1
    at = first[(h >> 64 - bits) + (1 << bits - 1)].astype(np.int64)
    near = keys[at]
    hit, more = near == h, np.nonzero(near < h)[0]
    while len(more):
        at[more] += 1
        near = keys[at[more]]
        hit[more] = near == h[more]
        more = more[near < h[more]]
    return hit, np.where(hit, values[at], np.float32(0))


#: Arrays that this process has read, by their model and files, all of one fit; the last one used comes last.
_held: dict[tuple, tuple] = {}


class Model:
    """A written model: its files, and the names of the copies that Spark has fetched to each machine, where workers can't open the files. Workers read the arrays of the models that they meet, and keep up to MODEL_BYTES of them."""

    def __init__(self, files: dict[int, list[str]], copies: dict[str, str] | None = None):
        self.files, self.copies = {k: tuple(sorted(v)) for k, v in files.items()}, copies

    def knows(self, lang: str) -> bool:
        """Whether any document taught the model of that name."""
        return number_of(lang) in self.files

    def arrays(self, model: int):
        """A model's keys and values as ``indexed`` gives them."""
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import SparkFiles

        files = self.files.get(model, ())
        for other in [x for x in _held if self.files.get(x[0]) != x[1]]:  # of an earlier fit
            del _held[other]
        if (model, files) in _held:
            _held[model, files] = _held.pop((model, files))
            return _held[model, files]
        parts = []
        for name in files:
            system, path = fs.FileSystem.from_uri(name) if self.copies is None else (fs.LocalFileSystem(), SparkFiles.get(self.copies[name]))
            table = pq.read_table(path, columns=["key", "value"], filters=[("model", "=", model)], filesystem=system)
            parts.append((table.column("key").to_numpy(), table.column("value").to_numpy()))
        own = indexed(parts)
        while _held and sum(x.nbytes for arrays in (*_held.values(), own) for x in arrays) > MODEL_BYTES:
            _held.pop(next(iter(_held)))
        _held[model, files] = own
        return own

    def log_probability(self, lang: str, a, b):
        """Natural logarithms of the probabilities of n-grams' newest symbols, given the others. Unknown languages know no n-gram."""
        import numpy as np

        number = number_of(lang)
        arrays = self.arrays(number)
        whole = hashed(number, ORDER, 0, a, b).view(np.int64)
        hit, out = look_up(arrays, whole)
        out, missed = out.astype(np.float64), np.nonzero(~hit)[0]
        index, place = distinct(whole[missed])
        a, b = [np.asarray(x, np.uint64)[missed[place]] for x in (a, b)]
        rest, left = np.zeros(len(a)), np.arange(len(a))
        for n in range(ORDER, 0, -1):  # what has no probability of n symbols has its context's weight, if there is one, and that of n - 1 symbols
            if not len(left):
                break
            own = _newest(n, a[left], b[left], np.zeros(len(left), np.uint64))
            if n < ORDER:
                hit, value = look_up(arrays, hashed(number, n, 0, *own).view(np.int64))
                rest[left] += value
                left, own = left[~hit], [x[~hit] for x in own]
            if n > 1:
                older, newer = own[0] >> np.uint64(_BITS), own[1] >> np.uint64(_BITS) | (own[0] & np.uint64(_ONE)) << np.uint64(2 * _BITS)
                rest[left] += look_up(arrays, hashed(number, n - 1, 1, older, newer).view(np.int64))[1]
        if len(left):
            zero = np.zeros(len(left), np.uint64)
            hit, value = look_up(arrays, hashed(number, 0, 0, zero, zero).view(np.int64))
            rest[left] += np.where(hit, value, -math.log(1 << _BITS))
        out[missed] = rest[index]
        return out

    def log_perplexity(self, lang: str, texts: list[str]):
        """The mean negative log-probability of each text's symbols, its end included."""
        import numpy as np

        code, size = symbols(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        total = np.zeros(len(texts))
        for place, a, b in windows(code, min(SLICE, SCORED)):
            total += np.bincount(owner[place], self.log_probability(lang, a, b), len(texts))
        return -total / (size - ORDER + 1)


def _batch_statistics(texts: list[list[bytes]]):
    """Repeated words of each list: how many stand in a run of REPEAT_WINDOW words that is found twice or more in the list."""
    import numpy as np

    size = np.array([len(w) for w in texts], np.int64)
    out = np.zeros(len(texts), np.int64)
    flat = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(size.sum())).view(np.uint64)
    if len(flat) < REPEAT_WINDOW:
        return out
    mixed = np.zeros(len(flat) - REPEAT_WINDOW + 1, np.uint64)
    for k in range(REPEAT_WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), size)
    starts = np.nonzero(owner[: len(mixed)] == owner[REPEAT_WINDOW - 1 :])[0]
    mixed = mixed[starts] * np.uint64(0xBF58476D1CE4E5B9) ^ (owner[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = starts[order[np.append(same, False) | np.append(False, same)]] if len(order) else starts
    edge = np.bincount(twice, minlength=len(flat) + 1) - np.bincount(twice + REPEAT_WINDOW, minlength=len(flat) + 1)
    return np.bincount(owner, np.cumsum(edge[:-1]) > 0, len(texts)).astype(np.int64)


def measure(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, model, whole, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity) of every row; one pass.

    ``model`` names the model that scores the text, ``whole`` is a digest of the text. log_perplexity is null for a text without words, where
    no document of its language taught the model, and for all if there is no model.
    """
    import pyarrow as pa

    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import numpy as np
        import xxhash

        for batch in bounded(batches, most=BATCH_BYTES):
            texts = [t.as_py() or "" for t in batch.column(2)]
            langs = [f"{lang}{_OF}{1 - half_of(t)}" for lang, t in zip(batch.column(1).to_pylist(), texts)]
            whole = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            rows = []
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            for text, own in zip(texts, words):
                chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
                lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
                rows.append((len(own), chars, sum(map(text.count, SYMBOL_MARKS)), len(lines) - len(set(lines))))
            repeated = _batch_statistics(words)
            del words
            perplexity, some = np.zeros(len(texts)), np.array([model is not None and r[0] > 0 and model.knows(lang) for r, lang in zip(rows, langs)], bool)
            for lang, part in _by_language(langs, texts):
                if with_words := [k for k in part if some[k]]:
                    perplexity[with_words] = model.log_perplexity(lang, [texts[k] for k in with_words])
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(whole, pa.binary()), *columns, pa.array(repeated), pa.array(perplexity, pa.float64(), mask=~some)], ["doc_id", "model", "whole", *numbers, "log_perplexity"])
            _give_back()

    source = docs.select(F.col("doc_id").cast("long"), _language(), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, model string, whole binary, " + "".join(f"{c} long, " for c in numbers) + "log_perplexity double")


def bands(measured: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(model, low, high) of the models that have scored a document that passes the base rules, from the median of the log-perplexities they gave and the language's robust deviation from it.

    Every distinct text counts once. A language's deviation is averaged with that of all languages by PRIOR documents, whatever its size.
    """
    passed = measured.where(~base_failed() & F.col("log_perplexity").isNotNull()).dropDuplicates(["model", "whole"]).withColumn("lang", F.substring_index("model", _OF, 1))
    middle = passed.groupBy("model").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    away = materialize(passed.join(materialize(middle, "quality-middles"), "model").select("lang", "model", "middle", F.abs(F.col("log_perplexity") - F.col("middle")).alias("d")), "quality-away")
    own = away.groupBy("lang").agg(F.percentile_approx("d", 0.5, 10_000).alias("away"), F.count(F.lit(1)).alias("docs"))
    every = away.agg(F.percentile_approx("d", 0.5, 10_000)).first()[0] or 0.0
    spread = F.greatest(1.4826 * (F.col("docs") * F.col("away") + PRIOR * every) / (F.col("docs") + PRIOR), F.lit(LEAST_SPREAD))
    return away.select("lang", "model", "middle").distinct().join(own, "lang").select("model", (F.col("middle") - lower * spread).alias("low"), (F.col("middle") + upper * spread).alias("high"))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fit(docs: DataFrame) -> Model:
    """The models of all of ``docs``."""
    values, tables = estimate(materialize(count_grams(docs), "grams"))
    model = write_model(values)
    discard(*tables)
    return model


def quality(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang; other columns are ignored) with its statistics, base_failed, perplexity, band and kept.

    ``kept`` is false if the base rules fail, else whether the perplexity lies in the band of the model that scored it; what no model could score, as a language's only text, is kept.
    Null texts are empty and fail the base rules, a null lang is the language of no name, repeated rows are judged alike and as if they were there once, and an empty table gives
    no rows. Texts of any length are read whole, SLICE symbols at a time. Languages are as many as ``lang`` has values.
    """
    measured = materialize(measure(docs, fit(docs)), "quality")
    out = measured.join(materialize(bands(measured, lower, upper), "quality-bands"), "model", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"))
