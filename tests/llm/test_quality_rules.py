"""The language model against its definition, and the bands."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagewright.llm")

from pagewright.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, key long"


def docs_of(spark, texts, lang="en", first=0):
    return spark.createDataFrame([(first + i, t, lang, 1) for i, t in enumerate(texts)], SCHEMA)


def spell(text):
    """Symbols of a text by the rules, with five marks before it and one behind it."""
    out, space = [], True
    for c in text:
        if c in " \t\n\x0b\f\r":
            out += [] if space else [" "]
            space = True
        else:
            out.append("0" if c in "0123456789" else {"\0": "\2", "\1": "\2"}.get(c, c))
            space = False
    return ["<"] * 5 + (out[:-1] if space and out else out) + [">"]


def brute(texts):
    """The definition, n-gram by n-gram: a function from an n-gram (a tuple of symbols) to its probability."""
    order = 6
    a, raw = {order: Counter()}, {}
    for s in map(spell, texts):
        for k in range(5, len(s)):
            a[order][tuple(s[k - 5 : k + 1])] += 1
    raw[order] = Counter(a[order])
    for n in range(order - 1, 0, -1):
        a[n] = Counter(g[1:] for g in a[n + 1])
        raw[n] = Counter()
        for g, v in raw[n + 1].items():
            raw[n][g[1:]] += v
    own, total = {}, {n: Counter() for n in a}
    for n in a:
        t = [sum(1 for v in a[n].values() if v == k) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        d = [0, *[min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 for k in (1, 2, 3)]]
        for g, v in a[n].items():
            total[n][g[:-1]] += v
        own[n] = {g: (v - d[min(v, 3)]) / total[n][g[:-1]] for g, v in a[n].items() if n < 3 or raw[n][g] >= 2}
    spare = {n: defaultdict(lambda: 1.0) for n in a}
    for n in a:
        for g, x in own[n].items():
            spare[n][g[:-1]] -= x

    def p(g):
        n = len(g)
        return own[n].get(g, 0.0) + spare[n][g[:-1]] * p(g[1:]) if n else 1 / (len(a[1]) + 1)

    return p, a


def perplexity(p, text):
    s = spell(text)
    logs = [math.log(p(tuple(s[k - 5 : k + 1]))) for k in range(5, len(s))]
    return -sum(logs) / len(logs)


def teachers(texts, half):
    return [t for t in dict.fromkeys(texts) if t and quality_rules._teaches([t])[0] and quality_rules.half_of(t) == half]


def test_kneser_ney(spark):
    """Also with copies, short texts and texts of marks, none of which teach."""
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(30))
    own = [make("abcdeA1") for _ in range(10)] + [make("日本語文\n") + " \0 \1 x", "too short", make("ab#$")]
    other = [make("abcxy") for _ in range(6)]
    docs = docs_of(spark, [*own, *own[:4], None, " "]).union(docs_of(spark, other, "de", 100))
    model = quality_rules.fit(docs)
    tried = [*own, "zzz", "q abq", "aaaaaaaa", "日x", "a"]
    for half in (0, 1):
        for lang, texts in (("en", own), ("de", other)):
            assert 1 < len(teachers(texts, half)) < 11
            p, counts = brute(teachers(texts, half))
            for a, text in zip(model.log_perplexity(f"{lang}\x1f{half}", tried), tried):
                assert math.isclose(a, perplexity(p, text), rel_tol=1e-5), text
        for context in [(), ("a",), ("b", " "), ("<", "a")]:
            assert math.isclose(sum(p((*context, *s)) for s in counts[1]) + (p((*context, "never"))), 1.0)
    assert not model.knows("xx\x1f0") and model.log_perplexity("xx\x1f0", ["abc"])[0] > 10


def test_slices_do_not_change_anything(spark, monkeypatch):
    import numpy as np

    texts = ["the cat sat on the mat " * 9, "x", "a  b\n" * 40]
    code, size = quality_rules.symbols(texts)
    assert size.tolist() == [len(spell(t)) for t in texts]
    whole = [np.concatenate(x) for x in zip(*quality_rules.windows(code))]
    monkeypatch.setattr(quality_rules, "SLICE", 7)
    parts = [np.concatenate(x) for x in zip(*quality_rules.windows(code))]
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(whole[0]) == size.sum() - 15


def sentence(rng, nouns, verbs):
    return f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} and then the {rng.choice(nouns)} was {rng.choice(verbs)}"


def test_shuffled_prose_is_worse_than_prose(spark):
    rng = random.Random(4)
    nouns = ["".join(rng.choices("bcdfglmnprst", k=1) + rng.choices("aeiou", k=1)) * 2 for _ in range(25)]
    verbs = [n + "ed" for n in nouns]
    prose = [" ".join(sentence(rng, nouns, verbs) for _ in range(12)) for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in prose]
    model = quality_rules.fit(docs_of(spark, prose))
    for half in (0, 1):
        a = model.log_perplexity(f"en\x1f{half}", [t for t in prose if quality_rules.half_of(t) != half])
        b = model.log_perplexity(f"en\x1f{half}", mixed)
        assert a.max() < b.min()


SYLLABLES = ["the", "an", "er", "in", "tion", "re", "ou", "st"]


def prose_of(rng, n, words=80):
    return [" ".join("".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(words)) for _ in range(n)]


def test_noise_is_above_its_band(spark):
    rng = random.Random(3)
    prose = prose_of(rng, 120)
    noise = [" ".join("".join(rng.choice("qxzjkv#%~") for _ in range(6)) for _ in range(80)) for _ in range(3)]
    marked = [" ".join(w + rng.choice(["###", "$$$"]) for w in t.split()) for t in prose_of(rng, 30)]  # no rarity: a fifth of all
    upper = [t.upper() for t in prose_of(rng, 2)]
    got = {r.doc_id: r for r in quality_rules.quality(docs_of(spark, prose + noise + marked + upper)).collect()}
    assert all(got[i].kept for i in range(120))
    bad = [got[i] for i in range(120, 155)]
    assert all(not r.base_failed and r.perplexity > r.high and not r.kept for r in bad)


def test_monotony_is_below_its_band(spark):
    """No eight words twice too often, so the base rules let it pass, yet one syllable all along."""
    rng = random.Random(3)
    prose = prose_of(rng, 160)
    low = [" ".join("tion" * rng.randrange(2, 7) for _ in range(250)) for _ in range(2)]
    got = {r.doc_id: r for r in quality_rules.quality(docs_of(spark, prose + low)).collect()}
    assert all(got[i].kept for i in range(160))
    for k in (160, 161):
        assert not got[k].base_failed
        assert got[k].perplexity < got[k].low
        assert not got[k].kept


def test_copies_move_nothing(spark, monkeypatch):
    rng = random.Random(6)
    texts = prose_of(rng, 60) + [" ".join("tion" * rng.randrange(2, 7) for _ in range(250))] + ["### ".join(prose_of(rng, 1)[0].split(" "))]
    told = lambda rows: {r.doc_id % 1000: (r.kept, round(r.perplexity, 6), round(r.low, 6), round(r.high, 6)) for r in rows}
    once = told(quality_rules.quality(docs_of(spark, texts)).collect())
    copies = docs_of(spark, texts).union(docs_of(spark, texts[40:] * 7, first=1040).where("doc_id < 1062")).union(docs_of(spark, [texts[-1]] * 30, first=1061).withColumn("doc_id", F.lit(61)))
    for limit in (quality_rules.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", limit)
        again = quality_rules.quality(copies).collect()
        assert told(again) == once and len(again) == copies.count()


def test_a_small_language_has_a_band(spark):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(60))
    docs = docs_of(spark, [text("aeiourstln") for _ in range(60)]).union(docs_of(spark, [text("aeiou") for _ in range(8)] + ["ab " * 30], "xx", 100)).union(docs_of(spark, [text("bcd")], None, 200))
    rows = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert len(rows) == 70 and all(r.low is not None and r.low < r.high for r in rows.values() if r.doc_id < 200)
    assert rows[200].kept and rows[200].perplexity is None and not rows[108].kept
    assert all(rows[k].kept for k in range(100, 108))


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SLICE", 1 << 14)
    rng = random.Random(9)
    prose = prose_of(rng, 60) + [prose_of(rng, 1, 60_000)[0]]
    got = {r.doc_id: r for r in quality_rules.quality(docs_of(spark, prose)).collect()}
    assert got[60].n_words == 60_000 and got[60].kept


def test_models_that_only_spark_can_open(spark, monkeypatch):
    """Where workers can't open the shared folder, Spark hands the files out."""
    docs = docs_of(spark, prose_of(random.Random(2), 30))
    want = {r.doc_id: r.perplexity for r in quality_rules.quality(docs).collect()}
    monkeypatch.setattr(quality_rules, "_is_known", lambda names: False)
    assert {r.doc_id: r.perplexity for r in quality_rules.quality(docs).collect()} == want
    monkeypatch.undo()
    assert not quality_rules._is_known(["s3a://bucket/file"]) and not quality_rules._is_known(["dbfs:/x"])


def test_no_order_outgrows_its_share(spark, monkeypatch):
    """With a large least share, a model has fewer n-grams than one over it, whatever stands in the texts."""
    monkeypatch.setattr(quality_rules, "LEAST_SHARE", 1 / 200)
    values, _ = quality_rules.estimate(quality_rules.materialize(quality_rules.count_grams(docs_of(spark, prose_of(random.Random(1), 40))), "grams"))
    most = values.where("kind = 0 and n >= 3").groupBy("lang", "n").count().collect()
    assert most and max(r["count"] for r in most) <= 200


def test_extra_columns_and_repeated_rows(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(25)), "en", 9, 9.0, 9.0, "x")] * 2 + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, low double, kept double, value string")
    got = quality_rules.quality(docs).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got) == [(0, True, False), (25, False, True), (25, False, True)]


def test_what_is_in_a_model_does_not_depend_on_its_size(spark):
    """N-grams that stand as often as LEAST_COUNT stay beside any number of others."""
    def kept(most):
        rows = [(1, k, k, count) for k, count in ((70, most), (80, quality_rules.LEAST_COUNT), (90, quality_rules.LEAST_COUNT - 1))]
        values, tables = quality_rules.estimate(quality_rules.materialize(spark.createDataFrame(rows, "lang long, a long, b long, count long"), "grams"))
        found = {(r.n, r.a, r.b) for r in values.where("kind = 0 and n >= 3").select("n", "a", "b").collect()}
        quality_rules.discard(*tables)
        return found

    small = kept(5)
    assert (quality_rules.ORDER, 80, 80) in small and (quality_rules.ORDER, 90, 90) not in small
    assert kept(1 << 40) == small


def test_a_worker_keeps_no_model_of_an_earlier_fit(spark):
    first, second = [quality_rules.fit(docs_of(spark, prose_of(random.Random(k), 20))) for k in (1, 2)]
    text = prose_of(random.Random(3), 1)
    for model in (first, second):
        for half in (0, 1):
            model.log_perplexity(f"en\x1f{half}", text)
        assert set(quality_rules._held) == set(model.files.items())
    assert [quality_rules.Model(first.files).log_perplexity("en\x1f0", text)[0]] == [first.log_perplexity("en\x1f0", text)[0]]


def test_scoring_takes_little_memory(spark):
    import tracemalloc

    model = quality_rules.fit(docs_of(spark, prose_of(random.Random(1), 20)))
    text = " ".join(prose_of(random.Random(2), 2500))
    model.log_perplexity("en\x1f0", ["a"])
    tracemalloc.start()
    model.log_perplexity("en\x1f0", [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 1_000_000 and peak < 50 * len(text)


def test_a_task_sends_every_ngram_once(spark, monkeypatch):
    """As long as it can hold those that differ, however many slices they stand in; what it can't hold is sent in parts. They are in order, and not summed again before they are shuffled."""
    import pyarrow as pa

    made = []
    docs = docs_of(spark, [])
    original = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or original(self, run, schema))
    monkeypatch.setattr(quality_rules, "SLICE", 1 << 11)
    rng = random.Random(7)
    texts = [t for t in prose_of(rng, 150) + [" ".join(rng.choices(["日本語", "ab", "\U0001f600x"], k=60))] if quality_rules._teaches([t])[0]]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    want = Counter()
    for text, lang in zip(texts, langs):
        s = spell(text)
        want.update((quality_rules.number_of(f"{lang}\x1f{quality_rules.half_of(text)}"), *s[k - 5 : k + 1]) for k in range(5, len(s)))
    letter = lambda code: {0: "<", 1: ">"}.get(code, chr(code))
    batches = [pa.RecordBatch.from_pydict({"lang": langs[k : k + 10], "text": texts[k : k + 10]}) for k in range(0, len(texts), 10)]
    for most, once in ((len(want) // 2 + 1, True), (len(want) // 8, False)):
        monkeypatch.setattr(quality_rules, "MOST_GRAMS", most)
        plan = quality_rules.count_grams(docs)._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("Aggregate") < plan.index("Exchange") < plan.index("MapInArrow") and "Aggregate" not in plan[plan.index("Exchange") : plan.index("MapInArrow")]
        rows = [tuple(r.values()) for b in made[-1](iter(batches)) for r in b.to_pylist()]
        got = Counter()
        for lang, a, b, count in rows:
            got[lang, *[letter(x >> 21 * k & (1 << 21) - 1) for x in (a, b) for k in (2, 1, 0)]] += count
        assert got == want and (len(rows) == len(want)) == once
        if once:
            keys = [(a, b) for lang, a, b, _ in rows if lang == rows[0][0]]
            assert keys == sorted(keys)


def test_look_ups_find_what_is_there():
    """Also with keys that share their first bits, at both ends, in parts out of order, and without keys."""
    import numpy as np

    rng = np.random.default_rng(3)
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for keys in (np.zeros(0, np.int64), rng.integers(least, most, 5000), np.append(rng.integers(least, most, 50), np.arange(300) + (1 << 40)), np.array([least, -1, 0, 1, most - 1]), np.array([7])):
        keys = np.unique(keys)
        rng.shuffle(keys)
        value = dict(zip(keys.tolist(), range(1, len(keys) + 1)))
        half = len(keys) // 2
        values = np.arange(1, len(keys) + 1).astype(np.float32)
        arrays = quality_rules.indexed([(keys[:half], values[:half]), (keys[half:], values[half:])] if half else [(keys, values)] if len(keys) else [])
        tried = np.unique(np.concatenate([keys, np.where(keys < most - 1, keys + 1, 0), np.where(keys > least, keys - 1, 0), rng.integers(least, most, 1000), [least, 0, most - 1]]))
        hit, found = quality_rules.look_up(arrays, tried)
        assert hit.tolist() == [k in value for k in tried.tolist()]
        assert found.tolist() == [value.get(k, 0) for k in tried.tolist()]


def test_scoring_hashes_every_ngram_once(spark, monkeypatch):
    """What the model has is found at its first search; only what it hasn't is searched again."""
    model = quality_rules.fit(docs_of(spark, prose_of(random.Random(1), 200)))
    text = prose_of(random.Random(2), 1, 4000)[0]
    sizes, original = [], quality_rules.hashed
    monkeypatch.setattr(quality_rules, "hashed", lambda lang, n, kind, a, b: sizes.append((n, len(a))) or original(lang, n, kind, a, b))
    model.log_perplexity("en\x1f0", [text])
    assert sum(size for n, size in sizes if n == quality_rules.ORDER) == len(text) + 1


IDLE = """
import random, re
from pyspark.sql import SparkSession
from pagewright.llm import quality_rules

def anonymous(batches):
    import pyarrow as pa
    for _ in batches:
        kb = sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))
        yield pa.RecordBatch.from_pydict({"kb": pa.array([kb], pa.int64())})

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rng = random.Random(1)
texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=5)) for _ in range(600)) for _ in range(1500)]
docs = spark.createDataFrame([(k, texts[k % 1500] + " " + str(k), "en") for k in range(6000)], "doc_id long, text string, lang string").coalesce(1)
kb = lambda: spark.range(1).mapInArrow(anonymous, "kb long").first().kb
quality_rules.count_grams(docs).count()
print("KEPT", kb())
"""


def test_an_idle_worker_keeps_little_memory():
    """Workers live on beside the stages that follow, in which Spark itself needs the room."""
    import os
    import subprocess
    import sys

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", IDLE], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("KEPT")[1]) < 130_000
