"""The whole pipeline against a plain version of each stage."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

pytest.importorskip("pagewright.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagewright.llm import ordinal_quality, simhash_dedup
from pagewright.llm.common import release, written
from tests.llm.test_native_operators import water_fill
from tests.llm.test_suffix_dedup import brute as plain_repeats
from tests.llm.test_text_operators import plain_best_fit, plain_features


def plain_classifier(docs, model):
    """Documents whose probability of the good grade is at least one half, by the features' description and the model's weights."""
    score = lambda d: sum(model.weights[k] for k in plain_features(d["text"]))
    return [d for d in docs if 1 / (1 + math.exp(model.thresholds[1] - score(d))) >= 0.5]


def plain_simhash(docs):
    prints = [simhash_dedup.fingerprint(d["text"]) for d in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b, key=lambda k: docs[k]["doc_id"])] = min(a, b, key=lambda k: docs[k]["doc_id"])
    return [d for i, d in enumerate(docs) if find(i) == i]


def plain_removal(docs):
    gone = plain_repeats([(d["doc_id"], d["text"]) for d in docs], 50)
    out = []
    for d in docs:
        words = (d["text"] or "").split()
        left = [w for k, w in enumerate(words) if k not in gone[d["doc_id"]]]
        if left or not gone[d["doc_id"]]:
            out.append((d["doc_id"], left))
    return out


def test_stages(spark, sf_dir):
    read = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    plain = read(docs)

    kept = stages["quality_classifier"](spark, docs, sf_dir)
    assert kept.columns == columns
    model = ordinal_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = plain_classifier(plain, model)
    assert read(kept) == plain

    kept = stages["simhash_near_dedup"](spark, kept, sf_dir)
    assert kept.columns == columns
    plain = plain_simhash(plain)
    assert read(kept) == plain

    kept = stages["suffix_array_dedup"](spark, kept, sf_dir)
    assert kept.columns == columns
    words = plain_removal(plain)
    plain = read(kept)
    assert [(d["doc_id"], (d["text"] or "").split()) for d in plain] == words
    assert all(d["n_chars"] == len(d["text"] or "") for d in plain)

    mixed = stages["source_mix"](spark, kept, sf_dir)
    assert mixed.columns == columns
    sizes = Counter()
    for d, (_, own) in zip(plain, words):
        sizes[d["source"]] += len(own)
    goal, want = water_fill(sizes), Counter()
    for d in plain:
        rate = goal[d["source"]] / sizes[d["source"]] if sizes[d["source"]] else 0
        text = hashlib.md5((d["text"] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix-1|{d['doc_id']}|{d['source']}|{text}".encode()).hexdigest()[:8], 16) / 2**32
        want[d["doc_id"]] = int(rate) + (draw < rate - int(rate))
    assert Counter(r.doc_id for r in mixed.collect()) == +want

    rows = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for d in plain:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[d["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += want[d["doc_id"]]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +pieces
    fill = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) == plain_best_fit([r.length for r in rows], 2048)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_tables(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def digest(df):
    return sorted(((r.doc_id, r.piece, r.ids_crc32) for r in df.collect()), key=str)


def by_hand(spark, sf_dir, path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs


def test_run_equals_its_stages(spark, sf_dir, tmp_path):
    before = written(spark)
    got = corpus_pipeline.run(spark, sf_dir)
    assert digest(got) == digest(by_hand(spark, sf_dir, tmp_path))
    release(spark, keep=before)


def test_odd_documents_run_through(spark, tmp_path):
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (1, "other words", None, None, None), (None, None, None, None, None), (None, "no id here", "en", None, 10), (2, "", "en", "b", 0), (3, long, "en", "b", len(long)), (4, long + " end", "en", "b", None), (5, "\x00 odd \u3000", "xx", "", 9)]
    sf_dir = odd_tables(spark, tmp_path / "sf", rows, [(1, 1, 0), (1, None, None), (None, 1, 1), (3, 1, 0), (2, 0, 1)])
    got = corpus_pipeline.run(spark, sf_dir)
    assert digest(got) == digest(by_hand(spark, sf_dir, tmp_path / "out")) and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_no_documents_run_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "sf", [], [])).count() == 0
