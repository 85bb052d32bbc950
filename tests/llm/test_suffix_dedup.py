"""Repeated passages against every run of words."""

import random

import pytest

pytest.importorskip("pagewright.llm")

from pagewright.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at int, spans string"


def rows_of(texts, ids=None):
    return [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in zip(ids or range(len(texts)), texts)]


def brute(rows, passage):
    """{(doc_id, text): words that go}; doc_ids are unique."""
    texts = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        texts.setdefault(t or "", i)
    kept = {}
    gone = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        if texts[t or ""] != i:
            gone[i] = set(range(len(words))) if len(words) >= passage else set()
            continue
        out, stays = set(), set()
        for k in range(len(words) - passage + 1):
            own = kept.setdefault(tuple(words[k : k + passage]), (i, k))
            if own != (i, k):
                out |= set(range(k, k + passage))
                if own[0] == i:
                    stays |= set(range(own[1], own[1] + passage))
        gone[i] = out - stays
    return gone


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    make = lambda n: [word() for _ in range(n)]
    shared = [make(rng.choice([8, 49, 50, 51, 60, 130])) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += make(rng.randrange(40)) + (rng.choice(shared) if rng.random() < 0.6 else [])
        sep = rng.choice([" ", "\n", "  "])
        texts.append(sep.join(parts))
    texts += [texts[3], texts[3], texts[5], "w " * 200, " ".join(make(30) * 4), "x y z", "x y z", None, "", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_every_repeated_run_goes_and_nothing_else(spark, seed):
    rows = rows_of(corpus(seed))
    want = brute(rows, 50)
    got = {r.doc_id: r for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, _, *_ in rows:
        assert {k for s in got[i].spans for k in range(s["from"], s["to"])} == want[i], i
        assert got[i].n_removed == len(want[i])
        assert i not in got[i].sources and all(s < i for s in got[i].sources)
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        left = [w for k, w in enumerate((t or "").split()) if k not in want[i]]
        if not left and want[i]:
            assert i not in out
        else:
            assert out[i].text == t if not want[i] else out[i].text.split() == left
            assert out[i].n_chars == len(out[i].text or "")


def test_words_between_spans_keep_their_separators():
    assert suffix_dedup.remove_spans(" a  b\nc d ", [(1, 2)]) == " a  c d "
    assert suffix_dedup.remove_spans("a b c", [(0, 1), (2, 3)]) == "b "
    assert suffix_dedup.remove_spans("a b", [(0, 2)]) == ""


def test_null_ids_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{k}" for k in range(70))
    rows = rows_of([long, long, long, long + " end", None], [None, 4, 4, None, None])
    got = suffix_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == [("4", 70, 0), ("4", 70, 0), ("None", 0, 0), ("None", 70, 70), ("None", 71, 70)]
    assert suffix_dedup.find_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_hashes_depend_on_their_words_alone():
    hasher = suffix_dedup._Hasher()
    runs = hasher.runs(hasher.words([[b"a", b"b", b"c", b"d"], [b"x", b"b", b"c", b"d"]]), 3)
    assert runs[1] == runs[5] and runs[0] != runs[4]


def test_a_hot_passage_over_many_segments_and_partitions(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    hot, warm = [word() for _ in range(70)], [word() for _ in range(55)]
    texts = [" ".join([word() for _ in range(rng.randrange(45))] + hot[rng.randrange(3) :] + (warm if k % 5 == 0 else []) + [word() for _ in range(rng.randrange(45))]) for k in range(300)]
    rows = rows_of(texts)
    want = brute(rows, 50)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.doc_id: r for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA), segment=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, *_ in rows:
        assert {k for s in got[i].spans for k in range(s["from"], s["to"])} == want[i], i


def test_a_very_long_text_is_read_whole(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(400)}" for _ in range(60_000)]
    rows = rows_of([" ".join(long), " ".join(["x", *long[59_000:59_060], "y"]), "z " * 300])
    got = {r.doc_id: r.n_removed for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 60, 2: 250}


def test_neighbours_are_compared_word_by_word():
    row = lambda right, left, least, most, did: (right.encode(), left.encode(), least, most, did, 0, 20)
    rows = sorted([row("a b c d ", "x y ", 0, 2, 1), row("a b c d ", "x z ", 0, 2, 2), row("a b d d ", "x y ", 0, 2, 0)])
    found = sorted(suffix_dedup.settle(rows, 4, False, False))
    assert found == [(1, 0, 20, (2, 2), (0, 0, 20)), (2, 0, 20, (0, 1), (1, 0, 20))]


def test_texts_whose_hashes_collide_stay_apart(spark, monkeypatch):
    """With one hash for all texts, only their digests tell them apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0 if len(c) == 1 else F.hash(*c).cast("long"))
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in "abc"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.find_repeats(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 60}
