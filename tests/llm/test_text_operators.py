"""Quality rules, classifier, token counts and packing against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("pagewright.llm")

import public_tokenizers

from pagewright.llm import ordinal_quality, packing, quality_rules, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, tail int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", 1) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \t\n", "one", "a b c d e f g h " * 6, "x\ny\nx\n\n \ny", "x y \x1c z w", "½ ² Ⅷ 一二 \x1f 7٣", "é 🙂🙂 don't we'll 'tis", "#*$ %&| <> 12,5", "w " * 5000, "<|endoftext|> x"]


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["p q", "r", "  ", "", "s t u"]) for _ in range(12)) for _ in range(20)]
    got = {r.doc_id: r for r in quality_rules.quality(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = WORDS.findall(text or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed), text
        assert not (r.base_failed and r.kept)


def test_empty_tables(spark):
    empty = docs_of(spark, ["x"]).where("doc_id > 5")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality(empty).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert ordinal_quality.score(empty, ordinal_quality.train(empty, labels)).count() == 0


def test_null_ids_and_languages(spark):
    rows = [(None, "a b c", None, None, None, None, None)] * 2 + [(1, None, "en", "s", 0, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert quality_rules.quality(docs).count() == 3
    assert sorted(r.n_words for r in token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()) == [0, 3, 3]
    assert packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 3


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = ordinal_quality.train(docs, labels.where("doc_id % 4 <> 0"))
    assert model.thresholds == sorted(model.thresholds)
    scored = ordinal_quality.score(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).collect()
    clean = [r["__pw_kept"] for r in scored if r.quality == 1 and r.toxic == 0]
    bad = [r["__pw_kept"] for r in scored if r.quality == 0 or r.toxic == 1]
    assert sum(clean) / len(clean) > 0.99
    assert sum(bad) / len(bad) < 0.15


def plain_features(text):
    """The features by their description: distinct words without edges, ends of several marks, cumulative shares, size."""
    slot = lambda x: zlib.crc32(x.encode()) % ordinal_quality.DIMENSIONS
    edge = ordinal_quality._EDGE.decode()
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return {slot("empty")}
    out = set()
    for w in words:
        core = w.strip(edge)
        out.add(slot("w " + core) if core else slot("m " + w[:8]))
        marks = w[len(w.rstrip(edge)) :]
        if len(marks) > 1:
            out.add(slot("t " + marks[:8]))
    lines = [x for x in low.split("\n") if x.strip()]
    distinct = set(words)
    marked = sum(1 for w in distinct if (w in edge if len(w) == 1 else w[-1] in edge and w[-2] in edge))
    shares = {"again": sum(a == b for a, b in zip(words, words[1:])) / len(words), "lines": 1 - len(set(lines)) / len(lines), "marked": marked / len(distinct), "distinct": len(distinct) / len(words) ** 0.75 / 2}
    for name, share in shares.items():
        for step in range(1, 11):
            if share * 20 >= step:
                out.add(slot(f"{name} {step}"))
    out.add(slot(f"size {min(8, len(words).bit_length())}"))
    return out


def test_classifier_scores_by_its_definition(spark):
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    model = ordinal_quality.Model(rng.normal(size=ordinal_quality.DIMENSIONS), [-0.5, 1.0])
    texts = [None, "", "Good words, good Words here.", "a$$$ b*** *** c! !", "x\nx\ny y y", "long " * 40_000, "été À la carte"]
    docs = spark.createDataFrame([(i, t, 1.0, True) for i, t in enumerate(texts)], "doc_id long, text string, score double, kept boolean")
    got = {r.doc_id: r for r in ordinal_quality.score(docs, model).collect()}
    assert len(got) == len(texts) and got[3].score == 1.0 and got[3].text == texts[3]
    for i, t in enumerate(texts):
        s = sum(model.weights[k] for k in plain_features(t))
        tails = [1 / (1 + math.exp(c - s)) for c in model.thresholds]
        assert math.isclose(got[i]["__pw_score"], s, abs_tol=1e-9), t
        assert math.isclose(got[i]["__pw_expected"], sum(tails), abs_tol=1e-9) and math.isclose(got[i]["__pw_tail"], tails[1], abs_tol=1e-9)
        assert got[i]["__pw_kept"] == (tails[1] >= 0.5)


def test_likelihood_and_its_slopes():
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    score, y, cuts = rng.normal(size=30), rng.integers(0, 4, 30), np.array([-1.0, 0.3, 1.2])

    def loss(score, cuts):
        below = lambda k, s: 0.0 if k < 0 else 1.0 if k > 2 else 1 / (1 + math.exp(s - cuts[k]))
        return -sum(math.log(below(k, s) - below(k - 1, s)) for k, s in zip(y.tolist(), score.tolist())) / len(y)

    own, by_score, by_cut = ordinal_quality.loss_and_slopes(score, y, cuts)
    assert math.isclose(own, loss(score, cuts), rel_tol=1e-9)
    for slopes, values, other in ((by_score, score, lambda v: loss(v, cuts)), (by_cut, cuts, lambda v: loss(score, v))):
        for k in range(len(values)):
            step = np.zeros(len(values))
            step[k] = 1e-6
            assert math.isclose(slopes[k], (other(values + step) - other(values - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-8)


def test_fitting_raises_the_likelihood():
    import numpy as np

    rng = random.Random(5)
    rows = [(k % 3, sorted({rng.randrange(50), 100 + k % 3, 100 + (k + rng.randrange(8) // 7) % 3})) for k in range(600)]
    model = ordinal_quality.fit([r[1] for r in rows], [r[0] for r in rows])
    y = np.array([r[0] for r in rows])
    score = np.array([sum(model.weights[k] for k in r[1]) for r in rows])
    assert ordinal_quality.loss_and_slopes(score, y, np.array(model.thresholds))[0] < 0.6 * math_log3()
    assert model.weights[100] < model.weights[101] < model.weights[102] and model.thresholds == sorted(model.thresholds)


def math_log3():
    import math

    return math.log(3)


def test_training_rows_and_ties(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "b a"), (1, "a a"), (3, None), (2, "c")], "doc_id long, text string")
    found = ordinal_quality.training_rows(docs, labels)
    assert [(i, g) for i, g, _ in found] == [(1, 1), (3, 2)]
    again = ordinal_quality.training_rows(docs, labels)
    assert [(i, g, f.tolist()) for i, g, f in found] == [(i, g, f.tolist()) for i, g, f in again]


def test_token_counts_equal_a_plain_search(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)
    byte = min(scores.values()) - token_counts.BYTE_MARGIN

    def plain(word):
        best = [(0.0, 0)] + [None] * len(word)
        for j in range(1, len(word) + 1):
            n = len(word[j - 1].encode())
            options = [(best[j - 1][0] + byte * n, best[j - 1][1] - n)]
            options += [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]
            best[j] = max(options)
        return -best[-1][1]

    texts = ODD + [" ".join(r.text.split()[:60]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["é" * 700 + "the" * 300]
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        words = WORDS.findall(text or "")
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(plain("▁" + w) for w in words), text


def test_a_small_trie_starts_anew_with_the_same_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    pick = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert pick(token_counts.token_counts(docs, path, 50)) == pick(token_counts.token_counts(docs, path))


def test_a_word_without_end_takes_bounded_memory():
    import random
    import resource

    from pagewright.llm.token_counts import Trie

    rng = random.Random(5)
    scores = {p: -float(k + 1) for k, p in enumerate(["▁a", "ab", "abc", "bca", "c", "ca", "▁", "a", "b", "cabcab"])}
    word = "▁" + "".join(rng.choices("abcd", k=3000))
    trie = Trie(scores)
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):  # a plain search
        options = [(best[end - 1][0] + trie.byte * len(word[end - 1].encode()), -best[end - 1][1] - len(word[end - 1].encode()))]
        options += [(best[end - len(p)][0] + s, -best[end - len(p)][1] - 1) for p, s in scores.items() if word[:end].endswith(p)]
        score, pieces = max(options)
        best.append((score, -pieces))
    assert trie.count(word) == best[-1][1] and len(trie.score) == 257
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert trie.count("▁" + "abcd" * 500_000) > 0
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 100 and len(trie.score) < 600


def test_a_text_of_many_long_words_starts_the_trie_anew():
    from pagewright.llm.token_counts import Trie

    scores = {"▁": -1.0, "a": -2.0, "aa": -2.5, "b": -3.0}
    words = [b"a" * k + b"b" * (k % 5) for k in range(1, 400)] * 2
    small, large = Trie(scores, 50), Trie(scores)
    assert small.count_words(words) == large.count_words(words) == sum(Trie(scores).count("▁" + w.decode()) for w in words)
    assert all(len(w) <= 256 for w in large.terminal)


def test_ids_are_the_tokenizers_own(monkeypatch):
    """Also where controls stand beside white space that isn't ASCII, and when what is remembered is forgotten."""
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 20)
    odd = ["\n  \u2028\x1c\x85\u65e5", "_\x85\t \x85\x1c\x85''s\u2028", "\u2028\x1c", "a\x1cb", "\u00bd cup", "w" * 100]
    for text in [*odd, *(f"some {k} words, {k % 7} again's \u00e9\n  x{k}" for k in range(100)), *odd]:
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in encoder.whole.encode(text, add_special_tokens=False).ids), text
    assert len(encoder.known) <= 10 and len(encoder.known.older) <= 10 and "w" * 100 not in encoder.known


def test_packing(spark):
    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = packing.pack_documents(docs_of(spark, texts), path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and 0 < r.length <= 2048 and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()), text[:50]
            at += r.length
        assert at == len(ids) and all(r.length == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(100, max(1, int(rng.expovariate(1 / rng.choice([5, 20, 50]))))) for _ in range(400)]
    placed = packing.sweep(Counter(lengths), 100)
    used, fill = Counter(), {}
    for length, rank, n, first, offset in placed:
        assert rank == used[length]
        used[length] += n
        for k in range(n):
            assert fill.get(first + k, 0) == offset
            fill[first + k] = offset + length
    assert used == Counter(lengths) and max(fill.values()) <= 100
    assert len(fill) == plain_best_fit(lengths, 100)
