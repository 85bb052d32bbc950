"""Mixing, chat formatting, archives and SimHash near-duplicates on small odd tables."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagewright.llm")

from pagewright.llm import arc_warc, chat_format, mixing, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rate string, salt int"


def water_fill(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    goal, full = {}, set()
    budget = share * sum(sizes.values())
    while True:
        rest = budget - sum(repeats * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        goal = {s: repeats * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if goal[s] > repeats * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "B", "é", "z", "\U0001f642", "￿"]
    rows = [(i, "w " * int(rng.paretovariate(1)), "en", rng.choice(names), 0, "x", 1) for i in range(400)] + [(None, None, None, None, None, None, None), (5, "", None, "none", 0, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(docs, keep=("doc_id", "source")).collect()
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = water_fill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]), r
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


def test_more_sources_than_are_sent(spark, monkeypatch):
    rows = [(i, "a b", "en", f"s{i % 9}", 0, "", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(str, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(map(str, mixing.plan(docs).collect())) == want


def test_copies_follow_the_rate(spark):
    docs = spark.createDataFrame([(i, "w", "en", "ab"[i % 2], 0, "", 0) for i in range(4000)], DOCS)
    got = mixing.plan(docs).collect()
    for source in {r.target for r in got}:
        own = [r for r in got if r.target == source]
        assert sum(r.copies for r in own) == pytest.approx(source, rel=0.05)


def test_repeated_rows_take_their_share(spark, monkeypatch):
    """Also where the keys of repeated rows are too many to be sent around, and whatever the other columns hold."""
    rows = [(1, "a", "one two three four five")] * 1000 + [(k, "b", f"w{k} " * 10) for k in range(300)] + [(None, "c", "x y")] * 7 + [(7, None, None)] * 3
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, text string, k long")
    for limit in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
        got = mixing.plan(docs, keep=("source", "k")).collect()
        assert len(got) == len(rows) and len({r.k for r in got}) == len(rows)
        for source in ("a", "c"):
            own = [r for r in got if r.source == source]
            assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= own[0].size and max(r.copies for r in own) <= 2
        assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert sorted((r.source or "", r.copies) for r in got) == sorted((r.source or "", r.copies) for r in mixing.plan(docs.repartition(5), keep=("source",)).collect())


def test_long_texts_are_mixed_whole(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 400_000), (2, "a", "w")], "doc_id long, source string, text string")
    assert sorted(r.size for r in mixing.plan(docs).collect()) == [1, 400_000]


def test_empty_mix(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


TURNS = "conv_id long, turn long, role string, text string, block string, n int"
NASTY = ["", "\\", "\\\\[INST]", "[INST] x [/INST]", "</s><s>", "[\\INST]", "[OUT] [AS] [TURN] </s>", " [/INST] ", "a\nb", "$1 \\1", "[SYS][/SYS][/TURN]", "é🙂"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "[INST] x"]), rng.choice(NASTY) + rng.choice(NASTY), "x", 1))
    rows += [(100, None, None, None, None, None), (None, 1, "user", "q", None, None), (None, 2, "assistant", "r", None, None), (101, 1, "assistant", "a", "", 0), (101, 1, "assistant", "a", "", 0)]
    turns = spark.createDataFrame(rows, TURNS)
    made = chat_format.examples(turns)
    got = {r.conv_id: r for r in chat_format.digest(made).collect()}
    convs = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), own
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        assert (r.target is None) == (r.loss_length == 0 and (r.target is None))
        if r.target is not None:
            span = r.text[r.loss_start : r.loss_start + r.loss_length]
            assert not any(c in span for c in chat_format.CONTROL) and r.text.endswith(span + " </s>")
    assert made.where("target is not null").count() == sum(r == "assistant" for own in convs.values() for r, _ in own)


def test_a_long_conversation_of_long_turns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"[OUT] {k} " * (20_000 if k == 3 else 50), "", 0) for k in range(60)]
    got = chat_format.digest(chat_format.examples(spark.createDataFrame(rows, TURNS))).first()
    loss = "".join(r[3] for r in rows if r[2] == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (60, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()


def test_no_turns(spark):
    assert chat_format.digest(chat_format.examples(spark.createDataFrame([], TURNS))).count() == 0


PAGES = "page_id long, url string, html string, kind string, digest int"
HTML = ["", None, "a", "\r\n\r\nWARC/1.1\r\n", "filedesc:// 1\n\n", "é\x00\x01", "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "x" * 70_000, "a\n", "a"]


@pytest.mark.parametrize("archive_bytes", [200, 1 << 24])
def test_archives(spark, archive_bytes):
    rows = [(i, f"http://h/{i} x#y", HTML[i % len(HTML)], "k", 0) for i in range(57)] + [(None, None, "a", None, None), (None, "u", "only null", None, None), (60, "u", "twice", "", 0), (60, "u", "twice", "", 0), (None, "u", "only null", None, None)]
    got = arc_warc.archive_pages(spark.createDataFrame(rows, PAGES), archive_bytes=archive_bytes).collect()
    best = {}
    for p, _, h, *_ in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", p))
    want = []
    for p, _, h, *_ in rows:
        b = best.get(h or "")
        data = (h or "").encode()
        revisit = b is not None and b != p
        want.append((str(p), len(data), arc_warc.sha1_base32(data), "revisit" if revisit else "response", str(b) if revisit else "None", b"" if revisit else data))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), bytes(r.payload)) for r in got) == sorted(want)


def test_no_pages(spark):
    assert arc_warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(spark, version):
    payloads = [b"", b"one\n\n", b"filedesc://"]
    rows = spark.createDataFrame([(k, f"http://h/ {k}\t\r\n", len(p)) for k, p in enumerate(payloads)] + [(None, None, 99)], "k long, u string, n long")
    lines = [r.h.encode() for r in rows.select(arc_warc.header_line(version, F.col("k"), F.col("u"), F.col("n")).alias("h")).collect()]
    block = arc_warc.version_block(version)
    records = b"".join(line + b"\n" + p + b"\n" for line, p in zip(lines, payloads))
    got = list(arc_warc.arc_records(block + records))
    assert [p for _, p in got] == payloads
    assert [h["URL"].partition(b"#")[0] for h, _ in got] == [b"http://h/%20" + str(k).encode() + b"%09%0D%0A" for k in range(3)]
    assert set(got[0][0]) == set(arc_warc.ARC_FIELDS[version])
    for bad in (records, block + b"http://h 1\n", block + lines[3] + b"\nshort", block.replace(b"URL", b"URI")):
        with pytest.raises(arc_warc.ArchiveError):
            list(arc_warc.arc_records(bad))
    assert arc_warc.timestamp(b"20010203040506") == "2001-02-03T04:05:06Z"
    assert arc_warc.timestamp(b"2001") == "2001-01-01T00:00:00Z"
    assert arc_warc.timestamp(b"soon") == "1970-01-01T00:00:00Z"


def test_archives_are_of_one_size_whatever_repeats(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://h/", f"<p>{'x' * 2000}</p>")] * 400, "page_id long, url string, html string")
    arc_warc.write_arc(pages, f"file://{tmp_path}/arc", 50_000)
    sizes = [len(list(arc_warc.arc_records(gzip.decompress(f.read_bytes())))) for f in (tmp_path / "arc").glob("part-*.gz")]
    assert sum(sizes) == 400 and len(sizes) > 10 and max(sizes) < 2 * 400 / len(sizes)


def test_odd_urls_and_refers_to(spark):
    rows = [(1, "http://h/a b\r\nWARC-Type: x", "same", 1), (2, None, "same", 1), (3, "", None, 1), (None, "u", "other", 1)]
    got = arc_warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")).collect()
    assert {(r.page_id, r.url, r.record_type, r.refers_to) for r in got if r.page_id != 3} == {(1, "http://h/a%20b%0D%0AWARC-Type:%20x", "revisit", 2), (2, next(r.url for r in got if r.page_id == 2), "response", None), (None, "u", "response", None)}


def test_documents_without_an_id_draw_apart(spark):
    docs = spark.createDataFrame([(None, f"w{k} " * 10, "a") for k in range(400)] + [(1, "x " * 10_000, "b"), (2, "y", "c")], "doc_id long, text string, source string")
    rows = mixing.plan(docs, weights=(1, 1, 1), share=0.4).where("size = 10").collect()
    taken = sum(r.size * r.copies for r in rows)
    assert abs(taken - rows[0].target) < 0.15 * rows[0].target and 0 < rows[0].rate % 1 < 1


def near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def test_simhash_components(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(3, 120))) for _ in range(60)]
    texts += [near(rng, t) for t in texts for _ in range(3)] + [texts[0], texts[0], "", None, " \n", "A B c", "a b C", "A B"]
    rows = [(3 * i + 1, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)] + [(None, texts[1], None, None, None, None, None), (1, "elsewhere", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash_dedup.near_duplicates(docs).collect()
    prints = [simhash_dedup.fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    low = [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == sorted((str(r[0]), signed(p), str(c)) for r, p, c in zip(rows, prints, low))
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in kept.collect()) == sorted(str(r[0]) + str(r[1]) for r, c in zip(rows, low) if r[0] == c)


def test_fingerprint_by_definition():
    import xxhash

    words = "Ab c\td É f g".split()
    text = "Ab c\td É f g"
    low = [w.replace("A", "a") for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[k : k + 4]).encode(), 42) for k in range(len(low) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash_dedup.fingerprint(text) == want
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0
    assert simhash_dedup.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_a_long_text_is_hashed_whole():
    import xxhash

    words = [f"W{k % 1009}é" for k in range(simhash_dedup._BLOCK + 5000)]
    low = [w.replace("W", "w") for w in words]
    votes = [0] * 64
    for k in range(len(low) - 3):
        h = xxhash.xxh64_intdigest(" ".join(low[k : k + 4]).encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    assert simhash_dedup.fingerprint("\n".join(words)) == sum(1 << b for b in range(64) if 2 * votes[b] > len(low) - 3)


@pytest.mark.parametrize("distance", range(1, 7))
def test_every_pair_within_the_distance_is_linked_once(spark, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(6):
            q = p
            for bit in rng.sample(range(64), rng.randrange(1, distance + 3)):
                q ^= 1 << bit
            prints.add(q)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    got = [tuple(sorted(r)) for r in simhash_dedup.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), distance).collect()]
    want = {tuple(sorted((signed(p), signed(q)))) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_first(empty).count() == 0
