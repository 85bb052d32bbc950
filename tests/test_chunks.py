"""Bodies in chunks: framing, the growing files' source, and the sink."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright.sources import items
from pagewright.sources.chunks import ChunkFiles
from pagewright.streaming import framing, sink

CHUNK = "document_id string, request_id string, begin long, bytes binary, last boolean"


def cut(body, rng, most=9):
    """A body's chunks at random bytes: (begin, bytes, last)."""
    at, out = 0, []
    while at < len(body):
        n = rng.randrange(1, most)
        out.append((at, body[at : at + n], False))
        at += n
    return [*out, (len(body), b"", True)]


def body_of(lines, tail="\n"):
    return ("\n".join(lines) + tail).encode()


LINES = ['{"type":"progress","日本":1}', "  ", "é😀" * 9, "", "x", '{"type":"final"}']
SHOWN = [t for t in LINES if t.strip()]


@pytest.mark.parametrize("tail", ["\n", "", "\n\n "])
def test_any_cut_gives_the_lines(tail):
    rng = random.Random(tail)
    for _ in range(150):
        chunks = cut(body_of(LINES, tail), rng)
        if rng.random() < 0.5:  # out of order, repeated and overlapping
            body = body_of(LINES, tail)
            chunks += [(a, body[a : a + 12], False) for a in rng.sample(range(len(body)), 5)]
            rng.shuffle(chunks)
        framer, got = framing.Framer(1000), []
        for k, chunk in enumerate(chunks):
            got += framer.feed(*chunk)
            if k % 7 == 3:
                framer = framing.Framer(1000, *framer.state())
        assert got == [(n, t, None) for n, t in enumerate(SHOWN)] and framer.ended


@pytest.mark.parametrize("body", [body_of(["ok", "y" * 31, "after"]), body_of(["ok", "é" * 31], ""), body_of(["ok"]) + b"z" * 500])
def test_a_line_over_the_limit_ends_its_search(body):
    rng = random.Random(1)
    for _ in range(40):
        framer, got = framing.Framer(30), []
        for chunk in cut(body, rng, 40):
            got += framer.feed(*chunk)
        assert got == [(0, "ok", None), (1, None, "provider_malformed_response")]


def test_a_gap_is_not_bridged_and_waits_for_so_long():
    framer = framing.Framer(10)
    assert list(framer.feed(0, b"a\n", False)) == [(0, "a", None)]
    assert list(framer.feed(30, b"b" * 30, False)) == []
    assert list(framer.feed(60, b"b" * 30, False)) == [(1, None, "provider_malformed_response")]


def bodies(rng, n=12):
    return {(f"d{k}", "r"): body_of([json.dumps({"type": "progress", "evaluated": e, "total": 9, "document_id": f"d{k}", "model": "日本é"}, ensure_ascii=k % 2 == 0) for e in range(rng.randrange(1, 8))], "\n" * (k % 3)) for k in range(n)}


def lines_in(all_):
    return sorted((*key, n, line) for key, body in all_.items() for n, line in enumerate(t for t in body.decode().split("\n") if t.strip()))


def test_a_table_of_chunks(spark):
    rng = random.Random(3)
    all_ = bodies(rng)
    rows = [(*key, *chunk) for key, body in all_.items() for chunk in cut(body, rng)] * 2 + [("none", "r", 0, None, None), (None, "r", 0, b"x\ny", True)]
    rng.shuffle(rows)
    got = framing.frame_chunks(spark.createDataFrame(rows, CHUNK).repartition(3)).collect()
    assert sorted((r.document_id, r.request_id, r.line_no, r.line) for r in got if r.document_id) == lines_in(all_)
    assert [r.line for r in got if r.document_id is None] == ["x", "y"]
    assert framing.frame_chunks(spark.createDataFrame([], CHUNK)).collect() == []


def test_growing_files_across_restarts(spark, tmp_path):
    """Files grow by random bytes between the runs of a query that is started anew each time; some are marked as complete late or never."""
    spark.dataSource.register(ChunkFiles)
    rng = random.Random(4)
    all_ = bodies(rng)
    folder = tmp_path / "bodies"
    folder.mkdir()
    out, written = str(tmp_path / "lines"), {key: 0 for key in all_}
    for round_ in range(4):
        for k, (key, body) in enumerate(all_.items()):
            if k > 4 * (round_ + 1):
                continue
            n = len(body) if round_ == 3 else min(len(body), written[key] + rng.randrange(0, 120))
            name = folder / f"{k:04d}~{key[0]}~{key[1]}"
            with open(name, "ab") as f:
                f.write(body[written[key] : n])
            written[key] = n
            if n == len(body) and k != 2:
                (folder / f"{name.name}.done").touch()
        chunks = spark.readStream.format("pagewright_chunks").option("chunkBytes", 50).load(str(folder))
        query = sink.message_sink(framing.frame_stream(chunks), out, "lines", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = [json.loads(r.value) for r in spark.read.text(out).collect()]
    want = [x for x in lines_in(all_) if x[0] != "d2" or all_["d2", "r"].endswith(b"\n")]
    assert sorted((r["document_id"], r["request_id"], r["line_no"], r["line"]) for r in got) == want


def test_the_source_forgets_complete_files(tmp_path):
    from pagewright.sources.chunks import ChunkReader

    for k in range(6):
        (tmp_path / f"{k}~d~r{k}").write_bytes(b"x" * k)
        if k != 3:
            (tmp_path / f"{k}~d~r{k}.done").touch()
    reader = ChunkReader({"path": str(tmp_path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"through": "2~d~r2", "open": {"3~d~r3": [3, False], "4~d~r4": [4, True], "5~d~r5": [5, True]}}
    chunks = [c for p in reader.partitions(start, end) for c in reader.read(p)]
    assert [(c[1], len(c[3]), c[4]) for c in chunks] == [("r0", 0, True), ("r1", 1, True), ("r2", 2, True), ("r3", 3, False), ("r4", 4, True), ("r5", 5, True)]
    assert reader.partitions(end, end) == []
    (tmp_path / "3~d~r3.done").touch()
    last = reader.latestOffset()
    assert last == {"through": "5~d~r5", "open": {}}
    assert [(p.name, p.begin, p.end, p.last) for p in reader.partitions(end, last)] == [("3~d~r3", 3, 3, True)]


def test_a_batch_written_again_leaves_no_second_line(spark, tmp_path):
    rows = spark.createDataFrame([("d", "r", "progress", k) for k in range(20)], "document_id string, request_id string, type string, evaluated int")
    write = sink.write_batch(str(tmp_path / "out"), "q")
    write(rows, 0)
    write(rows.where("evaluated < 5"), 1)
    broken = rows.withColumn("evaluated", F.when(F.col("evaluated") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("evaluated")))
    with pytest.raises(Exception, match="lost"):
        write(broken, 2)
    for batch in (0, 1, 1):
        write(rows if batch == 0 else rows.where("evaluated < 5"), batch)
    got = items.read_messages(spark, str(tmp_path / "out"))
    assert sorted(r.evaluated for r in got.collect()) == sorted([*range(20), *range(5)])
    assert '"request_id"' in spark.read.text(str(tmp_path / "out")).first().value
