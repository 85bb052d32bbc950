"""Conversation structure repair: the cheapest edits that give every conversation the role order ``(s?(ua)+)?``.

The order is an automaton of four states (nothing yet, after s, after u, after a). For every turn, from the last to the first, the cost of
finishing from each state is kept; then edits are traced forward. Both run over tensors laid out turn by turn: the conversations of a batch are bucketed by
length, and one NumPy step treats the same turn of all conversations of a bucket. Of equally cheap edits the trace takes the first letter in ASCII order; each letter leads to
one state, so that gives the least string.

Turns are range-sorted, so a conversation may have any share of all rows: what a task's batch holds of it is a block. A conversation that lies inside one batch is finished there. The blocks of the others
exchange only small matrices, cost of reaching each state from each state, whose min-plus products give the cost behind every block; blocks are then traced from all four states, and a fold over states picks one.
Within a batch, long runs are cut into segments of ``SEGMENT`` turns in the same way, so that the tensors stay wide.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import SPACES, bounded, discard, materialize, salted_join

DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
ENDS = ".!?"
#: Turns that are laid out as one sequence, and turns that a worker looks at together.
SEGMENT = 128
BATCH_ROWS = 10_000

_NEVER = 1 << 40
#: By state, the state that a written user or assistant turn leads to, and by state and kind (s, u, a, other) that of a kept turn, or -1.
_WRITE = (2, 2, 3, 2)
_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: By state, what it costs to finish, and the inserted turns that this takes.
_FINISH = (0, 2 * INSERT, INSERT, 0)
_ADDED = ("", "ua", "a", "")
#: Edits as bytes: letters of the audit, rerole and insert also with the role that is written.
_D, _IU, _IA, _K, _RU, _RA = 1, 2, 3, 4, 5, 6
_LETTERS = bytes.maketrans(bytes([_D, _IU, _IA, _K, _RU, _RA]), b"DIIKRR")
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_BLOCK = "part long, block long, kinds binary, faults binary, turns array<long>, lines array<string>, reaches array<long>"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``, and ``gone``: true for rows that stand for a dropped turn and only name their conversation.

    The checksum modulo 20 says what: 0 drops a turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    hit = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"), (fault == 3).alias("again"))
    return hit.select("conv_id", "turn", "role", "text", "gone", F.explode(F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k")).drop("k")


def _tensor(values, sizes, most: int):
    """(most, sequences): values laid end to end, as one row for each place; places behind a sequence's end are 0."""
    import numpy as np

    out = np.zeros((most, len(sizes)), values.dtype)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = values
    return out


def _backward(kind, forced, cut, sizes, ends):
    """(turns + 1, sequences, 4, e): the cost of finishing from each state before each turn; ``ends`` (sequences, 4, e) is that behind the last."""
    import numpy as np

    keep = np.array(_KEEP)
    costs = np.empty((len(kind) + 1, *ends.shape), np.int64)
    costs[-1] = ends
    for t in range(len(kind) - 1, -1, -1):
        after, more = costs[t + 1], cut[t].astype(np.int64)[:, None, None] * CUT
        to = keep[:, kind[t]].T
        kept = np.where((to >= 0)[:, :, None], np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), _NEVER)
        stays = np.minimum(kept, REROLE + after[:, _WRITE]) + more
        now = np.minimum(DELETE + after, np.where(forced[t][:, None, None], _NEVER, stays))
        user, assistant = now[:, 2].copy(), now[:, 3].copy()
        now[:, 2], now[:, 3] = np.minimum(user, INSERT + assistant), np.minimum(assistant, INSERT + user)
        now[:, :2] = np.minimum(now[:, :2], INSERT + now[:, 2:3])
        costs[t] = np.where((t < sizes)[:, None, None], now, ends)
    return costs


def _forward(costs, kind, forced, cut, sizes, state):
    """(edits (steps, sequences) as bytes, 0 where a sequence is done, the states reached) from the states given."""
    import numpy as np

    keep, write = np.array(_KEEP), np.array(_WRITE)
    at, state, steps = np.zeros(len(sizes), np.int64), state.copy(), []
    while len(live := np.flatnonzero(at < sizes)):
        t, s = at[live], state[live]
        now, after = costs[t, live, s], costs[t + 1, live]
        place, more = np.arange(len(live)), cut[t, live].astype(np.int64) * CUT
        to = keep[s, kind[t, live]]
        deletes = DELETE + after[place, s] == now
        inserts = ~deletes & (INSERT + costs[t, live, write[s]] == now)
        keeps = ~deletes & ~inserts & (to >= 0) & ~forced[t, live] & (after[place, to] + more == now)
        user = s != 2
        edit = np.where(deletes, _D, np.where(inserts, np.where(user, _IU, _IA), np.where(keeps, _K, np.where(user, _RU, _RA))))
        state[live] = np.where(deletes, s, np.where(keeps, to, write[s]))
        at[live] += ~inserts
        step = np.zeros(len(sizes), np.uint8)
        step[live] = edit
        steps.append(step)
    return np.stack(steps) if steps else np.zeros((0, len(sizes)), np.uint8), state


def _buckets(sizes):
    """Numbers of sequences of about the same length."""
    import numpy as np

    width = np.ceil(np.log2(np.maximum(sizes, 1)))
    return [np.flatnonzero(width == w) for w in np.unique(width)]


class Turns:
    """Sequences of turns laid end to end (kind, forced, cut; sizes), cut into segments of at most SEGMENT turns."""

    def __init__(self, kind, forced, cut, sizes):
        import numpy as np

        self.parts = np.maximum(1, -(-sizes // SEGMENT))
        self.owner = np.repeat(np.arange(len(sizes)), self.parts)
        self.first = np.cumsum(self.parts) - self.parts
        number = np.arange(len(self.owner)) - self.first[self.owner]
        self.sizes = np.minimum(SEGMENT, sizes[self.owner] - number * SEGMENT)
        self.starts = (np.cumsum(sizes) - sizes)[self.owner] + number * SEGMENT
        self.values = kind, forced, cut

    def _layout(self, which):
        import numpy as np

        sizes = self.sizes[which]
        flat = np.arange(sizes.sum()) + np.repeat(self.starts[which] - (np.cumsum(sizes) - sizes), sizes)
        return [_tensor(v[flat], sizes, int(sizes.max(initial=0))) for v in self.values], sizes

    def reaches(self, which=None):
        """(segments, 4, 4): the cost of getting from each state before a segment to each state behind it."""
        import numpy as np

        which = np.arange(len(self.owner)) if which is None else which
        out = np.empty((len(which), 4, 4), np.int64)
        for bucket in _buckets(self.sizes[which]):
            tensors, sizes = self._layout(which[bucket])
            ends = np.repeat(np.where(np.eye(4, dtype=bool), 0, _NEVER)[None], len(bucket), 0)
            out[bucket] = np.minimum(_backward(*tensors, sizes, ends)[0], _NEVER)
        return out

    def whole_reaches(self):
        """(sequences, 4, 4): the same of whole sequences."""
        import numpy as np

        parts = self.reaches()
        out = parts[self.first]
        for k in np.flatnonzero(self.parts > 1):
            for m in parts[self.first[k] + 1 : self.first[k] + self.parts[k]]:
                out[k] = np.minimum((out[k][:, :, None] + m[None]).min(axis=1), _NEVER)
        return out

    def solve(self, ends, states):
        """(edits, states): for every sequence and each of the ``states`` it may begin in, its cheapest edits and the state behind it; ``ends`` (sequences, 4) is the cost of finishing there."""
        import numpy as np

        several = self.parts > 1
        behind = ends[self.owner].copy()
        if several.any():
            which = np.flatnonzero(several[self.owner])
            reach = dict(zip(which.tolist(), self.reaches(which)))
            for k in np.flatnonzero(several):
                for part in range(self.first[k] + self.parts[k] - 2, self.first[k] - 1, -1):
                    behind[part] = (reach[part + 1] + behind[part + 1][None]).min(axis=1)
        edits, reached = [{} for _ in self.owner], [{} for _ in self.owner]
        for bucket in _buckets(self.sizes):
            tensors, sizes = self._layout(bucket)
            costs = _backward(*tensors, sizes, behind[bucket][:, :, None])[..., 0]
            for state in range(4):
                asked = several[self.owner[bucket]] | (state in states)
                own = np.flatnonzero(asked)
                if not len(own):
                    continue
                steps, after = _forward(costs[:, own], *[x[:, own] for x in tensors], sizes[own], np.full(len(own), state))
                made = steps > 0
                for j, n in enumerate(own):
                    edits[bucket[n]][state], reached[bucket[n]][state] = steps[made[:, j], j].tobytes(), int(after[j])
        out, to = [], []
        for k, (at, parts) in enumerate(zip(self.first, self.parts)):
            told, ended = [], []
            for state in states:
                done = []
                for part in range(at, at + parts):
                    done.append(edits[part][state])
                    state = reached[part][state]
                told.append(b"".join(done))
                ended.append(state)
            out.append(told)
            to.append(ended)
        return out, to


def _lines(edits: bytes, lines: list[str]) -> list[str]:
    """The repaired lines: ``lines`` are ``role:text`` of all turns."""
    out, at = [], 0
    for edit in edits:
        if edit in (_IU, _IA):
            out.append("user:" if edit == _IU else "assistant:")
            continue
        if edit == _K:
            out.append(lines[at][1])
        elif edit != _D:
            out.append(("user:" if edit == _RU else "assistant:") + lines[at][0])
        at += 1
    return out


def _price(edits: bytes, cut) -> int:
    """What the edits cost; ``cut`` says which turns are truncated."""
    import numpy as np

    found = np.frombuffer(edits, np.uint8)
    turns = found[(found != _IU) & (found != _IA)]
    return int(DELETE * (found == _D).sum() + INSERT * (len(found) - len(turns)) + REROLE * (turns >= _RU).sum() + CUT * (cut & (turns != _D)).sum())


def _illegal(kind):
    """For neighbours in an array of kinds: not one of su, ua and au."""
    a, b = kind[:-1], kind[1:]
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


class _Tally:
    """What is counted of a conversation while its turns pass by in order."""

    def __init__(self):
        self.counts, self.illegal, self.distinct, self.kind, self.low, self.high = [0, 0, 0, 0], 0, 0, None, None, None

    def add(self, kinds, faults, turns: list) -> None:
        import numpy as np

        if not len(kinds):
            return
        self.counts = [a + int(b) for a, b in zip(self.counts, np.bincount(faults, minlength=4))]
        before = kinds if self.kind is None else np.concatenate([np.array([self.kind], kinds.dtype), kinds])
        self.illegal, self.kind = self.illegal + int(_illegal(before).sum()), kinds[-1]
        for turn in turns:
            if turn is not None and turn != self.high:
                self.distinct, self.high = self.distinct + 1, turn
                self.low = turn if self.low is None else self.low

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, "blank": self.counts[_BLANK], "duplicate": self.counts[_DUPLICATE], "truncated": self.counts[_TRUNCATED], "illegal": self.illegal}


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _first_pass(turns: DataFrame) -> DataFrame:
    """Finished conversations, and the blocks (part not null) of those that touch the edge of a batch. ``turns`` is sorted within its partitions."""
    schema = f"{RESULT}, {_BLOCK}"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        arrow, number = _arrow(schema), 0
        for batch in bounded(batches, BATCH_ROWS):
            if not batch.num_rows:
                continue
            conv, part = batch.column(0), batch.column(1)[0].as_py()
            ids, known = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_valid().to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])))
            run_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, batch.num_rows)))
            there = ~batch.column(3).to_numpy(zero_copy_only=False)
            kind, fault = (batch.column(c).to_numpy()[there].astype(np.uint8) for c in (4, 5))
            sizes = np.bincount(run_of[there], minlength=len(begins))
            here = np.flatnonzero(there).tolist()
            turn, role, text = (batch.column(c).to_pylist() for c in (2, 6, 7))
            turn, lines = [turn[k] for k in here], [(text[k], f"{role[k]}:{text[k]}") for k in here]
            open_ = np.zeros(len(begins), bool)
            open_[[0, -1]] = True
            ends = np.cumsum(sizes)
            of = lambda runs: np.flatnonzero(np.isin(run_of[there], runs))
            forced, cut = (fault == _BLANK) | (fault == _DUPLICATE), fault == _TRUNCATED
            rows = []
            done = np.flatnonzero(~open_)
            own = of(done)
            found, states = Turns(kind[own], forced[own], cut[own], sizes[done]).solve(np.tile(_FINISH, (len(done), 1)), (0,))
            for k, (edits,), (state,) in zip(done.tolist(), found, states):
                span = slice(ends[k] - sizes[k], ends[k])
                tally = _Tally()
                tally.add(kind[span], fault[span], turn[span])
                edits += bytes({"u": _IU, "a": _IA}[c] for c in _ADDED[state])
                repaired = "\n".join(_lines(edits, lines[span])).encode("utf-8", "surrogatepass")
                rows.append({"conv_id": conv[begins[k]].as_py(), **tally.row(), "cost": _price(edits, cut[span]), "audit": edits.translate(_LETTERS).decode(), "repaired_sha256": hashlib.sha256(repaired).hexdigest()})
            left = np.flatnonzero(open_)
            own = of(left)
            reaches = Turns(kind[own], forced[own], cut[own], sizes[left]).whole_reaches()
            for k, reach in zip(left.tolist(), reaches):
                span = slice(ends[k] - sizes[k], ends[k])
                flat = [x for pair in lines[span] for x in pair]
                rows.append({"conv_id": conv[begins[k]].as_py(), "part": part, "block": number, "kinds": kind[span].tobytes(), "faults": fault[span].tobytes(), "turns": turn[span], "lines": flat, "reaches": reach.ravel().tolist()})
                number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return turns.mapInArrow(run, schema)


def _fold(blocks: DataFrame, column: str, schema: str, step, start) -> DataFrame:
    """(part, block, value): ``step`` over each conversation's blocks in order, from numbers of ``column`` alone."""
    import pyarrow as pa

    listed = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "block", column))).alias("x")).select("x")

    def run(batches):
        arrow = _arrow(schema)
        for batch in batches:
            for row in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(step(row.as_py(), start)), schema=arrow)

    return listed.mapInArrow(run, schema)


def _costs_behind(blocks: list, finish):
    import numpy as np

    behind, last = np.array(finish, np.int64), True
    for b in reversed(blocks):
        yield {"part": b["part"], "block": b["block"], "behind": behind.tolist(), "last": last}
        behind, last = (np.array(b["reaches"], np.int64).reshape(4, 4) + behind[None]).min(axis=1), False


def _states_before(blocks: list, state):
    for b in blocks:
        yield {"part": b["part"], "block": b["block"], "state": state}
        state = b["reached"][state]


def _trace(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, block, edits, reached): each block's edits from all four states, as ``blocks`` have ``behind``."""
    schema = "conv_id long, part long, block long, edits array<binary>, reached array<long>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in bounded(batches, 64):
            rows = batch.to_pylist()
            kind, fault = (np.frombuffer(b"".join(r[c] for r in rows), np.uint8) for c in ("kinds", "faults"))
            turns = Turns(kind, (fault == _BLANK) | (fault == _DUPLICATE), fault == _TRUNCATED, np.array([len(r["kinds"]) for r in rows], np.int64))
            edits, reached = turns.solve(np.array([r["behind"] for r in rows], np.int64).reshape(-1, 4), (0, 1, 2, 3))
            for r, told, to in zip(rows, edits, reached):
                if r["last"]:
                    told = [e + bytes({"u": _IU, "a": _IA}[c] for c in _ADDED[s]) for e, s in zip(told, to)]
                r |= {"edits": told, "reached": to}
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("conv_id", "part", "block", "edits", "reached")} for r in rows], schema=_arrow(schema))

    return blocks.select("conv_id", "part", "block", "kinds", "faults", "behind", "last").mapInArrow(run, schema)


def _last_pass(blocks: DataFrame) -> DataFrame:
    """One row for each conversation of ``blocks``, which have their edits and pass by in order, one at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        arrow, now, tally = _arrow(RESULT), None, None

        def row():
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], **tally.row(), "cost": cost, "audit": b"".join(audit).decode(), "repaired_sha256": digest.hexdigest()}], schema=arrow)

        for batch in bounded(batches, 16):
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        yield row()
                    now, tally, cost, audit, digest, begun = (r["conv_id"],), _Tally(), 0, [], hashlib.sha256(), False
                kinds, faults = (np.frombuffer(r[c], np.uint8) for c in ("kinds", "faults"))
                tally.add(kinds, faults, r["turns"])
                cost += _price(r["edits"], faults == _TRUNCATED)
                audit.append(r["edits"].translate(_LETTERS))
                for line in _lines(r["edits"], list(zip(r["lines"][::2], r["lines"][1::2]))):
                    digest.update(b"\n" * begun + line.encode("utf-8", "surrogatepass"))
                    begun = True
        if now is not None:
            yield row()

    return blocks.mapInArrow(run, RESULT)


def _is_in(text: Column, letters: str) -> Column:
    return text.isin(*letters)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text, and ``gone`` if there is such a column; others are ignored): its faults, and its cheapest repair.

    A conversation's rows are taken by turn (nulls first), ties by role and text. A row's first fault counts: blank (no word), duplicate (role and text seen earlier in the conversation), truncated
    (its last visible character isn't one of ``.!?``). ``gaps`` are turn numbers missing between the least and the largest; ``illegal`` are neighbours whose roles' initials aren't su, ua or au. ``cost``, ``audit`` (an initial for
    each edit: Delete, Insert, Keep, Rerole) and ``repaired_sha256`` (of ``role:text`` lines) describe the repair. Blank and duplicate rows are always deleted, what stays truncated costs one more.

    Null roles and texts are one space, so such rows are blank or of another role; a null conv_id is a conversation of its own; rows with ``gone`` only name theirs, and a conversation without other rows has zeros, an
    empty audit and the digest of nothing. Repeated rows are duplicates. An empty table gives no rows. Texts are read whole, a batch of bounded size at a time. A conversation may have any share of the rows: its digest alone,
    which nothing can split, reads its repaired lines in one task, one block after the other, and its audit has a letter for each of its rows.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), gone.alias("gone"))
    rows = rows.select("conv_id", *[F.when(F.col("gone"), None).otherwise(F.col(c)).alias(c) for c in ("turn", "role", "text")], "gone")
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    same = F.sha2(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.concat("role", "text")).cast("binary"), 256)
    blank = F.coalesce(seen == "", F.lit(False))
    rows = rows.withColumn("blank", blank).withColumn("whole", F.coalesce(_is_in(F.substring(seen, -1, 1), ENDS), F.lit(False))).withColumn("kind", kind)
    rows = rows.withColumn("same", F.when(~F.col("gone") & ~blank, same)).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "turns")
    firsts = rows.where("same is not null").groupBy("same").agg(F.min(F.struct("turn", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    marked = salted_join(rows, materialize(firsts, "turns-seen"), ["same"], ["uid"])
    later = F.coalesce(F.col("first.uid") != F.col("uid"), F.lit(False))
    fault = F.when(F.col("blank"), _BLANK).when(later, _DUPLICATE).when(~F.col("whole"), _TRUNCATED).otherwise(0)
    order = ["conv_id", "turn", "role", "text", "uid"]
    marked = marked.select("conv_id", "turn", "role", "text", "uid", "gone", "kind", fault.alias("fault"))
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ranged.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "gone", "kind", "fault", "role", "text")
    passed = materialize(_first_pass(ordered), "turns-passed")
    discard(rows)
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    blocks = passed.where("part is not null")
    behind = _fold(blocks, "reaches", "part long, block long, behind array<long>, last boolean", _costs_behind, _FINISH)
    traced = materialize(_trace(blocks.join(behind, ["part", "block"])), "turns-traced")
    before = _fold(traced, "reached", "part long, block long, state long", _states_before, 0)
    chosen = traced.join(before, ["part", "block"]).select("part", "block", F.element_at("edits", (F.col("state") + 1).cast("int")).alias("edits"))
    told = blocks.drop("edits").join(chosen, ["part", "block"]).select("conv_id", "part", "block", "kinds", "faults", "turns", "lines", "edits")
    last = _last_pass(told.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block"))
    return passed.where("part is null").select(*names).union(last.select(*names))
