"""SentencePiece encoding and decoding by vectorised merge rounds.

Encoding follows the byte-pair rule of the library: of all neighbouring symbols that make a piece of the vocabulary, the pair of the best score, leftmost first,
becomes one symbol, until no pair is left. Here the symbols of all distinct words of a batch lie in flat arrays, cut into segments that no merge can cross. In each
round every segment finds its best rank and merges all pairs of that rank at once, leftmost first where they overlap, and what is merged away is compacted out of the arrays.
A merge can make a neighbouring pair of the same or a better rank, which would come before the segment's later ones; such a merge is the segment's last in that round. So rounds give what single merges give.

A word starts at a word mark behind another character: no piece has a mark inside. Within words, a segment ends between two characters that no piece has side by side.
Both follow from the vocabulary, which is checked. Characters without a piece become bytes.

Decoding joins the pieces' bytes in one flat array. Nothing is shuffled; distinct words are remembered up to ``MOST_KNOWN`` characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded

MARK = "▁"
_NONE = (1 << 31) - 1
#: Characters of words that a worker remembers, of a text that are looked at at once, and bytes of texts that are handed to it at once.
MOST_KNOWN = 4 << 20
SLICE = 1 << 20
BATCH_BYTES = 4 << 20
#: Kinds of pieces and the name of byte-pair models in the files of the library (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_PAIR_MODEL = 2


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message: integers, or bytes of all else."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A byte-pair model file of the library, with the tables that merge rounds need."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = list(_fields(file.serialized_model_proto()))
        kind = next((v for n, part in parts if n == 2 for m, v in _fields(part) if m == 3), None)
        spec = dict(field for n, part in parts if n == 3 for field in _fields(part))
        # the normaliser's own fields: 2 its table, 3 mark before the text, 4 fewer spaces, 5 marks for spaces; absent ones are true
        if kind != _PAIR_MODEL or spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("only byte-pair models that leave texts as they are, with marks for spaces, are supported")
        self.prefix = bool(spec.get(3, 1))
        self.surface = next((v.decode() for n, part in parts if n == 2 for m, v in _fields(part) if m == 44), " ⁇ ")
        kinds = [dict(_fields(part)).get(3, _NORMAL) for n, part in parts if n == 1]
        if {_USER, _UNUSED} & set(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        pieces = [file.id_to_piece(i) for i in range(len(kinds))]
        self.unknown = kinds.index(_UNKNOWN)
        byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == _BYTE}
        self.bytes = np.array([byte[b] for b in range(256)], np.int32) if len(byte) == 256 else None
        self.is_byte = np.array([k == _BYTE for k in kinds])
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == _NORMAL}
        self._tables(normal, {p: file.get_score(i) for p, i in normal.items()}, len(pieces))
        texts = ["" if k == _CONTROL else self.surface if k == _UNKNOWN else bytes([int(p[1:-1], 16)]) if k == _BYTE else p.replace(MARK, " ") for p, k in zip(pieces, kinds)]
        texts = [t if isinstance(t, bytes) else t.encode() for t in texts]
        self.text_size = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.marked = np.array([k == _NORMAL and p.startswith(MARK) for p, k in zip(pieces, kinds)])
        self.forget()

    def _tables(self, normal: dict[str, int], scores: dict[str, float], count: int) -> None:
        import numpy as np

        letters = sorted(set("".join(normal)))
        symbol = {c: normal.get(c, count + k) for k, c in enumerate(letters)}  # a letter without a piece is a symbol of its own, which only merges
        self.symbols, self.count = count + len(letters), count
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in letters]] = [symbol[c] for c in letters]
        self.letter_of = np.zeros(0x110000, np.int32)  # 0 for what no piece has
        self.letter_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        beside = {(p[k], p[k + 1]) for p in normal for k in range(len(p) - 1)}
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in beside:
            self.beside[self.letter_of[ord(a)], self.letter_of[ord(b)]] = True
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        known = symbol | normal
        pairs = sorted((known[p[:k]] * self.symbols + known[p[k:]], rank[scores[p]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        self.keys, self.ranks, self.merged = (np.array([x[k] for x in pairs], t) for k, t in enumerate((np.int64, np.int32, np.int32)))
        marks = {len(p) for p in normal if not p.strip(MARK)}
        self.whole = any(a != MARK and b == MARK for a, b in beside)  # a mark inside a piece: no word may be cut
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # pieces of marks alone share one score below all others, so a run of marks is merged last and from the left; where the longest such
        # piece always comes first, long runs are cut into it
        longest, made = max(marks, default=0), {p: s for p, s in scores.items() if len(p) > 1}
        worst = min(made.values(), default=0.0)
        last = longest > 1 and all((s == worst) == (not p.strip(MARK)) for p, s in made.items())
        alone = lambda n: self.merge([MARK * n])[0].tolist()
        if last and all(alone(n) == [normal[MARK * longest], *alone(n - longest)] for n in range(longest + 1, 4 * longest)):
            self.words = re.compile(f"{MARK}{{{longest}}}(?={MARK})|{MARK}{{1,{longest}}}[^{MARK}]*|[^{MARK}]+")

    def forget(self) -> None:
        """Starts anew with the words that are remembered."""
        import numpy as np

        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pairs(self, left, right):
        """(rank, piece) of pairs of symbols; the rank is _NONE where they make no piece or a symbol is below 0."""
        import numpy as np

        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.symbols + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.merged[at]

    def merge(self, words: list[str]):
        """(ids, sizes): the pieces of all words, laid end to end, and how many each has."""
        import numpy as np

        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(code), -2, np.int32)  # a symbol where one starts; -2 where none does
        sym, pos = self.symbol_of[code], np.arange(len(code))
        letter = self.letter_of[code]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.beside[letter[:-1], letter[1:]]
        cut[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        seg = np.cumsum(cut) - 1
        after = lambda sym, seg: np.where(np.append(seg[1:], -1) == seg, np.append(sym[1:], -1), -1)
        rank, piece = self._pairs(sym, after(sym, seg))
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            if (done := low == _NONE).any():
                out[pos[done]] = sym[done]
                sym, pos, seg, rank, piece, low = (x[~done] for x in (sym, pos, seg, rank, piece, low))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            starts = np.append(True, at[1:] != at[:-1] + 1)  # of runs of pairs that overlap: every other one is merged
            run = at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            new, own = piece[at], rank[at]
            inside = np.append(False, seg[1:] == seg[:-1])[at]
            left = np.where(inside, sym[at - 1], -1)
            joined = np.append(False, at[1:] == at[:-1] + 2) & inside
            left = np.where(joined, np.append(-1, new[:-1]), left)
            last = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & (seg[last] == seg[at]), sym[last], -1)
            early = np.minimum(self._pairs(left, new)[0], self._pairs(new, right)[0]) <= own
            before = np.cumsum(early) - early
            opens = np.append(True, seg[at][1:] != seg[at][:-1])
            at = at[before == before[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]]
            sym = sym.copy()
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, pos, seg, rank, piece = (x[keep] for x in (sym, pos, seg, rank, piece))
            changed = np.zeros(len(sym), bool)
            changed[place[at]] = changed[np.maximum(place[at] - 1, 0)] = True
            changed = np.flatnonzero(changed)
            follow = np.minimum(changed + 1, len(sym) - 1)
            follow = np.where((changed + 1 < len(sym)) & (seg[follow] == seg[changed]), sym[follow], -1)
            rank[changed], piece[changed] = self._pairs(sym[changed], follow)
        starts = np.flatnonzero(out != -2)
        ids, owner = out[starts], np.repeat(np.arange(len(words)), lengths)[starts]
        if (strange := (ids < 0) | (ids >= self.count)).any():
            ids, owner = self._as_bytes(ids, owner, code[starts], strange)
        return ids, np.bincount(owner, minlength=len(words))

    def _as_bytes(self, ids, owner, code, strange):
        """``ids`` and ``owner`` with the bytes of each character that has no piece in its place, or the unknown piece for models without bytes."""
        import numpy as np

        if self.bytes is None:
            return np.where(strange, self.unknown, ids), owner
        spelt = np.frombuffer("".join(map(chr, code[strange].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        size = np.ones(len(ids), np.int64)
        size[strange] += (code[strange] >= 0x80).astype(np.int64) + (code[strange] >= 0x800) + (code[strange] >= 0x10000)
        ids = np.repeat(np.where(strange, -1, ids), size)
        ids[ids < 0] = self.bytes[spelt]
        return ids.astype(np.int32), np.repeat(owner, size)

    def _slices(self, text: str):
        """The text with marks, in slices of about SLICE characters that end where words do."""
        at, text = 0, (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        border = re.compile(f"[^{MARK}](?={MARK})")
        while at < len(text):
            end = None if self.whole else border.search(text, at + SLICE)
            end = end.end() if end else len(text)
            yield text[at:end]
            at = end

    def _ids(self, lists: list[list[str]]) -> list:
        """The ids of lists of words. Words that aren't known are merged together."""
        import numpy as np

        fresh = list(set().union(*lists).difference(self.known))
        if fresh:
            ids, sizes = self.merge(fresh)
            self.known.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            self.held += sum(map(len, fresh))
        out = []
        for words in lists:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.append(self.ids[_spread(self.starts[at], self.sizes[at])])
        if self.held > MOST_KNOWN:
            self.forget()
        return out

    def encode(self, *texts: str) -> list:
        """The ids of each text. Texts of up to SLICE characters are looked at together, longer ones a slice at a time."""
        import numpy as np

        cut = (lambda part: [part]) if self.whole else self.words.findall
        short = [k for k, text in enumerate(texts) if len(text) <= SLICE]
        out = dict(zip(short, self._ids([cut("".join(self._slices(texts[k]))) for k in short])))
        for k in set(range(len(texts))).difference(short):
            out[k] = np.concatenate([self._ids([cut(part)])[0] for part in self._slices(texts[k])])
        return [out[k] for k in range(len(texts))]

    def decode(self, ids) -> str:
        """The text of a text's ids. A mark that starts the first visible piece goes; bytes that make no character become U+FFFD, one for each."""
        import numpy as np

        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.text_size)):
            raise ValueError("ids must be places in the vocabulary")
        size = self.text_size[ids]
        data = self.texts[_spread(self.text_start[ids], size)].tobytes()
        visible = np.flatnonzero(size > 0)
        first = 1 if self.prefix and len(visible) and self.marked[ids[visible[0]]] else 0
        ends = np.cumsum(size)
        parts = [first, *ends[np.flatnonzero(size == 0)].clip(first).tolist(), len(data)]  # bytes on both sides of an invisible piece make no character
        return "".join(self._text(data[a:b]) for a, b in zip(parts, parts[1:]))

    @staticmethod
    def _text(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as bad:
                out.append(data[at : at + bad.start].decode() + "�")
                at += bad.start + 1
        return "".join(out)


def _spread(starts, sizes):
    """Indices of all places of ranges, laid end to end."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text; other columns are ignored), as the library encodes, without begin or end ids.

    A null text is empty and has no ids; null doc_ids are kept and repeated rows are encoded each; an empty table gives no rows. Whole texts are
    read, a slice at a time; a word of any length is merged whole, in memory that follows its length.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        model = _model(model_path)
        for batch in bounded(batches, most=BATCH_BYTES):
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = model.encode(*texts)
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) of every row of ``encoded`` (doc_id, ids array<int>), as the library decodes. Null ids are none; null among ids and numbers beyond the vocabulary raise."""
    import pyarrow as pa

    def run(batches):
        model = _model(model_path)
        for batch in bounded(batches, most=BATCH_BYTES):
            column = batch.column(1)
            texts = [model.decode(column[k].values.to_numpy(zero_copy_only=False)) if column[k].is_valid else "" for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``decode_ids`` returns."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    spelt = F.array_join(ids.cast("array<string>"), ",")
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(spelt.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
