"""Token counts under a unigram model, by dynamic programming over a trie.

A text's pre-tokens are its words, each with the word-start mark before it. The distinct pre-tokens of a
batch are inserted into a trie. A trie node stands for a prefix, and the best score of any way to
cut that prefix into vocabulary pieces depends on the prefix alone: it is computed once, when
the node is made, from the nodes on its own path, however many pre-tokens share it. The node
where a pre-token ends stores its count of pieces, and a document's count is the sum over its words.

A word's first ``DEPTH`` characters are nodes of the trie. What a longer word has beyond them no other word is likely to share: its prefixes are scored in the same
way, but only as many as the longest piece reaches back are held, and its count is kept by the text alone.

The trie lives on in the worker for the batches that follow and starts anew beyond ``max_nodes``
nodes, so memory is bounded, whatever words there are, and nothing is dropped. Nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded

WORD_START = "▁"
MAX_NODES = 600_000
#: Characters of a word, its mark among them, that become nodes.
DEPTH = 256
#: Words of a text that are summed at once.
PART_WORDS = 50_000
#: What a byte costs where no piece covers a character: below any piece of the vocabulary.
BYTE_MARGIN = 10.0


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the normal pieces of the ``sentencepiece`` file at ``path``.

    The file orders pieces by how early they were merged and holds no probabilities; a piece at place
    r has the Zipf log-probability -ln(r + 1), up to a constant that is the same for all.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(r + 1.0) for r, i in enumerate(normal, 1)}


class Trie:
    """Prefixes of pre-tokens with the best score and count of pieces of each; memory follows the characters inserted."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.byte = min(scores.values(), default=0.0) - BYTE_MARGIN
        ends: dict[str, set[int]] = {}  # by the last two characters, the lengths of pieces that are worth looking up
        for piece in scores:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.ends = {c: sorted(n) for c, n in ends.items()}
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}  # (node, next character) -> node
        self.score: list[float] = [0.0]  # of the best cut of the node's prefix, the empty one first
        self.pieces: list[int] = [0]  # and how many pieces it has
        self.terminal: dict[bytes, int] = {}  # word -> the count at the node where it ends

    def count(self, pre_token: str) -> int:
        """Pieces of the best cut; of equally good cuts, one with the fewest pieces. Makes the nodes that are missing."""
        children, node, score, pieces = self.children, 0, [0.0], [0]
        for at, c in enumerate(pre_token[:DEPTH]):
            child = children.get((node, c))
            if child is None:
                best, least = self._best(pre_token, at + 1, score, pieces, 0)
                self.score.append(best)
                self.pieces.append(least)
                child = children[node, c] = len(self.score) - 1
            node = child
            score.append(self.score[node])
            pieces.append(self.pieces[node])
        begin = 0
        for end in range(DEPTH + 1, len(pre_token) + 1):
            if len(score) > 4096:  # no piece reaches further back than the longest one
                begin = end - self.longest
                del score[: -self.longest], pieces[: -self.longest]
            best, least = self._best(pre_token, end, score, pieces, begin)
            score.append(best)
            pieces.append(least)
        return pieces[-1]

    def _best(self, word: str, end: int, score: list[float], pieces: list[int], begin: int) -> tuple[float, int]:
        """The best score of the first ``end`` characters and its count of pieces, from those of the prefixes of ``begin`` characters and more."""
        scores, c, at = self.scores, word[end - 1], end - 1 - begin
        size = len(c.encode("utf-8", "surrogatepass"))
        best, least = score[at] + self.byte * size, pieces[at] + size
        if (own := scores.get(c)) is not None and (score[at] + own, -pieces[at] - 1) > (best, -least):
            best, least = score[at] + own, pieces[at] + 1
        for length in self.ends.get(word[end - 2 : end], ()) if end > 1 else ():
            if length > end:
                break
            if (own := scores.get(word[end - length : end])) is not None:
                at = end - length - begin
                option = score[at] + own
                if option > best or option == best and pieces[at] + 1 < least:
                    best, least = option, pieces[at] + 1
        return best, least

    def trim(self) -> None:
        if max(len(self.score), len(self.terminal)) > self.max_nodes:
            self.clear()

    def count_words(self, words: list[bytes]) -> int:
        """The sum over a text's words. The trie may start anew between any two of them; the counts of a part of the text stay until the part is summed."""
        total = 0
        for at in range(0, len(words), PART_WORDS):
            part, known = words[at : at + PART_WORDS], self.terminal
            for word in set(part).difference(known):
                known[word] = self.count(WORD_START + word.decode("utf-8", "surrogatepass"))
                self.trim()
            total += sum(map(known.__getitem__, part))
            for word in part:
                if len(word) > DEPTH:
                    known.pop(word, None)
        return total


def token_counts(docs: DataFrame, vocabulary_path: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have 0 of both. Repeated rows are counted each; null doc_ids are kept; an
    empty table gives no rows. Whole texts are read, one batch of bounded size at a time; a word of any length
    takes no more memory than its own characters.
    """
    import pyarrow as pa

    def run(batches):
        trie = Trie(vocabulary(vocabulary_path), max_nodes)
        for batch in bounded(batches):
            words, tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                tokens.append(trie.count_words(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
