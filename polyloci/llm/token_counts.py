"""Operator 7, token counts by trie-shared dynamic programming.

A text's pre-tokens (runs of non-space characters, with the mark of a word's start before them) are split into
vocabulary pieces of the highest total score. The best score of a prefix doesn't depend on what follows, so pre-tokens
are put in a trie: each node holds the best score and the count of pieces of its prefix, computed once for all
pre-tokens that share it, and a pre-token's count is read at its last node.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A character that no piece covers counts one token and scores so much below the lowest piece.
UNKNOWN_BELOW = 10.0
#: Nodes and pre-tokens a process keeps; beyond that it starts a new trie. About 250 MB.
MOST_NODES, MOST_WORDS = 600_000, 300_000
#: Longer pre-tokens are split by themselves, without a trie, in memory for the longest piece only.
LONG = 256


def piece_scores(path: str) -> dict[str, float]:
    """Unigram log probabilities of the ordinary pieces of a SentencePiece model; control, unknown and byte pieces are left out.

    A merge vocabulary states no probabilities: its scores order the pieces by their merges, the most frequent first. Zipf's law
    gives the piece of rank r, of n, the probability 1 / (r H), H the sum of 1 / r over all. Nothing is fitted to a corpus.
    Pieces of equal score share the last rank of theirs.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    stated = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    rank = {score: r for r, score in enumerate(sorted(stated.values(), reverse=True), 1)}
    whole = math.log(sum(1 / r for r in range(1, len(stated) + 1)))
    return {piece: -math.log(rank[score]) - whole for piece, score in stated.items()}


#: Scores are whole millionths, with the number of tokens in the low bits: a split is one integer, and the larger is
#: the better one, of equal scores the one with fewer tokens.
SCALE, TOKEN_BITS = 1_000_000, 40


def split_value(score: float) -> int:
    return (round(score * SCALE) << TOKEN_BITS) - 1


class Trie:
    """Best splits of all prefixes met so far."""

    _open: dict[str, Trie] = {}

    def __init__(self, scores: dict[str, float]):
        self.values = {p: split_value(v) for p, v in scores.items()}
        # Lengths of pieces by their last two characters: look-ups only where a piece can end.
        ends: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: tuple(sorted(n)) for e, n in ends.items()}
        self.longest = max(map(len, scores), default=1)
        self.unknown = split_value(min(scores.values(), default=0.0) - UNKNOWN_BELOW)
        self.counts: dict[str, int] = {}
        self._clear()

    @classmethod
    def opened(cls, path: str) -> Trie:
        if path not in cls._open:
            cls._open[path] = cls(piece_scores(path))
        return cls._open[path]

    def _clear(self) -> None:
        """Start a new trie. Counts of the last pre-tokens are still at hand, so that frequent ones are never split again."""
        # node: children by character, and the value of the best split of the prefix that ends here
        self.root: tuple[dict, int] = ({}, 0)
        self.nodes = 0
        self.older, self.counts = self.counts, {}

    def count_long(self, pre_token: str) -> int:
        """As count(), holding the best values of the last prefixes only."""
        value_of, lengths, unknown, keep = self.values.get, self.lengths.get, self.unknown, self.longest
        best, first = [0], 0  # best[i]: of the prefix of first + i characters
        for end, c in enumerate(pre_token, 1):
            top = best[-1] + value_of(c, unknown)
            for n in lengths(pre_token[end - 2 : end], ()) if end > 1 else ():
                if n > end:
                    break
                value = value_of(pre_token[end - n : end])
                if value is not None and best[end - n - first] + value > top:
                    top = best[end - n - first] + value
            best.append(top)
            if len(best) > 2 * keep + 64:
                first += len(best) - keep - 1
                del best[: len(best) - keep - 1]
        return -best[-1] & ((1 << TOKEN_BITS) - 1)

    def count(self, pre_token: str) -> int:
        """Tokens of the best split of a pre-token, which is put in the trie."""
        node, best = self.root, [0]
        value_of, lengths, unknown = self.values.get, self.lengths.get, self.unknown
        for end, c in enumerate(pre_token, 1):
            child = node[0].get(c)
            if child is None:
                top = best[-1] + value_of(c, unknown)
                for n in lengths(pre_token[end - 2 : end], ()) if end > 1 else ():
                    if n > end:
                        break
                    value = value_of(pre_token[end - n : end])
                    if value is not None and best[end - n] + value > top:
                        top = best[end - n] + value
                child = node[0][c] = ({}, top)
                self.nodes += 1
            node = child
            best.append(child[1])
        return -node[1] & ((1 << TOKEN_BITS) - 1)

    def tokens(self, words: list[str]) -> int:
        """Tokens of the words as they stand in a text, each after the mark of its start."""
        try:
            return sum(map(self.counts.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for w in words:
            n = self.counts.get(w)
            if n is None:
                if len(w) > LONG:
                    total += self.count_long(MARK + w)
                    continue
                if self.nodes > MOST_NODES or len(self.counts) > MOST_WORDS:
                    self._clear()
                n = self.older.get(w)
                self.counts[w] = n = self.count(MARK + w) if n is None else n
            total += n
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, pre_tokens and tokens of every row, in one pass over whole texts and without a shuffle.

    Null and empty texts have none of either. Ids may be null or repeated; an empty table gives no rows; other columns
    are ignored. Each process shares its trie among all its tasks, and its size is bounded, however long a text or a
    pre-token is.
    """

    def run(batches):
        trie = Trie.opened(model_path)
        for batch in batches:
            words_of, tokens_of = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                words_of.append(len(words))
                tokens_of.append(trie.tokens(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], [id_col, "pre_tokens", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, pre_tokens long, tokens long")

