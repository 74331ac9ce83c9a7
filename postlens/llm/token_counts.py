"""Operator 8: token counts by trie-shared dynamic programming.

The pieces of a vocabulary file are read as a unigram model.  A text's distinct pre-tokens go into a
trie; the forward score of a prefix (best sum of piece scores, and how many tokens reach it) belongs
to its trie node, so it is computed once however many pre-tokens share the prefix, and the terminal
node holds the pre-token's count.  A document's count is the sum over its pre-tokens.

The work is one pass over the texts without a shuffle: every Python worker keeps a trie of the
pre-tokens it has met, and starts a new one when it reaches ``MAX_NODES`` nodes (memory bound; the
counts stay the same).  The vocabulary is a fixed file, read by each worker from ``vocab_path``.

The public file is a byte-pair file: it stores merge ranks, not probabilities.  ``scores="zipf"``
(default) gives the piece of rank r the log-probability of Zipf's law, -ln r - ln H(n);
``scores="stored"`` takes the stored numbers.  Either way a count is that of the best unigram
segmentation, which is close to, but not always, what merging by rank gives (see README).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm import common

SPACE = "▁"
#: Trie nodes and cached pre-tokens a worker keeps before it starts afresh.
MAX_NODES = 800_000
#: Longer pre-tokens are scored on their own, outside the trie.
TRIE_CHARS = 64
#: An unknown character scores this much below the worst piece and counts its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0

#: A run of spaces with the word after it, a line feed, or spaces before a line feed or the end.
_PRETOKEN = re.compile(r" *[^ \n]+|\n| +")


def load_scores(vocab_path: str, scores: str = "zipf") -> dict[str, float]:
    """piece (spaces as U+2581) → score, of the ordinary pieces of a sentencepiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=vocab_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if scores == "stored":
        return {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids}
    if scores != "zipf":
        raise ValueError("scores must be 'zipf' or 'stored'")
    total = math.log(math.fsum(1.0 / r for r in range(1, len(ids) + 1)))
    return {sp.id_to_piece(i): -math.log(r) - total for r, i in enumerate(ids, 1)}


class UnigramTrie(dict):
    """pre-token → token count.  A missing pre-token is inserted into the trie."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        super().__init__()
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces may hold spaces at their start only")
        #: every suffix of a piece → the suffix's own score, None where it is no piece: looking
        #: backwards from a position stops at the first string that no piece ends with
        self.suffixes: dict[str, float | None] = {p[k:]: None for p in scores for k in range(len(p))}
        self.suffixes.update(scores)
        self.singles = {p for p in scores if len(p) == 1}
        self.max_nodes = max_nodes
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}                      # node << 21 | code point → node
        self.score, self.count = [0.0], [0]                  # node 0 is the root

    def _forward(self, word: str, end: int, path: list[int]) -> None:
        """Append best (score, tokens) of word[:end]; path[k] is the place of word[:k]'s.  Equal
        scores go to fewer tokens."""
        scores, counts, suffixes = self.score, self.count, self.suffixes
        best = tokens = None
        k = end - 1
        if word[k] not in self.singles:
            best = scores[path[k]] + self.unknown
            tokens = counts[path[k]] + len(word[k].encode("utf-8", "surrogatepass"))
        while k >= 0:
            piece = word[k:end]
            if piece not in suffixes:
                break
            s = suffixes[piece]
            if s is not None:
                total, n = scores[path[k]] + s, counts[path[k]] + 1
                if best is None or total > best or total == best and n < tokens:
                    best, tokens = total, n
            k -= 1
        scores.append(best)
        counts.append(tokens)

    def _alone(self, word: str) -> int:
        """Count of a long word: nodes of its own, given back afterwards."""
        size, path = len(self.score), [0]
        for end in range(1, len(word) + 1):
            self._forward(word, end, path)
            path.append(len(self.score) - 1)
        n = self.count[-1]
        del self.score[size:], self.count[size:]
        return n

    def __missing__(self, pretoken: str) -> int:
        word = pretoken.replace(" ", SPACE)
        if len(word) > TRIE_CHARS:
            return self._alone(word)
        if len(self.score) > self.max_nodes:
            self._reset()
        path, child, node = [0], self.child, 0
        for end, ch in enumerate(word, 1):
            key = node << 21 | ord(ch)
            node = child.get(key)
            if node is None:
                self._forward(word, end, path)
                node = child[key] = len(self.score) - 1
            path.append(node)
        n = self[pretoken] = self.count[node]
        return n

    def pretokens(self, text: str | None) -> list[str]:
        """A leading space is put before the text; empty texts have none."""
        return _PRETOKEN.findall(" " + text.replace(SPACE, " ")) if text else []

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens) of a whole text."""
        found = self.pretokens(text)
        return sum(map(self.__getitem__, found)), len(found)


_TRIES: dict[tuple, UnigramTrie] = {}


def count_tokens(docs: DataFrame, vocab_path: str, scores: str = "zipf", max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens`` for every row of ``docs(doc_id, text)``.

    Null and empty texts count 0; null and repeated ids and equal rows each give their own row;
    other columns are not read; an empty table gives no rows; long words are scored outside the trie."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocab_path, scores, max_nodes)
        if key not in _TRIES:
            _TRIES[key] = UnigramTrie(load_scores(vocab_path, scores), max_nodes)
        trie, out = _TRIES[key], common.Collector(schema)
        for batch in batches:
            for doc_id, text in common.rows_of(batch, "doc_id", "text"):
                if out.add(doc_id, *trie.text(text)):
                    yield from out.flush()
        yield from out.flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
