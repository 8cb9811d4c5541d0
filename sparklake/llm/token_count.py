"""Token counts by dynamic programming shared over a trie.

A unigram model scores a segmentation by the sum of its pieces' log probabilities; the best one of a pre-token is found by the
forward recursion over its prefixes. Distinct pre-tokens are inserted, in order, in a trie whose nodes hold the forward score and the token
count of their prefix, so a prefix that several pre-tokens share is computed once, and each terminal node holds its pre-token's count.

Tokenizers aren't trained here: the probabilities are those of the vocabulary's file, or, where that ranks its pieces only, follow
Zipf's law by rank (log probability -log(r + 2) for the piece of rank r, up to a constant).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklake.llm._text import pieces, small_batches

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a pre-token, as the vocabulary's pieces do.
MARK = "▁"
#: Pre-tokens whose counts a task remembers before it starts anew, and that one trie holds.
MEMORY, TRIE = 400_000, 20_000


class Vocabulary:
    """Pieces in a trie: a node maps a character to the next node, and "" to the score of the piece that ends there."""

    def __init__(self, ranked: Sequence[str], scores: Sequence[float] | None = None):
        """Without ``scores`` (log probabilities) pieces are scored by their rank. Of a repeated piece the first counts."""
        self.root: dict = {}
        scores = [-math.log(rank + 2) for rank in range(len(ranked))] if scores is None else scores
        for piece, score in zip(ranked, scores, strict=True):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node.setdefault("", score)
        #: A character that no piece covers becomes its UTF-8 bytes, a token each.
        self.byte_score = min(scores, default=0.0) - 2

    @classmethod
    def load(cls, path: str = TOKENIZER) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        scores = [model.get_score(k) for k in ids]
        by_rank = all(a - b == 1 for a, b in zip(scores, scores[1:], strict=False))
        return cls([model.id_to_piece(k) for k in ids], None if by_rank else scores)


class Trie:
    """A trie of sorted, distinct pre-tokens, its nodes in depth-first order: each one's parent, character, forward score and the tokens of the best
    segmentation of its prefix (of equal scores the fewest); and each pre-token's terminal node."""

    def __init__(self, vocabulary: Vocabulary, pretokens: Sequence[str]):
        root, byte_score = vocabulary.root, vocabulary.byte_score
        self.parent, self.char, self.score, self.tokens = [-1], [""], [0.0], [0]
        self.terminal: list[int] = []
        # the path to the last node: nodes, their scores and tokens, and the pieces open there (start, vocabulary node)
        path, score, tokens, opened, last = [0], [0.0], [0], [[(0, root)]], ""
        for text in pretokens:
            shared = 0
            for a, b in zip(last, text, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :], score[shared + 1 :], tokens[shared + 1 :], opened[shared + 1 :]
            for depth in range(shared, len(text)):
                c = text[depth]
                size = 1 if c < "\x80" else len(c.encode())
                best, count, spans = score[depth] + size * byte_score, tokens[depth] + size, []
                for start, node in opened[depth]:
                    child = node.get(c)
                    if child is not None:
                        spans.append((start, child))
                        own = child.get("")
                        if own is not None:
                            value, n = score[start] + own, tokens[start] + 1
                            if value > best or (value == best and n < count):
                                best, count = value, n
                spans.append((depth + 1, root))
                self.parent.append(path[depth])
                self.char.append(c)
                self.score.append(best)
                self.tokens.append(count)
                path.append(len(self.parent) - 1)
                score.append(best)
                tokens.append(count)
                opened.append(spans)
            self.terminal.append(path[-1])
            last = text

    def counts(self) -> list[int]:
        """The tokens of each pre-token."""
        return [self.tokens[t] for t in self.terminal]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, n_tokens.

    Pre-tokens are runs of characters other than space and U+0009 to U+000D, each with the start mark. Null and empty texts have none.
    Whole texts of any length are counted; repeated rows each get their row, and null ids stay. Other columns are left out, so none can
    clash. Segmentations that tie in score count with the fewest tokens. An empty table gives no rows.
    """
    vocabulary = vocabulary or Vocabulary.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                texts = [(x or b"").split() for x in part.column("text").cast(pa.binary()).to_pylist()]
                distinct = set().union(*texts)
                if len(known) + len(distinct) > MEMORY:
                    known = {x: known[x] for x in distinct.intersection(known)}
                new = sorted(distinct.difference(known))
                for at in range(0, len(new), TRIE):
                    some = new[at : at + TRIE]
                    known.update(zip(some, Trie(vocabulary, [MARK + x.decode() for x in some]).counts(), strict=True))
                total = np.array([sum(map(known.__getitem__, words)) for words in texts], np.int64)
                yield pa.record_batch([part.column("id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(total)], ["id", "n_words", "n_tokens"])

    wanted = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, f"id {dict(wanted.dtypes)['id']}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
