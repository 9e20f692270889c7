"""Count the unigram tokens of every document, with the forward scores of a trie shared by all pre-tokens.

Method. A text is cut into pre-tokens (a run of spaces with what follows it) across which no piece of the
vocabulary reaches, so the best segmentation of the text is made of the best segmentations of its pre-tokens. Each
piece of input inserts its distinct new pre-tokens in a trie, level by level. A node stands for a prefix and keeps
that prefix's best forward score and the tokens on the way there, computed once, however many pre-tokens share it;
the node where a pre-token ends gives its count, which the task remembers. Documents then only look up and add.
Nothing is shuffled. A memory that reaches ``MAX_KNOWN`` starts anew, which changes no count.

Scores are those of the vocabulary file. Of equal scores the path with the longer last piece wins. A character that
no piece covers costs one token for each UTF-8 byte.

Defined cases. A null or empty text has no pre-tokens and no tokens. Repeated rows are counted one by one.
Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronofid.llm.text import chunks, mixed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pre-tokens whose counts a task remembers at most, and the length from which one is handled by itself.
MAX_KNOWN, LONG = 300_000, 256
#: Multiplier of the rolling hash of prefixes; any odd number.
BASE = 0x9E3779B97F4A7C15
SPACE = "▁"
_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores. ``unknown`` is the score of a character that no piece covers."""

    scores: dict[str, float]
    unknown: float
    longest: int

    @classmethod
    def of(cls, scores: dict[str, float]) -> Vocabulary:
        for piece in scores:
            if SPACE in piece.lstrip(SPACE) or ("\n" in piece and piece != "\n"):
                raise ValueError(f"a piece reaches across pre-tokens: {piece!r}")
        return cls(scores, min(scores.values()) - 10.0, max(map(len, scores)))

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return cls.of({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)})


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Counter:
    """Token counts of pre-tokens, by pre-token, for the vocabulary it was made for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        by_length: dict[int, list[str]] = {}
        for piece in vocabulary.scores:
            by_length.setdefault(len(piece), []).append(piece)
        #: For each length the sorted hashes of the pieces and their scores, longest first.
        self.pieces = []
        for length in sorted(by_length, reverse=True):
            hashes = np.array([self._hash(p) for p in by_length[length]], np.uint64)
            order = np.argsort(hashes)
            scores = np.array([vocabulary.scores[p] for p in by_length[length]])
            self.pieces.append((length, np.uint64(pow(BASE, length, 1 << 64)), hashes[order], scores[order]))

    @staticmethod
    def _hash(piece: str) -> int:
        total = 0
        for code in mixed(np.array([ord(c) for c in piece], np.uint64)).tolist():
            total = (total * BASE + code) % (1 << 64)
        return total

    def learn(self, pretokens: set[str]) -> None:
        """Make ``known`` hold these pre-tokens."""
        if len(self.known) > MAX_KNOWN:
            self.known.clear()
        new = [p for p in pretokens if p not in self.known]
        self.known.update((p, self._alone(p)) for p in new if len(p) > LONG)
        new = sorted((p for p in new if len(p) <= LONG), key=len, reverse=True)
        if new:
            self.known.update(zip(new, self._trie(new)))

    def _trie(self, pretokens: list[str]) -> list[int]:
        """Insert pre-tokens, longest first, level by level; give the token count of each."""
        lengths = np.array([len(p) for p in pretokens])
        codes = np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(lengths) - lengths
        n = len(pretokens)
        # Row k of a level belongs to pre-token k, which is still open there; equal prefixes are one node.
        node, out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        hashes, best, tokens = [np.zeros(n, np.uint64)], [np.zeros(n)], [np.zeros(n, np.int64)]
        for depth in range(1, int(lengths[0]) + 1):
            open_ = int(np.searchsorted(-lengths, -depth, "right"))
            code = codes[begins[:open_] + depth - 1].astype(np.int64)
            _, first, node = np.unique(node[:open_] << 21 | code, return_index=True, return_inverse=True)
            char = code[first]
            level = hashes[-1][first] * np.uint64(BASE) + mixed(char.astype(np.uint64))
            top, count = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
            for length, power, pieces, scores in self.pieces:
                if length > depth:
                    continue
                wanted = level - hashes[depth - length][first] * power
                at = np.minimum(np.searchsorted(pieces, wanted), len(pieces) - 1)
                score = np.where(pieces[at] == wanted, scores[at], -np.inf) + best[depth - length][first]
                better = score > top
                top[better] = score[better]
                count[better] = tokens[depth - length][first[better]] + 1
            # A single character that is no piece: it is tried last, as the shortest piece would be.
            lone = np.array([chr(c) not in self.vocabulary.scores for c in char])
            score = np.where(lone, self.vocabulary.unknown + best[depth - 1][first], -np.inf)
            better = score > top
            top[better] = score[better]
            size = 1 + (char[better] > 0x7F) + (char[better] > 0x7FF) + (char[better] > 0xFFFF)
            count[better] = tokens[depth - 1][first[better]] + size
            hashes.append(level[node])
            best.append(top[node])
            tokens.append(count[node])
            ended = lengths[:open_] == depth
            out[:open_][ended] = tokens[-1][ended]
        return out.tolist()

    def _alone(self, pretoken: str) -> int:
        """The count of one very long pre-token, character by character."""
        best, tokens, scores, longest = [0.0], [0], self.vocabulary.scores, self.vocabulary.longest
        for end in range(1, len(pretoken) + 1):
            top, count = None, 0
            for start in range(max(0, end - longest), end):
                score, cost = scores.get(pretoken[start:end]), 1
                if score is None:
                    if start < end - 1:
                        continue
                    score, cost = self.vocabulary.unknown, len(pretoken[start].encode())
                if top is None or score + best[start] > top:
                    top, count = score + best[start], tokens[start] + cost
            best.append(top)
            tokens.append(count)
        return tokens[-1]


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                listed = [pretokens(t) for t in texts]
                counter.learn(set(chain.from_iterable(listed)))
                counts = [sum(map(counter.known.__getitem__, x)) for x in listed]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(map(len, listed), pa.int64()), pa.array(counts, pa.int64())],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
