"""Operator 2, token counts under a unigram vocabulary, with work shared along prefixes.

A pre-token is a word between white space with the word-start mark before it.
Its number of tokens is that of its most likely segmentation, where a token's
probability follows its rank in the vocabulary (Zipf's law, as the file orders
tokens by frequency) and unknown characters fall back to their bytes. Forward
scores depend only on the prefix, so a task puts its distinct new pre-tokens in
order and walks them as a trie: a prefix that neighbours share is scored once,
and the counts at the ends of pre-tokens are kept in a bounded memory.

Defined cases: null and empty texts and texts of white space have no tokens;
a null id stays null; repeated rows are counted each; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keystead.llm.common import batched, texts

START = "▁"


def zipf_scores(vocabulary: str) -> dict[str, float]:
    """Tokens of a vocabulary file with log probabilities by rank; bytes and control tokens left out."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [
        file.id_to_piece(i)
        for i in range(file.get_piece_size())
        if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i))
    ]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)}


class Counter:
    """Token counts of pre-tokens."""

    def __init__(self, scores: dict[str, float], kept: int):
        self.scores, self.kept = scores, kept
        self.lengths = sorted({len(piece) for piece in scores})
        self.byte_score = min(scores.values(), default=0.0) - 10
        self.ends: dict[str, int] = {}

    def extend(self, word: str, size: int, forward: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -tokens) of the first ``size`` characters, from those of shorter prefixes."""
        width = len(word[size - 1].encode("utf-8", "surrogatepass"))
        score, tokens = forward[size - 1]
        best = (score + width * self.byte_score, tokens - width)
        for length in self.lengths:
            if length > size:
                break
            if (own := self.scores.get(word[size - length : size])) is not None:
                score, tokens = forward[size - length]
                best = max(best, (score + own, tokens - 1))
        return best

    def learn(self, words: set[str]) -> None:
        new = words - self.ends.keys()
        if len(self.ends) + len(new) > self.kept:
            self.ends.clear()
            new = words
        path, forward = "", [(0.0, 0)]
        for word in sorted(new):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del forward[shared + 1 :]
            for size in range(shared + 1, len(word) + 1):
                forward.append(self.extend(word, size, forward))
            path = word
            self.ends[word] = -forward[-1][1]


def token_counts(docs: DataFrame, vocabulary: str, kept: int = 300_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document.

    vocabulary: path of the vocabulary file on every machine. kept: pre-tokens
    whose counts a task remembers before it starts anew. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(zipf_scores(vocabulary), kept)
        for batch in batches:
            whole, doc_ids = texts(batch), batch.column("doc_id").to_pylist()
            for at in range(0, len(whole), 1000):
                words = [[START + word for word in text.split()] for text in whole[at : at + 1000]]
                counter.learn(set().union(*words))
                tokens = [sum(map(counter.ends.__getitem__, own)) for own in words]
                yield batched(
                    ["doc_id", "n_pretokens", "n_tokens"],
                    [pa.int64()] * 3,
                    [doc_ids[at : at + 1000], [len(own) for own in words], tokens],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
