"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place of a word; dynamic
programming carries the best score and its piece count along. The tie rules are those of the
tokenizers library's unigram model: of equal scores the piece that starts first wins, a character
that no single-character piece covers may stand as unknown at the lowest score less ten and is
tried last, and an unknown character counts its UTF-8 bytes (byte fallback).

Texts are cut at newlines, each newline a word of its own, and lines at blanks; a word carries the
mark of the blank before it. Words are counted once and their counts kept, in bounded number.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
KEPT = 400_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file in the order of their ids, with the scores of a Zipf law."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1.0)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts under a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.match = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - 10.0
        pieces = {p for p, _ in vocabulary}
        self.fallback = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word, its mark included."""
        n = len(word)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0], done, single = 0.0, 0, False
        for end, (length, score) in self.match.iter(word):
            end += 1
            while done < end - 1:
                self._close(word, best, count, done, single)
                done, single = done + 1, False
            candidate = best[end - length] + score
            if candidate > best[end]:
                best[end], count[end] = candidate, count[end - length] + 1
            single = single or length == 1
        while done < n:
            self._close(word, best, count, done, single)
            done, single = done + 1, False
        return count[n]

    def _close(self, word: str, best: list[float], count: list[int], at: int, single: bool) -> None:
        """All pieces that end after place ``at`` are known; let its character stand as unknown."""
        if not single and best[at] + self.unknown > best[at + 1]:
            best[at + 1] = best[at] + self.unknown
            count[at + 1] = count[at] + (len(word[at].encode()) if self.fallback else 1)

    def __getitem__(self, word: str) -> int:
        n = self.kept.get(word)
        if n is None:
            n = self.word(MARK + word)
            if len(self.kept) >= KEPT:
                self.kept.clear()
            if len(word) <= 64:
                self.kept[word] = n
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        lines = text.replace(MARK, " ").split("\n")
        total = (len(lines) - 1) * self["\n"]
        of = self.__getitem__
        for line in lines:
            if line:
                words = line.split(" ")
                total += sum(map(of, words[1:] if line[0] == " " else words))
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_chars and n_bytes of every row's whole text.

    ``vocabulary`` is a sentencepiece file on every executor. Null and empty texts have no tokens; very
    long ones are counted whole; null ids and repeated rows are rows like any other; an empty table
    gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """

    def run(batches):
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(unigram_vocabulary(vocabulary))
        count = _counters[vocabulary]
        for batch in slices(batches):
            n = [count(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "n_chars", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_bytes long, n_tokens long").withColumnRenamed("doc_id", id_col)
