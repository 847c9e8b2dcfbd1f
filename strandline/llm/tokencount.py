"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming then carries, for each end, only the best
score, the number of pieces of the best path and whether it ends in an unknown piece. No lattice or path is kept. The rules are those of the
exact tokenizer (`tokenizers` Unigram behind a Metaspace splitter): a word is U+2581 and what follows a space up to the next one; scores are summed
from the left in double precision; of equal scores at an end the earliest start stays; a character that is no piece is an unknown piece at the
lowest score less 10, and neighbouring unknown pieces count once.

Defined results: null and empty texts have 0 tokens. Rows repeat as in the input; other columns are ignored, whatever their names; an empty table gives no rows. A word of n characters
takes three lists of n, about 100 bytes a character, and a text its list of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

MARK = "▁"
UNKNOWN = 10.0  # fixed value: the penalty of an unknown piece below the lowest score
#: Words whose counts a worker remembers at a time.
REMEMBERED = 300_000
WORD = re.compile(" ?[^ ]+| ")
SCHEMA = "doc_id long, n_chars long, n_tokens long"


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))
    return [(m.id_to_piece(i), m.get_score(i)) for i in ids if m.get_score(i) > -1e8]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), float(score)))
        self.machine.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((float(s) for _, s in vocabulary), default=0.0) - UNKNOWN
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over one word."""
        n = len(word)
        best, count, unk = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at = 0

        def close(end: int) -> None:  # a lone character at each end up to here, after all matches that end there
            nonlocal at
            while at < end:
                if word[at] not in self.single and (best[at + 1] is None or best[at] + self.unknown > best[at + 1]):
                    best[at + 1], unk[at + 1] = best[at] + self.unknown, True
                    count[at + 1] = count[at] + (not unk[at])
                at += 1

        for last, (length, score) in self.machine.iter(word):
            close(last)
            start = last + 1 - length
            total = score + best[start]
            if best[last + 1] is None or total > best[last + 1]:
                best[last + 1], count[last + 1], unk[last + 1] = total, count[start] + 1, False
        close(n)
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = text if text[0] in (" ", MARK) else " " + text
        words = WORD.findall(text) if MARK not in text else re.findall(f"{MARK}[^{MARK}]*", text.replace(" ", MARK))
        total, known = 0, self.known
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.word(w.replace(" ", MARK, 1))
                if len(w) <= 200:
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each whole text: one narrow pass. The vocabulary is broadcast; its size is that of a tokenizer."""
    if len(vocabulary) > 2_000_000:
        raise ValueError("a vocabulary of over 2,000,000 pieces is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            t = b.column(1).to_pylist()
            yield batch(doc_id=(b.column(0), pa.int64()), n_chars=([len(x or "") for x in t], pa.int64()), n_tokens=([counter(x) for x in t], pa.int64()))

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, SCHEMA)
