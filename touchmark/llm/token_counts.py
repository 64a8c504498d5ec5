"""Token counts by Viterbi search over the vocabulary matches that an Aho-Corasick automaton lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchmark.llm.common import read, register, text_or_empty

SPACE = "▁"
UNKNOWN = "<unk>"
#: Score of an unknown character below the least score of the vocabulary: a fixed value.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task keeps; it starts over beyond, which changes no count.
KEPT_WORDS = 1 << 18


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, the unknown piece first, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [
        (model.id_to_piece(i), model.get_score(i))
        for i in ids
        if not (model.is_control(i) or model.is_byte(i) or model.is_unused(i) or model.is_unknown(i))
    ]
    return [(UNKNOWN, 0.0), *pieces]


class Unigram:
    """Counts the pieces of the best segmentation under summed scores.

    Ties follow the tokenizers library: of equal scores at an end, the piece with the earliest start
    stays. A character that is no piece itself can be unknown; unknowns side by side count once.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score, piece == UNKNOWN))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.kept: dict[str, int] = {}

    def _search(self, word: str) -> int:
        n = len(word)
        scores, counts, unknown = [0.0] + [0.0] * n, [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(1, n + 1):
            best, best_start, best_unknown = 0.0, -1, False
            while match is not None and match[0] == end - 1:
                length, score, is_unknown = match[1]
                total, start = scores[end - length] + score, end - length
                if best_start < 0 or total > best or (total == best and start < best_start):
                    best, best_start, best_unknown = total, start, is_unknown
                match = next(matches, None)
            if word[end - 1] not in self.single:
                total = scores[end - 1] + self.unknown
                if best_start < 0 or total > best:
                    best, best_start, best_unknown = total, end - 1, True
            scores[end], unknown[end] = best, best_unknown
            counts[end] = counts[best_start] + (not (best_unknown and unknown[best_start]))
        return counts[n]

    def count(self, text: str) -> int:
        """Pieces of a text: words begin at each space, and the first has one put before it."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        if not words[0]:
            words = words[1:]
        total, kept = 0, self.kept
        for word in words:
            n = kept.get(word)
            if n is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                n = kept[word] = self._search(SPACE + word)
            total += n
        return total


def count_tokens(
    docs: DataFrame, vocabulary: Sequence[tuple[str, float]], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: key, n_tokens. Null and empty texts have 0 tokens; other columns are ignored.

    The vocabulary, bounded by its file, is broadcast; each task builds the automaton once and searches
    each distinct word once while it keeps it. Rows come back one for one; texts are never shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Unigram(shared.value)
        for texts in batches:
            yield texts.map(model.count).astype("int64")

    return docs.select(F.col(key), F.pandas_udf(counted, "long")(text_or_empty(text)).alias("n_tokens"))




@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(read(spark, d, "documents"), vocabulary)
