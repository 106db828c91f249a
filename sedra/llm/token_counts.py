"""Token counts under a unigram vocabulary, without tokens: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character of a word; dynamic
programming carries the best score and that path's number of pieces, and nothing else: a ring of as many entries as the longest
piece has characters, whatever the length of the word. Rules of the tokenizer kept exactly:
scores add in double precision; among paths of equal score the piece that starts first (the longest) wins;
a character that is no piece of its own is unknown, at the lowest score less 10; neighbouring unknown
characters are one token, or, with byte fallback, as many as they have UTF-8 bytes. Words (runs of anything
but ASCII white space) are marked by a leading U+2581 and counted one by one, so a text's count is the sum
over its words; counts of short words are remembered. The scores of the default vocabulary are merge ranks, as its
file holds no unigram model.

Null and blank texts have 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """(piece, score) pairs; the first is the unknown token."""

    pieces: tuple
    byte_fallback: bool = True


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file; control and placeholder pieces are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    unknown = model.unk_id()
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and model.get_score(i) > -1e6]
    return Vocabulary(((model.id_to_piece(unknown), 0.0), *((model.id_to_piece(i), model.get_score(i)) for i in ids)))


class Counter:
    def __init__(self, vocabulary: Vocabulary, most: int = 500_000):
        self.unknown = vocabulary.pieces[0][0]
        self.floor = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.pieces = {p for p, _ in vocabulary.pieces}
        self.longest = max(map(len, self.pieces))
        self.fallback = vocabulary.byte_fallback and all(f"<0x{i:02X}>" in self.pieces for i in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, piece == self.unknown))
        self.automaton.make_automaton()
        self.known: dict[bytes, int] = {}
        self.most = most

    def word(self, word: str) -> int:
        """The number of tokens of a marked word."""
        n, floor = len(word), self.floor
        size = min(n, self.longest) + 1
        # For each end of a prefix: its best score, the tokens of that path before its last run of unknown characters, and that run's start (or -1) and bytes.
        score, count, start, width = [0.0] * size, [0] * size, [-1] * size, [0] * size
        matches = self.automaton.iter(word)
        end, match = next(matches, (n, None))
        for e in range(1, n + 1):
            best, length, un, single = -math.inf, 1, False, False
            while end == e - 1:
                k, s, u = match
                single |= k == 1
                x = s + score[(e - k) % size]
                if x > best or (x == best and k > length):
                    best, length, un = x, k, u
                end, match = next(matches, (n, None))
            if not single and floor + score[(e - 1) % size] > best:
                best, length, un = floor + score[(e - 1) % size], 1, True
            p, at = (e - length) % size, e % size
            if un:
                b = len(word[e - length : e].encode("utf-8", "surrogatepass"))
                row = (count[p], start[p], width[p] + b) if start[p] >= 0 else (count[p], e - length, b)
            else:
                row = (self._closed(word, e - length, count[p], start[p], width[p]) + 1, -1, 0)
            score[at], (count[at], start[at], width[at]) = best, row
        p = n % size
        return self._closed(word, n, count[p], start[p], width[p])

    def _closed(self, word: str, end: int, count: int, start: int, width: int) -> int:
        """count, and the tokens of the run of unknown characters from start to end."""
        if start < 0:
            return count
        known = end - start <= self.longest and word[start:end] in self.pieces
        return count + (width if self.fallback and not known else 1)

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, words)."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(MARK + w.decode("utf-8", "surrogatepass"))
                if len(w) <= 48:
                    if len(known) >= self.most:
                        known.clear()
                    known[w] = n
            total += n
        return total, len(words)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(id, n_tokens, n_words) for each row of docs. path: a model file that every executor has."""
    ship(docs.sparkSession)

    def run(batches):
        if vocabulary is not None:
            counter = Counter(vocabulary)
        else:
            counter = _counters.get(path or "") or _counters.setdefault(path or "", Counter(load_vocabulary(path)))
        for b in batches:
            rows = [counter.text(t) for t in texts(b, text_col)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], [id_col, "n_tokens", "n_words"])

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, out)
