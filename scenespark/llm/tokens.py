"""Count-only Viterbi: how many pieces a unigram tokenizer cuts a text into, without its pieces.

A text is split at white space and each word gets the word mark in front, as unigram
tokenizers with a metaspace do; no piece crosses a word. For a word an Aho-Corasick
automaton over the vocabulary gives every match by its end, and one pass carries best
score and piece count. Ties go to the piece that starts first; a character that no
piece of its own covers may be unknown, at the least score less 10, and unknown
characters in a row are one piece. Words are counted once for as long as a bounded
cache holds them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE, CACHED_CHARS = 1 << 18, 64  # words that are kept, and how long they may be
_MARKED = re.compile(f"{MARK}[^{MARK}]*")
#: Unicode's white space. str.split() also parts words at U+001C to U+001F.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log-probability) from a sentencepiece model file, its special and byte pieces left out.

    The public files hold merge ranks rather than unigram scores, so a piece's score is
    that of its rank under Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, -math.log(i + 1) - total) for i, p in enumerate(pieces)]


def words(text: str) -> list[str]:
    return _WORD.findall(text) if _CONTROL.search(text) else text.split()


class Counter:
    """Piece counts of words by a vocabulary of (piece, score)."""

    def __init__(self, pieces: Iterable[tuple[str, float]]):
        scores = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.longest = max((len(p) for p in scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, which carries its mark. What is held grows with the longest piece, not with the word."""
        ring = self.longest + 1
        best, count, dark = [0.0] * ring, [0] * ring, [False] * ring
        matches = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        match = next(matches, None)
        for e in range(1, len(word) + 1):
            top, start, unknown, single = -math.inf, -1, False, False
            while match is not None and match[0] == e - 1:
                size, score = match[1]
                s = e - size
                single |= size == 1
                value = score + best[s % ring]
                if value > top or value == top and s < start:
                    top, start = value, s
                match = next(matches, None)
            before = (e - 1) % ring
            if not single and self.unknown + best[before] > top:
                top, start, unknown = self.unknown + best[before], e - 1, True
            pieces = count[start % ring] + (not (unknown and dark[start % ring] and start))
            best[e % ring], count[e % ring], dark[e % ring] = top, pieces, unknown
        return count[len(word) % ring]

    def marked(self, word: str) -> int:
        """Pieces of a word as it stands in a text: it gets the mark unless it has it, and marks within it begin words of their own."""
        if MARK not in word:
            return self.word(MARK + word)
        return sum(self.word(part) for part in _MARKED.findall(word if word[0] == MARK else MARK + word))

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and pieces of a text."""
        cache, total = self.cache, 0
        ws = words(text or "")
        for w in ws:
            n = cache.get(w)
            if n is None:
                n = self.marked(w)
                if len(w) <= CACHED_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = n
            total += n
        return len(ws), total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those to keep) with n_words and n_tokens, both long.

    A null or blank text has none. The vocabulary, of a size that its tokenizer fixes,
    goes to each task. A very long text or word is one pass; only short words are cached.
    Ties between pieces are the tokenizer's own. Repeated rows get equal counts, an empty
    table gives an empty table. Columns of docs with those names are replaced; others stay.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens")]
    schema = docs.select(*keep).withColumns({"n_words": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            found = [counter.text(t.as_py()) for t in b.column("__text")]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*keep, "n_words", "n_tokens"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
