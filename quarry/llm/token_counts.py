"""Token counts of a tokenizer, without keeping the tokens.

An Aho-Corasick automaton lists the vocabulary's pieces in a word; dynamic programming over its positions carries the
number of pieces, never the pieces. What decides between pieces that end at one position is the tokenizer's own rule.

With a unigram vocabulary (pieces and log probabilities) as a parameter, that is the best score: of paths
with equal scores to a position, the one whose last piece starts first stays; a character
without a piece of its own is an unknown one, scored below all pieces, and neighbouring unknown ones are one
token.

No unigram vocabulary ships, and none is trained, so by default the counts are those of the shipped
``piece_bpe_32k.model``, a BPE model whose scores are ranks of merges. There exactly one piece that ends at a position goes on from the pieces before
it: the one that would stay apart from the last of them if the two were merged by rank, which the ways the two are built of
smaller pieces tell. A character without a piece is as many tokens as it has bytes.

Words start with the mark that stands for a space, and no piece but runs of marks
goes across one, so words are counted apart and each worker keeps the counts of the words it has met.

Defined cases: null or empty text has no tokens; repeated rows are counted each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import Kept, map_batches, with_text, worker_cache

#: What stands for a space; how far below the least score an unknown character is.
SPACE, BELOW = "▁", 10.0
#: Words whose counts a worker keeps in each of two generations, and their greatest length.
CACHE, CACHE_CHARS = 200_000, 64
#: Pairs of pieces a worker knows at most.
PAIRS = 500_000


def default_model() -> str:
    """A public model, read where it lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_vocabulary() -> tuple[tuple[str, float], ...]:
    """Pieces and scores of the public model; the scores are ranks of merges."""
    return _read(default_model())


@lru_cache(maxsize=4)
def _read(path: str) -> tuple[tuple[str, float], ...]:
    """The normal pieces only: control pieces and byte fallbacks match no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


class _ByWord:
    """Counts of texts from those of their words; ``count`` gives the tokens of one word."""

    def __init__(self) -> None:
        self.known = Kept(CACHE)

    def count(self, word: str) -> int:
        raise NotImplementedError

    def count_all(self, words: list[str]) -> list[int]:
        return [self.count(w) for w in words]

    def counts(self, texts: list[str]) -> list[int]:
        # A run of spaces stays with the word after it; only single spaces are the usual case.
        words = [(" " + t).replace(" ", SPACE).replace(SPACE, " " + SPACE).split(" ")[1:] if SPACE * 2 not in (" " + t).replace(" ", SPACE) else _runs((" " + t).replace(" ", SPACE)) for t in texts]
        fresh = self.known.missing(set().union(*words))
        self.known.new.update(zip(fresh, self.count_all(list(fresh)), strict=True))
        known = self.known.new
        out = [sum(map(known.__getitem__, own)) if t else 0 for own, t in zip(words, texts, strict=True)]
        self.known.forget_long(fresh, CACHE_CHARS)
        return out


@dataclass(frozen=True)
class Merges:
    """Pieces of a BPE vocabulary in the order of their merges, and the two places each is made of: -1 and -1 for a character of its own.

    ``lone`` are the characters that stand in pieces without being one; they have the places after the last piece.
    """

    pieces: tuple[str, ...]
    halves: tuple[tuple[int, int], ...]
    lone: tuple[str, ...]

    @classmethod
    def of(cls, vocabulary: tuple[tuple[str, float], ...]) -> Merges:
        """Pieces that their own merges don't lead to are never tokens of more than themselves, so they are left out."""
        ordered = tuple(p for p, _ in sorted(vocabulary, key=lambda x: -x[1]))
        rank = {p: i for i, p in enumerate(ordered)}
        lone = tuple(sorted({c for p in ordered for c in p} - rank.keys()))
        place = rank | {c: len(ordered) + i for i, c in enumerate(lone)}
        halves = []
        for piece in ordered:
            parts, last = list(piece), (-1, -1)
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], len(rank)), i))
                if parts[best] + parts[best + 1] not in rank:
                    break
                last = place[parts[best]], place[parts[best + 1]]
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            halves.append(last if len(parts) == 1 else (-2, -2))
        return cls(ordered, tuple(halves), lone)


class MergeCounter(_ByWord):
    """Counts of words under a BPE vocabulary with byte fallback."""

    def __init__(self, merges: Merges) -> None:
        import ahocorasick

        super().__init__()
        self.halves = merges.halves
        self.place = {p: i for i, p in enumerate((*merges.pieces, *merges.lone))}
        self.rank = {p: i for i, p in enumerate(merges.pieces)}
        self.names = (*merges.pieces, *merges.lone)
        self.edges: tuple[dict, dict] = ({}, {})
        self.n = len(merges.pieces)
        self.automaton = ahocorasick.Automaton()
        for i, (piece, (left, _)) in enumerate(zip(merges.pieces, merges.halves, strict=True)):
            _check_piece(piece)
            if left > -2:
                self.automaton.add_word(piece, (len(piece), i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}

    def _edge(self, place: int, side: int) -> list[tuple[str, int]]:
        """The pieces at one edge of a piece, from itself down to a character, each with the rank at which it is merged further."""
        out = self.edges[side].get(place)
        if out is None:
            out, at, above = [], place, self.n + 1
            while at < self.n and self.halves[at][0] >= 0:
                out.append((self.names[at], above))
                at, above = self.halves[at][side], at
            out.append((self.names[at], above))
            self.edges[side][place] = out
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the boundary of two neighbouring pieces comes before those that build them; of equal ranks the left one is first."""
        key = a * (len(self.names) + 1) + b
        found = self.apart.get(key)
        if found is None:
            found = self._apart(self._edge(a, 1), self._edge(b, 0))
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found

    def _apart(self, lefts: list[tuple[str, int]], rights: list[tuple[str, int]]) -> bool:
        rank = self.rank.get
        for x, x_above in lefts:
            for y, y_above in rights:
                across = rank(x + y)
                if across is not None and across < x_above and across <= y_above:
                    return False
        return True

    def count(self, word: str) -> int:
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
        if len(self.automaton):
            for last, (size, place) in self.automaton.iter(word):
                ends[last + 1].append((last + 1 - size, place))
        tokens, before = [0] * (len(word) + 1), [-1] * (len(word) + 1)  # of each prefix: how many, and the last one
        for end in range(1, len(word) + 1):
            for start, place in ends[end]:  # one of them goes on, in whatever order they come
                if not start or before[start] < 0 or self.stay_apart(before[start], place):
                    tokens[end], before[end] = tokens[start] + 1, place
                    break
            else:  # a character without a piece
                tokens[end], before[end] = tokens[end - 1] + len(word[end - 1].encode("utf-8", "replace")), self.place.get(word[end - 1], -1)
        return tokens[-1]


def _check_piece(piece: str) -> None:
    if SPACE in piece.lstrip(SPACE):
        raise ValueError(f"words can't be counted apart: {piece!r} goes across a space")


class Counter(_ByWord):
    """Counts of words under a unigram vocabulary."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...]) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            _check_piece(piece)
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - BELOW

    def _ends(self, word: str) -> list[list[tuple[int, float]]]:
        """Start and score of the pieces that end at each position, longest first."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        if len(self.automaton):
            for last, (size, score) in self.automaton.iter(word):
                ends[last + 1].append((last + 1 - size, score))
        for one in ends:
            one.sort()
        return ends

    def count(self, word: str) -> int:
        """Tokens of one stretch of text whose spaces are marks."""
        ends = self._ends(word)
        own = [False] * (len(word) + 1)  # positions where a piece of one character starts
        for end, pieces in enumerate(ends):
            if pieces and pieces[-1][0] == end - 1:
                own[end - 1] = True
        score, pieces, open_ = [0.0] * (len(word) + 1), [0] * (len(word) + 1), [False] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            best = None
            for start, value in ends[end]:
                if best is None or score[start] + value > best:
                    best = score[start] + value
                    pieces[end], open_[end] = pieces[start] + 1, False
            if not own[end - 1]:
                value = score[end - 1] + self.unknown
                if best is None or value > best:
                    best = value
                    pieces[end], open_[end] = pieces[end - 1] + (not open_[end - 1]), True
            score[end] = best
        return pieces[-1]


def _runs(text: str) -> list[str]:
    """Words with all the marks before them."""
    out, first = [], 0
    for i in range(1, len(text)):
        if text[i] == SPACE and text[i - 1] != SPACE:
            out.append(text[first:i])
            first = i
    return [*out, text[first:]]


def token_counts(docs: DataFrame, vocabulary: tuple[tuple[str, float], ...] | None = None) -> DataFrame:
    """doc_id, n_tokens and n_chars of every document: of the shipped BPE model, or of a unigram vocabulary."""
    if vocabulary is None:
        kind, held = MergeCounter, Merges.of(default_vocabulary())
    else:
        kind, held = Counter, vocabulary
    name = hash(held)
    shared = docs.sparkSession.sparkContext.broadcast(held)  # a tokenizer's vocabulary, the same at every size

    def run(batch: pa.RecordBatch) -> dict:
        counter = worker_cache(("counter", name), lambda: kind(shared.value))
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "n_tokens": counter.counts(texts), "n_chars": [len(t) for t in texts]}

    return map_batches(with_text(docs, "doc_id"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_chars long")
