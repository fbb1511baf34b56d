"""Token counts of a unigram vocabulary by count-only Viterbi.

A text is cut before every blank (blanks become U+2581, and one is put before a text that doesn't begin so); each piece is segmented by itself.
An Aho-Corasick automaton enumerates all vocabulary matches of a piece; dynamic programming over its characters keeps
only the best score and the number of tokens on the best way, never the tokens themselves.

Tie rules are the tokenizer's: ways are extended from left to right, and a way replaces another only if its score is
strictly greater, so of equal scores the one whose last token began first stays.  A character without a token of its
own counts as unknown with the lowest score of the vocabulary less 10; a run of unknown characters is one token, or,
with byte fallback, its UTF-8 bytes if the vocabulary has all of them.

Pieces whose characters are all common ones (or, with byte fallback, stand in no piece of the vocabulary) are segmented
side by side: one Aho-Corasick automaton with all its steps in a table moves through all of them place by place, and the
best way so far to each place is a column.  Other pieces go one by one through the same rules.

Texts are cut and counted a column at a time: the different pieces of a batch are looked up, what is new is segmented,
and rows are sums over arrays.  A worker keeps the automaton and the results of CACHE pieces from task to task.

Nulls and odd cases: a null or empty text has 0 tokens and score 0; pieces of any length are worked out whole, in
memory that grows with the piece alone; repeated rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter as Tally
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.words import slices

CACHE = 400_000
#: Characters that the lockstep automaton knows: of those that are tokens of their own ASCII's, then the commonest of the vocabulary.
DENSE = 160
#: Places of pieces that are segmented in lockstep at once.
CELLS = 1 << 18
BLANK = "▁"
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> tuple[list[tuple[str, float]], str]:
    """(piece, score) by id, and the unknown piece, of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.id_to_piece(model.unk_id())


class Lockstep:
    """The automaton of a vocabulary over its common characters, as tables: next state, and the matches that end in a state, longest first.

    ``unknown`` is the score of a character that no piece holds, where such a character counts as its bytes; None where it doesn't.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: float | None) -> None:
        scores = {p: s for p, s in pieces if p}  # of a piece that stands twice the last counts
        common = Tally("".join(scores))
        chars = sorted((c for c in common if c in scores), key=lambda c: (not c.isascii() and c != BLANK, -common[c], c))[:DENSE]
        self.unknown, self.none = unknown, len(chars)
        self.code = np.full(1 << 16, -1 if unknown is None else self.none, np.int16)
        self.code[[ord(c) for c in common if ord(c) < 1 << 16]] = -1
        for i, c in enumerate(chars):
            if ord(c) < 1 << 16:
                self.code[ord(c)] = i
        known = set(chars)
        own = [(p, s) for p, s in scores.items() if known.issuperset(p)]
        children: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        for piece, score in own:
            at = 0
            for c in piece:
                k = int(self.code[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                at = children[at][k]
            ends[at] = (len(piece), score)
        n = len(children)
        self.next, fail, depth = np.zeros((n, len(chars) + 1), np.int32), np.zeros(n, np.int64), [0]
        for at in depth:  # shorter beginnings first; the list grows as it is read
            if at:
                self.next[at] = self.next[fail[at]]
            for k, to in children[at].items():
                fail[to] = self.next[fail[at], k] if at else 0
                self.next[at, k] = to
                depth.append(to)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for at in depth:
            found[at] = ([ends[at]] if at in ends else []) + (found[fail[at]] if at else [])
        self.many = np.array([len(x) for x in found], np.int16)
        most = max(1, int(self.many.max()))
        self.length, self.score = np.zeros((n, most), np.int16), np.full((n, most), -np.inf)
        for at, matches in enumerate(found):
            for k, (length, score) in enumerate(matches):
                self.length[at, k], self.score[at, k] = length, score

    def count(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces (not empty) it can segment, and their tokens and scores."""
        size = np.array([len(p) for p in pieces], np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.where(points < 1 << 16, self.code[np.minimum(points, (1 << 16) - 1)], -1)
        begin = np.cumsum(size) - size
        good = np.minimum.reduceat(code, begin) >= 0 if len(pieces) else np.zeros(0, bool)
        tokens, score = np.zeros(len(pieces), np.int64), np.zeros(len(pieces))
        order = np.flatnonzero(good)[np.argsort(size[good], kind="stable")]
        at = 0
        while at < len(order):
            # pieces of about one length; the longest is the last
            end = at + 1
            while end < len(order) and (end + 1 - at) * (size[order[end]] + 1) <= CELLS and size[order[end]] <= 2 * size[order[at]] + 8:
                end = min(len(order), end + 256)
            while end > at + 1 and (end - at) * (size[order[end - 1]] + 1) > 2 * CELLS:
                end = at + (end - at) // 2
            part = order[at:end]
            tokens[part], score[part] = self._columns(code, points, begin[part], size[part])
            at = end
        return good, tokens, score

    def _columns(self, code: np.ndarray, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(begin), int(size[-1])
        best, count = np.zeros((n, longest + 1)), np.zeros((n, longest + 1), np.int64)
        state = np.zeros(n, np.int64)
        for t in range(1, longest + 1):
            lo = int(np.searchsorted(size, t))
            state = state[lo - n :] if lo else state
            here = code[begin[lo:] + t - 1]
            state = self.next[state, here].astype(np.int64)
            width = max(1, int(self.many[state].max()))
            rows = np.arange(lo, n)
            length = self.length[state, :width].astype(np.int64)
            ways = best[rows[:, None], t - length] + self.score[state, :width]
            pick = ways.argmax(1)  # of equal ways the longest last token: the first
            each = np.arange(n - lo)
            best[lo:, t] = ways[each, pick]
            count[lo:, t] = count[rows, t - length[each, pick]] + 1
            if self.unknown is not None and (none := np.flatnonzero(here == self.none)).size:
                point = points[begin[lo + none] + t - 1]
                best[lo + none, t] = best[lo + none, t - 1] + self.unknown
                count[lo + none, t] = count[lo + none, t - 1] + 1 + (point >= 0x80) + (point >= 0x800)
        each = np.arange(n)
        return count[each, size], best[each, size]


@dataclass
class Counter:
    """Best score and token count of pieces under a unigram vocabulary."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool = True
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in self.pieces}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in names} if self.byte_fallback else set()
        self.names = names
        # bytes of a run of unknown characters add up
        self.lockstep = Lockstep(self.pieces, self.unknown if len(self.bytes) == 256 else None)

    def count(self, piece: str) -> tuple[int, float]:
        """(tokens, score) of the best way through one piece."""
        found: list[list[tuple[int, float]]] = [[] for _ in piece]
        for end, (length, score) in self.automaton.iter(piece):
            found[end].append((length, score))
        # per place: score, tokens, and the start of an unknown run that ends there (-1: none)
        best, tokens, run = [0.0], [0], [-1]
        for end, matches in enumerate(found, 1):
            top, n, start = None, 0, -1
            for length, score in matches:  # longest first: its start comes first
                s = best[end - length] + score
                if top is None or s > top:
                    top, n, start = s, tokens[end - length] + 1, -1
            if not any(length == 1 for length, _ in matches):
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, start = s, run[end - 1] if run[end - 1] >= 0 else end - 1
                    # the run counts as a whole from where it began
                    n = tokens[start] + self._run(piece[start:end])
            best.append(top)
            tokens.append(n)
            run.append(start)
        return tokens[-1], best[-1]

    def _run(self, text: str) -> int:
        if text in self.names:
            return 1
        data = text.encode()
        return len(data) if self.bytes and all(b in self.bytes for b in data) else 1

    def _known(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of different pieces."""
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            side, tokens, scores = self.lockstep.count([BLANK + p for p in new])
            for piece, good, n, s in zip(new, side.tolist(), tokens.tolist(), scores.tolist(), strict=True):
                known[piece] = (n, s) if good else self.count(BLANK + piece)
        out = [known[p] for p in pieces]
        return np.array([n for n, _ in out], np.int64), np.array([s for _, s in out], np.float64)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of each text."""
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern(pc.replace_substring(texts, BLANK, " "), " ")
        begins, flat = words.offsets.to_numpy(), words.values
        row = np.repeat(np.arange(len(texts)), np.diff(begins))
        flat = flat.slice(int(begins[0]), int(begins[-1] - begins[0])).dictionary_encode()
        sizes = pc.binary_length(flat.dictionary).to_numpy()[flat.indices.to_numpy()]
        begins = begins - begins[0]
        # a text that begins with a blank gets no other before it, and an empty one has no piece
        first = np.zeros(len(row), bool)
        first[begins[:-1][np.diff(begins) > 0]] = True
        many = (np.diff(begins) > 1)[row] | (pc.binary_length(texts).to_numpy() == 0)[row]
        keep = ~(first & (sizes == 0) & many)
        n, score = self._known(flat.dictionary.to_pylist())
        at, row = flat.indices.to_numpy()[keep], row[keep]
        return np.bincount(row, n[at], len(texts)).astype(np.int64), np.bincount(row, score[at], len(texts))

    def text(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        n, score = self.column(pa.array([text], pa.string()))
        return int(n[0]), float(score[0])


_counters: dict[str, Counter] = {}


def counter_of(name: str, sent, byte_fallback: bool) -> Counter:
    """The worker's counter, kept from task to task; that of another query goes."""
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter(sent.value, byte_fallback)
    return _counters[name]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], *, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, score (of the best segmentation).

    ``pieces`` is a vocabulary: tens of thousands of short strings, sent along once.
    """
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(list(pieces)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(name, sent, byte_fallback)
        for whole in batches:
            for batch in slices(whole, 1):
                n, score = counter.column(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(score)], names=["id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, score double").withColumnRenamed("id", id_col)
