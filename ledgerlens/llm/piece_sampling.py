"""SentencePiece encoding by forward filtering and backward sampling.

A text's segmentation is drawn from the piece lattice: forward sums over all
segmentations of every prefix, then pieces are drawn from the end backwards
with exactly their conditional probabilities.  Draws come from a counter-based
generator keyed by the row key, the word's place and the step, so a row gets
the same pieces wherever and however often it is encoded.

No piece holds a space mark after another character (checked when the
vocabulary is loaded), so a lattice falls apart at spaces: the forward sums of
every distinct word are computed once, all words of a batch side by side, and
kept for the batches to come.  A long word (text without spaces) is filtered in
segments: its forward sums are linear in those of the last few characters before a
stretch, so all stretches of a segment advance together, first for every such
start, then for the start they really have.  Its draws are keyed by the place
in the word, so that all places draw at once and the path only follows them.
Characters without a piece of their own become their UTF-8 bytes, so decoding
gives back the exact text, space marks, control characters and all.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, mix64, spans

DEFAULT_MODEL = "piece_bpe_32k.model"
TEMPERATURE = 1.0
MARK = "▁"
#: Stands for a space mark that the text itself holds; no character has this code.
_LITERAL_MARK = 0x110000
_CHARS = 1 << 17
#: Characters of words whose lattices are kept from batch to batch; of these, of words that are not forgotten.
_KEPT_CHARS, _COMMON_CHARS = 5 << 17, 1 << 18
#: Occurrences in the first period from which on a word is not forgotten.
_COMMON = 2
#: Words from this length on are filtered by stretches; characters of a segment and of a stretch.
_LONG, _SEGMENT, _STRETCH = 128, 1 << 16, 256
_RUNS = re.compile(" *[^ ]+| +$")


def model_path(name: str = DEFAULT_MODEL) -> str:
    """Path of a public model file that is installed on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- vocabulary -------------------------------------------------------------

@dataclass(frozen=True)
class Vocabulary:
    """Piece strings by id, log weights, and the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    weight: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray


def load_vocabulary(path: str, temperature: float = TEMPERATURE) -> Vocabulary:
    """Vocabulary of a model file with byte pieces.

    Scores of a unigram model are log probabilities and are used as they are.
    A BPE model has merge ranks instead; its pieces get Zipf weights
    1 / ((rank + 2) ln size).  Both are divided by ``temperature``.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = tuple(model.id_to_piece(i) for i in range(size))
    special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
                        for i in range(size)])
    score = np.array([model.get_score(i) for i in range(size)])
    if (score[~special] == np.round(score[~special])).all():
        weight = -np.log((np.maximum(-score, 0) + 2) * np.log(size))
        weight[special] = -np.log(size * np.log(size))
    else:
        weight = score.copy()
        weight[special] = score[~special].min()
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(special):
        if model.is_byte(int(i)):
            byte_ids[int(pieces[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces; decoding could not be lossless")
    if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in np.flatnonzero(~special)):
        raise ValueError("a piece spans a word boundary")
    return Vocabulary(pieces, weight / temperature, ~special, byte_ids)


class Trie:
    """Transitions (node, character) -> node in an open hash table."""

    def __init__(self, vocabulary: Vocabulary):
        nodes: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for piece in np.flatnonzero(vocabulary.normal).tolist():
            node = 0
            for c in vocabulary.pieces[piece]:
                node = nodes.setdefault((node, ord(c)), len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            if node:
                piece_of[node] = piece
        keys = np.array([(n << 21) | c for n, c in nodes], np.int64)
        child = np.fromiter(nodes.values(), np.int64, len(nodes))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._place(keys)
        while len(keys):  # the first of those that want a free place gets it, the others try the next one
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            taken = np.zeros(len(at), bool)
            taken[first] = True
            taken &= free
            self.keys[at[taken]], self.child[at[taken]] = keys[taken], child[taken]
            keys, child, at = keys[~taken], child[~taken], (at[~taken] + 1) & ((1 << self.bits) - 1)
        self.piece_of = np.array(piece_of, np.int64)
        first = {c: child for (n, c), child in nodes.items() if n == 0}
        self.root = np.zeros(_LITERAL_MARK + 1, np.int32)
        self.root[list(first)] = list(first.values())

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        key = (node.astype(np.int64) << 21) | code
        at = self._place(key)
        found = self.keys[at]
        out = np.where(found == key, self.child[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _codes(text: str) -> np.ndarray:
    """Code points; spaces as the mark, marks as a code of their own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes == ord(MARK), _LITERAL_MARK, np.where(codes == 32, ord(MARK), codes))


def _spelled(code: int) -> bytes:
    """UTF-8 bytes of a character that has no piece."""
    return chr(ord(MARK) if code == _LITERAL_MARK else code).encode("utf-8", "surrogatepass")


# --- lattice ----------------------------------------------------------------

class Lattice:
    """Lattices of distinct words with their backward draws prepared."""

    def __init__(self, words: list[str], vocabulary: Vocabulary, trie: Trie):
        codes = _codes("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        self.last, self.first = ends + np.arange(len(words)), ends - sizes + np.arange(len(words))
        # node p + word number: the place before character p of that word
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) + word
        stop = ends[word]

        start, width, piece = [], [], []
        at = np.arange(len(codes))
        node, length = trie.root[codes].astype(np.int64), 1
        alone = trie.piece_of[node] >= 0
        while len(at):
            live = node > 0
            at, node = at[live], node[live]
            found = trie.piece_of[node]
            hit = found >= 0
            start.append(at[hit])
            width.append(np.full(int(hit.sum()), length))
            piece.append(found[hit])
            more = at + length < stop[at]
            at, node = at[more], node[more]
            node = trie.step(node, codes[at + length]) if len(at) else node
            length += 1
        lone = np.flatnonzero(~alone)
        start.append(lone)
        width.append(np.ones(len(lone), np.int64))
        piece.append(-1 - np.arange(len(lone)))
        start, width, piece = (np.concatenate(x) for x in (start, width, piece))

        # tokens of every edge; a character without a piece spells its bytes
        spelled = [_spelled(c) for c in codes[lone].tolist()]
        raw = vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        weight = np.where(piece >= 0, vocabulary.weight[np.maximum(piece, 0)], 0.0)
        if len(lone):
            weight[-len(lone):] = lengths * vocabulary.weight[vocabulary.byte_ids[0]]

        begin, end = place[start], place[start] + width
        offset = end - self.first[word[start]]
        # by offset, end and begin: one key, as no two edges share all three
        order = np.argsort((offset * (len(codes) + len(words) + 1) + end) * (length + 1) - width)
        begin, end, weight, piece, offset = (x[order] for x in (begin, end, weight, piece, offset))
        self.begin = begin.astype(np.int32)
        self.token_count = np.ones(len(piece), np.uint8)
        spell = np.flatnonzero(piece < 0)
        self.token_count[spell] = lengths[-1 - piece[spell]]
        spell_at = np.concatenate(([0], np.cumsum(lengths)))
        self.tokens = np.concatenate((piece, raw)).astype(np.int32)
        self.token_at = np.arange(len(piece), dtype=np.int32)
        self.token_at[spell] = len(piece) + spell_at[-1 - piece[spell]]

        # forward: log sum over all segmentations up to each node, by distance from the word's start
        total = np.zeros(len(codes) + len(words))
        chance = np.empty(len(begin))
        node_at = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1]))) if len(end) else np.zeros(0, np.int64)
        node_end = np.append(node_at[1:], len(end))
        cuts = np.flatnonzero(np.diff(offset[node_at], prepend=-1)) if len(node_at) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(node_at))):
            lo, hi = node_at[a], node_end[b - 1]
            seg = node_at[a:b] - lo
            value = total[begin[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(value, seg)
            count = node_end[a:b] - node_at[a:b]
            share = np.exp(value - np.repeat(top, count))
            mass = np.add.reduceat(share, seg)
            total[end[node_at[a:b]]] = top + np.log(mass)
            chance[lo:hi] = share / np.repeat(mass, count)
        self.total = total
        # backward draws: one search in the running sum, a whole number per node, between its first and last edge
        self.running = np.cumsum(chance)
        self.before = np.zeros(len(total))
        self.low, self.high = np.zeros(len(total), np.int32), np.zeros(len(total), np.int32)
        if len(node_at):
            node = end[node_at]
            self.low[node], self.high[node] = node_at, node_end - 1
            self.before[node[1:]] = self.running[node_at[1:] - 1]

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One draw per occurrence: tokens of all in order, and the number of tokens of each."""
        place, stop, open_ = self.last[words], self.first[words], np.arange(len(words))
        who, edges, step = [], [], 0
        steps = np.zeros(len(words), np.int64)
        with np.errstate(over="ignore"):
            while len(open_):
                u = (mix64(seeds + U64(step) * U64(0xD1B54A32D192ED03)) >> U64(11)).astype(np.float64) * 2.0 ** -53
                edge = np.searchsorted(self.running, self.before[place] + u, side="right")
                edge = np.minimum(np.maximum(edge, self.low[place]), self.high[place])
                who.append(open_)
                edges.append(edge)
                steps[open_] += 1
                place = self.begin[edge]
                more = np.flatnonzero(place > stop)
                place, stop, seeds, open_ = place[more], stop[more], seeds[more], open_[more]
                step += 1
        if not who:
            return np.zeros(0, np.int64), steps
        # drawn from the back: the s-th draw of an occurrence is the s-th edge from its end
        ordered = np.empty(int(steps.sum()), np.int64)
        behind = np.cumsum(steps)
        for s, (w, e) in enumerate(zip(who, edges)):
            ordered[behind[w] - 1 - s] = e
        count = self.token_count[ordered].astype(np.int64)
        at = np.repeat(self.token_at[ordered], count) + _within(count)
        owner = np.repeat(np.arange(len(words)), steps)
        return self.tokens[at], np.bincount(owner, weights=count, minlength=len(words)).astype(np.int64)


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of ``count`` items."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


class LongWord:
    """Forward sums of one word of any length; only these (a number per character) are held whole."""

    def __init__(self, word: str, vocabulary: Vocabulary, trie: Trie):
        self.codes, self.vocabulary, self.trie = _codes(word), vocabulary, trie
        n = len(self.codes)
        self.total = np.zeros(n + 1)
        for a in range(0, n, _SEGMENT):
            b = min(a + _SEGMENT, n)
            weight = self._band(a, b)[0]
            self.total[a + 1:b + 1] = self._forward(weight, self.total[max(0, a + 1 - weight.shape[1]):a + 1])

    def _band(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and piece (-1: spelled by bytes) of the edge of each width that ends at characters a..b."""
        reach = max(0, a - 32)  # pieces are far shorter
        codes = self.codes[reach:b]
        at, node = np.arange(len(codes)), self.trie.root[codes].astype(np.int64)
        edges = []
        while len(at):
            live = node > 0
            at, node = at[live], node[live]
            found = self.trie.piece_of[node]
            hit = found >= 0
            edges.append((at[hit] + len(edges) - (a - reach), found[hit]))
            more = at + len(edges) < len(codes)
            at, node = at[more], node[more]
            node = self.trie.step(node, codes[at + len(edges)]) if len(at) else node
        while len(edges) > 1 and not len(edges[-1][0]):
            edges.pop()
        if len(edges) > 32:
            raise ValueError("the vocabulary has a piece of more than 32 characters")
        weight, piece = np.full((b - a, max(1, len(edges))), -np.inf), np.full((b - a, max(1, len(edges))), -1, np.int32)
        for k, (end, found) in enumerate(edges):
            inside = end >= 0
            weight[end[inside], k], piece[end[inside], k] = self.vocabulary.weight[found[inside]], found[inside]
        lone = np.flatnonzero(piece[:, 0] < 0)
        own = self.codes[a:b][lone]
        own = np.where(own == _LITERAL_MARK, ord(MARK), own)
        size = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        weight[lone, 0] = size * self.vocabulary.weight[self.vocabulary.byte_ids[0]]
        return weight, piece

    @staticmethod
    def _forward(weight: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log forward sums behind each character of a segment, given those of the places up to its start."""
        n, reach = weight.shape
        stretches = -(-n // _STRETCH)
        pad = np.full((stretches * _STRETCH, reach), -np.inf)
        pad[:n] = weight
        pad[n:, 0] = 0.0
        # factor[c, t, k]: of the edge that ends behind place t of stretch c and begins reach - k places before
        factor = np.exp(pad[:, ::-1].reshape(stretches, _STRETCH, reach))

        def run(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Values (scaled) and log scales of all places from ``state[c, reach, columns]``."""
            columns = state.shape[2]
            value = np.zeros((stretches, reach + _STRETCH, columns))
            value[:, :reach] = state
            done = np.empty((stretches, _STRETCH, columns))
            scale, scales = np.zeros((stretches, columns)), np.empty((stretches, _STRETCH, columns))
            for t in range(_STRETCH):
                if t % 8 == 0:
                    top = value[:, t:t + reach].max(axis=1)
                    top[top <= 0] = 1.0
                    value[:, t:t + reach] /= top[:, None]
                    scale = scale + np.log(top)
                done[:, t] = value[:, t + reach] = np.einsum("ck,ckb->cb", factor[:, t], value[:, t:t + reach])
                scales[:, t] = scale
            return done, scales

        start = np.full(reach, -np.inf)
        start[reach - min(reach, len(before)):] = before[-reach:]
        starts = np.empty((stretches, reach))
        starts[0] = start
        if stretches > 1:
            value, scales = run(np.broadcast_to(np.eye(reach), (stretches, reach, reach)))
            with np.errstate(divide="ignore"):
                last = np.log(value[:, -reach:]) + scales[:, -reach:]
            for c in range(1, stretches):
                terms = last[c - 1] + starts[c - 1][None, :]
                top = terms.max(axis=1)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    starts[c] = np.log(np.exp(terms - safe[:, None]).sum(axis=1)) + safe
        top = starts.max(axis=1)
        value, scales = run(np.exp(starts - top[:, None])[:, :, None])
        with np.errstate(divide="ignore"):
            return (np.log(value[:, :, 0]) + scales[:, :, 0] + top[:, None]).ravel()[:n]

    def sample(self, seed: int) -> np.ndarray:
        """Tokens of one draw."""
        end, out = len(self.codes), []
        for a in range((end - 1) // _SEGMENT * _SEGMENT, -1, -_SEGMENT):
            b = min(a + _SEGMENT, len(self.codes))
            weight, piece = self._band(a, b)
            places = np.arange(a + 1, b + 1)
            from_ = places[:, None] - np.arange(1, weight.shape[1] + 1)[None, :]
            total = np.where(from_ >= 0, self.total[np.maximum(from_, 0)], -np.inf)
            chance = np.exp(total + weight - self.total[places][:, None])
            running = np.cumsum(chance, axis=1)
            with np.errstate(over="ignore"):
                u = (mix64(U64(seed) + places.astype(np.uint64) * U64(0xD1B54A32D192ED03)) >> U64(11)).astype(np.float64)
            width = (running <= (u * 2.0 ** -53 * running[:, -1])[:, None]).sum(axis=1)
            width = np.minimum(width, weight.shape[1] - 1)
            steps, path = width.tolist(), []
            while end > a:
                path.append(end - a - 1)
                end -= steps[end - a - 1] + 1
            path = np.array(path, np.int64)
            out.append((piece[path, width[path]], a + path))
        tokens: list[np.ndarray] = []
        for found, ends in out:
            lone = np.flatnonzero(found < 0)
            if len(lone):
                spelled = [_spelled(c) for c in self.codes[ends[lone]].tolist()]
                count = np.ones(len(found), np.int64)
                count[lone] = list(map(len, spelled))
                row = np.repeat(found, count)
                # tokens stand from the back, and so do the bytes of a character
                row[np.repeat(found < 0, count)] = self.vocabulary.byte_ids[
                    np.frombuffer(b"".join(x[::-1] for x in spelled), np.uint8)]
                found = row
            tokens.append(found)
        return np.concatenate(tokens)[::-1].astype(np.int32)


# --- texts ------------------------------------------------------------------

def words_of(text: str) -> list[str]:
    """Words without the first of the spaces before them (the text is read as if a space stood before it)."""
    parts = text.split(" ")
    if "" in parts:
        return [w[1:] for w in _RUNS.findall(" " + text)]
    return parts


class _Numbers(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Sampler:
    """Encodes batches of texts; lattices of words are kept until they hold ``_KEPT_CHARS`` characters.

    Then the words are forgotten, but the commonest ones of the first period stay for good, up to ``_COMMON_CHARS``.
    """

    def __init__(self, vocabulary: Vocabulary, trie: Trie):
        self.vocabulary, self.trie = vocabulary, trie
        self.numbers: _Numbers
        self.lattices: list[tuple[int, int, Lattice]]
        self.long: dict[int, str]
        self.chars: int
        self._start([])
        self.seen = np.zeros(0, np.int64)  # occurrences of the words of the first period
        self.stay: tuple[list[str], list[tuple[int, int, Lattice]], int] | None = None

    def _forget(self) -> None:
        if self.stay is None:
            common = np.flatnonzero(self.seen >= _COMMON)
            common = common[np.argsort(-self.seen[common], kind="stable")]
            words = list(self.numbers)
            words = [words[i] for i in common.tolist() if len(words[i]) < _LONG]
            sizes = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            self._start(words[:int(np.searchsorted(sizes, _COMMON_CHARS, side="right"))])
            self.stay = list(self.numbers), self.lattices[:], self.chars
        else:
            words, lattices, self.chars = self.stay
            self.numbers, self.lattices, self.long = _Numbers(zip(words, range(len(words)))), lattices[:], {}

    def _start(self, words: list[str]) -> None:
        self.numbers, self.lattices, self.long, self.chars = _Numbers(zip(words, range(len(words)))), [], {}, 0
        if words:
            self._learn(0)

    def _learn(self, known: int) -> None:
        words = list(islice(self.numbers, known, None))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = list(map(" ".__add__, words))
        for i in np.flatnonzero(sizes >= _LONG).tolist():
            self.long[known + i], short[i] = words[i], ""
        self.lattices.append((known, known + len(words), Lattice(short, self.vocabulary, self.trie)))
        self.chars += int(sizes.sum())

    def __call__(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled token ids of each text; ``keys`` are the seeds of the rows. An empty text has none."""
        if self.chars > _KEPT_CHARS:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        order, counts = array("q"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = words_of(text)
                counts[i] = len(found)
                order.extend(map(number, found))
        if not len(order):
            return [np.zeros(0, np.int32) for _ in texts]
        if len(self.numbers) > known:
            self._learn(known)
        words = np.array(order, np.int64)
        if self.stay is None:
            seen = np.bincount(words, minlength=len(self.numbers))
            seen[:len(self.seen)] += self.seen
            self.seen = seen
        with np.errstate(over="ignore"):
            seeds = mix64(np.repeat(keys.astype(np.int64).view(np.uint64), counts)
                          + (_within(counts).astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))
        long = np.zeros(len(self.numbers), bool)
        long[list(self.long)] = True
        drawn = []
        for first, end, lattice in self.lattices:
            at = np.flatnonzero((words >= first) & (words < end) & ~long[words])
            if len(at):
                drawn.append((at, *lattice.sample(words[at] - first, seeds[at])))
        at = np.flatnonzero(long[words])
        for which in np.unique(words[at]):
            word = LongWord(" " + self.long[int(which)], self.vocabulary, self.trie)
            for i in at[words[at] == which].tolist():
                tokens = word.sample(int(seeds[i]))
                drawn.append((np.array([i]), tokens, np.array([len(tokens)])))
        per_word = np.zeros(len(words), np.int64)
        for at, _, size in drawn:
            per_word[at] = size
        upto = np.cumsum(per_word)
        tokens = np.empty(int(upto[-1]), np.int32)
        for at, found, size in drawn:
            tokens[np.repeat(upto[at] - size, size) + _within(size)] = found
        ends = np.concatenate(([0], upto))[np.cumsum(counts)]
        return [tokens[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]


def encode_batch(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, trie: Trie) -> list[np.ndarray]:
    """``Sampler`` over one batch."""
    return Sampler(vocabulary, trie)(texts, keys)


class Decoder:
    """Token ids back to text."""

    def __init__(self, vocabulary: Vocabulary):
        table = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for byte, i in enumerate(vocabulary.byte_ids.tolist()):
            table[i] = bytes([byte])
        self.piece = table.__getitem__

    def __call__(self, ids: np.ndarray) -> str:
        return b"".join(map(self.piece, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


# --- the operator -----------------------------------------------------------

def _encode(vocabulary: Vocabulary):
    """``mapInPandas`` body: (doc_id as text, text, key) to (doc_id, ids, lossless), a few texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, decode = Sampler(vocabulary, Trie(vocabulary)), Decoder(vocabulary)
        for frame in frames:
            texts, keys = frame["text"].tolist(), frame["key"].to_numpy(np.int64)
            for a, b in spans([len(t or "") for t in texts], _CHARS):
                part = texts[a:b]
                encoded = sampler([t or "" for t in part], keys[a:b])
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[a:b].to_numpy(),
                    "ids": pd.Series([None if t is None else e for t, e in zip(part, encoded)], dtype=object),
                    "lossless": pd.Series([None if t is None else decode(e) == t
                                           for t, e in zip(part, encoded)], dtype=object)})

    return run


def decoded_column(ids: Column, vocabulary: Vocabulary) -> Column:
    """Text of an id array; null for null, empty for empty."""

    @F.pandas_udf("string")
    def decode_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = Decoder(vocabulary)
        for arrays in batches:
            yield pd.Series([None if a is None else decode(np.asarray(a)) for a in arrays], dtype=object)

    return decode_ids(ids)


def encode_documents(docs: DataFrame, path: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``doc_id, ids, n_pieces, lossless`` of every document, sampled with the row key ``doc_id``.

    A null text has null ids and zero pieces, an empty text no ids; rows of one
    id and text get the same pieces, rows with a null id share one key.  An
    empty table gives no rows; other columns are not read.
    """
    vocabulary = load_vocabulary(path or model_path(), temperature)
    # ids travel as text: a batch with a null id would turn whole numbers into doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("doc_id").alias("key"))
    encoded = rows.mapInPandas(_encode(vocabulary), "doc_id string, ids array<int>, lossless boolean")
    return encoded.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids",
                          F.coalesce(F.array_size("ids"), F.lit(0)).alias("n_pieces"), "lossless")
