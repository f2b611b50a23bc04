"""License scan: MinHash bands over overlapping windows, then exact containment.

For a template of n distinct five-word shingles, windows of just over n
shingles start every n/4 shingles, so every run of n shingles of a text lies in
a window.  Band settings follow from the lowest Jaccard similarity that such a
window can have with a template that it contains to 0.8: they retrieve it with
probability ``GUARANTEE`` or more.  Retrieved pairs are verified on the words
themselves.

A window can contain 0.8 of a template only if it holds as many of its shingles,
so signatures are made for windows with so many hits.

Notices of fewer than five words have no shingle: they count where their words
stand in a row.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, mix64, spans
from ledgerlens.llm._words import range_hashes, word_bounds
from ledgerlens.llm.license_texts import NOTICES, TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 2
GUARANTEE = 0.9999
_BYTES = 1 << 20
_CELLS = 1 << 18
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id string, license string, containment double, first_word int, window_words int"


def _is_separator() -> np.ndarray:
    out = np.ones(256, bool)
    for part in (slice(48, 58), slice(97, 123), slice(128, 256)):
        out[part] = False
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII bytes."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every run of five word hashes."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * U64(0x100000001B3) + words[k:k + n]
    return mix64(out)


class SizeClass:
    """Templates with the same number of shingles: their windows, bands and signatures."""

    def __init__(self, n: int, containment: float, rows: int, guarantee: float):
        self.n, self.rows = n, rows
        self.need = math.ceil(containment * n - 1e-9)
        self.stride = max(1, n // 4)
        self.width = math.ceil((n + self.stride - 1) / self.stride) * self.stride
        self.lowest = self.need / (self.width + n - self.need)
        hit = self.lowest ** rows
        self.bands = 1 if hit >= 1 else math.ceil(math.log(1 - guarantee) / math.log(1 - hit))
        self.salts = mix64(np.arange(1, self.bands * rows + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
        self.names: list[int] = []
        self.keys: list[np.ndarray] = []
        self.known = np.zeros(0, np.uint64)

    def signature(self, windows: np.ndarray) -> np.ndarray:
        """Band keys (windows x bands) of shingle hashes (windows x width)."""
        out = np.empty((len(windows), self.bands), np.uint64)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                key = np.zeros(len(windows), np.uint64)
                for row in range(self.rows):
                    low = mix64(windows ^ self.salts[band * self.rows + row]).min(axis=1)
                    key = mix64(key * U64(31) + low)
                out[:, band] = key
        return out

    def add(self, template: int, hashes: np.ndarray) -> None:
        self.names.append(template)
        self.known = np.union1d(self.known, hashes)
        self.keys.append(self.signature(hashes[None, :])[0])

    def retrieve(self, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, template) pairs that agree on a whole band."""
        for template, own in zip(self.names, self.keys):
            for window in np.flatnonzero((keys == own).any(axis=1)).tolist():
                yield window, template


class Scanner:
    """Templates ready for matching."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float = CONTAINMENT, rows: int = ROWS,
                 guarantee: float = GUARANTEE):
        self.containment, self.separator = containment, _is_separator()
        self.names = [name for name, _ in templates]
        self.shingles = [shingles_of(words_of(text)) for _, text in templates]
        if not all(self.shingles):
            raise ValueError("a template needs at least five words")
        self.classes: dict[int, SizeClass] = {}
        hashed = []
        for i, (_, text) in enumerate(templates):
            hashes = np.unique(self.hashes([text.encode()])[1])
            n = len(self.shingles[i])
            self.classes.setdefault(n, SizeClass(n, containment, rows, guarantee)).add(i, hashes)
            hashed.append(hashes)
        self.known = np.unique(np.concatenate(hashed))

    def hashes(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number and hash of every shingle, its number within the text, and the words per text."""
        buffer = np.frombuffer(b"\n".join(blobs).lower() + b"\n", np.uint8)
        starts, ends = word_bounds(buffer, self.separator)
        words = range_hashes(buffer, starts, ends)
        bounds = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1)
        owner = np.searchsorted(bounds, starts, side="right")
        shingles = shingle_hashes(words)
        inside = owner[:len(shingles)] == owner[SHINGLE - 1:SHINGLE - 1 + len(shingles)]
        counts = np.bincount(owner, minlength=len(blobs))
        first = np.cumsum(counts) - counts
        number = np.arange(len(shingles)) - first[owner[:len(shingles)]]
        return owner[:len(shingles)][inside], shingles[inside], number[inside], counts

    def scan(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first word, words) of the best window per match."""
        blobs = [t.encode("utf-8", "replace") for t in texts]
        owner, hashes, number, counts = self.hashes(blobs)
        if not len(hashes):
            return []
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == hashes)
        if not len(hits):
            return []
        shingle_count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(shingle_count) - shingle_count
        words: dict[int, list[bytes]] = {}
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for group in self.classes.values():
            own = hits[np.isin(hashes[hits], group.known)]
            for text, start in self._windows(group, owner[own], number[own], shingle_count):
                index = start[:, None] + np.arange(group.width)[None, :]
                # the last windows of a text are cut off at its end: they repeat their last shingle
                index = first[text][:, None] + np.minimum(index, shingle_count[text][:, None] - 1)
                for window, template in group.retrieve(group.signature(hashes[index])):
                    doc, begin = int(text[window]), int(start[window])
                    if doc not in words:
                        words[doc] = words_of(texts[doc])
                    end = min(begin + group.width, int(shingle_count[doc])) + SHINGLE - 1
                    share = len(self.shingles[template] & shingles_of(words[doc][begin:end])) / group.n
                    if share >= self.containment - 1e-12:
                        found = best.get((doc, template))
                        if found is None or (-share, begin) < (-found[0], found[1]):
                            best[doc, template] = (share, begin, end - begin)
        return [(doc, template, *found) for (doc, template), found in sorted(best.items())]

    @staticmethod
    def _windows(group: SizeClass, owner: np.ndarray, number: np.ndarray,
                 shingle_count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct windows (text, first shingle) with ``need`` or more of the given shingles, in bounded parts."""
        steps = group.width // group.stride
        starts = (number // group.stride)[:, None] - np.arange(steps)[None, :]
        text = np.repeat(owner, steps)
        starts = starts.ravel()
        keep = starts >= 0
        place = (text * (int(shingle_count.max()) + 1) + starts)[keep]
        found, counts = np.unique(place, return_counts=True)
        text, starts = np.divmod(found[counts >= group.need], int(shingle_count.max()) + 1)
        part = max(1, _CELLS // group.width)
        for a in range(0, len(text), part):
            yield text[a:a + part], starts[a:a + part] * group.stride


class Phrases:
    """Notices of fewer words than a shingle, found as whole runs of words."""

    def __init__(self, notices: Sequence[tuple[str, str]]):
        self.names = [name for name, _ in notices]
        self.words = [words_of(text) for _, text in notices]
        if not all(self.words):
            raise ValueError("a notice needs words")
        letter, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
        self.patterns = [re.compile(b"(?<!%s)%s(?!%s)" % (letter, gap.join(w), letter)) for w in self.words]

    def scan(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, first word, words) of the first place of every notice found."""
        blob = text.encode("utf-8", "replace").lower()
        for i, (pattern, words) in enumerate(zip(self.patterns, self.words)):
            match = pattern.search(blob)
            if match:
                yield i, len(_WORD.findall(blob, 0, match.start())), len(words)


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  containment: float = CONTAINMENT, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document and license found: ``doc_id, license, containment, first_word, window_words``.

    The window with the highest containment counts, the first of equal ones.
    ``notices`` are found as whole runs of words and ``templates`` need five
    words.  Null and empty texts match nothing.  Repeated rows come back as often as they occur, null ids as null.  An empty table
    gives no rows; other columns are not read.
    """
    templates, notices = tuple(templates), tuple(notices)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, phrases = Scanner(templates, containment), Phrases(notices)
        for frame in frames:
            frame = frame[frame["text"].notna()]
            texts, ids = frame["text"].tolist(), frame["doc_id"].tolist()
            for a, b in spans([len(t) for t in texts], _BYTES):
                found = defaultdict(list)
                rows = [(ids[a + doc], scanner.names[template], *match)
                        for doc, template, *match in scanner.scan(texts[a:b])]
                rows += [(ids[at], phrases.names[i], 1.0, *match)
                         for at in range(a, b) for i, *match in phrases.scan(texts[at])]
                for row in rows:
                    for name, value in zip(("doc_id", "license", "containment", "first_word", "window_words"), row):
                        found[name].append(value)
                if found:
                    yield pd.DataFrame(found)

    # ids travel as text: a batch with a null id would turn whole numbers into doubles
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
