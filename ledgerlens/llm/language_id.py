"""Language ID by language-bitmask n-gram filters.

Training keeps, per language, the character trigrams that make up at least
``MIN_SHARE`` of its trigrams (so at most 1/MIN_SHARE of them, whatever the
corpus size).  They enter one bit-sliced Bloom filter: every slot is a bitmask
with one bit per language, and the AND of an n-gram's slots names all languages
that contain it.  Over a text the bits are counted per language; each count is
corrected for that language's false-positive rate, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, arrow_batches, mix64, spans, stored

MIN_SHARE = 1e-4
SLOTS = 1 << 17
HASHES = 3
UNDETERMINED = "und"
#: Characters of texts that are looked at together; some twenty arrays of eight times as many bytes are held.
_CHARS = 1 << 17
_SPACE = 32
#: Documents that a task counts at once.
_BATCH_ROWS = 1000
#: Distinct trigrams that a task holds, of all languages together.
_HELD_GRAMS = 1 << 20


# --- trigrams ---------------------------------------------------------------

def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points with every non-letter turned into a space."""
    kinds = np.unique(codes)
    known = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    return np.where(known[np.searchsorted(kinds, codes)], codes, _SPACE).astype(np.uint64) if len(codes) else (
        codes.astype(np.uint64))


def trigram_blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed trigrams of all texts (lower case, words framed by spaces) and the text each is from, block by block."""
    lowered = [t.lower() for t in texts]
    joined = "  ".join(["", *lowered, ""])
    bounds = np.cumsum(np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered)))
    for at in range(0, len(joined) - 2, _CHARS):
        codes = np.frombuffer(joined[at:at + _CHARS + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters(codes)
        a, b, c = letters[:-2], letters[1:-1], letters[2:]
        keep = np.flatnonzero(((a != _SPACE) | (b != _SPACE)) & ((b != _SPACE) | (c != _SPACE)))
        packed = (a[keep] << U64(42)) | (b[keep] << U64(21)) | c[keep]
        # a trigram belongs to the text that its middle character is in
        owner = np.searchsorted(bounds, np.maximum(keep + at - 1, 0), side="right")
        yield packed, np.minimum(owner, max(len(texts) - 1, 0))


def _count_trigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to (lang, gram, n), added up within the task."""
    totals: dict[str, pd.Series] = {}
    for frame in frames:
        for lang, part in frame.groupby("lang", sort=False):
            texts = part["text"].tolist()
            for at, end in spans([len(t) for t in texts], _CHARS):
                for grams, _ in trigram_blocks(texts[at:end]):
                    gram, n = np.unique(grams, return_counts=True)
                    new = pd.Series(n, index=gram.view(np.int64))
                    totals[lang] = new if lang not in totals else totals[lang].add(new, fill_value=0)
                    while sum(map(len, totals.values())) > _HELD_GRAMS:  # whatever the number of languages
                        largest = max(totals, key=lambda x: len(totals[x]))
                        yield _rows(largest, totals.pop(largest))
    for lang, counts in totals.items():
        yield _rows(lang, counts)


def _rows(lang: str, counts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "gram": counts.index, "n": counts.to_numpy(np.int64)})


# --- filter -----------------------------------------------------------------

@dataclass(frozen=True)
class LanguageFilter:
    """Bit-sliced Bloom filter: ``masks[w, slot]`` has the bits of languages 64w to 64w+63."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_rates: np.ndarray
    hashes: int
    common: str
    #: Per language the share of its own trigrams that the filter holds.
    mass: np.ndarray


def _slots(grams: np.ndarray, count: int, hashes: int) -> Iterator[np.ndarray]:
    """``hashes`` slot numbers per n-gram (double hashing)."""
    one = mix64(grams)
    two = mix64(one ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            yield ((one + U64(k) * two) & U64(count - 1)).astype(np.int64)


def train(rows: DataFrame, min_share: float = MIN_SHARE, slots: int = SLOTS,
          hashes: int = HASHES) -> LanguageFilter | None:
    """Filter from ``rows(lang, text)``; None if there is no language.

    All rows count.  The driver receives at most ``1 / min_share`` n-grams per
    language and one row of totals per language.
    """
    rows = rows.where("lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with arrow_batches(rows.sparkSession, _BATCH_ROWS):
        counts = stored(rows.mapInPandas(_count_trigrams, "lang string, gram long, n long")
                        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "lang-docs").orderBy("lang").collect()
    if not sizes:
        return None
    languages = tuple(sorted(r["lang"] for r in sizes))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    chosen = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share).select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas()
    masks = np.zeros(((len(languages) + 63) // 64, slots), np.uint64)
    number = {lang: i for i, lang in enumerate(languages)}
    false_rates, mass = np.zeros(len(languages)), np.zeros(len(languages))
    for lang, part in chosen.groupby("lang"):
        i = number[lang]
        mass[i] = part["share"].sum()
        grams = part["gram"].to_numpy(np.int64).view(np.uint64)
        for slot in _slots(grams, slots, hashes):
            masks[i // 64, slot] |= U64(1) << U64(i % 64)
        filled = np.count_nonzero(masks[i // 64] >> U64(i % 64) & U64(1)) / slots
        false_rates[i] = filled ** hashes
    common = min(sizes, key=lambda r: (-r["docs"], r["lang"]))["lang"]
    return LanguageFilter(languages, masks, false_rates, hashes, common, mass)


def coverage(texts: list[str], model: LanguageFilter) -> np.ndarray:
    """Per text and language the corrected share of its trigrams that the language contains."""
    return _coverage(texts, model)[0]


def _coverage(texts: list[str], model: LanguageFilter) -> tuple[np.ndarray, np.ndarray]:
    """``coverage`` and the number of trigrams of each text."""
    n, out = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages)))
    for grams, owner in trigram_blocks(texts):
        n += np.bincount(owner, minlength=len(texts))
        slots = list(_slots(grams, model.masks.shape[1], model.hashes))
        for word, plane in enumerate(model.masks):
            held = plane[slots[0]]
            for slot in slots[1:]:
                held &= plane[slot]
            for bit in range(min(64, len(model.languages) - 64 * word)):
                out[:, 64 * word + bit] += np.bincount(owner, weights=(held >> U64(bit)) & U64(1), minlength=len(texts))
    share = out / np.maximum(n, 1)[:, None]
    return np.clip((share - model.false_rates) / (1 - model.false_rates), 0.0, 1.0), n


def decide(texts: list[str], model: LanguageFilter) -> tuple[list[str], np.ndarray]:
    """Language and score of texts with a letter; ties go to the first language by code point."""
    share = coverage(texts, model)
    best = share.argmax(axis=1)
    score = share[np.arange(len(texts)), best]
    names = [model.languages[i] if s > 0 else model.common for i, s in zip(best, score)]
    return names, score


def language_column(text: Column, model: LanguageFilter | None) -> Column:
    """Struct (lang_pred, score) of a text.

    Null texts, texts without a letter and all texts under an empty model give
    ``und`` with score 0; a text that shares nothing with any language gets the
    commonest language with score 0.
    """
    spark_model = model

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        given = texts.notna().to_numpy()
        at = np.flatnonzero(given) if spark_model is not None else np.empty(0, np.int64)
        values = texts.to_numpy()[at].tolist()
        for a, b in spans([len(t) for t in values], _CHARS):
            names[at[a:b]], scores[at[a:b]] = decide(values[a:b], spark_model)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(F.when(text.rlike(r"\p{L}"), text))


# --- the operator -----------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from (a null id is in neither fold: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, **options) -> LanguageFilter | None:
    """Filter learned from ``text`` and non-null ``lang`` of the documents outside the held-out fold."""
    return train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("lang", "text"), **options)


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; rows repeat as they occur.

    Only the text decides; see ``language_column`` for nulls and texts without
    letters.  An empty table gives no rows.
    """
    model = model or fit_documents(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       language_column(F.col("text"), model).alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score")


#: A document stays if it has this part of the coverage that its language has of itself ..
MIN_SCORE = 0.3
#: .. and its language leads the next one by this share of its trigrams, if it has enough of them to tell.
MIN_LEAD, MIN_TRIGRAMS = 0.02, 20


def identified(texts: list[str], model: LanguageFilter, min_score: float = MIN_SCORE,
               min_lead: float = MIN_LEAD) -> np.ndarray:
    """Whether the language of each text is clear.

    Coverage is compared with what the filter holds of the language itself, so a script of
    very many characters, of which it holds few n-grams, is measured by its own rule.
    """
    share, n = _coverage(texts, model)
    own = share / np.maximum(model.mass, 1e-9)
    best = own.argmax(axis=1)
    rows = np.arange(len(texts))
    top = own[rows, best]
    own[rows, best] = 0.0
    return (top >= min_score) & ((n < MIN_TRIGRAMS) | (top - own.max(axis=1) >= min_lead))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, min_lead: float = MIN_LEAD) -> DataFrame:
    """Documents whose language is clear; columns as they are.

    Null texts, texts without a letter, texts of some length that two languages cover alike and
    texts that no language covers go.  Without any language to learn from all go.
    The result is stored, as its batches are kept small.
    """
    model = fit_documents(docs)

    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        at = np.flatnonzero(texts.notna().to_numpy()) if model is not None else np.empty(0, np.int64)
        values = texts.to_numpy()[at].tolist()
        for a, b in spans([len(t) for t in values], _CHARS):
            out[at[a:b]] = identified(values[a:b], model, min_score, min_lead)
        return pd.Series(out)

    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col("text")
    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        return stored(docs.select(rows.alias("row"), clear(F.when(text.rlike(r"\p{L}"), text)).alias("clear")).where(
            "clear").select("row.*"), "lang-kept")
