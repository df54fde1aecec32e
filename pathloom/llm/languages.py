"""Language identification with one bit-sliced Bloom filter over character trigrams.

A slot of the filter is a mask with a bit for each language; a trigram's slots are ANDed, which gives at once all
languages whose filter holds it. A text's masks are counted per language, the counts are corrected by the filter's
false-positive rate, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices, small_batches

UND = "und"
#: Labels in the driver and in the model at most; a column with more is not one of languages.
MAX_LANGUAGES = 10_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One key for each letter (the letter and its two neighbours, other characters as a space; an ideograph or a
    syllable of East Asian scripts alone), and each text's end in the keys.

    Runs of characters that hold a digit are codes and no words: they are left out of texts that have other letters.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    kept = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    ends = np.cumsum(sizes)
    at = np.flatnonzero(letter)
    until = np.searchsorted(at, ends, "right")
    digit = np.flatnonzero((codes >= 48) & (codes <= 57))
    if len(digit):
        run = np.cumsum(codes <= 32, dtype=np.int64)
        coded = np.zeros(int(run[-1]) + 1, bool)
        coded[run[digit]] = True
        word = ~coded[run[at]]
        seen = np.concatenate([[0], np.cumsum(word)])
        left = np.diff(seen[until], prepend=0)
        owner = np.repeat(np.arange(len(sizes)), np.diff(until, prepend=0))
        at = at[word | (left[owner] == 0)]
        until = np.searchsorted(at, ends, "right")
    alone = (kept[at] >= 0x2E80) & ((kept[at] <= 0xD7FF) | (kept[at] >= 0xF900) & (kept[at] < 0xFB00) | (kept[at] >= 0x20000))
    sides = np.where(alone, np.uint64(0), (kept[at - 1] << np.uint64(42)) | kept[at + 1])
    return sides | (kept[at] << np.uint64(21)), until


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = keys * _MIX[0]
    h ^= h >> np.uint64(29)
    first = h >> np.uint64(64 - bits)
    return first, (h * _MIX[1]) >> np.uint64(64 - bits)


@dataclass(frozen=True)
class LanguageModel:
    """languages: in bit order. masks: a row of 2**bits slots for every 64 languages. false_rate: chance that an absent
    trigram shows a language's bit."""

    languages: list[str]
    bits: int
    masks: np.ndarray
    false_rate: np.ndarray

    def judge(self, texts: list[str | None]) -> dict[str, list]:
        keys, ends = trigrams(texts)
        first, second = _slots(keys, self.bits)
        mask = [row[first] & row[second] for row in self.masks]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(texts) else ends
        n = ends - starts
        if not self.languages:
            return {"lang_pred": [UND] * len(texts), "score": [0.0] * len(texts), "n_trigrams": n.tolist()}
        shares = np.zeros((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            seen = np.concatenate([[0], np.cumsum((mask[k // 64] >> self.masks.dtype.type(k % 64)) & self.masks.dtype.type(1), dtype=np.int64)])
            raw = seen[ends] - seen[starts]
            p = self.false_rate[k]
            shares[k] = np.clip((raw - n * p) / (np.maximum(n, 1) * (1 - p)), 0, 1)
        best = shares.argmax(axis=0)  # ties: the language that comes first by name
        return {
            "lang_pred": [self.languages[b] if c else UND for b, c in zip(best.tolist(), n.tolist())],
            "score": np.where(n > 0, shares[best, np.arange(len(texts))], 0.0).tolist(),
            "n_trigrams": n.tolist(),
        }


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 2000, min_share: float = 2e-5, ratio: float = 0.2, bits: int = 20) -> LanguageModel:
    """Learn the filter from rows with a language and a text.

    About ``rows_per_language`` rows of each language are used, picked by a hash of ``id_col`` (a bound in expectation,
    the count varies as a binomial does); the whole text of each. A trigram enters a language's filter if it makes up
    ``min_share`` of that language's trigrams, so at most ``1 / min_share`` enter, and at least ``ratio`` of its largest
    share in any language. No labelled rows give a model without languages, which answers ``und``. A mask has as many
    words of 64 bits as the languages need; more than ``MAX_LANGUAGES`` labels raise ValueError. Only ids and languages
    are read for the row counts. Null ids are drawn as one id.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(lang_col).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], bits, np.zeros((1, 1 << bits), np.uint8), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col(lang_col) == name, min(1.0, rows_per_language / n)).otherwise(part)
    sample = known.where(draw < part).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                texts = part.column(1).to_pylist()
                for name in set(langs.tolist()):
                    keys, n = np.unique(trigrams([texts[i] for i in np.flatnonzero(langs == name)])[0], return_counts=True)
                    into = total.setdefault(name, {})
                    for k, c in zip(keys.tolist(), n.tolist()):
                        into[k] = into.get(k, 0) + c
        for name, into in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(into), pa.string()), pa.array(into.keys(), pa.int64()), pa.array(into.values(), pa.int64())], ["lang", "gram", "n"])

    small_batches(labelled.sparkSession)
    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.persist()
    totals = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    floor = F.lit(float("inf"))
    for name, n in totals.items():
        floor = F.when(F.col("lang") == name, n * min_share).otherwise(floor)
    frequent = grams.where(F.col("n") >= floor).toPandas()  # at most 1 / min_share rows a language
    grams.unpersist()
    share: dict[int, np.ndarray] = {}
    for name, gram, n in frequent.itertuples(index=False):
        share.setdefault(gram, np.zeros(len(languages)))[languages.index(name)] = n / totals[name]
    kind = next((t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= most), np.uint64)
    masks = np.zeros(((len(languages) + 63) // 64, 1 << bits), kind)
    keys = np.fromiter(share, np.uint64, len(share))
    into = np.array(list(share.values())).reshape(len(share), len(languages))
    into = (into > 0) & (into >= ratio * into.max(axis=1, keepdims=True))
    for k in range(len(languages)):
        for slots in _slots(keys[into[:, k]], bits):
            np.bitwise_or.at(masks[k // 64], slots, kind(1 << k % 64))
    fill = np.array([((masks[k // 64] >> kind(k % 64)) & kind(1)).mean() for k in range(len(languages))])
    return LanguageModel(languages, bits, masks, fill**2)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``n_trigrams``, from the whole text of every row.

    ``score`` is the part of the text's trigrams that the predicted language's filter holds, corrected for false
    positives, 0 to 1. A null or letterless text gives ``und`` and 0; equal counts give the language first by name;
    repeated rows each get their answer; an empty table stays empty; columns of these three names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**bits slots, whatever the input
    return append_columns(df, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_trigrams", T.LongType())], lambda: held.value.judge)
