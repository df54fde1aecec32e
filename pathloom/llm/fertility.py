"""Quality rules by tokenizer fertility: what two public vocabularies make of a text, judged by bands for each language.

For a text in n tokens of a vocabulary: its characters per token (both vocabularies), the share of tokens that are
single bytes for want of a piece (the piece vocabulary), and the entropy of its tokens over that of n different ones,
or of ``ENTROPY_TOKENS`` in longer texts, whose entropy no longer grows with their length.
Prose of a language keeps to a narrow range of each; codes, hashes, broken encodings, repeated and foreign text do not.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, new_folder
from .vocabularies import vocabularies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
ENTROPY_TOKENS = 1024
MIN_WORDS, REPEAT_PERCENT = 50, 50
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "entropy")

#: First code points of blocks of a script and the script, until the next; letters of other blocks are "Other".
SCRIPTS = [
    (0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x780, "Other"), (0x900, "Devanagari"),
    (0x980, "Bengali"), (0xA00, "Other"), (0xB80, "Tamil"), (0xC00, "Other"), (0xE00, "Thai"), (0xE80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
_FIRST, _NAMES = np.array([f for f, _ in SCRIPTS]), [s for _, s in SCRIPTS]

#: A band is the median of its language's documents and this many deviations (1.4826 times the median distance from
#: the median) to both sides, but at least so much of the measure's scale.
DEVIATIONS = 8.0
LEAST_WIDTH = {"chars_per_token": 0.6, "chars_per_piece": 0.6, "byte_share": 0.15, "entropy": 0.2}
#: Documents below which a language has no bands of its own, and the bands that hold then: for any script.
MIN_DOCS = 30
DEFAULT_BANDS = {"chars_per_token": (0.3, 8.0), "chars_per_piece": (0.3, 8.0), "byte_share": (0.0, 0.5), "entropy": (0.35, 1.0)}
#: Languages above which bands are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def script_of(text: str) -> str | None:
    """The script of most letters, ties to the first by name; None for a text without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else None
    codes, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
    found: Counter = Counter()
    for c, n in zip(codes.tolist(), counts.tolist()):
        if chr(c).isalpha():
            k = int(np.searchsorted(_FIRST, c, "right")) - 1
            found[_NAMES[k] if k >= 0 and c < 0x20000 else "Han" if 0x20000 <= c < 0x32000 else "Other"] += n
    return min(found, key=lambda s: (-found[s], s)) if found else None


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word that equal an earlier line, and words in windows of three
    words that are in the text twice or more."""
    words = WORD.findall(text)
    lines = text.split("\n") if "\n" in text else ()
    lines = [x for x in lines if WORD.search(x)]
    repeated = 0
    if len(set(zip(words, words[1:], words[2:]))) < len(words) - 2:
        windows, end = Counter(zip(words, words[1:], words[2:])), 0
        for k, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def fertility(a: np.ndarray, b: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float, float]:
    """The measures of a text of so many characters with these ids."""
    counts = np.unique(b, return_counts=True)[1]
    share = counts / len(b)
    entropy = float(-(share * np.log2(share)).sum()) / math.log2(min(len(b), ENTROPY_TOKENS)) if len(b) > 1 else 1.0
    return chars / len(a), chars / len(b), float(is_byte[b].mean()), entropy


def measure(df: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``script`` and the measures of every whole text.

    Null texts count as empty: no words, no script, no measures. A text whose bytes in either vocabulary differ from it
    has no measures either. Columns of these names are replaced; rows that repeat are measured alike.
    """
    fields = [*[(n, T.LongType()) for n in BASE], ("script", T.StringType()), *[(n, T.DoubleType()) for n in MEASURES]]

    def start():
        work = vocabularies(byte_path, piece_path)

        def values(texts):
            made = {n: [] for n, _ in fields}
            for text in texts:
                for n, v in zip(BASE, base_counts(text or "")):
                    made[n].append(v)
                made["script"].append(script_of(text or ""))
            ids: dict[int, list | None] = {}
            for k, a, b in work.texts(texts):
                if a is None:
                    ids[k] = None
                else:
                    ids.setdefault(k, []).append((a, b))
            for k, text in enumerate(texts):
                parts = ids.get(k)
                found = fertility(*map(np.concatenate, zip(*parts)), len(text), work.b_is_byte) if parts else (None,) * 4
                for n, v in zip(MEASURES, found):
                    made[n].append(v)
            return made

        return values

    counted = append_columns(df, text_col, fields, start)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def fit_bands(measured: DataFrame, group_col: str, deviations: float = DEVIATIONS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(_group, _n_docs, _lo_*, _hi_*)`` from all measured rows that pass the base rules, a row for each group of at least
    ``min_docs`` of them: medians by mergeable sketches, so a group that holds most rows is no one task's."""
    good = measured.where(~F.col("base_failed") & F.col("entropy").isNotNull() & F.col(group_col).isNotNull())
    middle = good.groupBy(F.col(group_col).alias("_group")).agg(F.count("*").alias("_n_docs"), *[F.percentile_approx(m, 0.5, 10_000).alias(f"_mid_{m}") for m in MEASURES])
    middle = middle.where(F.col("_n_docs") >= min_docs).checkpoint()
    far = _with_groups(good.withColumn("_group", F.col(group_col)), middle)
    spread = far.groupBy("_group").agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"_mid_{m}")), 0.5, 10_000).alias(f"_off_{m}") for m in MEASURES])
    bands = middle.join(spread, "_group")
    width = {m: F.greatest(F.lit(LEAST_WIDTH[m]), F.lit(1.4826 * deviations) * F.col(f"_off_{m}")) for m in MEASURES}
    return bands.select("_group", "_n_docs", *[(F.col(f"_mid_{m}") - width[m]).alias(f"_lo_{m}") for m in MEASURES], *[(F.col(f"_mid_{m}") + width[m]).alias(f"_hi_{m}") for m in MEASURES])


def _with_groups(df: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with those of their ``_group``: few groups by broadcast, which count decides; many by salted keys."""
    if groups.count() <= BROADCAST_LANGUAGES:
        return df.join(F.broadcast(groups), "_group", how)
    salts = 32
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != "_group"]), F.lit(salts)).cast("int"))
    return salted.join(spread, ["_group", "_salt"], how).drop("_salt")


def judge(measured: DataFrame, bands: DataFrame, group_col: str) -> DataFrame:
    """``measured`` with ``kept``: false where the base rules fail or a measure is outside the band of the row's group;
    groups without bands, and rows without a group, have ``DEFAULT_BANDS``. A row without measures keeps the base verdict."""
    found = _with_groups(measured.withColumn("_group", F.col(group_col)), bands.drop("_n_docs"), "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = DEFAULT_BANDS[m]
        inside &= F.col(m).isNull() | F.col(m).between(F.coalesce(f"_lo_{m}", F.lit(low)), F.coalesce(f"_hi_{m}", F.lit(high)))
    return found.withColumn("kept", ~F.col("base_failed") & inside).select(*[c for c in measured.columns if c.lower() != "kept"], "kept")


def filter_quality(spark: SparkSession, df: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``df`` less its text, with counts, measures and ``kept``; bands are those of ``lang_col``, or of the script where
    that is null or no column is named. All rows are measured once, into the shared folder, and the bands come from all of them.

    No rows give no rows. A language that is mostly junk has the bands of its junk; base rules still hold.
    """
    folder = new_folder(spark, "fertility")
    script = F.concat(F.lit("script:"), F.col("script"))
    group = F.coalesce(F.col(lang_col), script) if lang_col else script
    measure(df, byte_path, piece_path, text_col).withColumn("_band", group).drop(text_col).write.parquet(folder)
    measured = spark.read.parquet(folder)
    return judge(measured, fit_bands(measured, "_band"), "_band").drop("_band")
