"""Secret scans: three fixed patterns, and strings in a sensitive context that zstandard cannot compress.

A candidate's novelty is the bytes it adds to a zstandard frame whose dictionary is primed with common code
identifiers and with the text around it, over the bytes that a random string of its length and alphabet adds: words,
repeated values and identifiers add little, random keys of any length and alphabet about as much as the random string.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

KINDS = ("assign", "access", "hex", "novel")
# The base patterns, with ASCII letters only in either case in the first.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

CONTEXT = re.compile(r"auth|bearer|credential|passphrase|passw|pwd|private|secret|token|api.?key|access.?key|signature|\bsig=", re.I | re.A)
#: A run of such characters is one candidate, less a name before it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: ``NAME=`` before a value, and path segments before it, which count as names where one of them is a sensitive word.
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=+(?=[^=])")
SEGMENTS = re.compile(r"/?(?:[A-Za-z_-]{3,}/)+")
LEAST_LENGTH = 20
#: It has a letter and a digit in ten characters or more without a separator, which names and paths made of words have not;
DENSE = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{10,}")
#: or letters of which so large a share is of another case than the one before, which names in mixed case have not.
LETTERS, CHANGES = re.compile(r"[A-Za-z]{16,}"), 0.36
#: Alphabets, from the smallest; a candidate's is the first that holds it.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-")
# Identifiers and words that code around keys is full of.
IDENTIFIERS = (
    "access_key access_token account_id api_key apikey application authorization authenticate basic bearer bucket certificate client_id "
    "client_secret config connection_string credentials database default development endpoint environment export false filename function "
    "github hostname http https import index instance integer localhost message namespace null object oauth offset option parameter "
    "passphrase password passwd path private_key production project property protocol public_key refresh_token region request resource "
    "response return secret secret_key self server service session_id settings signature static string timestamp token true undefined "
    "update url user_id username value version 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed patterns, ordered by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]  # a run of 16 or more is found whole
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


@lru_cache(maxsize=512)
def _random(alphabet: int, length: int) -> str:
    """A fixed random string; all of a length and alphabet pack alike."""
    return "".join(random.Random(length).choices(ALPHABETS[alphabet], k=length))


def novelty(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> float:
    """Compressed bytes that ``candidate`` adds to what the dictionary holds, over those that a random string adds: at most about 1."""
    primed = zstandard.ZstdCompressionDict((identifiers + "\n" + around).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    added = lambda x: len(packer.compress(x.encode())) - len(packer.compress(b""))
    own = set(candidate)
    alphabet = next((k for k, letters in enumerate(ALPHABETS) if own <= set(letters)), len(ALPHABETS) - 1)
    return added(candidate) / max(1, added(_random(alphabet, len(candidate)))) if candidate else 0.0


def value_start(text: str, a: int, b: int) -> int:
    """Where the value of the run from ``a`` to ``b`` begins: behind ``NAME=`` and behind path segments with a sensitive word."""
    while True:
        m = NAME.match(text, a, b) or SEGMENTS.match(text, a, b)
        if not m or not m[0].endswith("=") and not CONTEXT.search(m[0]):
            return a
        a = m.end()


def looks_random(value: str) -> bool:
    """Is it mixed enough for a key: letters and digits without separators, or letters of mixed case without order?"""
    if DENSE.search(value):
        return True
    return any(sum(x.isupper() != y.isupper() for x, y in zip(m[0], m[0][1:])) >= CHANGES * (len(m[0]) - 1) for m in LETTERS.finditer(value))


def novel_spans(text: str, taken: list[tuple[int, int, str]], reach: int = 96, after: int = 32, around: int = 512, least: float = 0.85, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Values of 20 characters or more whose novelty is ``least`` or more and that stand in a sensitive context.

    A run of key characters is a value, less ``NAME=`` and sensitive path segments at its beginning. The context is
    something sensitive named in the ``reach`` characters before the value, such a name included, on any line, or in the
    ``after`` ones behind it on the same line; lines of one key, with only white space between them, share the context
    of the first. A value inside one of the ``taken`` spans, which are sorted by start, is left to that span; one
    that only overlaps some is reported whole. Its own repetitions do not count as its surroundings.
    """
    found = []
    covered, k, end, sensitive = 0, 0, -1, False
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        goes_on = end >= 0 and a - end <= 8 and text[end:a].isspace()
        a = value_start(text, a, b)
        while k < len(taken) and taken[k][0] <= a:
            covered = max(covered, taken[k][1])
            k += 1
        sensitive = sensitive and goes_on or bool(CONTEXT.search(text, max(0, a - reach), a) or CONTEXT.search(text[b : b + after].partition("\n")[0]))
        end = b
        value = text[a:b]
        if b <= covered or not sensitive or b - a < LEAST_LENGTH or not looks_random(value):
            continue
        near = (text[max(0, a - around) : a] + "\n" + text[b : b + around]).replace(value, " ")
        if novelty(value, near, identifiers) >= least:
            found.append((a, b, KINDS[3]))
    return found


def scan(df: DataFrame, text_col: str = "text", novel: bool = True, identifiers: str = IDENTIFIERS) -> DataFrame:
    """``df`` with ``spans``, an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Whole texts are searched. Null and empty texts have no spans; repeated rows each get theirs; no rows give no rows;
    a column ``spans`` is replaced. Overlapping spans of different kinds all stay, those of equal start in the order of
    ``KINDS``; the compression method adds spans that no base span covers.
    """

    def work(texts):
        out = []
        for text in texts:
            base = base_spans(text) if text else []
            more = novel_spans(text, base, identifiers=identifiers) if text and novel else []
            every = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base
            out.append(",".join(f"{k}:{a}:{b}" for a, b, k in every))
        return {"spans": out}

    found = append_columns(df, text_col, [("spans", T.StringType())], lambda: work)
    return found.withColumn("spans", parse_spans(F.col("spans")))


def parse_spans(text):
    """``kind:start:end`` joined by commas as an array of structs; empty gives an empty array."""
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.split_part(x, F.lit(":"), F.lit(3)).cast("long").alias("end")))


def join_spans(spans, kinds: tuple[str, ...] = KINDS):
    """The spans of these kinds as ``kind:start:end``, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span that :func:`scan` finds replaced by ``mark``; overlapping spans become one mark.

    Null and empty texts stay as they are, repeated rows are treated alike, no rows give no rows, and all columns stay,
    whatever their names.
    """
    name = "clean"
    while name in {c.lower() for c in df.columns}:
        name += "_"

    def work(texts):
        out = []
        for text in texts:
            if not text:
                out.append(text)
                continue
            base = base_spans(text)
            spans = sorted((a, b) for a, b, _ in base + novel_spans(text, base))
            parts, done = [], 0
            for a, b in spans:
                if a >= done:
                    parts += [text[done:a], mark]
                done = max(done, b)
            out.append("".join([*parts, text[done:]]) if spans else text)
        return {name: out}

    made = append_columns(df, text_col, [(name, T.StringType())], lambda: work)
    return made.select(*[made[name if c == text_col else c].alias(c) for c in df.columns])
