"""Byte-level BPE by rank table: encoding with a segment tree over byte positions, and decoding.

The tree's leaves are the pair ranks that start at each live byte position, each inner node the least of its two
children with the position as a tie-break, so the root names the leftmost pair of the lowest rank. A merge changes the
leaves of the merged position, of its dead right neighbour and of its live left neighbour, each by one walk to the
root. Short pieces run through the same tree many at a time, as rows of an array.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Pieces up to this many bytes go through the row-wise trees; longer ones through a tree of their own.
WIDE = 32
#: Pieces of a worker's young generation; a full one becomes the old one, whose pieces not met since are forgotten.
REMEMBERED = 100_000
#: Bytes of a piece that is remembered at most; longer ones are encoded again.
REMEMBERED_BYTES = 64
_NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: a line for each token, base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class BytePairEncoder:
    """encode() and decode() by one rank table. Pieces come from ``pattern``; each is merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the ranks lack single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # one piece, a tree of its own
    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        get = self.pairs.get
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            if (r := get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            k = width + at
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        def pair(a: int, b: int) -> int:
            r = get(ids[a] << 20 | ids[b]) if 0 <= a and b < n else None
            return _NONE if r is None else r * width + a

        while (top := tree[1]) != _NONE:
            rank, at = divmod(top, width)
            gone = after[at]
            ids[at], after[at] = rank, after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            put(gone, _NONE)
            put(at, pair(at, after[at]))
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], -1)

    # many short pieces, a row for each
    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < lens[:, None], self.byte_ids[raw], -1)
        # column `width` stands for "no neighbour"
        after = np.minimum(np.tile(np.arange(1, width + 1), (m, 1)), width)
        after = np.where(after < lens[:, None], after, width)
        after = np.concatenate([after, np.full((m, 1), width)], axis=1)
        before = np.concatenate([np.tile(np.arange(-1, width - 1), (m, 1)), np.full((m, 1), width)], axis=1)
        before[:, 0] = width
        first = self._rank(ids[:, :width], ids[np.arange(m)[:, None], after[:, :width]])
        tree = np.full((m, 2 * width), _NONE, np.int64)
        tree[:, width:] = np.where(first >= 0, first * width + np.arange(width), _NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            k = width + at
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            after[rows, at] = follow
            before[rows, follow] = at
            put(rows, gone, np.full(len(rows), _NONE))
            r = self._rank(rank, ids[rows, follow])
            put(rows, at, np.where(r >= 0, r * width + at, _NONE))
            prior = before[rows, at]
            some = prior < width
            if some.any():
                own, prior = rows[some], prior[some]
                r = self._rank(ids[own, prior], rank[some])
                put(own, prior, np.where(r >= 0, r * width + prior, _NONE))
            rows = rows[tree[rows, 1] != _NONE]
        live = ids[:, :width] >= 0
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        made: dict[str, bytes] = {}
        groups: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                made[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                made[piece] = np.array(self.merge_long(raw), dtype="<u4").tobytes()
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(piece)
        for width, some in groups.items():
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                made.update(zip(part, self.merge_many([p.encode("utf-8", "surrogatepass") for p in part], width)))
        return made

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is an empty text."""
        pieces = [self.find(t) if t else [] for t in texts]
        now: dict[str, bytes | None] = dict.fromkeys(p for some in pieces for p in some)
        missing = set()
        for piece in now:
            if (x := self.known.get(piece)) is None:
                x = self.old.get(piece)
                if x is not None:
                    self.known[piece] = x
            if x is None:
                missing.add(piece)
            else:
                now[piece] = x
        for piece, x in self._merged(missing).items():
            now[piece] = x
            if len(x) + len(piece) <= REMEMBERED_BYTES:
                self.known[piece] = x
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        return [b"".join(map(now.__getitem__, some)) for some in pieces]

    def decode(self, ids: list[bytes | None]) -> list[bytes]:
        """The bytes of each run of ids; an id that is no token raises KeyError."""
        return [b"".join(map(self.tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One for each worker process, so that tasks after the first find it loaded and its pieces known."""
    return BytePairEncoder(load_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens`` of every whole text.

    Null and empty texts give no ids; a piece of any length costs n log n; repeated rows each get their ids; an empty
    table stays empty; columns of these two names are replaced.
    """

    def start():
        work = encoder(path, pattern)

        def run(texts):
            ids = work.encode(texts)
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

        return run

    return append_columns(df, text_col, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], start)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that its ids stand for (null ids: no bytes); a column of that name is replaced."""
    return append_columns(df, ids_col, [("decoded", T.BinaryType())], lambda: lambda ids: {"decoded": encoder(path, pattern).decode(ids)})


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``n_tokens`` as :func:`encode` gives them and ``decoded`` as :func:`decode` gives it from
    those ids, in one pass, so that a task needs one Python worker and not two."""

    def start():
        work = encoder(path, pattern)

        def run(texts):
            ids = work.encode(texts)
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": work.decode(ids)}

        return run

    return append_columns(df, text_col, [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.BinaryType())], start)
