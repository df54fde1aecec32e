"""Ids of two public vocabularies for texts, run by run: a byte-level BPE (``tokenizers`` file, A) and a piece BPE with
byte fallback (``sentencepiece`` file, B).

A text is read as space + text. It is cut before white space that no token of either vocabulary can span, so that each
run is encoded once and remembered; the cut characters are found from the vocabularies themselves when they are loaded.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: White space by A's pattern other than the six common ones.
RARE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
COMMON_SPACE = "\t\n\x0b\x0c\r "
#: Code points of unseen runs that go to the libraries in one call.
CALL_CHARS = 4_000


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both vocabularies; ``remembered`` runs at most are kept, in two generations of half as many."""

    def __init__(self, byte_path: str, piece_path: str, remembered: int = 600_000):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_kind, self.b_kind = (np.dtype("<u2") if len(t) <= 65536 else np.dtype("<u4") for t in (self.a_bytes, self.b_bytes))

        # characters that start a run: no piece of B holds them behind another character
        behind = {c for p in pieces if len(p) > 1 for c in p.replace("▁", " ").lstrip(" ") if c in COMMON_SPACE}
        cut = "".join(c for c in COMMON_SPACE if c not in behind)
        self.lead = self.b.encode("a")
        own = json.loads(self.a.to_str())
        plain = own["normalizer"] is None and own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.splits = plain and len(self.lead) == 1 and " " in cut  # otherwise each text is one run
        s, not_s = f"[{re.escape(cut)}]", f"[^{re.escape(cut)}]"
        # A joins white space to white space, so a run goes on where it ends in some that does not start one
        held = "".join(c for c in COMMON_SPACE if c not in cut)
        rare = f"(?<=[{re.escape(held)}{RARE_SPACE}])"
        self.runs = re.compile(f"{s}*{not_s}+(?:{rare}{s}+{not_s}+)*(?:{rare}{s}+(?!{not_s}))?|{s}+" if self.splits else r"(?s).+")
        self.recent: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.half = max(1, remembered // 2)

    def encode(self, runs: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of A and of B for each run; None where the bytes of either differ from the run's."""
        recent, older = self.recent, self.older
        missing = []
        for r in set(runs):
            if r not in recent:
                if r in older:
                    recent[r] = older[r]
                else:
                    missing.append(r)
        many = [r for r in missing if self.splits and not r.isspace()]  # what follows white space matters to A
        self.recent.update((r, self._alone(r)) for r in missing if not self.splits or r.isspace())
        at = 0
        while at < len(many):
            size, end = 0, at
            while end < len(many) and (end == at or size + len(many[end]) <= CALL_CHARS):
                size += len(many[end])
                end += 1
            self._together(many[at:end])
            at = end
        found = [recent[r] for r in runs]
        if len(recent) > self.half:
            self.older, self.recent = recent, {}
        return found

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with white space, as it stands behind another character."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode("a" + text, num_threads=1)[1:]
        return np.array(a, np.int64), np.array(b, np.int64)

    def _alone(self, run: str) -> tuple[bytes, bytes] | None:
        return self._packed(run, *self._ids(run)) if self.splits else self.document(run)

    def document(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of space + text, given with the space, by plain library calls; None where either's bytes differ from it."""
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1)
        return self._packed(text, np.array(a, np.int64), np.array(b, np.int64))

    def _packed(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes] | None:
        data = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return a.astype(self.a_kind).tobytes(), b.astype(self.b_kind).tobytes()

    def _together(self, runs: list[str]) -> None:
        text = "".join(runs)
        data = text.encode()
        a, b = self._ids(text)
        same = b"".join([self.a_bytes[i] for i in a]) == data and b"".join([self.b_bytes[i] for i in b]) == data
        ends = np.cumsum([len(r.encode()) for r in runs]) if not text.isascii() else np.cumsum([len(r) for r in runs])
        if same:
            a_at, b_at = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
            a_cut, b_cut = np.searchsorted(a_at, ends), np.searchsorted(b_at, ends)
            same = bool((a_at[a_cut] == ends).all() and (b_at[b_cut] == ends).all())
        if not same:
            self.recent.update((r, self._alone(r)) for r in runs)
            return
        a_ids, b_ids = a.astype(self.a_kind).tobytes(), b.astype(self.b_kind).tobytes()
        a_cut, b_cut = ((x + 1) * k.itemsize for x, k in ((a_cut, self.a_kind), (b_cut, self.b_kind)))
        p = q = 0
        for r, x, y in zip(runs, a_cut.tolist(), b_cut.tolist()):
            self.recent[r] = a_ids[p:x], b_ids[q:y]
            p, q = x, y

    def texts(self, texts: list[str | None], chunk: int = 50_000):
        """``(number of the text, ids of A, ids of B)`` of each text in turn, in parts of about ``chunk`` runs; None for
        both ids where the bytes of either differ from space + text. Null and empty texts yield nothing.

        Parts end where runs do, and so at a common end of tokens: a text of any length needs memory for one part. A
        text of several parts is gone through once before, so that nothing of one that differs is given out.
        """
        held, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > 2 * chunk:
                yield from self._flush(held)
                held, size = [], 0
                yield from self._long(k, text, chunk)
                continue
            held.append((k, text, self.runs.findall(" " + text)))
            size += len(held[-1][2])
            if size >= chunk:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _joined(self, found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join([x[0] for x in found]), self.a_kind), np.frombuffer(b"".join([x[1] for x in found]), self.b_kind)

    def _flush(self, held: list[tuple[int, str, list[str]]]):
        found, at = self.encode([r for _, _, own in held for r in own]), 0
        for k, text, runs in held:
            own = found[at : at + len(runs)]
            at += len(runs)
            if None in own:
                own = [self.document(" " + text)]
            yield (k, None, None) if own[0] is None else (k, *self._joined(own))

    def _long(self, k: int, text: str, chunk: int):
        def parts():
            at = (m.group() for m in self.runs.finditer(" " + text))
            while some := list(islice(at, chunk)):
                yield self.encode(some)

        if any(None in found for found in parts()):
            whole = self.document(" " + text)
            yield (k, None, None) if whole is None else (k, *self._joined([whole]))
        else:
            for found in parts():
                yield k, *self._joined(found)


@lru_cache(maxsize=1)
def vocabularies(byte_path: str, piece_path: str, remembered: int = 600_000) -> Vocabularies:
    return Vocabularies(byte_path, piece_path, remembered)
