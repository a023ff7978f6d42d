"""Token ids of whole texts through the tokenizers library, fast on repeated words.

A text is cut where the vocabulary's own rules cut it whatever stands around, each distinct piece is encoded by the
library once, and ids are remembered up to a bound. Two manners of cutting are known, and which one holds is probed:

* `blind`: case and white space don't matter; cuts at white space.
* `exact`: byte-level, a word takes the one space before it; cuts before spaces and around line feeds.

Texts of Latin-1 are also cut before full stops and commas where all of a text's follow a letter or digit, so that a word
is not a new piece with each, and `blind` pieces are put in lower case at once; others are cut at spaces and line feeds alone.

Texts with anything that could make a cut matter (unusual or repeated white space, special tokens' brackets), and
vocabularies that fail the probes, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

ROOM = 500_000  # pieces remembered by a Python worker
_ODD = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0]")
_ODD_BYTES = bytes(c for c in range(256) if _ODD.match(chr(c)))
_WIDE_SPACE = re.compile("[\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_STOP_APART = re.compile(r"[.,](?<![^\W_][.,])")
_PROBES = ("a b", "A.\nB c", "l'a 12 3", "It's, it'll.'s", "É$a% &b", "' s 't", "a_.b __c", "x2y.. (z)", "don't!!\nno", "\u201cIt\u2019s\u201d \u0416\u0443 \u03a3.\n\u4e2d\u6587 \u0301e")
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_latin(text: str) -> bool:
    return _latin(text) is not None


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def plain(text: str) -> bool:
    """Whether a cut at white space can't matter."""
    raw = _latin(text)
    odd = (_ODD.search(text) or _WIDE_SPACE.search(text)) if raw is None else len(raw.translate(None, _ODD_BYTES)) < len(raw)
    return not (odd or "<|" in text or "  " in text or "\n\n" in text or " \n " in text or "\n \n" in text)


def cut_exact(text: str) -> list[str]:
    out = text.replace("\n", "\0\n\0").replace(" ", "\0 ")
    return (out if not is_latin(text) or _STOP_APART.search(text) else out.replace(".", "\0.").replace(",", "\0,")).split("\0")


def cut_blind(text: str) -> list[str]:
    if not is_latin(text):
        return text.replace("\n", " ").split(" ")
    out = text.lower()
    return (out if _STOP_APART.search(text) else out.replace(".", " .").replace(",", " ,")).split()


class Encoder:
    """Texts to packed ids: `width` 2 or 4 bytes each, little-endian."""

    def __init__(self, path: str, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.code, self.known = Tokenizer.from_file(path), "H" if width == 2 else "I", {"": b""}
        if width == 2 and self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("two bytes can't hold these ids")
        self.cut = next((c for c in (cut_blind, cut_exact) if all(self._ids(p) == [i for x in c(p) for i in self._ids(x)] for p in _PROBES)), None)
        #: A token of its own between pieces, so that one call encodes many.
        self.separator = next((s for s in ("\n", " \x01 ") if self.cut and self._separates(s)), None)
        self.mark = self._ids(self.separator)[0] if self.separator else -1

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _separates(self, s: str) -> bool:
        probes = ["ab", "a", "12", ".", "!!", "'t", *([" É", " $", " 's"] if self.cut is cut_exact else [])]
        joined = [i for k, p in enumerate(probes) for i in (self._ids(s) if k else []) + self._ids(p)]
        return len(self._ids(s)) == 1 and self._ids(s.join(probes)) == joined

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of new pieces."""
        out: dict[str, bytes] = {}
        joined = [p for p in pieces if len(p) < 64 and p.isprintable() and not p.isspace()] if self.separator else []
        parts = [joined[at : at + 256] for at in range(0, len(joined), 256)]
        kind = np.uint16 if self.code == "H" else np.uint32
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.separator.join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, kind)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                continue  # the separator's id within a piece
            raw, size = ids.tobytes(), ids.itemsize
            bounds = [-size, *(ends * size).tolist(), len(raw)]
            out.update((p, raw[x + size : y]) for p, x, y in zip(part, bounds, bounds[1:]))
        rest = [p for p in pieces if p not in out]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[p] = array(self.code, e.ids).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null text has none."""
        out, parts = [b""] * len(texts), []
        for k, t in enumerate(texts):
            if t and self.cut and plain(t):
                parts.append((k, self.cut(t)))
            elif t:
                out[k] = array(self.code, self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids).tobytes()
        new = set().union(*(p for _, p in parts)).difference(self.known)
        learned = self._learn(new) if new else {}
        self.known.update(learned)
        get = self.known.__getitem__
        for k, p in parts:
            out[k] = b"".join(map(get, p))
        if len(self.known) > ROOM:
            for p in learned:
                del self.known[p]
        return out


def encoder(path: str, width: int = 4) -> Encoder:
    """One for each file and worker."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]
