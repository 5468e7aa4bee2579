"""Token ids of texts, with a memory for the pieces between spaces.

Byte-level and word-end BPE split a text into pre-tokens before they merge, and no pre-token reaches across a single
space that stands between other characters. So the ids of a text are the joined ids of its space-separated pieces (with
the space in front where the vocabulary keeps spaces), and a piece needs the library once. Texts with anything unusual
around a space, or with a special token's string, go to the library whole, and so does every text of a tokenizer for
which the property doesn't hold on a probe.

A piece that is one word, perhaps with marks behind it, goes to the library's BPE model itself: the word is one
pre-token and the marks another, so the normalizer and the splitter have nothing left to decide.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

KEEP_FIRST, KEEP_MOST = 400_000, 800_000
_MARKS = ".,;:!?|%&$#*"
_WORDS = ("Und", "dass", "été", "Über", "a", "THE", "l'eau", "größe", "ÇA", "señor")
_PROBE = ("Und, dass", "été l'été", "a1 b22", "x!! (y)", "don't we'll", "ü\nv w.\nZ")
_loaded: dict = {}


class _Pieces(dict):
    """Pieces with their ids; a new one is encoded when it is first asked for."""

    def __init__(self, memo: Memo, lead: str, known=()):
        super().__init__(known)
        self.memo, self.lead = memo, lead

    def __missing__(self, piece: str):
        found = self[piece] = self.memo.ids_of(piece, self.lead)
        return found


class Memo:
    """encode(texts) -> for each the ids as little-endian bytes of `dtype`; null texts have none."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 65536 else np.dtype("<u4")
        self.marks = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lead = next((s for s in ("", " ") if all(
            self._ids(p) == [i for k, w in enumerate(p.split(" ")) for i in self._ids((s if k else "") + w)] for p in _PROBE)), None)
        self.first = _Pieces(self, "")
        self.later = self.first if self.lead == "" else _Pieces(self, self.lead or "")
        self.tails: dict = {}
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.line_feed = self._ids("\n")
        self.lower: bool | None = None
        if self.lead is not None:
            self._probe_words()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _probe_words(self) -> None:
        """Set how a word reaches the model (as it is, or in lower case), if on the probe it gives the library's ids."""
        # The fixed byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.shown_lead = self.lead.translate(self.alphabet)
        for lower in (False, True):
            self.lower = lower
            words = [self.lead + w for w in _WORDS if w.isalpha()] + ["!!", ".", "%%%"]
            try:
                if all(self._model(w) == self._ids(w) for w in words):
                    return
            except Exception:  # a model of another kind  # noqa: BLE001
                break
        self.lower = None

    def _model(self, word: str) -> list[int]:
        if self.lower:
            word = word.lower() if word.isascii() else "".join([c.lower() for c in word])
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]

    def _quick(self, piece: str, lead: str) -> bytes | None:
        """The ids of a piece that is a word with marks behind it, from the model; None for any other piece."""
        start = self.lead and piece[:1] == "\n"
        word = piece[1:] if start else piece
        tail = ""
        if not word.isalpha():
            word = word.rstrip(_MARKS)
            if not word.isalpha():
                return None
            tail = piece[len(word) + (1 if start else 0) :]
        if word.isascii():
            # Letters stand for themselves in the byte alphabet.
            word = word.lower() if self.lower else word
            if lead and not start:
                word = self.shown_lead + word
        else:
            if not unicodedata.is_normalized("NFC", word):
                return None
            if self.lower:
                word = "".join([c.lower() for c in word])
            word = (word if start else lead + word).encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(word)]
        if start:
            ids = self.line_feed + ids
        if tail:
            if tail not in self.tails:
                self.tails[tail] = self._ids(tail)
            ids += self.tails[tail]
        return array(self.code, ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _odd(self, p: str) -> bool:
        """Whether a text that holds the piece p has to go to the library whole."""
        if self.lead:
            p = p[1:] if p[:1] == "\n" else p
            if not p or p[0].isspace() or p[-1].isspace():
                return True
        return any(m in p for m in self.marks)

    def ids_of(self, piece: str, lead: str) -> bytes | bool:
        """A piece's ids; False for an odd one. A piece from a line's start begins with the line feed instead of the space."""
        found = self._quick(piece, lead) if self.lower is not None else None
        if found is None:
            found = not self._odd(piece) and self._whole([piece if self.lead and piece[:1] == "\n" else lead + piece])[0]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t]
        if self.lead is not None:
            todo, whole = whole, []
            lines = " \n" if self.lead else " "
            first, later, same = self.first.__getitem__, self.later.__getitem__, self.first is self.later
            for i in todo:
                pieces = texts[i].replace("\n", lines).split(" ")
                try:
                    out[i] = b"".join(map(later, pieces)) if same else first(pieces[0]) + b"".join(map(later, pieces[1:]))
                except TypeError:  # an odd piece is False
                    whole.append(i)
            self._forget()
        for i in range(0, len(whole), 64):
            part = whole[i : i + 64]
            for k, ids in zip(part, self._whole([texts[k] for k in part])):
                out[k] = ids
        return out

    def _forget(self) -> None:
        """What came first is mostly what is frequent."""
        same = self.first is self.later
        for name in ("first", "later"):
            if len(memo := getattr(self, name)) > KEEP_MOST:
                setattr(self, name, _Pieces(self, memo.lead, islice(memo.items(), KEEP_FIRST)))
        if same:
            self.first = self.later


def memo(path: str, special_as_text: bool = False) -> Memo:
    """One per worker process, path and mode."""
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = Memo(path, special_as_text)
    return _loaded[key]


def text_batches(column, most_chars: int = 4_000_000):
    """Slices (from, to) of a list of texts of about so many characters."""
    at, held = 0, 0
    for i, t in enumerate(column):
        held += len(t) if t else 0
        if held >= most_chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(column):
        yield at, len(column)
