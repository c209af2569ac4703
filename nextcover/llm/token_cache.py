"""Token ids of whole texts by the ``tokenizers`` library, without encoding a common word twice.

Both vocabularies cut a text before they merge bytes, and the cuts below never fall inside
such a piece: ``words`` vocabularies drop white space, ``bytes`` vocabularies start a piece at
every single space that a visible character follows. So the ids of a text are those of its
pieces behind one another; a single line end is a piece of its own too, and begins one here. Latin letters with punctuation behind them are two pieces in either
vocabulary and go straight to the library's merge model, without its normaliser, which would
leave them alone but for case. A text where this isn't certain goes to the library as a whole.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from itertools import chain, islice
from operator import attrgetter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: not white space to both Python and the library, or a mark of a special token
ODD = [*map(chr, range(0x1C, 0x20)), "\x85", "\u180e", "\u200b", "\ufeff", "<|"]
#: white space other than spaces and line ends
RARE_SPACES = [*"\t\r\x0b\x0c\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
ID = attrgetter("id")
LINE = "\n"
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:%$#&*|()\"-]*)")
SPACES = re.compile(r" (?=\s|$)")


#: fixed rule of byte-level vocabularies: bytes that have no visible character are shown by those from U+0100 on
_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = dict(zip((b for b in range(256) if b not in _visible), range(256, 512)))


class Encoder:
    """Encodes texts; keeps the ids of about ``most`` pieces. Works in one thread, as a Spark task has one core."""

    def __init__(self, path: str, kind: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # else a thread of the library for each core of the machine
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind, self.most = kind, most
        self.line = tuple(self.library.encode(LINE, add_special_tokens=False).ids)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.letters: dict[str, tuple] = {}
        self.signs: dict[str, tuple] = {"": ()}
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        self.start = np.zeros(1 << 14, np.int64)

    def _shorten(self) -> None:
        """Keep the half that was learned first, which holds the common pieces."""
        half = self.most // 2
        self.known = dict(islice(self.known.items(), half))
        self.letters = {}
        self.used = int(self.start[len(self.known)])

    def _letters(self, piece: str) -> tuple | None:
        """Ids of letters met before, alone or with punctuation behind them; without those of a line
        end in front."""
        at = self.known.get(piece)
        if at is None:
            return self.letters.get(piece)
        skip = len(self.line) if piece[0] == LINE else 0
        return tuple(self.flat[self.start[at] + skip:self.start[at + 1]].tolist())

    def _ids(self, pieces: list[str]) -> list[tuple]:
        out: list = [None] * len(pieces)
        odd = []
        merge, letters, signs = self.library.model.tokenize, self.letters, self.signs
        as_bytes = self.kind == "bytes"
        for i, piece in enumerate(pieces):
            line, body = (LINE, piece[1:]) if as_bytes and piece[0] == LINE else ("", piece)
            if body.isascii() and body.isalpha():
                core, tail = body, ""
            elif m := PLAIN.fullmatch(body):
                core, tail = m.groups()
            else:
                odd.append(i)
                continue
            ids = self._letters(line + core) if tail else letters.get(piece)
            if ids is None:
                name = core if as_bytes else core.lower()
                name = name if name.isascii() else name.encode().decode("latin-1").translate(SHOWN)
                ids = tuple(map(ID, merge("\u0120" + name if as_bytes and not line else name)))
                if tail:  # a piece of letters alone is among the known ones
                    letters[line + core] = ids
            if tail not in signs:
                signs[tail] = tuple(self.library.encode(tail, add_special_tokens=False).ids)
            out[i] = self.line + ids + signs[tail] if line else ids + signs[tail] if tail else ids
        texts = [" " + pieces[i] if as_bytes and pieces[i][0] != LINE else pieces[i] for i in odd]
        for i, e in zip(odd, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = tuple(e.ids)
        return out

    def _learn(self, pieces: list[str]) -> None:
        gc.disable()  # many small tuples, no cycles
        ids = self._ids(pieces)
        gc.enable()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
        n, k = self.used + len(flat), len(self.known)
        if n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(n, np.uint16)])
        if k + len(pieces) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(k + len(pieces) + 1, np.int64)])
        self.flat[self.used:n] = flat
        self.start[k + 1:k + len(pieces) + 1] = self.used + np.cumsum(sizes)
        self.used = n
        self.known.update(zip(pieces, range(k, k + len(pieces))))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _uncertain(self, text: str) -> bool:
        if any(c in text for c in ODD):
            return True
        if self.kind == "words":
            return False
        if any(c in text for c in RARE_SPACES):
            return SPACES.search(text) is not None or LINE in text
        return "  " in text or " \n" in text or "\n\n" in text or text[0] == LINE or text[-1] == " "

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (16 bits) of each text."""
        out: list = [None] * len(texts)
        lists: list[list[str]] = []
        places: list[int] = []
        as_bytes = self.kind == "bytes"
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.empty(0, np.uint16)
            elif self._uncertain(text):
                out[i] = self._whole(text)
            else:
                # a line end in front makes the first piece one like those that begin a line
                lists.append((LINE + text.replace(LINE, " \n")).split(" ") if as_bytes else text.split())
                places.append(i)
        fresh = set().union(*lists).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > self.most:
                self._shorten()
                fresh = set().union(*lists).difference(self.known)
            self._learn(list(fresh))
        known = self.known
        for i, pieces in zip(places, lists):
            at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            begin = self.start[at]
            size = self.start[at + 1] - begin
            total = int(size.sum())
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            ids = self.flat[shift + np.arange(total)]
            out[i] = ids[len(self.line):] if as_bytes else ids
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(file: str, kind: str) -> Encoder:
    """This worker's encoder for a vocabulary file (a name among the public files, or a path)."""
    if (file, kind) not in _encoders:
        _encoders[file, kind] = Encoder(file if "/" in file else public_tokenizers.path(file), kind)
    return _encoders[file, kind]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
