"""Encoding of texts with a public tokenizer file inside Arrow batches.

Texts are split at safe boundaries -- places where the tokenizer's own
pre-tokenisation always cuts -- and each distinct piece is encoded by the
library once while it is known to a worker; a text's ids are those of its pieces.
Boundaries are found on the bytes of many texts at once, and Arrow numbers the
pieces, so that Python meets each distinct piece of a batch only once.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import worker_state

# The Unicode White_Space characters, as the inside of a character class.
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PUNCT = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe, which may begin a contraction


_BEYOND_ASCII_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_OTHER_SPACE, _BLANK, _LETTER, _SIGN = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[9:14], _KIND[0x20] = _OTHER_SPACE, _BLANK
_KIND[[b for b in range(128) if re.match("[A-Za-z]", chr(b))]] = _LETTER
_KIND[[b for b in range(128) if re.match(f"[{_PUNCT}]", chr(b))]] = _SIGN


def cut(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that begin at ``begins`` and have ASCII white space only.

    A piece is a run of other characters with the one blank before it, or what is left of a run of white space (its last
    character, which a word that follows is not joined to unless it is a blank, is a piece of its own).  Between an ASCII
    letter and an ASCII sign there is a cut too: both kinds of file end a letter run and a run of signs there."""
    kind = _KIND[data]
    space = (kind & (_OTHER_SPACE | _BLANK)) > 0
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    inner = ~first[1:-1]  # the pair (i, i + 1) lies in one text
    start = first[:-1].copy()
    start[1:] |= (space[1:] & ~space[:-1]) | ((kind[1:] | kind[:-1]) == _LETTER | _SIGN)
    word = ~space[1:] & space[:-1] & inner
    start[:-1] |= word
    start[1:] |= word & (kind[:-1] != _BLANK)
    return np.flatnonzero(start)


def _byte_letters(piece: str) -> str:
    """The letters by which byte-level files write bytes: those of printable Latin-1 characters
    stand for themselves, the others, in order, for the characters from 256 on."""
    return piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)


_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

#: A word whose normal form and lower case are taken letter by letter (the dotted capital I is not).
_LATIN_WORD = re.compile("(?: |)[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")


def piece_rules(tok) -> tuple[re.Pattern, Callable[[str], str]] | None:
    """The pattern whose matches are independent pieces for the tokenizer, or
    None where no safe boundary is known (whole texts are encoded then); and what
    its normalisation and byte mapping make of a piece of Latin letters with at
    most one blank before them.

    Byte-level files keep one leading space with a word, as in the published
    pre-tokenisation pattern; files that drop white space cut at all of it.  A
    run of Latin letters is cut off before ASCII punctuation: both kinds of
    file end a letter run there."""
    pre, norm = (json.loads(part.__getstate__()) if part else {} for part in (tok.pre_tokenizer, tok.normalizer))
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tok.get_added_tokens_decoder().values()):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return (re.compile(f" ?[{_LATIN}]+(?=[{_PUNCT}])| ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+"),
                _byte_letters)
    steps = pre.get("pretokenizers", [])
    drops_space = (len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert")
                   and steps[0].get("behavior") == "Removed"
                   and steps[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                   and not steps[1].get("add_prefix_space"))
    known = {"NFC", "Lowercase", "Replace"}
    if drops_space and norm.get("type") == "Sequence" and {n["type"] for n in norm["normalizers"]} <= known:
        lower = any(n["type"] == "Lowercase" for n in norm["normalizers"])
        return (re.compile(f"[{_LATIN}]+(?=[{_PUNCT}])|[^{_W}]+"),
                lambda piece: _byte_letters((piece.lower() if lower else piece).lstrip(" ")))
    return None


#: Text bytes encoded at once: more of them share their distinct pieces.
ENCODE_BYTES = 4 << 20

#: Longer pieces (characters) are encoded anew where they are met after the table was cleared.
LONG_PIECE = 64


class _Codes(dict):
    """Numbers pieces as they are met, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class PieceEncoder:
    """Ids and lengths of texts for a tokenizer file.

    When the piece table passes ``max_pieces`` or ``max_bytes`` only the more frequent half is
    kept, and no long piece, which bounds the memory of a worker whatever the texts hold."""

    def __init__(self, path: str, max_pieces: int = 300_000, max_bytes: int = 8 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pattern, self.letters = piece_rules(self.tok) or (None, None)
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_strings = special
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.max_pieces, self.max_bytes = max_pieces, max_bytes
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.lens = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.met = np.zeros(1 << 12, np.int64)  # how often each piece was met
        self.known = self.used = self.piece_bytes = 0

    def _forget(self) -> None:
        """Keep the pieces met most often, half of the table at most."""
        kept = np.sort(np.argsort(-self.met[:self.known], kind="stable")[:self.max_pieces // 2])
        pieces = list(self.codes)
        kept = np.array([k for k in kept[self.met[kept] > 1].tolist() if len(pieces[k]) <= LONG_PIECE], np.int64)
        lens, starts = self.lens[kept], self.starts[kept]
        first = np.cumsum(lens) - lens
        flat = self.flat[np.repeat(starts - first, lens) + np.arange(int(lens.sum()))]
        met = self.met[kept] // 2
        self._reset()
        self.codes.update((pieces[k], i) for i, k in enumerate(kept.tolist()))
        self.known, self.used = len(kept), len(flat)
        self.piece_bytes = sum(len(pieces[k]) for k in kept.tolist())
        self.lens, self.starts, self.flat, self.met = (_grown(x, 1 << 12) for x in (lens, first, flat, met))

    def _pieces(self, text: str) -> list[str]:
        if self.pattern is None:
            return [text] if text else []
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def _learn(self) -> None:
        """Encode the pieces met since the last call, in batches of about a megabyte."""
        new, self.codes.new = self.codes.new, []
        self.piece_bytes += sum(map(len, new))
        if self.known + len(new) > len(self.lens):
            self.lens, self.starts, self.met = (_grown(x, self.known + len(new)) for x in (self.lens, self.starts, self.met))
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and held < 1 << 20:
                held += len(new[end])
                end += 1
            ids = self._encode_all(new[at:end])
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(lens.sum())
            if self.used + total > len(self.flat):
                self.flat = _grown(self.flat, self.used + total)
            self.flat[self.used:self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
            k = self.known
            self.lens[k:k + len(ids)] = lens
            self.starts[k:k + len(ids)] = self.used + np.cumsum(lens) - lens
            self.known += len(ids)
            self.used += total
            at = end

    def _encode_all(self, pieces: list[str]) -> list[list[int]]:
        """``_encode`` without the cycle collector, which would go through the whole piece table again and again."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(pieces)
        finally:
            if on:
                gc.enable()

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece.  Words of Latin letters go to the file's BPE model
        straight away, several times faster than through the whole encoding."""
        ids: list = [None] * len(pieces)
        if self.letters:
            model, letters, word = self.tok.model.tokenize, self.letters, _LATIN_WORD.fullmatch
            for i, piece in enumerate(pieces):
                if word(piece):
                    ids[i] = [t.id for t in model(letters(piece))]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return ids

    def _plain(self, text: str) -> bool:
        """Whether ``cut`` knows the text's boundaries: no special strings, white space of ASCII only."""
        return not (any(x in text for x in self.special_strings) or not text.isascii() and _BEYOND_ASCII_SPACE.search(text))

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_code`` for plain texts."""
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = b"".join(raw)
        ends = np.cumsum(size)
        starts = cut(np.frombuffer(data, np.uint8), (ends - size)[size > 0])
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        numbers = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        return numbers[pieces.indices.to_numpy()], np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)

    def _code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts one after the other, and pieces per text."""
        if len(self.codes) > self.max_pieces or self.piece_bytes > self.max_bytes:
            self._forget()
        plain = [bool(t) and self.pattern is not None and self._plain(t) for t in texts]
        codes, some = self._numbered([t for t, p in zip(texts, plain) if p])
        per = np.zeros(len(texts), np.int64)
        per[plain] = some
        others = {i: [self.codes[x] for x in self._pieces(t)] for i, (t, p) in enumerate(zip(texts, plain)) if t and not p}
        if others:
            runs = iter(np.split(codes, np.cumsum(some)[:-1]) if len(some) else ())
            codes = np.concatenate([np.array(others[i], np.int64) if i in others else next(runs)
                                    for i, p in enumerate(plain) if p or i in others])
            for i, x in others.items():
                per[i] = len(x)
        self._learn()
        self.met[:self.known] += np.bincount(codes, minlength=self.known)
        return codes, per

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        codes, per = self._code(texts)
        return _sums(self.lens[codes], per)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and tokens of each text."""
        codes, per = self._code(texts)
        lens = self.lens[codes]
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        at = np.repeat(self.starts[codes] - first, lens) + np.arange(total)
        return self.flat[at], _sums(lens, per)


def _grown(x: np.ndarray, least: int) -> np.ndarray:
    """``x`` with room for ``least`` values and a quarter more."""
    out = np.zeros(max(least + least // 4, len(x)), x.dtype)
    out[:len(x)] = x
    return out


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    ends = np.cumsum(per)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - per]


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, reused by its later tasks."""
    return worker_state("encoder", path, lambda: PieceEncoder(path))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
