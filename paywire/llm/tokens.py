"""Exact, memoised use of a `tokenizers` vocabulary file inside a task.

A text of plain characters is cut into the pieces that the file's own pre-tokeniser
makes, and each distinct piece is encoded by the library once as long as the worker
remembers it.  Other texts are cut at ASCII white space first, and their plain chunks
into pieces.  The cuts change no id: no merge crosses such a boundary.  Where that could
fail (white space outside ASCII, other normalisers) the library gets the whole text.

A text that holds the string of one of the file's own control tokens goes to the
library whole as well, which gives that token's id.  With `special_as_text` such a string
is ordinary text, so no document can put a control token among its ids.
"""

from __future__ import annotations

import gc
import json
import re

import regex
from tokenizers import Tokenizer

from paywire.llm.common import MEMOS

#: White space that the Unicode pattern `\s` knows beyond ASCII, and the separators Python adds.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
#: Letters beyond ASCII on which normalisation and case are plain in every Unicode version.
_LETTERS = "À-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[ -~{_LETTERS}]+").fullmatch
_ODD = re.compile(f"[^\t-\r -~{_LETTERS}]").search
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII).findall
#: The two published pre-tokenisers' patterns, and what they come to on plain characters.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ON_PLAIN = {
    _BYTE_LEVEL: rf" ?[A-Za-z{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|\s+(?!\S)|\s+",
    _WORDS: rf"[A-Za-z{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{{-~]+",
}


def _pieces(pattern: str):
    """Pieces of a text of plain characters and ASCII white space."""
    return re.compile(_ON_PLAIN[pattern], re.ASCII).findall if pattern in _ON_PLAIN else regex.compile(pattern).findall


class _Memo(dict):
    """At most `most` parts and as many older ones; a part asked for again moves from the older ones, so frequent parts stay.

    Parts of over 64 characters, which seldom come again, are not kept.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, part):
        found = self.older.get(part) or self.encode(part)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found


class Encoder:
    """ids of whole texts as little-endian bytes of `width` (2 or 4) each.

    max_chunks bounds the memory of the memo; what falls out of it is encoded again, which costs time only.
    """

    def __init__(self, path: str, max_chunks: int = 300_000, special_as_text: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added and not special_as_text else None
        # a run of characters without case that all these tokens hold: looked for first, as a search without regard to case is slow
        self.mark = max((m for m in re.findall(r"[!-@\[-`{-~]+", added[0]) if all(m in t for t in added)), key=len, default="") if added else ""
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.memo = _Memo(self._part, max(1, max_chunks // 2))
        self.words = False
        self.pieces = None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.lower = False
        bpe = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        if bpe and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.pieces = _pieces(_BYTE_LEVEL)
        elif bpe and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            split = pre["pretokenizers"][0]
            if split["behavior"] == "Removed" and split["invert"] and r"\s" in split["pattern"]["Regex"]:
                self.pieces = _pieces(split["pattern"]["Regex"])
                self.words = self.lower = True
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        if self.pieces:
            from tokenizers.pre_tokenizers import ByteLevel

            show = ByteLevel(add_prefix_space=False, use_regex=False)
            plain = [*range(32, 127), *(i for i in range(0xC0, 0x100) if i not in (0xD7, 0xF7))]
            self.shown = {i: show.pre_tokenize_str(chr(i))[0][0] for i in plain}
            self.space = self.shown[32]
            self.model = self.library.model.tokenize

    def whole(self, text: str) -> bytes:
        return b"".join(self.packed[i] for i in self.library.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """ids of a piece, or of a chunk between white space."""
        space = part[0] == " "
        letters = part[1:].isalpha() if space else part.isalpha()
        if letters and part.isascii():
            show = self.space + part[1:] if space else part.lower() if self.lower else part
        elif not _PLAIN(part):
            return self.whole(part)
        else:
            if self.lower:
                part = part.lower()
            if not letters and len(found := self.pieces(part)) != 1:
                return b"".join([self.memo[p] for p in found])
            show = part.translate(self.shown)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model(show)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special and self.mark in text and self.special(text):
            return self.whole(text)
        if self.pieces is None:
            return self.whole(text)
        if not _ODD(text):
            parts = self.pieces(text.lower() if self.lower else text)
        elif _OTHER_SPACE(text):
            return self.whole(text)
        else:
            parts = text.split() if self.words else _CHUNKS(text)
        return b"".join(map(self.memo.__getitem__, parts))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _forget() -> None:
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()  # an encoder and its memo refer to each other, so the memory stays without


MEMOS["tokens"] = _forget


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker process, as its memo is worth keeping between tasks."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text=special_as_text)
    return _ENCODERS[key]
