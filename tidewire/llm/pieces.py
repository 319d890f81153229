"""White-space pieces of texts, their words, and a cache of what was made of them.

No word of the vocabulary's split pattern crosses white space, so the encoding of
a text is that of its pieces in order. Pieces and words repeat a lot; each worker
keeps the recent ones in two generations of bounded size. A piece that was
forgotten is encoded again; nothing is left out.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator

import regex

GENERATION = 1 << 16
GROUP_CHARS = 1 << 20
#: characters that Python takes for white space and the Unicode property does not
_NOT_BLANK = regex.compile("[\x1c-\x1f]")
_BLANK = regex.compile(r"\p{White_Space}+")
#: beyond these letters, Unicode versions may differ, and the library itself splits
_RARE = regex.compile("[^\x00-ɏ]")


class PieceSplitter:
    """Pieces and words of texts as a vocabulary file of the tokenizers library has them (NFC, lower case, split pattern)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "|\n")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    @functools.cached_property
    def library(self):
        """The tokenizers library's own object, truncation and padding unused; it is loaded where rare letters need it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def pieces(self, text: str) -> list[str]:
        """White-space pieces, with special tokens' strings as pieces of their own."""
        if "<|" in text and self.special_pattern.search(text):
            out, at = [], 0
            for m in self.special_pattern.finditer(text):
                out += [*self.pieces(text[at : m.start()]), m.group()]
                at = m.end()
            return out + self.pieces(text[at:])
        if _NOT_BLANK.search(text):
            return [p for p in _BLANK.split(text) if p]
        return text.split()

    def words(self, pieces: list[str]) -> list[list[str]]:
        """Normalised words of each piece."""
        usual = [p for p in pieces if not _RARE.search(p)] if _RARE.search("".join(pieces)) else pieces
        whole = unicodedata.normalize("NFC", "\n".join(usual)).replace("Σ", "σ").lower()
        found: list[list[str]] = [[]]
        for word in self.pattern.findall(whole):
            if word == "\n":
                found.append([])
            else:
                found[-1].append(word)
        if len(usual) == len(pieces):
            return found[: len(pieces)]
        by = dict(zip(usual, found, strict=False))
        return [by[p] if p in by else self._by_library(p) for p in pieces]

    def _by_library(self, piece: str) -> list[str]:
        out = []
        for part in _BLANK.split(self.library.normalizer.normalize_str(piece)):
            raw, at = part.encode(), 0
            for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(part):  # a symbol for each byte
                out.append(raw[at : at + len(symbols)].decode())
                at += len(symbols)
        return out


class PieceCache:
    """Encoded pieces: ``encode`` gives the ids (as bytes) of words, ``entries`` what is kept of encoded pieces."""

    def __init__(self, splitter: PieceSplitter, encode: Callable[[list[str]], list[bytes]], entries: Callable[[list[bytes]], list], width: int = 4, generation: int = GENERATION):
        self.splitter, self.encode, self.entries, self.width, self.generation = splitter, encode, entries, width, generation
        self.new: dict = {}
        self.old: dict = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def clear(self) -> None:
        self.new, self.old, self.words, self.old_words = {}, {}, {}, {}

    def _learn(self, pieces: list[str]) -> None:
        special = self.splitter.special
        plain = [p for p in pieces if p not in special]
        spelled = self.splitter.words(plain)
        if len(self.words) > GENERATION:
            self.words, self.old_words = {}, self.words
        lacking = set().union(*spelled) - self.words.keys()
        again = lacking & self.old_words.keys()
        self.words.update(zip(again, map(self.old_words.__getitem__, again), strict=True))
        lacking = list(lacking - again)
        self.words.update(zip(lacking, self.encode(lacking), strict=True))
        get = self.words.__getitem__
        encoded = [b"".join(map(get, words)) for words in spelled]
        named = [p for p in pieces if p in special]
        encoded += [special[p].to_bytes(self.width, "little") for p in named]
        self.new.update(zip(plain + named, self.entries(encoded), strict=True))

    def texts(self, texts: list[str | None]) -> Iterator[list]:
        """The entries of the pieces of each text."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= GROUP_CHARS):
                chars += len(texts[j] or "")
                j += 1
            if len(self.new) > self.generation:
                self.new, self.old = {}, self.new
            split = [self.splitter.pieces(t) if t else [] for t in texts[i:j]]
            lacking = set().union(*split) - self.new.keys()
            again = lacking & self.old.keys()
            self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
            if lacking := list(lacking - again):
                self._learn(lacking)
            for pieces in split:
                yield list(map(self.new.__getitem__, pieces))
            i = j
