"""Byte-level BPE ids of whole texts through the tokenizers library, with caches of pieces and words.

Byte-level pre-tokenisation always starts a new token at a space between two
non-space characters, and nothing right of such a space depends on what is left of
it.  A text therefore encodes as the concatenation of its space-led pieces, each
encoded alone, and most pieces of a corpus occur again and again.  Texts with other
white space next to a space are cut at fewer places; the result is the same.

A line feed between two non-space characters is a token of its own, so texts are cut there
first, where that is all the line feeds they hold.

A piece that is new is cut into words by the vocabulary's own pattern, and new words
go to the library's model.  Pieces with added tokens, or with characters on which
versions of Unicode may differ, go through the library as a whole.
"""

from __future__ import annotations

import json
import re

import regex

from .common import LATIN_END, Generations, byte_symbols, kept_by_worker

#: Pieces, words that start a line, and other words that a Python worker keeps in each of two generations.
CACHE_PIECES, CACHE_STARTS, CACHE_WORDS = 400_000, 40_000, 20_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The split that byte-level pre-tokenisation makes (a fixed value of such vocabularies).
_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class _SpaceBeside(Exception):
    """A piece is empty, or begins or ends with white space: its text is to be cut at fewer places."""


class PieceEncoder:
    def __init__(self, vocabulary_path: str) -> None:
        from tokenizers import Tokenizer

        with open(vocabulary_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a byte-level vocabulary of the kind whose pieces can be encoded alone")
        self.tokenizer = Tokenizer.from_file(vocabulary_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x["content"] for x in spec["added_tokens"]]
        # Letters, or letters and one mark, are one word or two, unless an added token can stand in them.
        self.marks = ".,;:!?" if all(re.search(r"[^\w.,;:!?]", token) for token in self.added) else None
        self.tokenize = self.tokenizer.model.tokenize
        self.symbols = dict(enumerate(byte_symbols()))
        self.space = self.symbols[32]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Generations(lambda word: self._word(word.encode("utf-8").decode("latin-1").translate(self.symbols)), CACHE_WORDS)
        self.pieces = Generations(self._piece, CACHE_PIECES)
        self.starts = Generations(lambda word: self._piece(word, ""), CACHE_STARTS)
        self.feed = None if any("\n" in token for token in self.added) else self._alone("\n")

    @classmethod
    def shared(cls, vocabulary_path: str) -> PieceEncoder:
        """One per Python worker, so that tasks of the same worker share its caches."""
        return kept_by_worker(f"pieces {vocabulary_path}", lambda: cls(vocabulary_path))

    def _word(self, shown: str) -> bytes:
        """Ids of a word that is written in byte symbols."""
        packed = self.packed
        return b"".join([packed[x.id] for x in self.tokenize(shown)])

    def _alone(self, text: str) -> bytes:
        """Ids of a stretch of text."""
        if any(token in text for token in self.added) or not (text.isascii() or max(text) <= LATIN_END):
            return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.words.__getitem__, _PATTERN.findall(text)))

    def _piece(self, piece: str, lead: str = " ") -> bytes:
        """Ids of a space, or nothing, and the piece."""
        known, space = (self.pieces, self.space) if lead else (self.starts, "")
        if self.marks and piece.isascii():
            if piece.isalpha():
                return self._word(space + piece)
            if piece[-1:] in self.marks and piece[:-1].isalpha():
                return known[piece[:-1]] + self.words[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _SpaceBeside
        if self.marks and max(piece) <= LATIN_END:
            if piece.isalpha():
                return self._word(space + piece.encode("utf-8").decode("latin-1").translate(self.symbols))
            if piece[-1] in self.marks and piece[:-1].isalpha():
                return known[piece[:-1]] + self.words[piece[-1]]
        return self._alone(lead + piece)

    def _lines(self, text: str) -> bytes:
        """Ids of a text whose lines all begin and end with something but white space."""
        if self.feed is None:
            raise _SpaceBeside
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.starts[first] + b"".join(map(self.pieces.__getitem__, rest)))
        return self.feed.join(out)

    def _pieces(self, text: str) -> bytes:
        """Ids of any text."""
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.pieces.__getitem__, rest))
        except _SpaceBeside:
            first, *rest = _CUT.split(text)
            last = [rest.pop()] if rest else []
            ids = b"".join([*map(self.pieces.__getitem__, rest), *(self._alone(f" {x}") for x in last)])
        return self._alone(first) + ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers; a null text counts as empty."""
        out = []
        for text in texts:
            try:
                out.append(self._lines(text or ""))
            except _SpaceBeside:
                out.append(self._pieces(text or ""))
            self.words.turn()
            self.starts.turn()
            self.pieces.turn()
        return out
