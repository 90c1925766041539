"""Token ids of whole texts from a tokenizer file, each distinct piece between spaces encoded once per worker.

Both public vocabularies cut a text at a single space between two non-space characters before they merge
anything, so a text's ids are the ids of its pieces one after the other. Pieces repeat, so their ids are
remembered as bytes; a piece of plain letters and marks goes straight to the vocabulary's merges, every other
piece, and every text with uneven white space, through the tokenizer as it is. A text that holds the string of one of
the file's added tokens, which are matched before anything else, goes through the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array

from .common import in_worker

#: Pieces remembered by one Python worker; later new pieces are encoded each time they occur.
REMEMBERED = 200_000

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ž]*)([.,;:!?|()%$&*#+=-]*)")


class _Uneven(Exception):
    """White space at a piece's edge: the piece can't be encoded by itself."""


class _Pieces(dict):
    """Ids of pieces that follow ``before``, which is a space or nothing."""

    def __init__(self, owner: PieceEncoder, before: str) -> None:
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        owner = self.owner
        plain = _PLAIN.fullmatch(piece)
        if plain:
            word, marks = plain.groups()
            ids = owner.merged(self.before + word) + owner.merged(marks) if word else owner.merged(self.before + marks)
        elif "\n" in piece:
            first, *rest = piece.split("\n")
            ids = self[first] + b"".join(owner.line_end + owner.starts[p] for p in rest)
            return ids  # the parts are remembered
        else:
            ids = owner.whole(self.before + piece)
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # a token matched in the normalized text may be spelled in any way
        self.markers = [""] if any(t.normalized for t in added) else [t.content for t in added]
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.line_end = self.whole("\n")
        # the vocabulary spells bytes as characters: its own spelling of each, from its pre-tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {
            b: spelled.pre_tokenize_str(bytes([b]).decode())[0][0] for b in range(0x80)}
        for b in range(0x80, 0x100):  # é is C3 A9: the second byte of U+0080..U+00BF, the first of U+0080, U+00C0
            if b < 0xC0:
                self.spelling[b] = spelled.pre_tokenize_str(bytes([0xC2, b]).decode())[0][0][1]
        for b in (0xC2, 0xC3, 0xC4, 0xC5):
            self.spelling[b] = spelled.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0]
        self.spaced = self.whole(" a") != self.whole("a")  # a space is part of the token after it
        self.marks: dict[str, bytes] = {"": b""}
        self.after, self.starts = _Pieces(self, " "), _Pieces(self, "")

    def merged(self, word: str) -> bytes:
        """Of one run of letters or marks, with the space before it."""
        known = self.marks.get(word)
        if known is not None:
            return known
        word_in = word
        if not self.spaced:
            word = word.lstrip(" ").lower()
        spelled = word.encode().decode("latin-1").translate(self.spelling)
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self.marks) < REMEMBERED:
            self.marks[word_in] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Raw ids of the text."""
        if any(m in text for m in self.markers):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.starts[first] + b"".join(map(self.after.__getitem__, rest))
        except _Uneven:
            if not text:
                return b""
        first, *rest = _SINGLE_SPACE.split(text)
        return b"".join([self.whole(first), *(self.whole(" " + p) for p in rest)])


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, as long as it goes on with the same file."""
    return in_worker(("encoder", path), lambda: PieceEncoder(path))
