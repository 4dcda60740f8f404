"""Subword ids of whole texts with a public tokenizer, through a word memo.

The tokenizer normalises, splits at white space and punctuation and merges inside each piece, so
a text's ids are those of its white-space separated words in a row.  Each worker keeps the ids of
words and pieces it has met (bounded; emptied when full) and asks the library only for new ones.
Texts with the literal of an added token, which counts in its own case only, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import regex

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers.
MEMO = 1_200_000
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Marks that often end a word and are a piece of their own.
MARKS = frozenset(b"%c" % c for c in b",.;:!?")
TEXT_MARKS = frozenset(",.;:!?")
#: Characters outside of this take the library's own normaliser.
PLAIN = re.compile(r"[\x21-\x7e\xa1-ſ]+")
#: How some ids are written, by their number.
PACKED = [struct.Struct(f"<{n}H") for n in range(64)]
#: The same for words of ASCII, whose letters are lower case.
ASCII, ASCII_SPLIT = re.compile(rb"[\x21-\x7e]+"), re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """word (bytes, ASCII lower-cased) -> its ids as little-endian 16-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(path)  # for words, whose case is lost
        self.plain.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() >= 1 << 16:
            raise ValueError("ids and one more number must fit 16 bits")
        self.merge = self.tokenizer.model.tokenize
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def piece(self, p: str) -> bytes:
        """Ids of one piece: a run of letters, a number, or a run of other characters."""
        found = self.merge(p if p.isascii() else p.encode().decode("latin-1").translate(self.table))
        kind = PACKED[len(found)] if len(found) < len(PACKED) else struct.Struct(f"<{len(found)}H")
        return kind.pack(*[t.id for t in found])

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters stand for themselves
            got = self.piece(word.decode("ascii"))
        elif word[-1:] in MARKS and word[:-1].isalpha():
            got = self[word[:-1]] + self[word[-1:]]
        elif ASCII.fullmatch(word):
            pieces = ASCII_SPLIT.findall(word)
            got = self.piece(word.decode("ascii")) if len(pieces) == 1 else b"".join([self[p] for p in pieces])
        else:
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text):
                text = text.lower()
                if text.isalpha():  # letters only are one piece, and a mark behind them is another
                    got = self.piece(text)
                elif text[-1] in TEXT_MARKS and text[:-1].isalpha():
                    got = self[text[:-1].encode()] + self[word[-1:]]
                else:
                    pieces = SPLIT.findall(text)
                    got = self.piece(pieces[0]) if len(pieces) == 1 else b"".join([self[p.encode()] for p in pieces])
            else:
                ids = self.plain.encode(text, add_special_tokens=False).ids
                got = struct.pack(f"<{len(ids)}H", *ids)
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got

    def literal(self, text: str | None) -> bool:
        """Whether the text has the literal of an added token, so that its words do not tell its ids."""
        return bool(text) and any(a in text for a in self.added)

    def ids(self, text: str | None, ws: list[bytes] | None = None) -> bytes:
        """Ids of a whole text; null counts as empty.  ``ws`` are its words if they are known."""
        if self.literal(text):
            found = self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}H", *found)
        return b"".join(map(self.__getitem__, words(text) if ws is None else ws))


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    """The worker's memo of a vocabulary."""
    return Memo(path)
