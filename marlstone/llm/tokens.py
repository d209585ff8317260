"""Token ids of whole texts with the public tokenizers, at the speed of a look-up.

A text is cut before the blanks that follow a non-blank. No pre-token of either
tokenizer crosses such a cut, so a text's ids are its chunks' ids in a row. A
worker keeps the ids of the chunks it has met in a bounded table, so each
frequent chunk is encoded once; chunks it has not met are split with the
tokenizer's own pattern and encoded by its BPE model. Chunks with characters
outside the range where this is plain go through the library's whole pipeline.

So do whole texts that hold the string of an added token (the library gives it
the token's own id, wherever it stands), and all texts where a tokenizer file
has other settings than the two kinds known here.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: The pre-token patterns that the two tokenizer files name.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The settings of the two kinds of files; the cut and the patterns above hold for these alone.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_SETTINGS = {"normalizer": None, "pre_tokenizer": _BYTE_LEVEL | {"use_regex": True}}
WORD_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN.pattern}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}],
    },
}
#: A worker's tables are emptied when one holds this many chunks or pre-tokens.
MOST_CHUNKS = 600_000
_PLAIN = re.compile("\n?[\x20-ɏ]*")  # no combining marks, no odd blanks (but U+0085 and U+00A0, which the patterns know)
_MARKS = string.punctuation.replace("'", "")  # an apostrophe may begin a pre-token of letters
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


def _spelled(s: str) -> str:
    if s.isascii() and s.isprintable():
        return s.replace(" ", "Ġ")
    return s.encode("utf-8").decode("latin-1").translate(_LETTERS)


class Encoder(dict):
    """``ids(text)`` as little-endian unsigned 32-bit integers; the mapping itself is the table of chunks."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}  # of the chunks' pre-tokens
        settings = json.loads(self.tokenizer.to_str())
        kind = {k: settings[k] for k in BYTE_SETTINGS}
        self.by_word = kind == WORD_SETTINGS  # lower case, blanks dropped
        added = settings["added_tokens"]
        self.added = [t["content"] for t in added]
        known = kind in (BYTE_SETTINGS, WORD_SETTINGS) and settings["model"]["type"] == "BPE" and settings["post_processor"] is None and settings["truncation"] is None
        self.plain = known and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)

    def whole(self, text: str) -> bytes:
        """The library's whole pipeline."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            found = b"".join([self.words.get(part) or self._part(part) for part in self._parts(chunk)])
        else:
            found = self.whole(chunk)
        self[chunk] = found
        return found

    def _part(self, part: str) -> bytes:
        """A pre-token's ids; words that come with several marks are encoded once."""
        self.words[part] = found = array("I", [t.id for t in self.tokenize(_spelled(part))]).tobytes()
        return found

    def _parts(self, chunk: str) -> list[str]:
        """The pre-tokens of a plain chunk; one word, with or without marks at its end, needs no pattern."""
        if self.by_word:
            chunk = chunk.lower() if chunk.isascii() else "".join(c.lower() for c in chunk)
            body = chunk
        else:
            body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if (word := body.rstrip(_MARKS)).isalpha():
            cut = len(word) - len(body)
            return [chunk[:cut], chunk[cut:]]
        return (WORD_PATTERN if self.by_word else BYTE_PATTERN).findall(chunk)

    def _chunks(self, text: str) -> list[str]:
        flat = text.replace("\n", " ")
        if self.by_word:
            return flat.split(" ")
        # A printable text has no blank but this one; where none follows another, each word but the first carries its own.
        if flat.isprintable() and "  " not in flat and flat[0] != " " != flat[-1]:
            return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return _CUT.split(text)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(t in text for t in self.added):
            return self.whole(text)
        if max(len(self), len(self.words)) > MOST_CHUNKS:
            self.clear()
            self.words.clear()
        return b"".join(map(self.__getitem__, self._chunks(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, find: Callable[[str], str] | None = None) -> Encoder:
    """This worker's encoder of a tokenizer file, by its public name or its path."""
    if name not in _ENCODERS:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = (find or public_tokenizers.path)(name)
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]
