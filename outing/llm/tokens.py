"""Token ids of whole texts by a public tokenizer, remembered by white-space chunk or by word after a space."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

#: A chunk that is longer is not remembered.
LONGEST_CHUNK = 64
#: Chunks that a task remembers; with LONGEST_CHUNK this bounds the memory, at some 100 MB.
CACHE_LIMIT = 400_000
#: As CACHE_LIMIT, for words after a space, which a worker remembers from one task to the next: some 250 MB.
WORKER_CACHE_LIMIT = 1_000_000
#: Python's split() takes these as white space, the tokenizer does not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Begins the strings of special tokens, which the tokenizer looks for before it lowers a text.
_SPECIAL = "<|"
#: The words that the pre-tokenizer of word_bpe_49k.json makes of an ASCII text.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The tokenizer settings that the shortcuts below are made for.
_EXPECTED = ("NFC", "Replace", "Lowercase"), r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The words that byte-level BPE's pre-tokenizer makes of ASCII without white space but a space in front.
_BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")
#: ASCII punctuation that ends words often.
_STOPS = ".,;:!?"
#: Latin letters up to here are the same letters in every version of Unicode that is in use.
_LATIN = "ɏ"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the box keeps the public vocabulary file `name`; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


def _has_byte_rules(tokenizer) -> bool:
    """Whether the tokenizer prepares texts by byte-level BPE's pattern alone, without normalising them."""
    import json

    made = json.loads(tokenizer.to_str())
    steps = made["pre_tokenizer"] or {}
    plain = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")
    specials = all(t["content"].startswith(_SPECIAL) for t in made["added_tokens"])
    return bool(plain) and made["normalizer"] is None and not made["truncation"] and specials


def _has_word_rules(tokenizer) -> bool:
    """Whether the tokenizer prepares texts as word_bpe_49k does, which the shortcuts rely on."""
    import json

    made = json.loads(tokenizer.to_str())
    steps = tuple(n["type"] for n in (made["normalizer"] or {}).get("normalizers", ()))
    split = next(iter((made["pre_tokenizer"] or {}).get("pretokenizers", ())), {})
    specials = all(t["content"].startswith(_SPECIAL) for t in made["added_tokens"])
    return (steps, split.get("pattern", {}).get("Regex")) == _EXPECTED and specials


class _Chunks(dict):
    """white-space chunk (in lower case) -> its ids as bytes, remembered up to CACHE_LIMIT chunks."""

    limit = CACHE_LIMIT

    def __init__(self, tokenizer):
        super().__init__()
        self._tokenizer, self._model, self._letters = tokenizer, tokenizer.model, _byte_letters()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _make(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable():
            if chunk.isalpha():
                return self._word(chunk)
            return b"".join(map(self._word, _ASCII_WORDS.findall(chunk)))
        if len(chunk) > 1 and chunk[-1] in ".,":
            if chunk[-2].isalnum():  # a full stop or comma after a letter or digit is a token of its own
                return self[chunk[:-1]] + self[chunk[-1]]
        elif chunk.isalpha() and max(chunk) <= _LATIN:
            return self._word(chunk.encode().decode("latin-1").translate(self._letters))
        return array("I", self._tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self._make(chunk)
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = found
        return found


class _SpacedWords(_Chunks):
    """chunk without white space, but for a space in front if `lead` -> its ids as bytes, by byte-level BPE.

    A chunk that begins with a line break has no space in front: its ids are `line_break` and those of the rest.
    """

    limit = WORKER_CACHE_LIMIT

    def __init__(self, tokenizer, lead: str, line_break: bytes = b"", after_break: _SpacedWords | None = None):
        super().__init__(tokenizer)
        self._line_break, self._after_break = line_break, after_break
        self._lead, self._front = lead, self._letters[0x20] if lead else None
        self._stop = {c: self._word(c) for c in _STOPS}.__getitem__

    def _make(self, chunk: str) -> bytes:
        if chunk[0] == "\n":
            return self._line_break + self._after_break[chunk[1:]]
        if len(chunk) > 1 and chunk[-1] in _STOPS and chunk[-2].isalnum() and chunk[-2] <= _LATIN:
            return self[chunk[:-1]] + self._stop(chunk[-1])  # a stop after a letter or digit is a word of its own
        if chunk.isascii() and chunk.isprintable():
            if chunk.isalpha():
                return self._word((chr(self._front) if self._lead else "") + chunk)
            words = _BYTE_WORDS.findall(self._lead + chunk)
            return b"".join(self._word(w.replace(" ", chr(self._letters[0x20]))) for w in words)
        if chunk.isalpha() and max(chunk) <= _LATIN:
            return self._word((self._lead + chunk).encode().decode("latin-1").translate(self._letters))
        return array("I", self._tokenizer.encode_batch_fast([self._lead + chunk], add_special_tokens=False)[0].ids).tobytes()


class _Spaced:
    """ids of whole texts by byte-level BPE: its words never span a space between two others, nor a line break."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer
        self._first = _SpacedWords(tokenizer, "")
        self._next = _SpacedWords(tokenizer, " ", self._whole("\n"), self._first)

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __call__(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        if _SPECIAL in text or not flat.strip(" ") or " " in (flat[0], flat[-1]) or "  " in flat or not flat.isprintable():
            return self._whole(text)  # white space in runs, at the ends or of other kinds, or control characters
        first, *rest = (flat if flat == text else text.replace("\n", " \n")).split(" ")
        return self._first[first] + b"".join(map(self._next.__getitem__, rest))


class Encoder:
    """ids(text) of a tokenizers file; texts prepared as word_bpe_49k prepares them are encoded by chunk.

    Such a tokenizer never joins text across white space, so a text's ids are those of its chunks in turn, and a
    frequent chunk is encoded once. So is one of a byte-level BPE like byte_bpe_50k, whose words may begin with a
    space. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        self._tokenizer = _tokenizer(path)
        self._known = _Chunks(self._tokenizer) if path in _BY_WORD else None
        self._spaced = _Spaced(self._tokenizer) if path in _BY_BYTE else None

    @staticmethod
    def _by_chunk(text: str) -> bool:
        """Whether the text may be lowered and split before the tokenizer sees it."""
        if _SPECIAL in text or any(c in text for c in _NOT_SPACE):
            return False
        if text.isascii():
            return True
        if "Σ" in text or "İ" in text:  # their lower case depends on what is around, or grows
            return False
        return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if self._spaced is not None:
            return list(map(self._spaced, texts))
        known, out = self._known, []
        for text in texts:
            if known is not None and self._by_chunk(text):
                out.append(b"".join(map(known.__getitem__, text.lower().split())))
            else:
                out.append(array("I", self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes())
        return out


_TOKENIZERS: dict[str, object] = {}
_BY_WORD: set[str] = set()
_BY_BYTE: set[str] = set()


def _tokenizer(path: str):
    """This worker's tokenizer for `path`."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = _TOKENIZERS[path] = Tokenizer.from_file(path)
        if _has_word_rules(made):
            _BY_WORD.add(path)
        elif _has_byte_rules(made):
            _BY_BYTE.add(path)
    return _TOKENIZERS[path]


def encoder(path: str) -> Encoder:
    """An encoder for one task: what it remembers goes when the task ends."""
    return Encoder(path)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """This worker's encoder, which later tasks in the worker find warm; what it remembers stays bounded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
