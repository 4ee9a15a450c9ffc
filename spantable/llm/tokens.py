"""Token ids of whole texts, word by word with a bounded memory of words."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from spantable.llm.text import forget_with

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Words, and parts of words, that a worker remembers in each of two generations.
REMEMBERED, PARTS = 1 << 18, 1 << 19

# Bytes as byte-level BPE writes them: printable Latin-1 characters stand for themselves, the rest follows from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
# What a file must say for its texts to be encoded word by word: fixed values of the tokenizer file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]}
_EASY = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed pattern of the tokenizer file, for words of the characters above.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
# Printable ASCII that is neither letter nor digit: one such mark after letters is a part of its own.
_MARKS = frozenset(c for c in range(33, 127) if not chr(c).isalnum())


def resolve(path: str) -> str:
    """A path as it is; a bare name means a file of the installed public tokenizers."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class _Words(dict):
    """ids of words as little-endian bytes; what is missing is asked of the older generation, then of encode."""

    def __init__(self, encode, older: dict) -> None:
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes | str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found


class WordTokens:
    """Encodes texts as the tokenizers library does with add_special_tokens=False.

    The tokenizer drops white space and never joins what white space separates,
    so a text's ids are those of its words in turn. `by_word` says whether the
    file has the very normalizer, pre-tokenizer and word end for which this and
    the parts of words below hold; for any other file texts are encoded whole.
    """

    def __init__(self, path: str, end: int | None = END) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(resolve(path))
        self.dtype = np.dtype("<u2") if max(self.tok.get_vocab_size(), end or 0) <= 1 << 16 else np.dtype("<u4")
        import json

        say = json.loads(self.tok.to_str())
        model = {k: say["model"].get(k) for k in ("type", "end_of_word_suffix", "continuing_subword_prefix", "dropout")}
        expected = {"type": "BPE", "end_of_word_suffix": "</w>", "continuing_subword_prefix": None, "dropout": None}
        blank = lambda x: x or None  # noqa: E731 - the library writes an absent prefix as null or as an empty string
        self.by_word = say.get("normalizer") == _NORMALIZER and say.get("pre_tokenizer") == _PRE and {k: blank(v) for k, v in model.items()} == expected
        self.special = tuple(x["content"] for x in say.get("added_tokens", []))
        self.end = b"" if end is None else self.dtype.type(end).tobytes()
        self.model = self.tok.model
        self.small = [self.dtype.type(i).tobytes() for i in range(self.tok.get_vocab_size())]
        self.parts = _Words(self._part, {})
        self.words = _Words(self._word, {})

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        """A word's ids: by its parts, where these are easy to tell, else as the library has it."""
        if word.isalpha():  # ASCII letters only
            return self.parts[word.lower().decode()]
        if word[:-1].isalpha() and word[-1] in _MARKS:
            return self.parts[word[:-1].lower().decode()] + self.parts[chr(word[-1])]
        text = word.decode("utf-8", "surrogatepass")
        if not _EASY.fullmatch(text) or "<" in text and any(s in text for s in self.special):
            return self._library(text.encode("utf-8", "replace").decode())
        return b"".join([self.parts[p] for p in _PART.findall(text.lower())])

    def _part(self, part: str) -> bytes:
        small = self.small
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE)
        return b"".join([small[t.id] for t in self.model.tokenize(shown)])

    def encode(self, text: str | bytes | None) -> np.ndarray:
        """The ids of a text, None as empty, and the end id."""
        if not self.by_word:
            return np.frombuffer(self._library(text.decode() if isinstance(text, bytes) else text or "") + self.end, self.dtype)
        if len(self.words) > REMEMBERED:
            self.words = _Words(self._word, dict(self.words))
        if len(self.parts) > PARTS:
            self.parts = _Words(self._part, dict(self.parts))
        data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        return np.frombuffer(b"".join(map(self.words.__getitem__, data.split())) + self.end, self.dtype)


@lru_cache(4)
def word_tokens(path: str, end: int | None) -> WordTokens:
    """One encoder a worker: its memory of words serves all its tasks."""
    return WordTokens(path, end)


forget_with(word_tokens.cache_clear)
