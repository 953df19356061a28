"""Token ids of whole texts by public tokenizers, with a cache of words.

A text is cut at ASCII white space only where the tokenizer could not join tokens
across the cut; each distinct word is encoded once by the tokenizer library and its
ids are kept.  The result equals that of encoding the whole text at once.
"""

from __future__ import annotations

import functools
import os

#: Words that the cache of one Python worker holds; others are encoded anew each time.
CACHE_WORDS = 400_000


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file: in ``folder``, or in the installed public set."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for 256, 257, ... in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Word to the little-endian 32-bit ids of its tokens."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        ids = self.encode(word)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def _pack(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class WordBpe:
    """The tokenizer of ``word_bpe_49k.json``: lower case, white space dropped, so words are independent."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # Fixed value: the pattern of the vocabulary file by which it cuts words.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.parts = _Words(self._part)
        self.words = _Words(self._word)

    def _part(self, part: str) -> bytes:
        spelt = part.encode().decode("latin-1").translate(self.letters)
        return _pack(t.id for t in self.model.tokenize(spelt))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if b"<|" in word or max(text) > "ÿ":
            # Special tokens, and letters whose normal form or lower case is not one to one.
            return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join([self.parts[p] for p in self.cut(text.lower())])

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def count(self, text: bytes) -> int:
        return len(self.ids(text)) // 4


# White space, in UTF-8, and a blank after it.
_PAIRS = [w.encode() + b" " for w in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + [chr(0x2000 + k).encode() + b" " for k in range(11)]


class ByteBpe:
    """The tokenizer of ``byte_bpe_50k.tiktoken``: byte-level, a blank belongs to the word after it."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.counts = _Words(lambda word: len(self.encoding.encode_ordinary(word.decode("utf-8", "replace"))))
        self.inside = regex.compile(r"(?<=\s) (?=\s)|(?<=\s) \s*$").search

    def odd(self, text: bytes) -> bool:
        """Whether a blank lies inside, or at the end, of other white space: a cut there would change the tokens."""
        return any(p in text for p in _PAIRS) and self.inside(text.decode("utf-8", "replace")) is not None

    def count(self, text: bytes) -> int:
        """Tokens of the text, which is cut before each blank."""
        if self.odd(text):
            return len(self.encoding.encode_ordinary(text.decode("utf-8", "replace")))
        first, *rest = text.split(b" ")
        counts = self.counts
        return (counts[first] if first else 0) + sum([counts[b" " + w] for w in rest])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker, which keeps its cache between tasks."""
    return WordBpe(path)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
