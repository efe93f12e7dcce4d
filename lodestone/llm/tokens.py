"""Exact token ids and counts through worker caches of pre-token encodings.

A text is cut at single spaces only. Neither library joins what lies on both sides of such
a cut, so a text's encoding is the concatenation of its parts' encodings, and a worker
remembers the parts that it has met. Texts in which a cut isn't safe are encoded whole.
"""

from __future__ import annotations

import base64
import re

import public_tokenizers

#: Entries of one generation of a worker's cache; two generations live at a time.
CACHE_ENTRIES = 300_000
#: Longer parts, and those that hold a line feed, are encoded and not kept.
CACHE_PART = 40
_LIBRARIES: dict = {}


def tokenizer(name: str):
    """The ``tokenizers`` tokenizer of a public file, once per process."""
    if name not in _LIBRARIES:
        from tokenizers import Tokenizer

        _LIBRARIES[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _LIBRARIES[name]


def ranked(name: str):
    """The ``tiktoken`` encoding of a public rank file, without special tokens, once per process."""
    if name not in _LIBRARIES:
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LIBRARIES[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LIBRARIES[name]


def sentencepiece(name: str):
    """The ``sentencepiece`` processor of a public file, once per process."""
    if name not in _LIBRARIES:
        import sentencepiece as sp

        _LIBRARIES[name] = sp.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return _LIBRARIES[name]


#: White space characters in a row from which on ``tiktoken`` runs out of stack.
LONG_SPACE = 50_000
_LONG = re.compile(rf"\s{{{LONG_SPACE},}}")


def ranked_count(text: str, name: str) -> int:
    """Tokens of a text in a rank file, whatever its white space.

    The pattern of pre-tokens takes a run of white space without its last character, which
    belongs to what follows, as one pre-token; at the text's end the whole run. Such a run is
    encoded as the one piece that it is, and what stands before and after by the pattern.
    """
    ranks, n, at = ranked(name), 0, 0
    for m in _LONG.finditer(text) if len(text) >= LONG_SPACE else ():
        stop = m.end() - (m.end() < len(text))
        # the character that the run before this one has left may be white space too
        n += len(ranks.encode_ordinary(text[at : m.start()])) + len(ranks._encode_single_piece(text[m.start() : stop]))
        at = stop
    return n + len(ranks.encode_ordinary(text[at:]))


class Unsafe(Exception):
    """A part at which the text can't be cut."""


class PartCache(dict):
    """``self[part]`` is :meth:`encode` of it; frequent parts outlive the infrequent ones.

    When the cache is full it becomes the old generation, and what is met again moves from
    there to the new one. Parts of the fixed ``table`` (the broadcast tier) are never lost.
    """

    def __init__(self, table: dict | None = None):
        super().__init__(table or {})
        self.table, self.old, self.full = table or {}, {}, len(table or {}) + CACHE_ENTRIES

    def __missing__(self, part: str):
        if part in self.old:
            out = self.old[part]
        else:
            out = self.encode(part)
            if len(part) > CACHE_PART or "\n" in part:
                return out
        if len(self) >= self.full:
            self.old = dict(self)
            self.clear()
            self.update(self.table)
        self[part] = out
        return out

    def encode(self, part: str):
        raise NotImplementedError


class ByteLevelIds:
    """Ids of a byte-level BPE vocabulary, as a text's library gives them.

    The rank file has the vocabulary of the ``tokenizers`` file; ``tiktoken`` returns the
    same ids several times as fast (tested). Texts that hold an added token's string go to
    ``tokenizers``, which takes it for that token, as do those with a run of ``LONG_SPACE``
    white space characters, at which ``tiktoken`` runs out of stack.
    """

    def __init__(self, name: str):
        self.library, self.ranks = tokenizer(f"{name}.json"), ranked(f"{name}.tiktoken")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaces = _LONG

    def ids(self, text: str) -> list[int]:
        if any(a in text for a in self.added) or (len(text) >= LONG_SPACE and self.spaces.search(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class PieceCache(PartCache):
    """Sentencepiece BPE: a part's value is what ``value`` makes of the ids of its pieces.

    The library puts a space mark before a text and replaces spaces by it. No piece has the
    mark after another character (checked here), so no merge crosses a cut before a space;
    a part encoded alone gets the same mark. Runs of spaces and the mark itself are unsafe.
    """

    MARK = "▁"

    def __init__(self, name: str, value, table: dict | None = None):
        super().__init__(table)
        self.library, self.value = sentencepiece(name), value
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        assert not any(re.search(f"[^{self.MARK}]{self.MARK}", p) for p in pieces), "pieces cross words"

    def encode(self, part: str):
        if not part or self.MARK in part:
            raise Unsafe
        return self.value(self.library.encode(part))

    def values(self, text: str) -> list:
        """The values of a text's parts, or of the whole text where it can't be cut; none if it is empty."""
        if not text:
            return []
        try:
            return list(map(self.__getitem__, text.split(" ")))
        except Unsafe:
            return [self.value(self.library.encode(text))]
