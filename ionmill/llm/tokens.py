"""Exact whole-text tokenisation with the tokenizers library, at the speed of a cache.

Both vocabularies split a text wherever a non-space character is followed by a space, tab or line break, whatever stands around it, since no
pre-token holds a non-space character before white space. So a text's ids are those of its pieces (white-space run, then non-space run), joined.
A new piece made of plain Latin-1 letters, digits and signs is split further by the vocabulary's own pattern, and only the strings not seen
before are encoded, by the library itself. A text with other white space, or one that spells an added token, goes to the library whole,
because these need context.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space, line feed, tab and return; one search each is quicker than a pattern.
_ODD_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r")
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_LETTERS = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_ONE = re.compile(f" ?[{_LETTERS}]+").fullmatch
_PLAIN = re.compile(f"[{_LETTERS}0-9 \n\t\r!-/:-@\\[-`{{-~]*").fullmatch
#: The vocabularies' pre-token patterns, for plain pieces.
_SPACE_FREE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+").findall
_SPACE_BOUND = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+").findall
#: Pre-tokens that show whether the model by itself gives what the library gives.
_PROBES = ("plain", "würde", "ñandú", "'ll", "7", "...", "}#", "zzqxj")
#: What keeps single spaces from telling pieces apart: white space next to white space, tabs, returns, and the mark itself.
_TANGLED = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\0")
#: Bytes that an entry of the cache takes besides its string and ids.
_ENTRY = 220


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes.

    space_free: the vocabulary is lower case and drops white space (else it keeps both).
    cache_bytes: bound of what is kept between calls. The cache has two generations: a full young one becomes the old one, and what is met again moves up.
    special_as_text: a text that spells an added token is encoded as ordinary text, not as that token.
    """

    def __init__(self, path: str, space_free: bool = False, cache_bytes: int = 192 << 20, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.head = re.match("[^a-zA-Z]*", os.path.commonprefix(added))[0]  # what all added tokens begin with; a cheap test before the search
        self.special = re.compile("|".join(map(re.escape, added)), re.I).search if added else None
        self.space_free, self.cache_bytes = space_free, cache_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model, spell = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.byte_chars = {ord(c): spell(c)[0][0] for c in map(chr, range(256)) if _PLAIN(c)}
        probes = list(_PROBES) if space_free else [*_PROBES, *(" " + p for p in _PROBES), "\n", " "]
        self.single = self._model_ids if self._model_ids(probes) == self.library(probes) else self.library  # another kind of vocabulary

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_of(self, strings: list[str]) -> list[str]:
        table = self.byte_chars
        return [t.translate(table) for t in strings]

    def _model_ids(self, strings: list[str]) -> list[bytes]:
        """Ids of single pre-tokens of plain characters, by the vocabulary's own model: a tenth of the time that a call for a text takes."""
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(s)]).tobytes() for s in self._bytes_of(strings)]

    def _marked(self, text: str) -> str | None:
        """The text with one space before each piece but the first; None if single spaces cannot tell its pieces apart.

        Without its own white space, a piece is what it was, less a space at its front; a first piece that has none gets a NUL instead.
        """
        if self.space_free:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if any(map(text.__contains__, _TANGLED)):
            return None
        text = text.replace("\n", " \n")
        return text[1:] if text[:1] == " " else "\0" + text

    def _pieces(self, parts: list[str]) -> list[str]:
        if self.space_free:
            return parts
        return [p if (c := p[:1]) == "\n" else p[1:] if c == "\0" else " " + p for p in parts]

    def _meet(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` that are not known; known ones are young afterwards."""
        new = wanted.difference(self.young)
        if self.old:
            back = new.intersection(self.old)
            self._add(back, map(self.old.__getitem__, back))
            new -= back
        return new

    def _add(self, strings, ids) -> None:
        got = dict(zip(strings, ids, strict=True))
        self.young.update(got)
        self.held += sum(map(len, got)) + sum(map(len, got.values())) + _ENTRY * len(got)

    def _learn(self, pieces: set[str]) -> None:
        cut, low = (_SPACE_FREE, str.lower) if self.space_free else (_SPACE_BOUND, str)
        one, whole, split = [], [], {}
        for p in pieces:
            if _ONE(p):
                if (t := low(p)) == p:
                    one.append(p)
                else:
                    split[p] = (t,)
            elif _PLAIN(p):
                split[p] = cut(low(p))
            else:
                whole.append(p)
        self._add(one, self.single(one))
        self._add(whole, self.library(whole))
        parts: set[str] = set()
        parts.update(*split.values())
        new = list(self._meet(parts))
        self._add(new, self.single(new))
        get = self.young.__getitem__
        self._add(split, [b"".join(map(get, ts)) for ts in split.values()])

    def _known(self, pieces: set[str]) -> None:
        if new := self._meet(pieces):
            self._learn(new)

    def _marked_ids(self, marked: list[str]) -> list[bytes]:
        """Arrow numbers the pieces, only distinct ones are looked up, and Arrow lines up their ids."""
        split = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        distinct = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self._known(set(distinct))
        ids = pa.array(list(map(self.young.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        view = memoryview(data or b"")
        return [bytes(view[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """One byte string per text. Nulls are the caller's to replace."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and a collection would walk the cache
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: dict[int, bytes] = {}
        odd = [i for i, t in enumerate(texts) if any(map(t.__contains__, _ODD_SPACE)) or self.special and self.head in t and self.special(t)]
        out.update(zip(odd, self.library([texts[i] for i in odd]), strict=True))
        marked = {i: self._marked(t) for i, t in enumerate(texts) if i not in out}
        split = {i: _PIECE.findall(texts[i]) for i, m in marked.items() if m is None}
        if split:
            self._known(set().union(*split.values()))
            get = self.young.__getitem__
            out.update((i, b"".join(map(get, ps))) for i, ps in split.items())
        if plain := [i for i, m in marked.items() if m is not None]:
            out.update(zip(plain, self._marked_ids([marked[i] for i in plain]), strict=True))
        if self.held > self.cache_bytes // 2:
            self.old = self.young if self.held <= self.cache_bytes else {}  # one call may learn more than the bound
            self.young, self.held = {}, 0
        return [out[i] for i in range(len(texts))]


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str, space_free: bool = False, cache_bytes: int = 192 << 20, special_as_text: bool = False) -> TextEncoder:
    """The encoder of this Python worker; workers are reused, and so is the cache. A worker holds one encoder at a time."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, space_free, cache_bytes, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


def gathered(batches: Iterator, most_chars: int = 6_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the first two columns, in runs of about that many characters whatever the batches; null texts are empty."""
    ids: list = []
    texts: list[str] = []
    n = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= most_chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def slices(sizes: list[int], most: int):
    """(first, last) of runs whose sizes reach about that much, for bounded memory."""
    first, n = 0, 0
    for i, size in enumerate(sizes):
        n += size
        if n >= most:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def in_slices(texts: list[str], most_chars: int = 6_000_000):
    """slices() of texts by their characters."""
    return slices(list(map(len, texts)), most_chars)
