"""Token ids of whole texts, pre-token by pre-token.

The default tokenizer works on pre-tokens, which never hold white space, so the ids of a text are those of
its words, or of its pre-tokens, one after another. Each worker keeps the ids of the pre-tokens it
has met, up to a fixed number, and so encodes one once instead of at each occurrence. Texts are cut, looked up and
put together by whole slices in Arrow and numpy, so that an occurrence costs no Python object. Tokenizers whose own rules for cutting
texts differ are given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import worker_cache

#: Pre-tokens, and as many words, whose ids a worker keeps at most, and the greatest length in bytes of one. Half of them stay when there are more.
CACHE, CACHE_BYTES = 200_000, 64

#: The tokenizer's own pre-tokens, for lower-cased Latin-1 text: a contraction, a run of letters, one number, or a run of what is
#: neither nor blank. Letters and numbers are those of Unicode within it; _KIND has the kind of each character.
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _BLANK
_KIND[[ord(c) for c in "0123456789²³¹¼½¾"]] = _NUMBER
_KIND[[ord(c) for c in map(chr, range(256)) if c.isalpha()]] = _LETTER

#: Byte-level characters of each Latin-1 character's UTF-8 bytes: printable bytes stand for themselves, the others for 256, 257, ...
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
_LEVEL = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(256)} | {ord("\n"): "\n"}  # no pre-token has it


#: How that tokenizer normalises and cuts texts; only one that does the same is given pieces of them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of Latin-1 texts, and how many come before each text's end, from 0 on."""
    text = np.frombuffer("\n".join([*texts, "", ""]).lower().encode("latin-1"), np.uint8)
    kind = _KIND[text]
    solid = kind != _BLANK
    begins = solid.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    # A contraction begins where a run of other characters does, and what follows it is cut anew.
    quote = np.flatnonzero(begins & (text == ord("'")))
    after, then = text[quote + 1], text[quote + 2]
    one = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(after.astype(np.uint16) << 8 | then, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
    begins[quote[one | two] + 1] = False
    for found, size in ((one, 2), (two, 3)):
        at = quote[found] + size
        begins[at] = solid[at]
    firsts = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid))  # in the text without blanks
    cut = pa.Array.from_buffers(pa.large_binary(), len(firsts) - 1, [None, pa.py_buffer(firsts), pa.py_buffer(text[solid])])
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return cut, np.searchsorted(np.flatnonzero(begins), ends)


def _stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as its size, one stretch after another."""
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


class _Known:
    """Strings and their ids in flat arrays, which take a few bytes for each where Python's objects take hundreds."""

    def __init__(self, learn: Callable[[pa.Array], Iterable[list[int]]]) -> None:
        self.learn, self.turn = learn, 0
        self.strings = pa.array([], pa.large_binary())
        self.sizes = self.turns = np.zeros(0, np.int64)  # ids of each, and when it was last asked for
        self.ids = np.zeros(0, "<u4")

    def _add(self, fresh: pa.Array) -> None:
        found = list(self.learn(fresh))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.strings = pa.concat_arrays([self.strings, fresh])
        self.sizes, self.turns = np.concatenate([self.sizes, sizes]), np.concatenate([self.turns, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), "<u4", sizes.sum())])

    def _forget(self) -> None:
        """Long strings go, and beyond the limit those that were not asked for the longest."""
        stay = np.flatnonzero(pc.binary_length(self.strings).to_numpy() <= CACHE_BYTES)
        if len(stay) > CACHE:
            stay = np.sort(stay[np.argpartition(self.turns[stay], -(CACHE // 2))[-(CACHE // 2) :]])
        if len(stay) < len(self.strings):
            self.ids = self.ids[_stretches((np.cumsum(self.sizes) - self.sizes)[stay], self.sizes[stay])]
            self.strings, self.sizes, self.turns = self.strings.take(pa.array(stay)), self.sizes[stay], self.turns[stay]

    def encode(self, asked: pa.Array, before: np.ndarray) -> list[bytes]:
        """The ids of texts whose strings stand one after another in ``asked``; ``before``: how many come before each text's end, from 0 on."""
        self.turn += 1
        found = pc.index_in(asked, value_set=self.strings)
        place, new = found.fill_null(-1).to_numpy(zero_copy_only=False), found.is_null()
        if found.null_count:
            coded = asked.filter(new).dictionary_encode()
            place = place.copy()
            place[new.to_numpy(zero_copy_only=False)] = coded.indices.to_numpy() + len(self.strings)
            self._add(coded.dictionary)
        self.turns[place] = self.turn
        sizes = self.sizes[place]
        ends = np.append(0, np.cumsum(sizes))[before]
        out = self.ids[_stretches((np.cumsum(self.sizes) - self.sizes)[place], sizes)]
        if found.null_count:
            self._forget()
        return [out[a:b].tobytes() for a, b in pairwise(ends.tolist())]


class WordEncoder:
    """Texts to their ids as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pre_tokens, self.words = _Known(self._pre_tokens), _Known(self._words)
        rules = json.loads(self.tokenizer.to_str())
        specials = [x["content"] for x in rules["added_tokens"]]
        self.by_words = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _CUTS} and all(x.startswith("<|") and not re.search(r"\s", x) for x in specials)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """This worker's encoder, kept from task to task."""
        return worker_cache(("encoder", path), lambda: cls(path))

    def _pre_tokens(self, fresh: pa.Array) -> Iterable[list[int]]:
        """Pre-tokens go to the model itself, as normalising and cutting leave them as they are."""
        listed = pc.binary_join(pa.ListArray.from_arrays([0, len(fresh)], fresh), pa.scalar(b"\n", fresh.type))[0].as_py()
        return ([token.id for token in self.model.tokenize(w)] for w in listed.decode("latin-1").translate(_LEVEL).split("\n"))

    def _words(self, fresh: pa.Array) -> Iterable[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch(fresh.cast(pa.large_string()).to_pylist(), add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        # Special tokens are found before anything else, so texts that may hold one are left to the tokenizer, word by word.
        plain = ["<|" not in t and _latin(t) for t in texts]
        cut = iter(self.pre_tokens.encode(*_cut([t for t, own in zip(texts, plain, strict=True) if own])))
        parts = [t.replace("\n", " ").split(" ") for t, own in zip(texts, plain, strict=True) if not own]
        split = pa.array(chain.from_iterable(parts), pa.large_binary())
        rest = iter(self.words.encode(split, np.cumsum([0, *map(len, parts)])))
        return [next(cut if own else rest) for own in plain]
