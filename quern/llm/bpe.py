"""Byte-level BPE through the tokenizers library; a batch's distinct pieces are encoded once.

A single space between two characters that are not white space always begins a new
pre-token of this kind of tokenizer, and a lone line feed between such characters is a
pre-token of its own. A text can therefore be cut there, each piece be encoded by the
library once, and the ids be joined; the result equals encoding the whole text. Where a
text has adjacent white space, only the cuts that stay certain are made. A text that
holds a special token's string goes to the library whole, and so does every text if the
tokenizer's file names another way of cutting.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ADJACENT = re.compile(r"\s\s|\x00")
_CERTAIN = re.compile(r"(?<=\S)(?= \S)")
_BREAK = re.compile(r"[\s\x00]")
_BARE = "\x00"
#: Adjacent spaces and line feeds, or white space of another kind: such texts are looked at one by one.
_ODD_TEXT = r"[ \n][ \n]|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text that are cut and looked up at a time.
GROUP_BYTES = 8 << 20


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> PieceEncoder:
    """This process's encoder: a Python worker that runs several tasks keeps its cache from one to the next."""
    return PieceEncoder(path)


class PieceEncoder:
    """Encode texts to packed little-endian ids.

    ``cache_entries`` bounds the memory: two generations of so many pieces are kept. The
    cache has no influence on results.
    """

    def __init__(self, path: str, cache_entries: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        said = json.loads(self.tok.to_str())
        cut = said.get("pre_tokenizer") or {}
        # Cuts at spaces are certain for this kind only.
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and said.get("normalizer") is None and said["model"]["type"] == "BPE"
        added = self.tok.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.vocab_size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        # Each character of such a token's name stands for one byte.
        self.size = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.vocab_size)], np.int64)
        self.cache_entries = cache_entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _joined(self, words: list[str], together: int = 64) -> list[bytes]:
        """Ids of words without white space, each behind a space: many are given to the library as one text.

        A space before a word begins a pre-token, so no token spans two words, and ids are
        dealt back by the bytes of their tokens.
        """
        flat = array(self.code)
        for e in self.tok.encode_batch_fast([" " + " ".join(words[i : i + together]) for i in range(0, len(words), together)], add_special_tokens=False):
            flat.extend(e.ids)
        sizes = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1
        width = self.dtype.itemsize
        ends = (np.searchsorted(np.cumsum(self.size[np.frombuffer(flat, self.dtype)]), np.cumsum(sizes)) + 1) * width
        packed, ends = flat.tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _fill(self, keys: list[str]) -> list[bytes]:
        """Ids of each piece. A key is the piece after its leading space; keys that begin with a line feed or NUL have none."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if None in found:
            lost = {k for k, v in zip(keys, found) if v is None}
            fresh = [k for k in lost if k not in old]
            young.update((k, old[k]) for k in lost if k in old)
            plain = [k for k in fresh if k and k[0] not in "\n\x00"]
            text = " ".join(plain)
            if _BARE in text or len(text.split()) != len(plain):  # some have white space inside
                plain = [k for k in plain if not _BREAK.search(k)]
            if plain:
                young.update(zip(plain, self._joined(plain)))
                fresh = [k for k in fresh if k not in young]
            if fresh:
                said = [k[1:] if k[:1] == _BARE else k if k[:1] == "\n" else " " + k for k in fresh]
                young.update(zip(fresh, self._library(said)))
            found = [young[k] if v is None else v for k, v in zip(keys, found)]
            if len(young) > self.cache_entries:
                self.old, self.young = young, {}
        return found

    def _keys(self, text: str) -> list[str] | None:
        """The pieces of a text, or nothing where only the library can cut it."""
        if not self.cuts or any(x in text for x in self.specials):
            return None
        if _ADJACENT.search(text):
            if _BARE in text:
                return None
            parts = _CERTAIN.split(text)
            return [_BARE + parts[0], *(p[1:] for p in parts[1:])]
        return (_BARE + text.replace("\n", " \n " + _BARE)).split(" ")

    def _dealt(self, keys: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pieces one after the other, and how many each list has."""
        named = keys.dictionary_encode()
        found = self._fill(named.dictionary.to_pylist())
        packed = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begins, at = np.cumsum(sizes) - sizes, named.indices.to_numpy()
        n = sizes[at]
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        place = np.repeat(begins[at] - done[:-1], n)
        place += np.arange(len(place))
        return packed[place], np.diff(done[ends], prepend=0)

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For so many texts at a time: ids of all of them one after the other, and how many each has. Null has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + GROUP_BYTES, "right")))
            yield self._group(texts[start:stop])
            start = stop

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD_TEXT)
        for x in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False) | (not self.cuts)
        plain = texts.filter(pa.array(~odd))
        pieces = pc.split_pattern(pc.binary_join_element_wise(_BARE, pc.replace_substring(plain, "\n", " \n " + _BARE), ""), " ")
        ids, counts = self._dealt(pieces.flatten(), pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py())
        if not odd.any():
            return ids, counts
        strange = texts.filter(pa.array(odd)).to_pylist()
        keys = [self._keys(t) for t in strange]
        cut = [k for k in keys if k is not None]
        some, some_counts = self._dealt(pa.array([x for k in cut for x in k], pa.string()), np.cumsum([len(k) for k in cut], dtype=np.int64))
        dealt = iter(np.split(some, np.cumsum(some_counts)[:-1]) if cut else [])
        own = [np.frombuffer(self._library([t])[0], self.dtype) if k is None else next(dealt) for t, k in zip(strange, keys)]
        # Both kinds in the order of the texts: runs of plain ones stay together.
        total = np.zeros(len(odd), np.int64)
        total[~odd], total[odd] = counts, [len(x) for x in own]
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        parts, done = [], 0
        for i, (where, x) in enumerate(zip(np.flatnonzero(odd).tolist(), own)):
            upto = where - i
            parts += [ids[at[done] : at[upto]], x]
            done = upto
        return np.concatenate([*parts, ids[at[done] :]]), total

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, none for null."""
        for ids, counts in self.encode_array(pa.array(texts, pa.string())):
            yield from (x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1]))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of one text."""
        return next(self.encode_many([text]))


_ODD = re.compile(r"[^\S ]")


@lru_cache(maxsize=2)
def shared_word_encoder(path: str) -> WordEncoder:
    """This process's encoder of words."""
    return WordEncoder(path)


class WordEncoder:
    """Encode words by themselves, each with one leading space, by the ranks of a byte-level BPE.

    Such a tokenizer begins a new piece at every single space before a character that is not
    white space. Words can therefore be joined and encoded together; ids are dealt back to
    words by their numbers of bytes. Words with other white space are encoded one by one.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.vocab_size = max(ranks.values()) + 2
        self.end = self.vocab_size - 1
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.tok = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(self.vocab_size, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        return self.tok.encode_to_numpy(text, disallowed_special=())

    def encode(self, words: list[str], group: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        ids, times = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), group):
            part = words[lo : lo + group]
            text = " " + " ".join(part)
            if _ODD.search(text):
                alone = [self._ids(" " + w) for w in part]
                ids += alone
                times.append(np.fromiter(map(len, alone), np.int64, len(alone)))
                continue
            ids.append(self._ids(text))
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in part), np.int64, len(part)) + 1)
            times.append(np.diff(np.searchsorted(np.cumsum(self.size[ids[-1]]), ends) + 1, prepend=0))
        return np.concatenate([x.astype(self.dtype) for x in ids]), np.concatenate(times)
