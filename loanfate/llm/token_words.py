"""Ids of whole texts by the vocabularies of the tokenizers library, from the merges of its files.

The merges are done by tiktoken, which takes a vocabulary as ranks: a file's ids ascend with its
merges, so ids are ranks. A word end is written as a line feed, which no word has; the merges of a
letter with it come first, as the file's letters with a word end are single symbols.

:class:`ByteEncoder` hands whole texts to the library. :class:`WordEncoder` is for vocabularies that
drop white space: words stand alone between blanks, so a batch's different words are encoded once
and its texts are gathered from them.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from loanfate.llm import bpe

#: Words remembered by a worker in each of two generations. Bounds its memory, never its results.
REMEMBERED_WORDS = 150_000
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
#: Words of letters that are merged in one call.
MERGED_WORDS = 65_536
#: Stands for the end of a word.
WORD_END = b"\n"

#: Fixed value: the split pattern of the library's byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Splits words that are joined with their word ends.
WORD_PATTERN = r"[^\n]+\n"

#: Marks that may end a word: together they are one match, and the letters before them another.
_MARKS = string.punctuation
#: Latin letters that no normaliser composes or splits.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 ones for themselves,
    the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def id_bytes(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if held.itemsize != 4:
        raise RuntimeError("this platform has no 32-bit array type")
    if os.sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    """Once in each Python worker; strings of special tokens in a text are ordinary text.

    Spark runs a worker for each core, so the library's own threads are switched off.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def merge_encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file as ranks; raises where its ids don't ascend with its merges."""
    with open(path, encoding="utf-8") as held:
        model = json.load(held)["model"]
    end, vocabulary = model["end_of_word_suffix"] or "", model["vocab"]
    byte = {letter: b for b, letter in _byte_letters().items()}

    def spelled(token: str) -> bytes:
        if end and token.endswith(end):
            return bytes(byte[c] for c in token.removesuffix(end)) + WORD_END
        return bytes(byte[c] for c in token)

    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocabulary[a + b] for a, b in pairs]
    base = len(byte) * (2 if end else 1)
    if merged != list(range(base, base + len(merged))):
        raise ValueError(f"the ids of {path} don't ascend with its merges")
    if end and any(WORD_END in spelled(a + b)[:-1] for a, b in pairs):
        raise ValueError(f"merges of {path} have the byte that stands for a word end")
    letters = {t: i for t, i in vocabulary.items() if i < base}
    ranks = {spelled(t): i for t, i in letters.items()} | {spelled(a + b): i for (a, b), i in zip(pairs, merged)}
    pattern = WORD_PATTERN if end else BYTE_LEVEL_PATTERN
    return tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """For byte-level vocabularies without a normaliser: whole texts, as :func:`bpe.encode` takes them."""

    def __init__(self, path: str) -> None:
        self.encoding = merge_encoding(path)

    def encode(self, text: str) -> bytes:
        return id_bytes(bpe.encode(self.encoding, text))


@lru_cache(maxsize=4)
def last_of_word(path: str) -> np.ndarray:
    """For each id of :func:`merge_encoding` whether a word ends with it; the word end alone is no word's."""
    tokens = map(merge_encoding(path).decode_single_token_bytes, range(merge_encoding(path).n_vocab))
    return np.array([len(t) > 1 and t.endswith(WORD_END) for t in tokens])


def gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after the other, and their ends; ``ids`` holds those of all entries in order."""
    begin, length = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1]) if len(ends) else 0)
    place += np.repeat(begin[at] - ends + length, length)
    return ids[place], ends


class WordEncoder(dict):
    """For lower-case vocabularies with word ends that drop white space: a word to its ids.

    A word of Latin letters, which no normaliser composes or splits, is one match of the split
    pattern, and marks behind it are another: the lower-cased letters are merged directly, those of
    many words in one call. The marks and all other words go through the whole library, each by
    itself, and are remembered. When the dictionary is full it becomes the old generation, from
    which words met again come back; so frequent words stay and rare ones go.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer, self.encoding, self.last = load_tokenizer(path), merge_encoding(path), last_of_word(path)
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = id_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words``, of letters only, and each word's number of them."""
        ids, end = [np.empty(0, "<u4")], pa.scalar(WORD_END.decode(), pa.large_string())
        for start in range(0, len(words), MERGED_WORDS):
            some = words[start:start + MERGED_WORDS]
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(some)], some), end)[0].as_py() + end.as_py()
            ids.append(np.array(self.encoding.encode_ordinary(joined.lower()), "<u4"))
        joined_ids = np.concatenate(ids)
        ends = np.flatnonzero(self.last[joined_ids]) + 1
        if len(ends) != len(words):
            raise RuntimeError("the merges don't keep words apart")
        return joined_ids, np.diff(ends, prepend=0)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` and each word's number of them; a word has an entry of letters and one of the rest."""
        letters, rest = pc.utf8_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        n_letters, n_rest, n = (pc.binary_length(a).to_numpy() for a in (letters, rest, words))
        plain = (n_letters > 0) & (n_letters + n_rest == n)
        mask = pa.array(plain, pa.bool_())
        merged = letters.filter(mask).dictionary_encode()
        asked = pc.if_else(mask, rest, words).dictionary_encode()
        merged_ids, merged_sizes = self._merged(merged.dictionary)
        known = [self[w] for w in asked.dictionary.to_pylist()]
        ids = np.concatenate([merged_ids, np.frombuffer(b"".join(known), "<u4")])
        # The last entry has no ids: it stands for the letters of words that are asked whole.
        sizes = np.concatenate([merged_sizes, np.array([len(k) // 4 for k in known], np.int64), [0]])
        at = np.full((len(words), 2), len(sizes) - 1, np.int32)
        at[plain, 0] = merged.indices.to_numpy()
        at[:, 1] = asked.indices.to_numpy() + len(merged_sizes)
        return gather(ids, sizes, at.ravel())[0], sizes[at].sum(axis=1)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the different words of all of them are encoded once."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        ids, ends = gather(*self._distinct(words.dictionary), words.indices.to_numpy())
        flat = ids.tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]
        return [flat[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]
