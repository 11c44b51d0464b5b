"""Exact ids of a public ``tokenizers`` file, with each distinct word encoded once."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import as_text, coded_words, starts_of, word_hashes


def vocabulary(name_or_path: str) -> str:
    """A path as given, or the place of a public file of that name."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_letters() -> dict[int, str]:
    """The names that byte-level models give to the UTF-8 bytes of the letters above ASCII, capitals being lower-cased.

    A byte that prints stands for itself; the others are named from 256 on, in order.
    """
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    odd = [b for b in range(256) if b not in prints]
    name = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(odd)}
    small = {c: "".join(name[b] for b in chr(c).encode()) for c in [*range(0xDF, 0xF7), *range(0xF8, 0x100)]}
    return small | {c: small[c + 32] for c in [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]}


class Index:
    """Numbers 64-bit keys in the order they come: an open-addressed table of arrays."""

    def __init__(self):
        self.keys, self.n = np.zeros(1 << 14, np.uint64), 0
        self._spread(15)

    def _spread(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self._place(np.arange(self.n, dtype=np.int32))

    def _place(self, numbers: np.ndarray) -> None:
        at = (self.keys[numbers] >> self.shift).view(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key, -1 where it has none."""
        at = (keys >> self.shift).view(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slots[at]
            out[todo] = got
            more = (got >= 0) & (self.keys[got] != keys[todo])
            todo, at = todo[more], at[more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that have no number yet."""
        upto = self.n + len(keys)
        if upto > len(self.keys):
            more = np.zeros(1 << upto.bit_length(), np.uint64)
            more[: self.n] = self.keys[: self.n]
            self.keys = more
        self.keys[self.n : upto] = keys
        old, self.n = self.n, upto
        if 2 * upto > len(self.slots):
            self._spread((2 * upto).bit_length())
        else:
            self._place(np.arange(old, upto, dtype=np.int32))


class WordEncoder:
    """Encodes whole texts by way of their words.

    Valid for the tokenizer of word_bpe_49k.json: it lower-cases, its pre-tokens
    never hold white space, and a run of letters never shares a pre-token with
    the punctuation after it (tests compare with the library on whole texts).
    The library encodes each distinct word once and the ids are gathered; plain
    words go to its model directly, being one pre-token each.  Words are known
    by 64-bit hashes, so the cache is a few arrays; it is emptied at
    ``most_words`` words or 16 times as many ids, so memory stays bounded.
    """

    #: Words of these letters are one pre-token each.
    PLAIN = r"^[a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"

    def __init__(self, file: str, most_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary(file))
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.vocab_size <= 1 << 16 else np.uint32
        self.letters = byte_letters()
        self.most = most_words
        self._clear()

    def _clear(self) -> None:
        self.known = Index()
        self.ids = np.zeros(1 << 16, self.kind)
        self.at = np.zeros(1 << 15, np.int32)  # where the ids of every word begin; its last entry is where those of the last end

    def _keep(self, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        k, used = self.known.n, int(self.at[self.known.n])
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 1 << (used + len(ids)).bit_length())
        if k + len(keys) >= len(self.at):
            self.at = np.resize(self.at, 1 << (k + len(keys) + 1).bit_length())
        self.ids[used : used + len(ids)] = ids
        self.at[k : k + len(keys) + 1] = used + starts_of(lens)
        self.known.add(keys)

    def _add(self, words: pa.Array, keys: np.ndarray) -> None:
        plain = pc.match_substring_regex(words, self.PLAIN)
        easy = plain.to_numpy(zero_copy_only=False)
        tokenize, letters = self.tok.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w if w.isascii() else w.translate(letters))] for w in words.filter(plain).to_pylist()]
        found += [e.ids for e in self.tok.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(np.concatenate([keys[easy], keys[~easy]]), lens, np.fromiter(chain.from_iterable(found), self.kind, int(lens.sum())))

    def _even(self, texts: pa.Array) -> pa.Array:
        """The texts with fewer distinct words and the same ids."""
        special = pc.match_substring(texts, "<|")  # specials are matched before lower-casing
        low = pc.if_else(special, texts, pc.ascii_lower(texts))
        return pc.replace_substring_regex(low, pattern=r'(\pL)([.,!?;:*%&$#)\]}"]+)([ \t-\r]|$)', replacement=r"\1 \2\3")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every text, and all ids one after the other."""
        lens, codes, words = coded_words(self._even(as_text(texts)))
        keys = word_hashes(words)
        if self.known.n > self.most or self.at[self.known.n] > 16 * self.most:
            self._clear()
        place = self.known.find(keys)
        new = place < 0
        if new.any():
            self._add(words.filter(pa.array(new)), keys[new])
            place[new] = self.known.find(keys[new])
        first, n = self.at[place], (self.at[place + 1] - self.at[place])[codes]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = first[codes] - (ends - n)
        ids = self.ids[np.repeat(shift, n) + np.arange(total)]
        return np.diff(np.concatenate([[0], ends])[starts_of(lens)]), ids


_kept: dict[str, WordEncoder] = {}


def kept_encoder(file: str) -> WordEncoder:
    """The encoder of this process for a file: words that one task has met are known to the next."""
    if file not in _kept:
        _kept.clear()  # one at a time
        _kept[file] = WordEncoder(file)
    return _kept[file]
