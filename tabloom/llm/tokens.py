"""Token ids of whole texts by a public tokenizer file, with the ids of pieces of words kept between texts.

The tokenizer never joins what white space divides, nor an ASCII letter or digit with ASCII punctuation other than an
apostrophe, so a text is cut there and each different piece is encoded once by the tokenizers library. Pieces are told
apart by a 64-bit hash and their length. A text with a control string of the tokenizer (`<|`) is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
from tokenizers import Tokenizer

from tabloom.llm.shingles import hash_spans, slices

#: Different pieces that are kept; beyond, all are forgotten and learnt anew.
KEPT = 1_500_000
#: Bytes of text that are worked on at once; all kept pieces are sorted again where such a run brings new ones.
RUN_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 ASCII letter or digit, 2 ASCII punctuation without apostrophe, 3 anything else
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _c in range(33, 127):
    _KIND[_c] = 1 if chr(_c).isalnum() else 2
_KIND[39] = 3


class TokenCache:
    """Encoder for a tokenizer file whose words end in a marked token and whose pieces don't cross white space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pieces, length in ids of each in that order, and all ids. Plain words are encoded many in one text
        and told apart by their end tokens."""
        plain = [k for k, p in enumerate(pieces) if p.isalpha() and (p.isascii() or normalize("NFC", p).lower().isalpha())]
        runs = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        texts = ["\n".join([pieces[k] for k in run]) for run in runs]
        order, lengths, flat = [], [], []
        for run, encoded in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype=np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(run):
                order += run
                lengths.append(np.diff(cut, prepend=0))
                flat.append(ids)
        done = set(order)
        rest = [k for k in range(len(pieces)) if k not in done]
        for encoded in self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False):
            lengths.append(np.array([len(encoded.ids)]))
            flat.append(np.array(encoded.ids, dtype=np.uint32))
        return np.array(order + rest, dtype=np.int64), np.concatenate(lengths), np.concatenate(flat)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        order, length, ids = self._encode(pieces)
        begin = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, ids])
        sorting = np.argsort(all_keys := np.concatenate([self.keys, keys[order]]), kind="stable")
        self.keys = all_keys[sorting]
        self.begin = np.concatenate([self.begin, begin])[sorting]
        self.length = np.concatenate([self.length, length])[sorting]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def _run(self, run: list[bytes]) -> Iterator[np.ndarray]:
        sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
        joined = b"\n".join(run) + b"\n"
        data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
        kind = _KIND[data]
        before = np.concatenate([np.zeros(1, dtype=np.int8), kind[:-1]])
        split = (before == 0) | (before * kind == 2)
        begin = np.flatnonzero(split & (kind > 0))
        stop = (kind == 0) | (before * kind == 2)
        end = np.flatnonzero(stop & (before > 0))
        hashes = hash_spans(data, begin, end)
        hashes ^= (end - begin).astype(np.uint64)
        keys, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        _, known = self._places(keys)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > KEPT:
                self._forget()
                known[:] = False
            new = first[~known]
            lowered = data.tobytes()
            texts = [lowered[b:e].decode("utf-8", "replace") for b, e in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            self._learn(keys[~known], texts)
        place, _ = self._places(keys)
        length = self.length[place][each]
        start = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.flat[np.repeat(self.begin[place][each] - start, length) + np.arange(total)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(begin, np.cumsum(sizes + 1))]
        at = 0
        for text, stop_at in zip(run, ends.tolist(), strict=True):
            if b"<|" in text:
                whole = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
                yield np.array(whole.ids, dtype=np.uint32)
            else:
                yield ids[at:stop_at]
            at = stop_at

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; a null is empty."""
        for run in slices(texts, RUN_BYTES):
            yield from self._run(run)


_CACHES: dict[str, TokenCache] = {}


def token_cache(path: str) -> TokenCache:
    """The encoder of this worker process, kept from task to task."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]
