"""Tokens of vocabularies whose pre-tokenizer drops white space, so that each word of a text is encoded alone."""

from __future__ import annotations

import os

import numpy as np

from .bpe import Encoder
from .words import SHORT, Texts, span_codes

TOGETHER = 64  # unseen words that go to the library as one text


class WordEncoder(Encoder):
    """Encodes texts word by word (what ASCII white space separates); words' tokens are cached and unseen words go to the tokenizers library.

    Fits tokenizer files that turn white space into word bounds and whose added tokens have none in them: neither a token, nor a
    normal form, nor a lower-case form then reaches over white space. A hit is always the very word.
    """

    def __init__(self, path: str, cache_pieces: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def encode_new(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Some words at a time, with spaces between them; a token's offset tells whose it is."""
            counts, parts = np.zeros(len(words), np.int64), []
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            texts = [" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
            for at, e in zip(range(0, len(words), TOGETHER), library.encode_batch(texts, add_special_tokens=False), strict=True):
                starts = np.cumsum(size[at : at + TOGETHER]) - size[at : at + TOGETHER]
                places = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
                counts[at : at + TOGETHER] = np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=starts.size)
                parts.append(np.array(e.ids, np.int32))
            return np.concatenate(parts), counts

        self.encode_new, self.cache_pieces, self.added = encode_new, cache_pieces, []
        self.clear()

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.cache_pieces or self.used > 16 * self.cache_pieces:
            self.clear()
        t = Texts(data, offsets)
        if not t.starts.size:
            return np.zeros(0, np.int32), np.zeros(offsets.size, np.int64)
        size, raw = t.ends - t.starts, data.tobytes()
        at = np.empty(size.size, np.int64)
        short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
        at[short] = self.cache.get(*span_codes(data, t.starts[short], t.ends[short]))
        at[long] = [self.long.get(raw[a:b], -1) for a, b in zip(t.starts[long].tolist(), t.ends[long].tolist(), strict=True)]
        missing = np.flatnonzero(at < 0)
        if missing.size:
            words = [raw[a:b] for a, b in zip(t.starts[missing].tolist(), t.ends[missing].tolist(), strict=True)]
            number = {w: self.known + i for i, w in enumerate(dict.fromkeys(words))}
            self._add(list(number))
            at[missing] = [number[w] for w in words]
        counts = self.length[at]
        stops = np.cumsum(counts, dtype=np.int64)
        flat = self.flat[np.repeat(self.start[at] - stops + counts, counts) + np.arange(stops[-1])]
        return flat, np.concatenate([[0], stops])[t.first]


_loaded: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This Python worker's encoder of a file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
