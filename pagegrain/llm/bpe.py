"""Byte-level BPE: speculate and verify.

Text is cut at places where no token can cross (before a space that a non-space follows).
The pieces are encoded once and kept in a bounded cache. Of a new piece, each word (by the
tokenizer's own split pattern) is cut greedily into longest vocabulary entries. A cut is what
merging would give exactly if every adjacent pair of tokens would stay as it is when
only that pair were merged from bytes; all pairs of all new words are tested together in
numpy. Words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex

from .words import SHORT, joined, span_codes, utf8

#: The split pattern of byte-level tokenizer files with use_regex. White space is
#: Unicode White_Space, as in the library; regex's own \s also takes U+001C to U+001F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

NEVER = np.iinfo(np.int64).max
LONG = 48


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


OTHER, LETTER, NUMBER, SPACE = range(4)
_kinds: list[np.ndarray] = []


def char_kinds() -> np.ndarray:
    """The split pattern's kind of every code point."""
    if not _kinds:
        kinds = np.full(0x110000, OTHER, np.uint8)
        codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
        every = codes.tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                kinds[codes[m.start() : m.end()]] = kind
        _kinds.append(kinds)
    return _kinds[0]


class Table:
    """A hash table from whole numbers to whole numbers, probed for many keys at once. Absent keys give -1."""

    def __init__(self, keys: list[int], values: list[int], bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for key, value, at in zip(keys, values, self._slot(np.array(keys, np.int64)).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while more.size:
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class Vocabulary:
    """A byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip or normalize are not supported")
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = [self.bytes_of.get(i, b"") for i in range(max([*self.bytes_of, *self.added.values()]) + 1)]
        for text, i in self.added.items():
            self.pieces[i] = text.encode()
        n = len(self.pieces)
        self.born = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (self.id_of[bytes(letters[c] for c in t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = (r, made)
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = r, a, b
        self.pairs = Table([(a << 24) | b for a, b in self.rank], [(r << 24) | made for r, made in self.rank.values()], 18)
        nodes, edges, accepts = {b"": 0}, {}, [-1]
        for word, token in self.id_of.items():
            for i in range(len(word)):
                if word[: i + 1] not in nodes:
                    nodes[word[: i + 1]] = len(accepts)
                    edges[nodes[word[:i]] << 8 | word[i]] = len(accepts)
                    accepts.append(-1)
            accepts[nodes[word]] = token
        self.trie, self.accepts = Table(list(edges), list(edges.values()), 20), np.array(accepts)
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)])
        self.lengths = np.array([len(p) for p in self.pieces])
        self.split = regex.compile(PATTERN)

    def greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words cut into longest vocabulary entries from the left: tokens and each one's word, in order.

        All words walk the trie of the vocabulary side by side, a byte a step; one that can't go on
        emits the last token it passed and starts again behind it.
        """
        word, at, stop = np.arange(starts.size), starts.copy(), ends
        node, token, behind = np.zeros(word.size, np.int64), np.full(word.size, -1), at.copy()
        made: list[tuple[np.ndarray, np.ndarray]] = []
        while word.size:
            inside = at < stop
            to = np.where(inside, self.trie.get((node << 8) | data[np.where(inside, at, 0)]), -1)
            go = to >= 0
            at = np.where(go, at + 1, behind)
            node = np.where(go, to, 0)
            accepted = np.where(go, self.accepts[node], -1)
            fresh = accepted >= 0
            if not go.all():
                made.append((word[~go], token[~go]))
            token, behind = np.where(fresh, accepted, token), np.where(fresh, at, behind)
            open_ = go | (at < stop)
            if not open_.all():
                word, at, stop, node, token, behind = (x[open_] for x in (word, at, stop, node, token, behind))
        if not made:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, tokens = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(words, kind="stable")
        return tokens[order], words[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging their joined bytes give just these two?

        Goes back in time from the finished pair. x and y are the pieces on the two sides of the
        joint, and x_gone and y_gone are the ranks of the merges that take them up on their own
        side. A merge across the joint happens if its rank comes before both (of equal ranks, the
        leftmost is first). Then the younger piece is undone.
        """
        ok = np.ones(a.size, bool)
        at, x, y = np.arange(a.size), a.astype(np.int64), b.astype(np.int64)
        x_gone, y_gone = np.full(a.size, NEVER), np.full(a.size, NEVER)
        while at.size:
            found = self.pairs.get((x << 24) | y)
            rank = np.where(found >= 0, found >> 24, NEVER)
            crossed = (rank < x_gone) & ((rank < y_gone) | ((rank == y_gone) & (rank != NEVER)))
            ok[at[crossed]] = False
            x_born, y_born = self.born[x], self.born[y]
            go = ~crossed & (np.maximum(x_born, y_born) >= 0)
            undo_x = x_born > y_born
            x_gone, y_gone = np.where(undo_x, x_born, x_gone)[go], np.where(undo_x, y_gone, y_born)[go]
            x, y, at = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go], at[go]
        return ok

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Exact merging of words up to LONG bytes: always the pair of lowest rank, leftmost first, a merge of each word a turn."""
        size = ends - starts
        width = int(size.max())
        column = np.arange(width)
        tokens = np.where(column < size[:, None], self.byte_ids[data[np.minimum(starts[:, None] + column, data.size - 1)]], -1)
        rank = self._ranks(tokens[:, :-1], tokens[:, 1:])
        out: list[list[int]] = [[]] * size.size
        word = np.arange(size.size)
        while word.size:
            i = rank.argmin(axis=1) if width > 1 else np.zeros(word.size, np.int64)
            low = rank[np.arange(word.size), i] if width > 1 else np.full(word.size, NEVER)
            done = low == NEVER
            if done.any():
                for w, t in zip(word[done].tolist(), tokens[done].tolist(), strict=True):
                    out[w] = [x for x in t if x >= 0]
                go = ~done
                word, tokens, rank, i, low = word[go], tokens[go], rank[go], i[go], low[go]
                if not word.size:
                    break
            rows = np.arange(word.size)
            tokens[rows, i] = low & 0xFFFFFF
            behind = column[:-1] > i[:, None]
            tokens[:, :-1] = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            tokens[:, -1] = -1
            rank[:, :-1] = np.where(behind[:, :-1] | (column[:-2] == i[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NEVER
            rank[rows, i] = self._ranks(tokens[rows, i], tokens[rows, np.minimum(i + 1, width - 1)])
            left = np.maximum(i - 1, 0)
            rank[rows, left] = np.where(i > 0, self._ranks(tokens[rows, left], tokens[rows, i]), rank[rows, left])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and product (rank << 24 | token) of pairs; NEVER where there is none."""
        a, b = np.broadcast_arrays(a, b)
        found = self.pairs.get(((a << 24) | b).ravel()).reshape(a.shape)
        return np.where((found >= 0) & (b >= 0), found, NEVER)

    def merged_long(self, word: np.ndarray) -> list[int]:
        """The same with a heap and linked neighbours, for words of any length."""
        tokens = self.byte_ids[word].tolist()
        n, rank = len(tokens), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (p := (tokens[left], tokens[after[left]])) in rank:
                    heapq.heappush(heap, (rank[p][0], left, *p))
        return [t for t in tokens if t >= 0]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy proposals, checked all at once; exact merging for words that fail. Tokens of all words, and counts."""
        size = ends - starts
        short = np.flatnonzero(size <= LONG)
        tokens, word = self.greedy(data, starts[short], ends[short])
        word = short[word]
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique((tokens[inside] << 24) | tokens[inside + 1], return_inverse=True)
        bad = np.zeros(size.size, bool)
        bad[word[inside[~self.compatible(pairs >> 24, pairs & 0xFFFFFF)[back]]]] = True
        good = ~bad[word]
        parts, of = [tokens[good]], [word[good]]
        failed = np.flatnonzero(bad)
        failed = failed[np.argsort(size[failed], kind="stable")]
        for some in np.array_split(failed, max(1, failed.size // 2048)):
            if some.size:
                exact = self.merged(data, starts[some], ends[some])
                parts.append(np.fromiter((t for w in exact for t in w), np.int64))
                of.append(np.repeat(some, [len(w) for w in exact]))
        for i in np.flatnonzero(size > LONG).tolist():
            exact = self.merged_long(data[starts[i] : ends[i]])
            parts.append(np.array(exact))
            of.append(np.full(len(exact), i))
        tokens, word = np.concatenate(parts), np.concatenate(of)
        return tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=size.size)

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces, and counts by piece.

        Within a piece without white space behind its first place and without apostrophes, words end where the kind
        of character changes (a space in front goes with what follows). The pattern cuts the others.
        """
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        starts = ends - size
        kinds = char_kinds()[chars]
        piece = np.repeat(np.arange(len(texts)), size)
        odd = (kinds == SPACE) | (chars == 0x27)
        led = starts[(size > 1) & (chars[np.minimum(starts, max(0, chars.size - 1))] == 0x20)]
        odd[led] = False
        plain = np.ones(len(texts), bool)
        plain[piece[odd]] = False
        cut = np.ones(chars.size, bool)
        cut[1:] = kinds[1:] != kinds[:-1]
        cut[starts] = True
        cut[led + 1] = False
        where = np.flatnonzero(cut & plain[piece])
        width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width)])
        last = np.append(where[1:], chars.size)
        last = np.minimum(last, ends[piece[where]])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        tokens, counts = self.encode_words(data, place[where], place[last])
        of = np.repeat(piece[where], counts)
        if not plain.all():
            rest = [(i, w.encode()) for i in np.flatnonzero(~plain).tolist() for w in self.split.findall(texts[i])]
            size = np.fromiter((len(w) for _, w in rest), np.int64, len(rest))
            more, counts = self.encode_words(np.frombuffer(b"".join(w for _, w in rest), np.uint8), np.cumsum(size) - size, np.cumsum(size))
            tokens, of = np.concatenate([tokens, more]), np.concatenate([of, np.repeat([i for i, _ in rest], counts)])
            tokens, of = tokens[np.argsort(of, kind="stable")], np.sort(of)
        return tokens, np.bincount(of, minlength=len(texts))

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; ids out of range raise."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class Cache:
    """From codes of 128 bits to whole numbers; open addressing, probed and filled for many codes at once. High halves are never 0."""

    def __init__(self, bits: int = 16) -> None:
        self.size, self.bits = 0, bits
        self.low, self.high, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (joined(low, high) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, self.values[slot], -1).astype(np.int64)
        more = np.flatnonzero(~hit & (there != 0))
        while more.size:
            slot[more] = (slot[more] + 1) & (self.high.size - 1)
            there = self.high[slot[more]]
            hit = (there == high[more]) & (self.low[slot[more]] == low[more])
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (there != 0)]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
        """New, distinct codes and their numbers."""
        while 2 * (self.size + low.size) > self.high.size:
            old = np.flatnonzero(self.high)
            was = self.low[old], self.high[old], self.values[old]
            self.__init__(self.bits + 1)
            self._put(*was)
            self.size = old.size
        self._put(low, high, values.astype(np.int32))
        self.size += low.size

    def _put(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
        slot = self._slot(low, high)
        while low.size:
            free = np.flatnonzero(self.high[slot] == 0)
            taken = np.unique(slot[free], return_index=True)[1]  # of several for one slot, the first
            won = free[taken]
            self.low[slot[won]], self.high[slot[won]], self.values[slot[won]] = low[won], high[won], values[won]
            left = np.ones(low.size, bool)
            left[won] = False
            low, high, values, slot = low[left], high[left], values[left], (slot[left] + 1) & (self.high.size - 1)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their tokens: at their starts, and before each space that a non-space of the same text follows."""
    at = np.flatnonzero(data[:-1] == 0x20)
    follows = data[at + 1]
    blank = (follows == 0x20) | ((follows >= 0x09) & (follows <= 0x0D))
    wide = np.flatnonzero(np.isin(follows, _WIDE_FIRST))
    if wide.size:
        raw = data.tobytes()
        blank[wide] = [raw.startswith(_WIDE, i) for i in (at[wide] + 1).tolist()]
    cut = np.zeros(data.size, bool)
    cut[at[~blank]] = True
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[starts[starts > 0] - 1] = False
    cut[starts] = True
    return np.flatnonzero(cut)


_WIDE = tuple(c.encode() for c in SPACES if ord(c) > 0x7F)
_WIDE_FIRST = np.array(sorted({c[0] for c in _WIDE}), np.uint8)


class Encoder:
    """Encodes texts piece by piece; pieces' tokens are cached. ``encode_new`` encodes unseen pieces.

    A hit is always the very piece: up to SHORT bytes, a piece's code is its bytes, and longer ones are looked up by their
    bytes. A cache of more pieces or ids than its bounds is emptied.
    """

    def __init__(self, vocabulary: Vocabulary, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None, cache_pieces: int = 1_000_000) -> None:
        self.v, self.encode_new, self.cache_pieces = vocabulary, encode_new or vocabulary.encode_pieces, cache_pieces
        self.added = [a.encode() for a in vocabulary.added]
        self.clear()

    def clear(self) -> None:
        self.cache = Cache()
        self.long: dict[bytes, int] = {}
        self.flat, self.used, self.known = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, pieces: list[bytes]) -> None:
        """Encodes new, distinct pieces; they get the next numbers."""
        ids, counts = self.encode_new([p.decode() for p in pieces])
        n = self.known
        while self.used + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + counts.size > self.start.size:
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + ids.size] = ids
        self.start[n : n + counts.size] = self.used + np.cumsum(counts) - counts
        self.length[n : n + counts.size] = counts
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        short = np.flatnonzero(size <= SHORT)
        self.cache.add(*span_codes(np.frombuffer(b"".join(pieces), np.uint8), (ends - size)[short], ends[short]), n + short)
        self.long.update((pieces[i], n + i) for i in np.flatnonzero(size > SHORT).tolist())
        self.used, self.known = self.used + ids.size, n + counts.size

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts without added tokens, and their bounds."""
        if not data.size:
            return np.zeros(0, np.int32), np.zeros(offsets.size, np.int64)
        if self.known > self.cache_pieces or self.used > 16 * self.cache_pieces:
            self.clear()
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], data.size)
        raw = data.tobytes()
        at = np.empty(starts.size, np.int64)
        short = np.flatnonzero(ends - starts <= SHORT)
        at[short] = self.cache.get(*span_codes(data, starts[short], ends[short]))
        long = np.flatnonzero(ends - starts > SHORT)
        at[long] = [self.long.get(raw[a:b], -1) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        missing = np.flatnonzero(at < 0)
        if missing.size:
            pieces = [raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            number = {p: self.known + i for i, p in enumerate(dict.fromkeys(pieces))}
            self._add(list(number))
            at[missing] = [number[p] for p in pieces]
        counts = self.length[at]
        stops = np.cumsum(counts, dtype=np.int64)
        flat = self.flat[np.repeat(self.start[at] - stops + counts, counts) + np.arange(stops[-1])]
        return flat, np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another (null: none), with added tokens found in them, and each text's bounds."""
        data, offsets = utf8(texts)
        raw = data.tobytes() if self.added else b""
        if not any(a in raw for a in self.added):
            return self._plain(data, offsets)
        parts, text, token = [], [], []
        for i, t in enumerate(texts.to_pylist()):
            for k, p in enumerate(self.v.added_split.split(t or "")):
                parts.append("" if k % 2 else p)
                text.append(i)
                token.append(self.v.added[p] if k % 2 else -1)
        flat, bounds = self._plain(*utf8(pa.array(parts, pa.string())))
        text, token = np.array(text), np.array(token)
        special = np.flatnonzero(token >= 0)
        counts = np.bincount(text, np.diff(bounds) + (token >= 0), minlength=len(texts)).astype(np.int64)
        return np.insert(flat, bounds[special], token[special]), np.concatenate([[0], np.cumsum(counts)])

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, bounds = self.encode(pa.array(texts, pa.string()))
        return np.split(flat, bounds[1:-1])


_loaded: dict[tuple[str, str], Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """This Python worker's encoder of a file: speculate and verify. Its cache is small, as other steps go on in the same worker."""
    if (key := ("own", path)) not in _loaded:
        _loaded[key] = Encoder(Vocabulary(path), cache_pieces=250_000)
    return _loaded[key]


def library_encoder(path: str) -> Encoder:
    """This Python worker's encoder whose unseen pieces the tokenizers library encodes."""
    if (key := ("library", path)) not in _loaded:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True  # the encoder has cut them out
        v = Vocabulary(path)

        def encode_new(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All pieces that start with a space as one text, as no token crosses their bounds; token lengths tell whose they are."""
            spaced = np.fromiter((p[0] == " " and p[1:2] not in SPACES for p in new), bool, len(new))
            parts, of = [], []
            rows = np.flatnonzero(spaced)
            if rows.size:
                ids = np.array(t.encode_batch_fast(["".join(new[i] for i in rows.tolist())], add_special_tokens=False)[0].ids)
                stops = np.cumsum([len(new[i].encode()) for i in rows.tolist()])
                parts.append(ids)
                of.append(rows[np.searchsorted(stops, np.cumsum(v.lengths[ids]))])
            rows = np.flatnonzero(~spaced)
            for i, e in zip(rows.tolist(), t.encode_batch_fast([new[i] for i in rows.tolist()], add_special_tokens=False), strict=True):
                parts.append(np.array(e.ids, np.int64))
                of.append(np.full(len(e.ids), i))
            tokens, piece = np.concatenate(parts), np.concatenate(of)
            return tokens[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(new))

        _loaded[key] = Encoder(v, encode_new)
    return _loaded[key]
