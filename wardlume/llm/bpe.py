"""Byte-pair encoding by speculation and verification, vectorised with numpy; runs inside Spark tasks.

1. Pre-tokens are cut for a whole batch of texts at once, from an array of character classes.
2. Each distinct word of the batch is proposed as a sequence of greedy longest vocabulary matches.
3. Every adjacent pair of proposed tokens is tested at once: a pair is compatible when undoing both tokens' merges,
   latest first, never uncovers a merge across the boundary that would have come earlier. A sequence of
   pairwise compatible tokens is the encoding.
4. Only words with an incompatible pair are merged exactly.

Words already encoded by this worker are remembered up to a fixed number of words.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata

import numpy as np

U = np.uint64
NONE = np.int64(1 << 40)
#: Characters worked on at once, and words remembered by a worker.
CHUNK_CHARS, MEMORY_WORDS = 1_200_000, 1_000_000
#: A longer failing word is merged with a queue instead of a matrix.
MATRIX_SYMBOLS = 48

OTHER, SPACE, LETTER, NUMBER = range(4)
#: The code points with the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: English contractions that both pre-tokenizers split off.
SHORT, LONG = "stmd", ("re", "ve", "ll")

BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, U(base))
    p[0] = 1
    return np.cumprod(p)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    return _powers(int(BASE), size)[:n], _powers(int(UNBASE), size)[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span; equal spans at different places agree."""
    p, q = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[:-1], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its class, its lower case, a random-looking 64-bit value."""
    top = sys.maxunicode + 1
    kinds = np.zeros(top, np.uint8)
    lower = np.arange(top, dtype=np.uint32)
    for c in range(top):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kinds[c] = LETTER
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        elif k[0] == "N":
            kinds[c] = NUMBER
        if k[0] in "NS" and len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    kinds[WHITE] = SPACE
    return kinds, lower, mix(np.arange(1, top + 1, dtype=U) * BASE)


class Lookup:
    """A fixed map from 64-bit keys to numbers: a direct table, and a sorted list for keys that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = U(64 - max(8, int(len(keys) * 8).bit_length()))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        keys, values, slot = keys[order], values[order], slot[order]
        first = np.ones(len(keys), bool)
        first[1:] = slot[1:] != slot[:-1]
        self.keys = np.zeros(1 << (64 - int(self.bits)), U)
        self.values = np.full(len(self.keys), NONE, np.int64)
        self.more = np.zeros(len(self.keys), bool)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        self.more[slot[~first]] = True
        by = np.argsort(keys[~first])
        self.rest, self.rest_values = keys[~first][by], values[~first][by]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0xD6E8FEB86659FD93)) >> self.bits).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if keys.ndim > 1:
            return self(keys.ravel()).reshape(keys.shape)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        again = np.flatnonzero((out == NONE) & self.more[slot])
        if len(again) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[again]), len(self.rest) - 1)
            out[again] = np.where(self.rest[at] == keys[again], self.rest_values[at], NONE)
        return out


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file, and its encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.folded = spec.get("normalizer") is not None  # lower case, white space dropped
        self.joined_by_space = spec.get("decoder") is None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[p[0] + p[1]] for p in pairs], np.int64)
        # of several merges that make one token the first one counts
        for k in range(len(pairs) - 1, -1, -1):
            self.rank[made[k]], self.left[made[k]], self.right[made[k]] = k, a[k], b[k]
        self._pairs = Lookup(a.astype(U) << U(32) | b.astype(U), np.arange(len(pairs)))
        self.made = made
        letters = byte_letters()
        bytes_of = {c: i for i, c in enumerate(letters)}
        self.byte = np.array([vocab[c] for c in letters], np.int64)
        self.last_byte = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        # a token takes part in the proposals if its own string encodes to it
        own = made[self._compatible(self.left[made], self.right[made], self.rank[made])]
        ids = np.concatenate([self.byte, self.last_byte, own])
        raw: dict[bool, tuple[list[bytes], list[int]]] = {False: ([], []), True: ([], [])}
        for i in np.unique(ids):
            s = self.strings[i]
            ends = bool(self.suffix) and s.endswith(self.suffix)
            body = s[: len(s) - len(self.suffix)] if ends else s
            raw[ends][0].append(bytes(bytes_of[c] for c in body))
            raw[ends][1].append(int(i))
        self._values = mix(np.arange(1, 257, dtype=U) * BASE)
        self.longest = max(len(x) for k in raw for x in raw[k][0])
        self._inner, self._final = (self._strings_lookup(*raw[k]) for k in (False, bool(self.suffix)))
        self._known = np.empty(0, U)
        self._known_at = np.empty(0, np.int64)
        self._reset()

    def _strings_lookup(self, words: list[bytes], ids: list[int]) -> Lookup:
        ends = np.cumsum([len(w) for w in words])
        flat = self._values[np.frombuffer(b"".join(words), np.uint8)]
        return Lookup(span_hashes(flat, ends - [len(w) for w in words], ends), np.array(ids, np.int64))

    def _reset(self) -> None:
        self._known, self._known_at = np.empty(0, U), np.empty(0, np.int64)
        self._ids, self._offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair whether [a, b] is the encoding of its own string (up to the merge of rank limit)."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NONE) if limit is None else limit
        while len(live):
            crossing = self._pairs(a.astype(U) << U(32) | b.astype(U)) < limit
            ok[live[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossing & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def _proposed(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of every word: (word, token) in order of word and place."""
        p, q = powers(len(flat) + 1)
        total = np.zeros(len(flat) + 1, U)
        np.cumsum(self._values[flat] * p[:-1], out=total[1:])
        words, tokens, places = [], [], []
        word, at, step = np.arange(len(start)), start.copy(), 0
        while len(word):
            token, size = np.full(len(word), NONE), np.minimum(end[word] - at, self.longest)
            todo = np.arange(len(word))
            while len(todo):
                s, n = at[todo], size[todo]
                h = mix((total[s + n] - total[s]) * q[s] + n.astype(U))
                final = s + n == end[word[todo]]
                found = np.empty(len(todo), np.int64)
                found[final], found[~final] = self._final(h[final]), self._inner(h[~final])
                token[todo] = found
                todo = todo[found == NONE]
                size[todo] -= 1
            words.append(word), tokens.append(token), places.append(np.full(len(word), step))
            at = at + size
            on = at < end[word]
            word, at, step = word[on], at[on], step + 1
        word, token, place = map(np.concatenate, (words, tokens, places))
        order = np.lexsort((place, word))
        return word[order], token[order]

    def _merged(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of symbols[start : start + size], flat, and their lengths.

        The lowest merge goes first, the leftmost of equals; words of like length are merged side by side.
        """
        owners, tokens, low = [], [], 1
        for high in (5, 7, 9, 11, 14, 18, 26, MATRIX_SYMBOLS):
            pick = np.flatnonzero((size >= low) & (size <= high))
            low = high + 1
            if not len(pick):
                continue
            columns = np.arange(high)
            inside = columns[None, :] < size[pick][:, None]
            g = np.full((len(pick), high + 1), -1, np.int64)
            g[:, :-1][inside] = symbols[(start[pick][:, None] + columns)[inside]]
            ranks = self._pairs((g[:, :-1].astype(U) << U(32)) | (g[:, 1:].astype(U) & U(0xFFFFFFFF)))
            while len(pick):
                row = np.arange(len(pick))
                where = ranks.argmin(1)
                best = ranks[row, where]
                over = best == NONE
                if over.any():
                    rest = g[over]
                    owners.append(np.repeat(pick[over], (rest >= 0).sum(1)))
                    tokens.append(rest[rest >= 0])
                    on = ~over
                    pick, g, ranks, where, best = pick[on], g[on], ranks[on], where[on], best[on]
                    row = row[: len(pick)]
                if not len(pick):
                    break
                late = columns[None, :] > where[:, None]
                g[:, :-1] = np.where(late, g[:, 1:], g[:, :-1])
                g[:, -1] = -1
                g[row, where] = self.made[best]
                ranks[:, :-1] = np.where(late[:, :-1], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NONE
                # only the two pairs beside the new token have changed
                ranks[row, where] = self._pairs((g[row, where].astype(U) << U(32)) | (g[row, where + 1].astype(U) & U(0xFFFFFFFF)))
                before = np.maximum(where - 1, 0)
                ranks[row, before] = np.where(where > 0, self._pairs((g[row, before].astype(U) << U(32)) | (g[row, before + 1].astype(U) & U(0xFFFFFFFF))), ranks[row, before])
        for w in np.flatnonzero(size > MATRIX_SYMBOLS):
            done = self._merged_long(symbols[start[w] : start[w] + size[w]])
            owners.append(np.full(len(done), w))
            tokens.append(done)
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))

    def _merged_long(self, symbols: np.ndarray) -> np.ndarray:
        ids = symbols.tolist()
        n = len(ids)
        ranks = self._pairs((symbols[:-1].astype(U) << U(32)) | symbols[1:].astype(U)).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = int(NONE)
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    q = int(self._pairs(np.array([ids[x] << 32 | ids[y]], U))[0])
                    if q < none:
                        heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([t for t in ids if t >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word's ids end."""
        sizes = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = end - sizes
        word, token = self._proposed(flat, start, end)
        inside = word[1:] == word[:-1]
        at = np.flatnonzero(inside)
        # a pair that many words share is tested once
        pairs, back = np.unique(token[at] << 32 | token[at + 1], return_inverse=True)
        fails = np.zeros(len(words), bool)
        fails[word[at[~self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        counts = np.bincount(word, minlength=len(words))
        if fails.any():
            symbols = self.byte[flat]
            symbols[end - 1] = self.last_byte[flat[end - 1]]
            exact, exact_counts = self._merged(symbols, start[fails], sizes[fails])
            counts[fails] = exact_counts
            out = np.empty(counts.sum(), np.int64)
            is_exact = np.repeat(fails, counts)
            out[is_exact], out[~is_exact] = exact, token[~fails[word]]
            token = out
        return token.astype(np.int32), np.cumsum(counts)

    def _cut(self, cps: np.ndarray, kinds: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens [start, end) of the joined texts; doc_starts: first characters of the texts that have any."""
        n = len(cps)
        first = np.zeros(n + 1, bool)
        first[doc_starts] = True
        first[n] = True
        starts = first.copy()
        starts[1:n] |= kinds[1:] != kinds[:-1]
        runs = starts.copy()
        white = kinds == SPACE
        if self.folded:
            starts[:n] |= kinds == NUMBER
        else:
            # a white run before a word gives its last character away: a space joins the word, others stand alone
            last = np.flatnonzero(white & ~np.append(white[1:], False) & ~first[1:])
            starts[last] = True
            joins = last[cps[last] == 32]
            starts[joins + 1] = False
        mark = np.flatnonzero((cps[:-1] == 39) & runs[: n - 1] & starts[: n - 1] & (kinds[1:] == LETTER) & ~first[1:n]) if n > 1 else []
        if len(mark):
            one = np.isin(cps[mark + 1], [ord(c) for c in SHORT])
            beyond = np.minimum(mark + 2, n - 1)
            two = np.zeros(len(mark), bool)
            for x in LONG:
                two |= (cps[mark + 1] == ord(x[0])) & (cps[beyond] == ord(x[1]))
            two &= (mark + 2 < n) & ~first[beyond] & ~one
            mark, size = mark[one | two], np.where(two, 3, 2)[one | two]
            starts[mark + 1] = False
            starts[mark + size] = True
        begin = np.flatnonzero(starts[:n])
        end = np.append(begin[1:], n)
        if self.folded:
            keep = ~white[begin]
            begin, end = begin[keep], end[keep]
            # the last word of a run of words ends where white space starts: ends come from the next start
        return begin, end

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds_of, lower, values = characters()
        sizes = np.array([len(t) for t in texts], np.int64)
        text = "".join(texts)
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.folded:
            cps = lower[cps]
        ends = np.cumsum(sizes)
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        begin, end = self._cut(cps, kinds_of[cps], (ends - sizes)[sizes > 0])
        hashes = span_hashes(values[cps], begin, end)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, unique)
        at[at == len(self._known)] = 0
        new = self._known[at] != unique if len(self._known) else np.ones(len(unique), bool)
        if new.any():
            if len(self._known) + new.sum() > MEMORY_WORDS:
                self._reset()
                new = np.ones(len(unique), bool)
            if self.folded:
                text = cps.tobytes().decode("utf-32-le", "surrogatepass")
            i = where[new]
            fresh = [text[a:b].encode("utf-8", "replace") for a, b in zip(begin[i].tolist(), end[i].tolist(), strict=True)]
            ids, stops = self.encode_words(fresh)
            base = len(self._offsets) - 1
            self._ids = np.concatenate([self._ids, ids])
            self._offsets = np.concatenate([self._offsets, self._offsets[-1] + stops])
            place = np.searchsorted(self._known, unique[new])
            self._known_at = np.insert(self._known_at, place, np.arange(base, base + len(fresh)))
            self._known = np.insert(self._known, place, unique[new])
            at = np.searchsorted(self._known, unique)
        row = self._known_at[at][inverse]
        a, counts = self._offsets[row], self._offsets[row + 1] - self._offsets[row]
        stop = np.cumsum(counts)
        total = int(stop[-1]) if len(stop) else 0
        flat = self._ids[np.repeat(a - (stop - counts), counts) + np.arange(total)]
        of = np.searchsorted(ends, begin, side="right")
        return flat, np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, and how many each has. Strings of special tokens become their ids."""
        parts: list[str] = []
        layout: list[list[int | tuple[int]]] | None = None
        if self._special and any("<|" in t and self._special.search(t) for t in texts):
            layout = []
            for t in texts:
                row, at = [], 0
                for m in self._special.finditer(t):
                    row += [len(parts), (self.special[m.group()],)]
                    parts.append(t[at : m.start()])
                    at = m.end()
                row.append(len(parts))
                parts.append(t[at:])
                layout.append(row)
        else:
            parts = texts
        if self.folded:
            parts = [t if t.isascii() else (t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("İ", "i̇") for t in parts]
        flats, counts, chunk, size = [], [], [], 0
        for t in parts:
            chunk.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                f, c = self._encode_chunk(chunk)
                flats.append(f), counts.append(c)
                chunk, size = [], 0
        if chunk:
            f, c = self._encode_chunk(chunk)
            flats.append(f), counts.append(c)
        flat = np.concatenate(flats) if flats else np.empty(0, np.int32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if layout is None:
            return flat, count
        piece = np.split(flat, np.cumsum(count)[:-1])
        rows = [np.concatenate([np.array(x, np.int32) if isinstance(x, tuple) else piece[x] for x in row]) for row in layout]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included: tokens joined by spaces where the file names no decoder."""
        if self.joined_by_space:
            return " ".join([self.strings[i] for i in ids.tolist()])
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = b"".join(bytes(back.get(c, 32) for c in self.strings[i]) if i not in self.special.values() else self.strings[i].encode() for i in ids.tolist())
        return raw.decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    """One encoder for each file and worker process."""
    return Bpe(path)
