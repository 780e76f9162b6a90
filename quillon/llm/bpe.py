"""Byte-pair encoding by speculate and verify.

A word's encoding is first guessed by greedy longest match. A guess is right exactly if no merge
would have happened across any boundary of two neighbouring tokens, which is a property of the
pair alone. All pairs of a batch are tested at once in numpy; only words with a failing pair are
merged step by step. Results are kept per chunk of text in a two-generation cache, bounded by entries and characters.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex

_FAR = 1 << 40
_NEVER = np.int64(_FAR)
#: Characters of text that are cut into chunks at once.
BLOCK_CHARS = 1 << 20


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + k)] = b
    return table


class MergeTable:
    """Vocabulary and merges of one tokenizer file; a symbol is one character: a byte, or 256 + a word's last byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = _byte_characters()

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = [chars[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256) if ends else "".join(map(chr, raw))

        self.vocab = {symbols(t): i for t, i in model["vocab"].items()}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank_of: dict[int, int] = {}
        #: The id that the merge of a rank makes.
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, new = model["vocab"][x], model["vocab"][y], self.vocab[symbols(x) + symbols(y)]
            self.rank_of[a * size + b] = r
            self.made.append(new)
            self.rank[new], self.left[new], self.right[new] = r, a, b
        keys = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(self.rank_of.values(), np.int64, len(keys))[order]
        #: Bytes of every id, for decoding.
        self.bytes = [b""] * size
        for s, i in self.vocab.items():
            self.bytes[i] = bytes(ord(c) & 255 for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self._reachable()

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair: would encoding both strings together give just these two tokens?

        Walks back in time from the finished pair. The symbol made last is taken apart first (of two made
        by one rule the right one is the later); each pair met on the way was adjacent until then, so a
        merge of a lower rank would have joined it. A right symbol's own merge comes after one of the
        same rule to its left, hence the +1.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        while len(at):
            hit = self._pair_rank(a, b) < limit
            good[at[hit]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~hit & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_right = rb >= ra
            limit = np.where(undo_right, rb + 1, ra)
            a, b = np.where(undo_right, a, self.right[a]), np.where(undo_right, self.left[b], b)
        return good

    def _reachable(self) -> None:
        """Keep only tokens that merging can make as candidates for the guess."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(self.size, bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            fine[i] &= fine[self.left[i]] and fine[self.right[i]]
        self.guess = {s: i for s, i in self.vocab.items() if fine[i]}
        #: By its first four symbols, the longest token that begins so.
        self.reach: dict[str, int] = {}
        for s in self.guess:
            if len(s) > 3:
                self.reach[s[:4]] = max(self.reach.get(s[:4], 0), len(s))

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, get, reach = [], 0, len(word), self.guess.get, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 4], 3))
            while (t := get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def exact(self, word: str) -> list[int]:
        """Merge by lowest rank, leftmost first."""
        if len(word) > 64:
            return self._exact_long(word)
        size, rank, made = self.size, self.rank_of.get, self.made
        ids = [self.vocab[c] for c in word]
        ranks = [rank(a * size + b, _FAR) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < _FAR:
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], _FAR)
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], _FAR)
        return ids

    def _exact_long(self, word: str) -> list[int]:
        """The same over a linked list with a heap, so that time grows little faster than the word."""
        size, rank, made = self.size, self.rank_of.get, self.made
        ids = [self.vocab[c] for c in word]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1], _FAR)) < _FAR]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i] = made[low]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and (right := nxt[left]) < n and (r := rank(ids[left] * size + ids[right], _FAR)) < _FAR:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Encodings of the words (strings of symbols), and how many needed exact merging."""
        guesses = [self.propose(w) for w in words]
        size = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(size.sum()))
        if len(flat) < 2:
            return guesses, 0
        owner = np.repeat(np.arange(len(guesses)), size)
        inner = owner[1:] == owner[:-1]
        keys, at = np.unique((flat[:-1] * self.size + flat[1:])[inner], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[at]
        failing = np.unique(owner[1:][inner][~good])
        for i in failing:
            guesses[i] = self.exact(words[i])
        return guesses, len(failing)


_BOUNDARY = re.compile(r" (?=\S)")


def text_blocks(text: str) -> list[str]:
    """A long text in parts of about BLOCK_CHARS that are encoded alone; each but the first begins with its space."""
    out, start = [], 0
    while len(text) - start > BLOCK_CHARS and (m := _BOUNDARY.search(text, start + BLOCK_CHARS)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class Encoder:
    """Encodes texts like the file's tokenizer, chunk by chunk. kind 'bytes': byte-level pieces with their
    leading space; kind 'words': lower-cased pieces with word ends. The chunk rule of each kind keeps every
    piece whole: text is cut only before a space that a non-space follows, or ('words') at spaces."""

    #: The pre-tokenizers' patterns (fixed values).
    PIECES = {
        "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    }

    def __init__(self, path: str, generation: int = 300_000, generation_chars: int = 8_000_000):
        self.table = MergeTable(path)
        self.kind = "words" if self.table.suffix else "bytes"
        self._piece = regex.compile(self.PIECES[self.kind])
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.table.special)) + ")") if self.table.special else None
        self._inner_space = re.compile(r" (?!\S)")
        #: A generation of the cache ends with this many chunks or characters in it.
        self.generation, self.generation_chars, self.held = generation, generation_chars, 0
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.exact_words = self.guessed_words = 0
        from tokenizers import Tokenizer

        # Which characters past this are letters depends on the library's Unicode version: its pre-tokenizer says
        # where the pieces of such chunks end. They are encoded here like all others.
        self._rare = re.compile("[^\0-\u024f]")
        library = Tokenizer.from_file(path)
        self._pieces_of = library.pre_tokenizer.pre_tokenize_str
        self._symbol = {c: chr(b) for c, b in _byte_characters().items()}
        if self.kind == "words":
            self._normalise = library.normalizer.normalize_str

    def chunks(self, text: str) -> list[str]:
        """For kind 'bytes' every chunk but the first stands for a space and the chunk; the first is marked by a NUL."""
        if self.kind == "words":
            return text.replace("\n", " ").split(" ")
        parts = _BOUNDARY.split(text) if self._inner_space.search(text) else text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def blocks(self, text: str) -> list[str]:
        return text_blocks(text)

    def _words(self, piece: str) -> str:
        s = piece.encode("utf-8", "replace").decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + 256) if self.kind == "words" else s

    def _borders(self, part: str) -> list[str]:
        """The words of a part by the file's own pre-tokenizer, whose pieces are written in stand-ins for bytes."""
        found = self._pieces_of(self._normalise(part) if self.kind == "words" else part)
        words = ["".join(map(self._symbol.__getitem__, piece)) for piece, _ in found]
        return [w[:-1] + chr(ord(w[-1]) + 256) for w in words] if self.kind == "words" else words

    def _learn(self, chunks: list[str]) -> None:
        words: dict[str, int] = {}
        plans: list[list[int | tuple[int, ...]]] = []
        find, symbols, number, lower = self._piece.findall, self._words, words.setdefault, self.kind == "words"
        young, old = self.young, self.old
        for chunk in chunks:
            raw = chunk if lower else chunk[1:] if chunk[:1] == "\0" else " " + chunk
            if chunk.isalpha() and (raw.isascii() or not self._rare.search(raw)) and not lower:
                plans.append([number(symbols(raw), len(words))])  # letters only: one piece
                continue
            plan: list[int | tuple[int, ...]] = []
            borders = None if raw.isascii() or not self._rare.search(raw) else self._borders
            for k, part in enumerate(self._cut.split(raw) if self._cut and "<" in raw else [raw]):
                if k % 2:
                    plan.append(-1 - self.table.special[part])
                    continue
                if borders:
                    plan += [number(w, len(words)) for w in borders(part)]
                    continue
                if lower:
                    part = part.lower() if part.isascii() else self._normalise(part)
                for p in find(part):
                    # A space and plain letters are what the chunk of these letters stands for.
                    bare = p[1:]
                    if not lower and p[0] == " " and bare.isalpha() and bare.isascii() and (ids := young.get(bare) or old.get(bare)):
                        plan.append(ids)
                    else:
                        plan.append(number(symbols(p), len(words)))
            plans.append(plan)
        made, slow = self.table.encode_words(list(words))
        self.exact_words += slow
        self.guessed_words += len(words) - slow
        for chunk, plan in zip(chunks, plans, strict=True):
            young[chunk] = tuple(chain.from_iterable([p if type(p) is tuple else made[p] if p >= 0 else (-1 - p,) for p in plan]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, no special tokens added."""
        return list(self.stream(texts))

    def stream(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The same one after another; no more than about BLOCK_CHARS of text is in work at once."""
        group: list[list[str]] = []
        total = 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self._run(group)
                group, total = [], 0
                ids: list[int] = []
                for block in self.blocks(text):
                    chunks = self.chunks(block)
                    if self.kind == "bytes" and ids and chunks[0] == "\0":
                        del chunks[0]  # the block's leading space belongs to its first word
                    ids += self._run([chunks])[0]
                yield ids
                continue
            group.append(self.chunks(text))
            total += len(text)
            if total > BLOCK_CHARS:
                yield from self._run(group)
                group, total = [], 0
        yield from self._run(group)

    def _run(self, group: list[list[str]]) -> list[list[int]]:
        young, old = self.young, self.old
        found = [list(map(young.get, chunks)) for chunks in group]
        gaps = [[k for k, ids in enumerate(row) if ids is None] for row in found]
        new = {chunks[k] for chunks, gap in zip(group, gaps, strict=True) for k in gap}
        if new:
            known = new.intersection(old)
            for c in known:
                young[c] = old[c]
            self._learn(list(new.difference(known)))
            self.held += sum(map(len, new))
        for chunks, row, gap in zip(group, found, gaps, strict=True):
            for k in gap:
                row[k] = young[chunks[k]]
        out = [list(chain.from_iterable(row)) for row in found]
        if len(young) > self.generation or self.held > self.generation_chars:
            self.old, self.young, self.held = young, {}, 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        table = self.table.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
