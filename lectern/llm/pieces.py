"""Encode and decode with a SentencePiece BPE vocabulary, with seeded merge-dropout.

A text falls into parts which no piece can join. Encoding a part starts from single
characters and works off an agenda: the best-scored pair of neighbours that forms a piece
is merged, the leftmost first on ties, and the merged piece's new pairs enter the agenda.
With dropout, the k-th candidate that comes up in part i of a document is skipped if a
hash of the seed, the document, i and k falls below the rate; so a run can be repeated
anywhere, each occurrence of a word is cut by chances of its own, and every rate gives
pieces that decode to the same text.

What a part gives depends on the part and on which candidates are skipped alone. For
parts that come again a worker remembers that as a tree: from the part without skips, a
branch for each candidate skipped first, and so on. All parts of some documents go down
their trees together, as far as their hashes say. The agendas of parts that came for the
first time are worked off side by side, a step of all of them at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import kept, turn_to

SEED = 42
#: Share of candidate merges that are skipped.
RATE = 0.1
#: Nodes of the trees a worker remembers, parts it knows to have come once, and candidates of a part that trees branch on.
NODES, ONCE, BRANCHES = 250_000, 300_000, 20
#: Agendas that are worked off side by side.
ROWS = 4096
#: Parts and words up to this length are remembered.
REMEMBERED = 64
SPACE = "▁"
#: Places in one agenda.
PLACES = 1 << 40
#: Parts up to this length have their agenda in a plain list.
SHORT, NONE, AWAY = 32, 1 << 62, (1 << 31) - 1
#: Fixed values of the hashes.
FULL, GOLD, MIX, STIR = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def default_model() -> str:
    """The vocabulary named by LECTERN_PIECE_MODEL, or that of the installed public tokenizers."""
    return os.environ.get("LECTERN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(MIX)
    x = (x ^ x >> np.uint64(29)) * np.uint64(STIR)
    return x ^ x >> np.uint64(32)


def part_hashes(seed: int, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash for each part, of its document's key and its place among the document's parts."""
    return stirred(stirred(keys ^ np.uint64(seed * GOLD & FULL)) + places * np.uint64(GOLD))


class Skips:
    """The candidates of a part that are skipped."""

    def __init__(self, part_hash: int, below: int) -> None:
        self.hash, self.below = part_hash, below

    def __contains__(self, k: int) -> bool:
        x = self.hash + (k + 1) * GOLD & FULL
        x = (x ^ x >> 32) * MIX & FULL
        x = (x ^ x >> 29) * STIR & FULL
        return (x ^ x >> 32) >> 11 < self.below


def chances(hashes: np.ndarray, k: int) -> np.ndarray:
    """53-bit numbers of the k-th candidates of parts."""
    return stirred(hashes + np.uint64((k + 1) * GOLD & FULL)) >> np.uint64(11)


class Hashed:
    """Skips of many parts by their hashes."""

    def __init__(self, hashes: np.ndarray, below: int) -> None:
        self.hashes, self.below = hashes, below

    def at(self, rows: np.ndarray, k: int) -> np.ndarray:
        return chances(self.hashes[rows], k) < np.uint64(self.below)

    def of(self, row: int) -> Skips:
        return Skips(int(self.hashes[row]), self.below)


class Named:
    """Skips of many parts, named one by one."""

    def __init__(self, names: list[tuple[int, ...]]) -> None:
        self.names = names
        self.masks = np.array([sum(1 << k for k in x) for x in names], np.int64)

    def at(self, rows: np.ndarray, k: int) -> np.ndarray:
        return (self.masks[rows] >> np.int64(min(k, 62)) & 1).astype(bool)

    def of(self, row: int) -> tuple[int, ...]:
        return self.names[row]


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Pool:
    """An array that grows."""

    def __init__(self, kind: type, width: int = 0) -> None:
        self.rows = np.zeros((1024, width) if width else 1024, kind)
        self.n = 0

    def add(self, values) -> int:
        n = len(values)
        while self.n + n > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.n : self.n + n] = values
        self.n += n
        return self.n - n


#: Stands for U+2581 in a text.
LITERAL = "\x00" + SPACE


class Vocabulary:
    """Pieces and scores of a BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode("utf-8")
        long = [p for p in self.id if len(p) > 1]
        joined = {c for p in long for c in p}
        # If no piece has a space after another character, texts can be cut before spaces.
        inner = any(SPACE in p.lstrip(SPACE) for p in long)
        self.pairs = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.ranked = sorted(self.score, key=lambda p: (-self.score[p], self.id[p]))
        self.rank = {p: r for r, p in enumerate(self.ranked)}
        # lines can be cut apart, and words before their spaces, if no piece joins a newline or has a space inside
        self.plain = "\n" not in joined and not inner
        self.spelling = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.spelling_size = np.array([len(x) for x in self.bytes_of])
        self.spelling_start = np.cumsum(self.spelling_size) - self.spelling_size
        self._pair_table()
        self._joins_table()
        self.forget()

    def forget(self) -> None:
        #: Words and parts, where their own parts and nodes begin.
        self.word: dict[str | tuple[str, ...], int] = {}
        self.part: dict[str, int] = {}
        self.word_start, self.word_size, self.word_parts = Pool(np.int64), Pool(np.int64), Pool(np.int32)
        #: Of each node: its part and the skips that lead to it, candidates that come up, ids, and nodes one skip further.
        self.node: list[tuple[str, tuple[int, ...]]] = []
        self.candidates, self.id_start, self.id_size, self.id_pool = Pool(np.int64), Pool(np.int64), Pool(np.int64), Pool(np.int32)
        self.further = Pool(np.int32, BRANCHES)
        #: Parts, and branches, that have come once.
        self.once: set[str] = set()
        self.tried: set[int] = set()
        #: Those that have come again.
        self.again: dict[str, None] = {}
        self.taken: dict[int, None] = {}
        self.loose: list[str] = []
        #: U+2581 itself, which is no part of a text otherwise.
        self.part[LITERAL] = self._enter(["\0"], [()])
        self.id_size.rows[0] = 3
        self.id_start.rows[0] = self.id_pool.add([self.byte[b] for b in SPACE.encode()])

    def _pair_table(self) -> None:
        """A hash table of all pairs of symbols that form a piece. A symbol is a piece's rank, or a character that is none, after those."""
        n = len(self.ranked)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, r in self.rank.items():
            if len(p) == 1:
                self.symbol[ord(p)] = r
        one = lambda x: self.rank[x] if x in self.rank else n + ord(x) if len(x) == 1 else None
        pairs = {(a, b): r for p, r in self.rank.items() for i in range(1, len(p)) if (a := one(p[:i])) is not None and (b := one(p[i:])) is not None}
        self.pair_bits = max(4, (6 * len(pairs)).bit_length())
        self.pair_key = np.full(1 << self.pair_bits, -1, np.int64)
        self.pair_rank = np.full(1 << self.pair_bits, AWAY, np.int32)
        left = np.array([a << 21 | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        at = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.pair_key[at] < 0)
            own, first = np.unique(at[free], return_index=True)
            self.pair_key[own], self.pair_rank[own] = left[free[first]], ranks[free[first]]
            on = self.pair_key[at] != left
            left, ranks, at = left[on], ranks[on], at[on] + 1 & (1 << self.pair_bits) - 1
        self.symbol_id = np.array([self.id[p] for p in self.ranked], np.int32)

    def _joins_table(self) -> None:
        """A map of the pairs of characters that stand together in a piece, by numbers of these characters."""
        chars = sorted({c for p in self.pairs for c in p})
        self.char_number = np.zeros(0x110000, np.int32)
        self.char_number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_count = len(chars) + 1
        at = np.array([self.char_number[ord(a)] * self.char_count + self.char_number[ord(b)] for a, b in self.pairs], np.int64)
        self.joins = np.zeros(self.char_count**2 // 8 + 1, np.uint8)
        np.bitwise_or.at(self.joins, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _uncut(self, texts: list[str]) -> list[bool]:
        """Whether each text is one part."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = self.char_number[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        at = chars[:-1] * self.char_count + chars[1:]
        cut = (self.joins[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 0
        ends = np.cumsum(size)
        cut[ends[:-1] - 1] = False  # where one text ends
        before = np.concatenate(([0], np.cumsum(cut), [0]))
        before[-1] = before[-2]
        return (before[ends - 1] == before[ends - size]).tolist()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(GOLD)) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs of symbols form; AWAY if none, or if one is missing (negative)."""
        keys = a << 21 | b
        at = self._slot(keys)
        out = self.pair_rank[at]
        seen = self.pair_key[at]
        more = np.flatnonzero((seen != keys) & (seen >= 0))
        out[seen != keys] = AWAY
        while len(more):
            at[more] = at[more] + 1 & (1 << self.pair_bits) - 1
            seen = self.pair_key[at[more]]
            met = seen == keys[more]
            out[more[met]] = self.pair_rank[at[more[met]]]
            more = more[~met & (seen >= 0)]
        out[(a < 0) | (b < 0)] = AWAY
        return out

    def merge_many(self, parts: list[str], skips: Hashed | Named) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each part, candidates of each) of many parts, as :meth:`merge` gives them."""
        size = np.array([len(p) for p in parts], np.int64)
        pool, (start, sizes, candidates) = Pool(np.int32), np.zeros((3, len(parts)), np.int64)
        order = np.argsort(size, kind="stable")
        for x in range(0, len(order), ROWS):
            rows = order[x : x + ROWS]
            rows = rows[size[rows] <= SHORT]
            if len(rows):
                self._side_by_side(parts, rows, size[rows], skips, pool, start, sizes, candidates)
        for i in np.flatnonzero(size > SHORT).tolist():
            pieces, candidates[i] = self.merge(parts[i], skips.of(i))
            ids = self.ids(pieces)
            start[i], sizes[i] = pool.add(ids), len(ids)
        return gathered(pool.rows, start, sizes), sizes, candidates

    def _side_by_side(self, parts: list[str], rows: np.ndarray, size: np.ndarray, skips: Hashed | Named, pool: Pool, start: np.ndarray, sizes: np.ndarray, candidates: np.ndarray) -> None:
        wide = int(size.max())
        chars = np.frombuffer("".join([parts[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        columns = np.arange(wide)
        sym = np.full((len(rows), wide), -1, np.int64)
        sym[columns < size[:, None]] = self.symbol[chars]
        agenda = np.full((len(rows), wide), AWAY, np.int32)
        agenda[:, :-1] = self._ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(rows), -1)
        k = 0
        while len(rows):
            i = agenda.argmin(1)
            every = np.arange(len(rows))
            r = agenda[every, i]
            done = r == AWAY
            if done.any():
                candidates[rows[done]] = k
                self._tell(sym[done], rows[done], pool, start, sizes)
                sym, agenda, rows, i, r = (x[~done] for x in (sym, agenda, rows, i, r))
                every = np.arange(len(rows))
            skip = skips.at(rows, k)
            agenda[every[skip], i[skip]] = AWAY
            k += 1
            at = every[~skip]
            if not len(at):
                continue
            i, r = i[at], r[at].astype(np.int64)
            s, a = sym[at], agenda[at]
            behind = columns[:-1] > i[:, None]
            s[:, :-1] = np.where(behind, s[:, 1:], s[:, :-1])
            s[:, -1] = -1
            behind |= columns[:-1] == i[:, None]
            a[:, :-1] = np.where(behind, a[:, 1:], a[:, :-1])
            every = np.arange(len(at))
            s[every, i] = r
            a[every, i] = self._ranks(r, s[every, np.minimum(i + 1, wide - 1)])
            a[every[i == wide - 1], i[i == wide - 1]] = AWAY
            on = np.flatnonzero(i > 0)
            a[on, i[on] - 1] = self._ranks(s[on, i[on] - 1], r[on])
            sym[at], agenda[at] = s, a

    def _tell(self, sym: np.ndarray, rows: np.ndarray, pool: Pool, start: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.ranked)
        on = sym >= 0
        count = on.sum(1)
        start[rows] = pool.add(self.symbol_id[np.minimum(sym[on], n - 1)]) + np.cumsum(count) - count
        sizes[rows] = count
        for x in np.flatnonzero((sym >= n).any(1)).tolist():  # characters without a piece
            ids = self.ids([self.ranked[y] if y < n else chr(y - n) for y in sym[x, on[x]].tolist()])
            start[rows[x]], sizes[rows[x]] = pool.add(ids), len(ids)

    def merge(self, word: str, skipped=()) -> tuple[list[str], int]:
        """(pieces of one part, best merges first; number of candidates that came up). ``skipped`` says ``k in`` it.

        The agenda holds a merge as its piece's rank among all scores and its place, in
        one number; for a short part it is a list in order of place instead.
        """
        n = len(word)
        if n <= SHORT:
            return self.merge_short(word, skipped)
        rank, piece = self.rank, self.ranked
        sym: list[str | None] = list(word)
        agenda = [r * PLACES + i for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        k = 0
        while agenda:
            r, i = divmod(pop(agenda), PLACES)
            p = piece[r]
            left = sym[i]
            if left is None or (j := after[i]) >= n or left + sym[j] != p:
                continue  # one side has been merged meanwhile
            k += 1
            if k - 1 in skipped:
                continue
            sym[i], sym[j] = p, None
            after[i] = m = after[j]
            if m < n:
                before[m] = i
                if (r := rank.get(p + sym[m])) is not None:
                    push(agenda, r * PLACES + i)
            h = before[i]
            if h >= 0 and (r := rank.get(sym[h] + p)) is not None:
                push(agenda, r * PLACES + h)
        return [s for s in sym if s is not None], k

    def merge_short(self, word: str, skipped=()) -> tuple[list[str], int]:
        rank, piece = self.rank, self.ranked
        sym = list(word)
        agenda = [rank.get(a + b, NONE) for a, b in zip(word, word[1:], strict=False)]
        k = 0
        while agenda and (r := min(agenda)) != NONE:
            i = agenda.index(r)
            k += 1
            if k - 1 in skipped:
                agenda[i] = NONE
                continue
            sym[i] = p = piece[r]
            del sym[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(p + sym[i + 1], NONE)
            if i:
                agenda[i - 1] = rank.get(sym[i - 1] + p, NONE)
        return sym, k

    def parts(self, word: str) -> list[str]:
        """``word`` cut wherever two characters stand together in no piece, as no merge can cross there."""
        cuts = [i for i, p in enumerate(map(str.__add__, word, word[1:]), 1) if p not in self.pairs]
        return [word[x:y] for x, y in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of pieces; characters without a piece become their bytes."""
        known = self.id
        try:
            return np.array([known[p] for p in pieces], np.int32)
        except KeyError:
            return np.array([x for p in pieces for x in ([known[p]] if p in known else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")])], np.int32)

    def _enter(self, parts: list[str], names: list[tuple[int, ...]]) -> int:
        """Nodes for parts and the skips that lead to them; the first one's number."""
        ids, sizes, candidates = self.merge_many(parts, Named(names))
        self.id_start.add(self.id_pool.add(ids) + np.cumsum(sizes) - sizes)
        self.id_size.add(sizes)
        self.candidates.add(candidates)
        self.further.add(np.full((len(parts), BRANCHES), -1, np.int32))
        self.node += zip(parts, names, strict=True)
        return len(self.node) - len(parts)

    def _grow(self) -> None:
        """Enter what came again."""
        room = max(0, NODES - len(self.node))
        if new := list(self.again)[:room]:
            first = self._enter(new, [()] * len(new))
            self.part.update(zip(new, range(first, first + len(new)), strict=True))
        self.again = {}
        if new := list(self.taken)[: max(0, NODES - len(self.node))]:
            at, k = (np.array(x) for x in zip(*(divmod(x, BRANCHES) for x in new), strict=True))
            own = [self.node[x] for x in at.tolist()]
            first = self._enter([p for p, _ in own], [(*name, x) for (_, name), x in zip(own, k.tolist(), strict=True)])
            self.further.rows[at, k] = np.arange(first, first + len(new))
        self.taken = {}

    def _loose(self, part: str) -> int:
        """A number for a part that is not remembered, below zero."""
        self.loose.append(part)
        return -len(self.loose)

    def _word(self, word: str | tuple[str, ...], whole: bool) -> list[int]:
        """The nodes of a word with the space before it (a newline before it instead, if it begins with one), or of other text as it is in a tuple.

        A word is entered when all its parts are remembered, a part when it comes again.
        ``whole`` says that a word is one part.
        """
        if whole:
            parts = [SPACE + word]
        elif isinstance(word, tuple):
            parts = [LITERAL] if len(word) == 2 else self.parts(word[0])
        elif word[:1] == "\n":
            parts = ["\n", *(self.parts(word[1:]) if len(word) > 1 else [])]
        else:
            parts = self.parts(SPACE + word)
        nodes, known = [], True
        for p in parts:
            at = self.part.get(p)
            if at is None:
                at, known = self._loose(p), False
                if len(p) <= REMEMBERED:
                    if p in self.once:
                        self.again[p] = None
                    elif len(self.once) < ONCE:
                        self.once.add(p)
            nodes.append(at)
        if known and len(word if isinstance(word, str) else word[0]) <= REMEMBERED:
            self.word_start.add([self.word_parts.add(nodes)])
            self.word[word] = self.word_size.add([len(nodes)])
        return nodes

    def words(self, text: str) -> list[str | tuple[str, ...]]:
        """What a text consists of, as :meth:`_word` takes it. A leading space is added, as the model was trained; a literal U+2581 is apart from a space."""
        out: list[str | tuple[str, ...]] = []
        for k, some in enumerate(text.split(SPACE)):
            if k:
                out.append((LITERAL, "itself"))
            if not self.plain:
                if some or not k:
                    out.append((("" if k else SPACE) + some.replace(" ", SPACE),))
                continue
            for i, line in enumerate(some.split("\n")):
                words: list[str | tuple[str, ...]] = line.split(" ")
                if "" in words:  # spaces that follow each other or end the line
                    if i:
                        out.append("\n")
                    if line or not (k or i):
                        out.append((("" if k or i else SPACE) + line.replace(" ", SPACE),))
                    continue
                if i:
                    words[0] = "\n" + words[0]
                elif k:
                    words[0] = (words[0],)
                out += words
        return out

    def encode_all(self, texts: list[str | None], keys: np.ndarray, seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's end); none for an empty or null text. Keys are the documents'."""
        every: list[str | tuple[str, ...]] = []
        counts = []
        for t in texts:
            words = self.words(t) if t else []
            every += words
            counts.append(len(words))
        self.loose: list[str] = []
        at = list(map(self.word.get, every))
        missing = [i for i, x in enumerate(at) if x is None]
        new: list[list[int]] = []
        if missing:
            own = list(map(every.__getitem__, missing))
            number = {w: i for i, w in enumerate(dict.fromkeys(own))}
            simple = [isinstance(w, str) and w[:1] != "\n" for w in number]
            uncut = iter(self._uncut([SPACE + w for w, x in zip(number, simple, strict=True) if x] or [SPACE]))
            new = [self._word(w, x and next(uncut)) for w, x in zip(number, simple, strict=True)]
            for i, w in zip(missing, own, strict=True):
                at[i] = -1 - number[w]
        word = np.array(at, np.int64)
        fresh = np.flatnonzero(word < 0)
        size = self.word_size.rows[np.maximum(word, 0)]
        start = self.word_start.rows[np.maximum(word, 0)]
        many = np.array([len(x) for x in new], np.int64)
        size[fresh] = many[-1 - word[fresh]]
        start[fresh] = self.word_parts.n + (np.cumsum(many) - many)[-1 - word[fresh]]
        pool = np.concatenate((self.word_parts.rows[: self.word_parts.n], np.array([y for x in new for y in x], np.int32)))
        node = gathered(pool, start, size)
        before = np.concatenate(([0], np.cumsum(size)))
        ends = before[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        in_text = np.diff(np.concatenate(([0], ends)))
        places = np.arange(len(node)) - np.repeat(ends - in_text, in_text)
        hashes = part_hashes(seed, np.repeat(keys.view(np.uint64), in_text), places.astype(np.uint64))
        below = int(rate * 2**53)
        loose = node < 0
        if below:
            n = self.candidates.rows[np.maximum(node, 0)]
            loose |= n > BRANCHES
            self._go_down(node, np.flatnonzero(~loose & (n > 0)), hashes, below, loose)
        alone = np.flatnonzero(loose)
        parts = [self.loose[-1 - x] if x < 0 else self.node[x][0] for x in node[alone].tolist()]
        more, sizes_alone, _ = self.merge_many(parts, Hashed(hashes[alone], below))
        node[alone] = 0
        sizes, start = self.id_size.rows[node], self.id_start.rows[node]
        sizes[alone], start[alone] = sizes_alone, self.id_pool.n + np.cumsum(sizes_alone) - sizes_alone
        ids = gathered(np.concatenate((self.id_pool.rows[: self.id_pool.n], more)), start, sizes)
        self._grow()
        return ids, np.concatenate(([0], np.cumsum(sizes)))[ends]

    def _go_down(self, node: np.ndarray, on: np.ndarray, hashes: np.ndarray, below: int, loose: np.ndarray) -> None:
        """Move parts, those at ``on``, to the nodes that their hashes lead to; what no tree holds becomes loose."""
        own, hashes, k = node[on], hashes[on], 0
        while len(own):
            skip = np.flatnonzero(chances(hashes, k) < np.uint64(below))
            if len(skip):
                to = self.further.rows[own[skip], k]
                out = skip[to < 0]  # for the first time, or there is no room
                for x in np.unique(own[out] * BRANCHES + k).tolist():
                    if x in self.tried:
                        self.taken[x] = None
                    elif len(self.tried) < ONCE:
                        self.tried.add(x)
                own[skip] = np.maximum(to, 0)
                loose[on[out]] = True
            k += 1
            n = self.candidates.rows[own]
            done = (n <= k) | loose[on]
            if k == BRANCHES:  # skips have opened more candidates than the tree branches on
                loose[on[~done]] = True
                done[:] = True
            keep = done & ~loose[on]
            node[on[keep]] = own[keep]
            own, hashes, on = own[~done], hashes[~done], on[~done]

    def encode(self, text: str | None, seed: int = SEED, key: int = 0, rate: float = 0.0) -> np.ndarray:
        """Ids of one text."""
        return self.encode_all([text], np.array([key], np.int64), seed, rate)[0]

    def rest(self) -> None:
        """Between tasks, when the worker may wait for long or serve another operator."""
        if len(self.node) >= NODES:
            self.forget()
        self.once.clear()
        self.tried.clear()

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, the added space of a text first."""
        return gathered(self.spelling, self.spelling_start[ids], self.spelling_size[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded."""
        return self.spelled(ids)[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker, as long as it encodes."""
    return Vocabulary(path)


kept.append(vocabulary.cache_clear)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("key"))


def _some(parts: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that their texts alone are Python objects."""
    for p in parts:
        for at in range(0, len(p), rows):
            yield p.slice(at, rows)


def shipped(spark: SparkSession, model: str | None) -> str:
    """The vocabulary's name among the files that workers have; they get it from the driver."""
    path = model or default_model()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(id_col, ids array<int>), one row per input row.

    Skips go by the id as text; rows that share an id, or have none, share their chances
    place by place. Null and empty texts have no ids. A text of any length is cut by the
    same rule. Other columns are ignored. Row order does not matter.
    """
    name = shipped(docs.sparkSession, model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pieces encode")
        v = vocabulary(SparkFiles.get(name))
        for p in _some(parts):
            ids, ends = v.encode_all(p["text"].to_pylist(), p["key"].to_numpy(), seed, rate)
            yield pa.RecordBatch.from_arrays([p["id"], pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))], ["id", "ids"])
        v.rest()

    kind = docs.schema[id_col].dataType
    return _keyed(docs, id_col, text_col).mapInArrow(run, "id string, ids array<int>").select(F.col("id").cast(kind).alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id_col, text): the texts that were encoded; null ids give null."""
    name = shipped(encoded.sparkSession, model)

    def run(ids: pd.Series) -> pd.Series:
        v = vocabulary(SparkFiles.get(name))
        return pd.Series([None if x is None else v.decode(np.asarray(x)) for x in ids], dtype=object)

    return encoded.select(id_col, F.pandas_udf(run, "string")(F.col(ids_col)).alias("text"))


def checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(id_col, n_ids, ids_sha256, lossless): digests of :func:`encode` and whether decoding gives the text back.

    Encoding and decoding happen in one pass, so that the ids need not leave the worker.
    """
    name = shipped(docs.sparkSession, model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pieces checked")
        v = vocabulary(SparkFiles.get(name))
        for p in _some(parts):
            texts = p["text"].to_pylist()
            ids, ends = v.encode_all(texts, p["key"].to_numpy(), seed, rate)
            sizes = np.diff(np.concatenate(([0], ends)))
            whole = memoryview(ids.astype("<i4", copy=False)).cast("B") if len(ids) else memoryview(b"")
            digests = [hashlib.sha256(whole[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            spelled = v.spelled(ids)
            want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            length = np.add.reduceat(np.concatenate((v.spelling_size[ids], [0])), np.minimum(ends - sizes, len(ids))) * (sizes > 0)
            to = np.cumsum(length)
            same = [spelled[e - n : e] == w for e, n, w in zip(to.tolist(), length.tolist(), want, strict=True)]
            yield pa.RecordBatch.from_arrays([p["id"], pa.array(sizes), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["id", "n_ids", "ids_sha256", "lossless"])
        v.rest()

    kind = docs.schema[id_col].dataType
    return _keyed(docs, id_col, text_col).mapInArrow(run, "id string, n_ids long, ids_sha256 string, lossless boolean").select(F.col("id").cast(kind).alias(id_col), "n_ids", "ids_sha256", "lossless")
