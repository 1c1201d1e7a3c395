"""Piece models (SentencePiece BPE) and their compilation into a deterministic transducer.

Merging by score is local: cut the merged text between two pieces, and each side alone merges to the same pieces.
So the pieces of a prefix are those of an earlier prefix and one last piece, and a last piece fits if and only if
it and the piece before it stay two when merged by themselves. Reading one character more needs to know, for each
earlier place from which a piece may still grow to here, the last piece there and the number of pieces since. That
is the transducer's state; only places within the longest piece's reach count, so there are finitely many. Its
transitions give the change in the number of pieces, and the last piece of the longer prefix.

States and transitions are made when first met and kept for the texts that follow.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SPACE = "▁"
# Kinds of pieces and the model type, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; groups do not occur."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    ids: dict[str, int]  # of the pieces that merging can make
    scores: dict[str, float]
    names: list[str]
    kinds: list[int]
    byte_ids: list[int]  # of the 256 bytes, for characters without a piece
    begin: int
    end: int
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool


@lru_cache(maxsize=4)
def loaded(data: bytes) -> PieceModel:
    """The model of a serialized file: BPE with byte fallback, without user-defined or unused pieces."""
    names, kinds, scores = [], [], []
    normal: dict[int, object] = {}
    trainer: dict[int, object] = {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    if trainer.get(3, 1) != BPE or trainer.get(24, 0) or {USER, UNUSED} & set(kinds) or not trainer.get(35, 0):
        raise ValueError("not a plain BPE model with byte fallback")
    usable = [i for i, k in enumerate(kinds) if k == NORMAL]
    place = {n: i for i, n in enumerate(names)}
    return PieceModel(
        {names[i]: i for i in usable},
        {names[i]: scores[i] for i in usable},
        names,
        kinds,
        [place[f"<0x{b:02X}>"] for b in range(256)],
        place.get("<s>", -1),
        place.get("</s>", -1),
        normal.get(2, b""),
        bool(normal.get(3, 1)),
        bool(normal.get(4, 1)),
        bool(normal.get(5, 1)),
    )


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The pieces of a text by merging, the pair of best score first and the leftmost of equal ones; the last merge."""
    final = None
    symbols: list[str | None] = list(text)
    before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
    queue: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < len(symbols):
            pair = symbols[a] + symbols[b]
            if pair in scores:
                heapq.heappush(queue, (-scores[pair], a, b, pair))

    for i in range(len(text) - 1):
        offer(i, i + 1)
    while queue:
        _, a, b, pair = heapq.heappop(queue)
        if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != pair or after[a] != b:
            continue
        final = symbols[a], symbols[b]
        symbols[a], symbols[b] = pair, None
        after[a] = after[b]
        if after[a] < len(symbols):
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [s for s in symbols if s is not None], final


class Merges:
    """Merging of many short texts at once: a row of symbols each, one merge a row in every round.

    Symbols are numbers of pieces; after them come characters that only longer pieces hold, and one for all others.
    For each two symbols whose joined text is a piece, ``made`` has that piece and ``rank`` the place of its score
    from the best, equal ones alike.
    """

    GONE, NEVER = -1, np.iinfo(np.int32).max

    def __init__(self, model: PieceModel):
        symbols = dict(model.ids)
        for char in sorted(set("".join(model.ids)) - symbols.keys()):
            symbols[char] = len(model.names) + len(symbols) - len(model.ids)
        self.pieces, self.other = len(model.names), len(model.names) + len(symbols) - len(model.ids)
        self.byte_ids = np.array(model.byte_ids, np.int32)
        self.of_char = np.full(0x110000, self.other, np.int32)
        self.of_char[[ord(c) for c in symbols if len(c) == 1]] = [i for c, i in symbols.items() if len(c) == 1]
        ranks = np.unique([-x for x in model.scores.values()], return_inverse=True)[1]
        found = [(-1, 0, self.NEVER)]
        for (piece, i), rank in zip(model.ids.items(), ranks.tolist()):
            for n in range(1, len(piece)):
                left, right = symbols.get(piece[:n]), symbols.get(piece[n:])
                if left is not None and right is not None:
                    found.append((left * (self.other + 1) + right, i, rank))
        keys, made, rank = np.array(found, np.int64).T
        self.made, self.rank = made.astype(np.int32), rank.astype(np.int32)
        # An open hash table, at most a quarter full: a key, -1 in empty slots, and its place; 0 in empty slots.
        self.bits = np.uint64(64 - (len(keys) * 4).bit_length())
        self.keys, self.place = np.full(1 << (64 - int(self.bits)), -1, np.int64), np.zeros(1 << (64 - int(self.bits)), np.int32)
        left = np.arange(1, len(keys))
        slot = self._slot(keys[left])
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several the last one stays
            took = self.keys[slot] == keys[left]
            self.place[slot[took]] = left[took]
            left, slot = left[~took], (slot[~took] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in ``made`` and ``rank`` of pairs of symbols; 0 where they never merge."""
        wanted = left * np.int64(self.other + 1) + right
        slot = self._slot(wanted)
        held, found = self.keys[slot], self.place[slot]
        more = np.flatnonzero((held != wanted) & (held != -1))
        while len(more):
            slot[more] = (slot[more] + 1) % len(self.keys)
            held = self.keys[slot[more]]
            found[more] = self.place[slot[more]]
            more = more[(held != wanted[more]) & (held != -1)]
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts' pieces, and how many each text has; a character without a piece gives its bytes."""
        n, size = len(texts), max(map(len, texts), default=0)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        inside = np.arange(size + 1) < sizes[:, None]
        chars = np.zeros((n, size + 1), np.uint32)
        chars[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        left = np.where(inside, self.of_char[chars], self.other)  # the last column stands for both ends
        self._merge(left)
        kept = inside & (left != self.GONE)
        ids, counts = left[kept], kept.sum(1)
        bare = np.flatnonzero(ids >= self.pieces)
        if not len(bare):
            return ids, counts
        code = chars[kept][bare]
        raw = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
        many = np.ones(len(ids), np.int64)
        many[bare] = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        whole = np.repeat(ids, many)
        whole[whole >= self.pieces] = self.byte_ids[raw]
        return whole, np.bincount(np.repeat(np.arange(n), counts), many, n).astype(np.int64)

    def _merge(self, left: np.ndarray) -> None:
        """Merges each row of symbols in place, the pair of best score first and the leftmost of equal ones."""
        n, end = left.shape[0], left.shape[1] - 1
        after, before = np.tile(np.arange(1, end + 2), (n, 1)), np.tile(np.arange(-1, end), (n, 1))
        before[:, 0] = end
        after[:, end] = end
        ranks = np.full(left.shape, self.NEVER, np.int32)
        ranks[:, :end] = self.rank[self.pairs(left[:, :end].ravel(), left[:, 1:].ravel())].reshape(n, end)
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(1)
            going = ranks[rows, at] != self.NEVER
            rows, at = rows[going], at[going]
            second = after[rows, at]
            third, first = after[rows, second], before[rows, at]
            made = self.made[self.pairs(left[rows, at], left[rows, second])]
            left[rows, at], left[rows, second], ranks[rows, second] = made, self.GONE, self.NEVER
            after[rows, at] = third
            before[rows, third] = np.where(third < end, at, end)
            ranks[rows, at] = self.rank[self.pairs(made, left[rows, third])]
            ranks[rows, first] = np.where(first < end, self.rank[self.pairs(left[rows, first], made)], self.NEVER)


class State(dict):
    """Transitions by character: (next state, change in the number of pieces).

    ``open`` has, for each earlier place from which a piece may still grow, the trie's node of the text since, the
    last piece before the place (-1 at the start), and the number of pieces since; ``last`` is the last piece here.
    """

    __slots__ = ("machine", "open", "last")

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.step(self, char)
        return step


class Transducer:
    """Reads normalised text; ``start`` is the state where a text or a segment begins.

    A segment begins at a space that follows another character, if no piece goes on over such a place, and around
    characters that are in no longer piece; there the state is as at the start.
    """

    # Transitions, and pairs of pieces, that are kept; beyond, the tables are made anew as texts need them.
    LIMIT, PAIRS = 400_000, 600_000

    def __init__(self, model: PieceModel):
        self.names, self.ids, self.scores = model.names, model.ids, model.scores
        # A trie of all pieces: children by character, and the piece that ends at a node (-1 for none).
        self.kids: list[dict[str, int]] = [{}]
        self.piece: list[int] = [-1]
        for name, i in model.ids.items():
            node = 0
            for char in name:
                below = self.kids[node].get(char)
                if below is None:
                    below = self.kids[node][char] = len(self.kids)
                    self.kids.append({})
                    self.piece.append(-1)
                node = below
            self.piece[node] = i
        longer = [p for p in model.ids if len(p) > 1]
        inside = set("".join(longer))
        self.inside = inside
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in longer)
        self.solo = solo = "".join(c for c in "\n\t\r" if c not in inside)
        one = f"[{solo}]|" if solo else ""
        self.segment = re.compile(f"{one}{SPACE}+[^{SPACE}{solo}]*|[^{SPACE}{solo}]+" if self.splits else r"(?s).+")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.states = {}
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():  # they hold one another
            state.clear()
        self.states: dict[tuple, State] = {}
        self.fits: dict[int, bool] = {}
        self.made = 0
        self.start = self.state((), -1)

    def state(self, open_: tuple, last: int) -> State:
        found = self.states.get((open_, last))
        if found is None:
            found = self.states[open_, last] = State()
            found.machine, found.open, found.last = self, open_, last
        return found

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two parts that a piece is last merged from; none for a single character."""
        if piece not in self.parts:
            last = merged(self.names[piece], self.scores)[1]
            self.parts[piece] = last and (self.ids[last[0]], self.ids[last[1]])
        return self.parts[piece]

    def stay_two(self, a: int, b: int) -> bool:
        """Whether merging a + b gives a and b.

        Takes the merges of both back, latest first, and looks each time whether the two parts that then touch
        would have been merged before the merge just taken back. ``bound`` is that one's score. Of equal scores
        the merge further left comes first.
        """
        key = a << 32 | b
        found = self.fits.get(key)
        if found is not None:
            return found
        names, scores = self.names, self.scores
        x, y, bound, wins_tie = a, b, None, False
        while True:
            across = scores.get(names[x] + names[y])
            if across is not None and (bound is None or across > bound or across == bound and wins_tie):
                found = False
                break
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                found = True
                break
            if right is None or left is not None and scores[names[x]] < scores[names[y]]:
                bound, wins_tie, x = scores[names[x]], False, left[1]
            else:
                bound, wins_tie, y = scores[names[y]], True, right[0]
        self.fits[key] = found
        return found

    def step(self, state: State, char: str) -> tuple[State, int]:
        self.made += 1
        if char not in self.inside:
            return self.start, 1 if char in self.ids else len(char.encode())
        if self.splits and char == SPACE and state.last >= 0 and self.names[state.last][-1] != SPACE:
            return self.start[char][0], 1
        kids, piece, fits = self.kids, self.piece, self.fits
        going, last, since = [], -1, 0
        for node, before, n in state.open:
            below = kids[node].get(char)
            if below is None:
                continue
            if last < 0 and piece[below] >= 0:
                known = before < 0 or fits.get(before << 32 | piece[below])
                if known if known is not None else self.stay_two(before, piece[below]):
                    last, since = piece[below], n
            if kids[below]:
                going.append((below, before, n))
        single = kids[0].get(char)
        if last < 0:
            last, change = (piece[single] if single is not None else -1), 1
            if last < 0:  # a character without a piece that longer pieces hold: its bytes, and a new start
                return self.start, len(char.encode())
        else:
            change = 1 - since
        open_ = [(node, before, n + change) for node, before, n in going]
        if single is not None and kids[single]:
            open_.append((single, state.last, change))
        return self.state(tuple(open_), last), change

    def count(self, text: str) -> int:
        """Pieces of a normalised text."""
        if self.made > self.LIMIT:
            self.clear()
        state, n = self.start, 0
        for char in text:
            state, change = state[char]
            n += change
        return n

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text; a character without a piece stands for its bytes.

        Follows the last pieces of all prefixes by themselves, without the states that count.
        """
        kids, piece, fits, end = self.kids, self.piece, self.fits, len(text)
        if len(fits) > self.PAIRS:
            fits.clear()
        last, size = [-1] * (end + 1), [1] * (end + 1)
        for start in range(end):
            node, at, before = 0, start, last[start]
            while at < end:
                node = kids[node].get(text[at])
                if node is None:
                    break
                at += 1
                found = piece[node]
                if found >= 0 and last[at] < 0:
                    if before >= 0:
                        known = fits.get(before << 32 | found)
                        if not (known if known is not None else self.stay_two(before, found)):
                            continue
                    last[at], size[at] = found, at - start
        out = []
        while end:
            out.append(text[end - size[end] : end])
            end -= size[end]
        return out[::-1]

    def words(self, text: str) -> list[str] | None:
        """Keys of the segments of a normalised text, or None where it must be split with care.

        A key is a word without the mark before it, or a line end with the word that follows it at once. Runs of
        marks belong together; texts that have some are left to ``segment``.
        """
        if not self.splits or text[:1] != SPACE or SPACE + SPACE in text:
            return None
        return (text.replace("\n", SPACE + "\n") if "\n" in self.solo else text).split(SPACE)[1:]

    def word(self, key: str) -> str:
        """The normalised text of a key of ``words``."""
        return key if key[:1] == "\n" and "\n" in self.solo else SPACE + key


class Record:
    """Where the bytes of a normalised text come from: the stretches that normalising changed, in order.

    A stretch has its first and end place in the normalised text and in the source. A place inside one is that of
    the whole stretch; between two of them places run on together.
    """

    def __init__(self, stretches: np.ndarray):
        """[stretch, (first, end, first in the source, end in the source)]"""
        self.first, self.end, self.source, self.source_end = stretches.reshape(-1, 4).T

    def places(self, at: np.ndarray) -> np.ndarray:
        """Places in the source's bytes of places in the normalised text's bytes."""
        if not len(self.first):
            return at
        i = np.searchsorted(self.first, at, "right") - 1
        k = np.maximum(i, 0)
        after = self.source_end[k] + at - self.end[k]
        return np.where(i < 0, at, np.where(at < self.end[k], self.source[k], after))


class Normalizer:
    """Text before merging: longest prefixes replaced by the compiled character map, spaces marked.

    The map is a double array of 32-bit units (a trie over UTF-8 bytes) whose values are places in a block of
    zero-terminated texts.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        blob = model.charsmap
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]
        self.plain = not self.units and not model.trim_spaces and model.escape_spaces

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What replaces the longest prefix of data[at:], and that prefix's length; else one character as it is."""
        if self.units:
            node = self._offset(self.units[0])
            best = None
            for n in range(at, len(data)):
                node ^= data[n]
                unit = self.units[node]
                if unit & 0x800000FF != data[n]:
                    break
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    best = (self.units[node] & 0x7FFFFFFF, n + 1 - at)
            if best:
                value, size = best
                return self.texts[value : self.texts.index(0, value)], size
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def prefix(self, text: str) -> str:
        return SPACE if text and self.model.dummy_prefix else ""

    def recorded(self, text: str) -> tuple[str, Record]:
        """The normalised text, and the record of its source.

        Under an empty map only the first mark and the spaces are changed, each space into a mark.
        """
        if not text:
            return "", Record(np.zeros((0, 4), np.int64))
        if self.plain:
            lead = len(SPACE.encode()) if self.model.dummy_prefix else 0
            spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            first = spaces + (len(SPACE.encode()) - 1) * np.arange(len(spaces)) + lead
            marks = np.stack([first, first + len(SPACE.encode()), spaces, spaces + 1], 1)
            return self.prefix(text) + text.replace(" ", SPACE), Record(np.concatenate([[[0, lead, 0, 0]], marks]))
        return self._walked(text.encode())

    def _walked(self, data: bytes) -> tuple[str, Record]:
        """As ``recorded``, by the longest prefixes that the map replaces, one after another."""
        m = self.model
        mark = SPACE.encode() if m.escape_spaces else b" "
        at = 0
        if m.trim_spaces:
            while at < len(data):
                new, size = self.longest(data, at)
                if new != b" ":
                    break
                at += size
        if at >= len(data):
            return "", Record(np.zeros((0, 4), np.int64))
        out = bytearray(mark if m.dummy_prefix else b"")
        stretches = [(0, len(out), at, at)]
        after_space = m.trim_spaces
        while at < len(data):
            new, size = self.longest(data, at)
            if m.trim_spaces and after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = m.trim_spaces and new.endswith(b" ")
                new = new.replace(b" ", mark)
            if new != data[at : at + size]:
                stretches.append((len(out), len(out) + len(new), at, at + size))
            out += new
            at += size
        if m.trim_spaces and out.endswith(mark):
            while out.endswith(mark):
                del out[-len(mark) :]
            end = int(Record(np.array(stretches)).places(np.array([len(out)]))[0])
            stretches = [s for s in stretches if s[0] < len(out)] + [(len(out), len(out), end, end)]
        return out.decode(), Record(np.array(stretches))

    def normalized(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes and its end the place in the UTF-8 bytes of ``text``."""
        new, record = self.recorded(text)
        return new, record.places(np.arange(len(new.encode()) + 1)).tolist()


@lru_cache(maxsize=2)
def tools(data: bytes) -> tuple[PieceModel, Normalizer, Transducer]:
    """A model with its normalizer and transducer, kept for later tasks of a Python worker."""
    model = loaded(data)
    return model, Normalizer(model), Transducer(model)


@lru_cache(maxsize=1)
def merges_of(data: bytes) -> Merges:
    """A model's merges, kept likewise."""
    return Merges(loaded(data))
