"""SentencePiece BPE with seeded merge-dropout.

Merges come from a public SentencePiece model. The agenda holds candidate merges by score;
each candidate that is popped is skipped if a keyed hash of seed, text, occurrence and place (where its
two symbols begin and end in the unit) falls below the dropout rate, so one seed always gives one
segmentation and other seeds give others. No piece of the model goes on after a word end, so merges never
cross one: the agenda runs over units (a word with the blanks before it), and every occurrence of a
unit in a text draws for itself.

What is remembered, in a bounded table, depends on no draw: for a unit and a set of skipped
candidates, the segmentation and the places popped on the way, as a tree whose branches are further skips.
An occurrence walks from the unit's root: it draws for the places of its node, goes on to the branch of the
first skipped one, and ends where nothing more is skipped. A branch not met before is computed by the
agenda, many units in step. Only what comes again is remembered: a unit from its second occurrence on, a branch where its node
was visited ``OFTEN`` times; other occurrences go through the agenda by themselves, in step too.

Characters the model lacks become byte pieces, and so does the model's own blank sign where
a text holds it, so decoding gives back every text exactly.

Defined cases: null text is empty and has no ids; equal texts get equal ids; texts of any length are encoded whole; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

BLANK = "▁"
UNITS = re.compile(" *[^ \n▁]+| +|\n|▁")
MASK = (1 << 64) - 1
# Odd multipliers and the finalizer of the published splitmix64 generator.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BEGIN, END = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
NEVER = float("-inf")
SHORT = 48
NONE = np.iinfo(np.int32).max
IN_STEP = 4_096
WORD = 21  # characters of a remembered unit: at most 3 * 20 candidates are popped, so the skipped ones fit 64 bits
UNKNOWN, ALONE = -1, -2
OFTEN = 8
MET = 1 << 22


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(FIRST)
    z = (z ^ z >> np.uint64(27)) * np.uint64(SECOND)
    return z ^ z >> np.uint64(31)


def draw(key: int, begin: int, end: int) -> int:
    """The keyed hash of the candidate whose symbols begin and end at these characters of the unit."""
    z = key + begin * BEGIN + end * END & MASK
    z = (z ^ z >> 30) * FIRST & MASK
    z = (z ^ z >> 27) * SECOND & MASK
    return z ^ z >> 31


PLACE = (np.arange(1 << 16, dtype=np.uint64) >> np.uint64(8)) * np.uint64(BEGIN) + (np.arange(1 << 16, dtype=np.uint64) & np.uint64(255)) * np.uint64(END)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(end, self.used // 2), self.data.dtype)])
        self.data[self.used : end] = values
        self.used = end

    def now(self) -> np.ndarray:
        return self.data[: self.used]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all slices start .. start + size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Paths:
    """Remembered nodes: a unit and its skipped candidates."""

    def __init__(self):
        self.root: dict[str, int] = {}
        self.units: list[str] = []
        self.unit, self.skipped = Pool(np.int32), Pool(np.uint64)
        self.at, self.size = Pool(np.int64), Pool(np.int64)  # of the places popped
        self.ids_at, self.ids_size = Pool(np.int64), Pool(np.int64)
        self.places, self.branch, self.ids = Pool(np.uint16), Pool(np.int32), Pool(np.int32)
        self.visits = Pool(np.int32)

    def __len__(self) -> int:
        return self.unit.used

    def add(self, unit: np.ndarray, skipped: np.ndarray, ids: np.ndarray, ids_size: np.ndarray, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = len(self)
        self.at.extend(self.places.used + np.cumsum(size) - size)
        self.ids_at.extend(self.ids.used + np.cumsum(ids_size) - ids_size)
        for pool, values in ((self.unit, unit), (self.skipped, skipped), (self.size, size), (self.ids_size, ids_size), (self.ids, ids), (self.places, places), (self.visits, np.zeros(len(unit)))):
            pool.extend(values)
        self.branch.extend(np.full(len(places), UNKNOWN))
        return np.arange(first, len(self), dtype=np.int32)

    def thinned(self, most: int) -> Paths:
        """What was visited most, ``most`` nodes or fewer, with half of its visits; a branch is visited no oftener than where it leaves from."""
        visits = self.visits.now()
        least = int(np.partition(visits, -most - 1)[-most - 1]) if most < len(visits) else 0
        keep = np.flatnonzero(visits > max(1, least))
        new = np.full(len(self) + 1, UNKNOWN, np.int32)
        new[keep] = np.arange(len(keep))
        out = Paths()
        roots = {u: int(new[n]) for u, n in self.root.items() if n >= 0 and new[n] >= 0}
        number = np.zeros(len(self.units), np.int32)
        number[self.unit.data[[int(keep[n]) for n in roots.values()]]] = np.arange(len(roots))
        out.root, out.units = roots, list(roots)
        at, size, ids_at, ids_size = (p.data[keep] for p in (self.at, self.size, self.ids_at, self.ids_size))
        there = spread(at, size)
        out.add(number[self.unit.data[keep]], self.skipped.data[keep], self.ids.data[spread(ids_at, ids_size)], ids_size, self.places.data[there], size)
        out.branch.data[: out.branch.used] = new[self.branch.data[there]]  # UNKNOWN is the last place
        out.visits.data[: len(keep)] = visits[keep] // 2
        return out


class DropoutBPE:
    """Encoder and decoder of one model, seed and rate."""

    def __init__(self, path: str | None = None, rate: float = 0.1, seed: int = 0, remembered: int = 200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        self.rate, self.seed, self.remembered = rate, seed & MASK, remembered
        self.limit = min(int(rate * (1 << 64)), MASK)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                if len(piece) > 1 and (re.search(f"[^{BLANK}]{BLANK}", piece) or "\n" in piece):
                    raise ValueError(f"the model has a piece that goes on after a word end: {piece!r}")
                plain = piece.replace(BLANK, " ")
                self.score[plain], self.id[plain] = sp.get_score(i), i
                self.raw.append(plain.encode())
        self._pair_tables()
        self.paths = Paths()
        self.met, self.marks = np.zeros(MET, bool), 0

    def keys(self, text: str, n: int) -> list[int]:
        """The hash keys of a text's ``n`` units."""
        return self._keys([text], [n]).tolist()

    def _keys(self, texts: list[str], counts: list[int]) -> np.ndarray:
        digest, seed, sizes = xxhash.xxh64_intdigest, self.seed, np.array(counts, np.int64)
        of_text = np.array([digest(t.encode("utf-8", "surrogatepass"), seed) for t in texts], np.uint64)
        return mixed(np.repeat(of_text, sizes) + (spread(np.ones(len(sizes), np.int64), sizes)).astype(np.uint64) * np.uint64(GOLDEN))

    def unit(self, unit: str, key: int) -> list[int]:
        """Ids of one occurrence of a unit, by the agenda."""
        # The model's blank sign is a space in these tables, so a text's own sign is an unknown character.
        pieces = self._short(unit, key) if len(unit) <= SHORT else self._long(unit, key)
        try:
            return [self.id[x] for x in pieces]
        except KeyError:
            return [i for x in pieces for i in ((self.id[x],) if x in self.id else (self.byte[b] for b in x.encode()))]

    def _short(self, text: str, key: int) -> list[str]:
        """The agenda as a list beside the symbols."""
        score, limit = self.score.get, self.limit
        symbols = list(text)
        begin = list(range(len(text) + 1))
        agenda = [score(a + b, NEVER) for a, b in zip(text, text[1:])]
        while agenda:
            best = max(agenda)
            if best == NEVER:
                break
            k = agenda.index(best)
            if limit and draw(key, begin[k], begin[k + 2]) < limit:
                agenda[k] = NEVER  # the keyed hash skips this merge
                continue
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k], begin[k + 1]
            if k < len(agenda):
                agenda[k] = score(symbols[k] + symbols[k + 1], NEVER)
            if k:
                agenda[k - 1] = score(symbols[k - 1] + symbols[k], NEVER)
        return symbols

    def _long(self, text: str, key: int) -> list[str]:
        """The same with a heap and linked symbols: in time for tokens of any length."""
        score, limit, n = self.score.get, self.limit, len(text)
        agenda: list[tuple] = []
        ends = list(range(1, n + 1))  # end of the symbol that starts at k; 0: merged away
        before = list(range(-1, n - 1))

        def propose(a: int) -> None:
            b = ends[a]
            if b < n:
                s = score(text[a : ends[b]])
                if s is not None:
                    heapq.heappush(agenda, (-s, a, b, ends[b]))

        for k in range(n - 1):
            propose(k)
        while agenda:
            _, a, b, e = heapq.heappop(agenda)
            if ends[a] != b or ends[b] != e or limit and draw(key, a, e) < limit:
                continue
            ends[a], ends[b] = e, 0
            if e < n:
                before[e] = a
            if before[a] >= 0:
                propose(before[a])
            propose(a)
        out, k = [], 0
        while k < n:
            out.append(text[k : ends[k]])
            k = ends[k]
        return out

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that the pieces a and b make together; -1: none. Open addressing with linear probing."""
        wanted = a.astype(np.int64) << 32 | b
        slot = self._slot(wanted)
        made = self.pair_piece[slot]
        found = self.pair_key[slot]
        made[found != wanted] = -1
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.pair_mask
            found = self.pair_key[slot[open_]]
            hit = found == wanted[open_]
            made[open_[hit]] = self.pair_piece[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return made

    def _slot(self, wanted: np.ndarray) -> np.ndarray:
        scattered = wanted.astype(np.uint64) * np.uint64(GOLDEN)
        return (scattered >> np.uint64(40)).astype(np.int64) & self.pair_mask

    def _pair_tables(self) -> None:
        """Every way to split a piece into two pieces, and the pieces' places in the order of scores."""
        splits = {(self.id[s[:k]] << 32 | self.id[s[k:]]): i for s, i in self.id.items() for k in range(1, len(s)) if s[:k] in self.id and s[k:] in self.id}
        keys, made = np.array(list(splits), np.int64), np.array(list(splits.values()), np.int32)
        self.pair_mask = (1 << max(10, (4 * len(keys)).bit_length())) - 1
        self.pair_key, self.pair_piece = np.full(self.pair_mask + 1, -1, np.int64), np.full(self.pair_mask + 1, -1, np.int32)
        slot = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.pair_key[slot[rest]] < 0]
            self.pair_key[slot[free]] = keys[free]  # of several at one place the last stays
            rest = rest[self.pair_key[slot[rest]] != keys[rest]]
            slot[rest] = slot[rest] + 1 & self.pair_mask
        self.pair_piece[slot] = made
        ranks = np.unique([-self.score[s] for s in self.id], return_inverse=True)[1]
        self.rank = np.full(len(self.raw) + 1, NONE, np.int32)  # the last place: no piece
        self.rank[list(self.id.values())] = ranks * (SHORT + 16)
        self.symbol = np.full(max((ord(c) for c in self.id if len(c) == 1), default=0) + 2, -1, np.int32)
        for c, i in self.id.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i

    def _symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First symbols and lengths of the units all of whose characters the model has, and which those are."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbol[np.minimum(points, len(self.symbol) - 1)]
        whole = np.minimum.reduceat(symbols, np.cumsum(sizes) - sizes) >= 0
        return symbols[np.repeat(whole, sizes)], sizes[whole], whole

    def _in_step(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, skips: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed ids and their numbers, and the places popped and their numbers, of units of at most ``SHORT`` characters.

        The agendas are columns of one table: each round pops the best candidate of every
        column, skips it (by its keyed hash, or where the round's bit in ``skips`` is set) or merges. An entry is the score's place and the row, so ties
        go to the left as in the agenda of one unit."""
        n, height = len(sizes), int(sizes.max())
        cols = np.arange(n)
        rows = np.arange(height)
        table = np.full((height + 1, n), -1, np.int32)
        inside = rows[:, None] < sizes
        table[:-1].T[inside.T] = symbols
        made = np.full((height + 1, n), -1, np.int32)
        made[:-2][inside[1:]] = self._lookup(table[:-2][inside[1:]], table[1:-1][inside[1:]])
        agenda = np.where(made >= 0, self.rank[made] + np.arange(height + 1)[:, None], NONE).astype(np.int32)
        after = np.repeat(np.arange(1, height + 2)[:, None], n, 1).astype(np.int8)
        after[:-1][~inside] = height
        after[sizes - 1, cols] = height
        before = np.repeat(np.arange(-1, height)[:, None], n, 1).astype(np.int8)
        popped = np.zeros(n, np.int64)
        rounds: list[np.ndarray] = []
        live = cols
        while len(live):
            best = agenda.min(0)[live]  # cheaper than to gather the live columns
            going = best < NONE
            if not going.all():
                live, best = live[going], best[going]
                if not len(live):
                    break
            k = best % (SHORT + 16)
            right = after[k, live]
            end = after[right, live]
            place = np.zeros(n, np.uint16)
            place[live] = k << 8 | np.minimum(end, sizes[live])
            rounds.append(place)
            agenda[k, live] = NONE
            popped[live] += 1
            merging = live
            if skips is not None or keys is not None:
                if skips is not None:
                    kept = skips[live] >> np.uint64(len(rounds) - 1) & np.uint64(1) == 0
                else:
                    kept = mixed(keys[live] + PLACE[place[live]]) >= np.uint64(self.limit)
                merging, k, right, end = live[kept], k[kept], right[kept], end[kept]
            table[k, merging] = made[k, merging]
            table[right, merging] = -1
            agenda[right, merging] = NONE
            after[k, merging] = end
            before[end, merging] = k
            left = before[k, merging]
            has_left, has_right = left >= 0, end < height
            a = np.concatenate([left[has_left], k[has_right]])
            b = np.concatenate([k[has_left], end[has_right]])
            at = np.concatenate([merging[has_left], merging[has_right]])
            new = self._lookup(table[a, at], table[b, at])
            made[a, at] = new
            agenda[a, at] = np.where(new >= 0, self.rank[new] + a, NONE)
        present = (table[:-1] >= 0).T
        places = np.stack(rounds, 1)[np.arange(len(rounds)) < popped[:, None]] if rounds else np.zeros(0, np.uint16)
        return table[:-1].T[present], present.sum(1), places, popped

    def _by_length(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), IN_STEP):
            yield order[k : k + IN_STEP]

    def _compute(self, numbers: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """New nodes of remembered units (by their numbers in ``paths.units``) with these skipped candidates."""
        units, out = self.paths.units, np.zeros(len(numbers), np.int32)
        for part in self._by_length(np.fromiter((len(units[i]) for i in numbers.tolist()), np.int64, len(numbers))):
            symbols, sizes, _ = self._symbols([units[i] for i in numbers[part].tolist()])
            out[part] = self.paths.add(numbers[part], skipped[part], *self._in_step(symbols, sizes, None, skipped[part]))
        return out

    def _learn(self, units: list[str]) -> None:
        """Roots of units not met before; those with unknown characters go by themselves each time."""
        paths = self.paths
        whole = self._symbols(units)[2]
        paths.root.update((units[i], ALONE) for i in np.flatnonzero(~whole).tolist())
        known = [units[i] for i in np.flatnonzero(whole).tolist()]
        first = len(paths.units)
        paths.units += known
        if known:
            made = self._compute(np.arange(first, first + len(known)), np.zeros(len(known), np.uint64))
            paths.root.update(zip(known, made.tolist()))

    def _met(self, units: list[str]) -> np.ndarray:
        """Which units came before, by a table of marks (several units may share one), or come twice here."""
        if self.marks > MET // 4:
            self.met[:], self.marks = False, 0
        slot = np.fromiter(map(hash, units), np.int64, len(units)) & (MET - 1)
        _, of, count = np.unique(slot, return_inverse=True, return_counts=True)
        again = self.met[slot] | (count[of] > 1)
        self.met[slot] = True
        self.marks += int((~again).sum())
        return again

    def _walk(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where each occurrence ends: past the branches of all candidates that its hashes skip. ALONE: past one that isn't remembered yet."""
        paths, limit = self.paths, np.uint64(self.limit)
        node, done = node.copy(), np.zeros(len(node), np.int64)
        live = np.arange(len(node))
        while len(live):
            np.add.at(paths.visits.data, node[live], 1)
            sizes = paths.size.data[node[live]] - done[live]
            places = spread(paths.at.data[node[live]] + done[live], sizes)
            of = np.repeat(live, sizes)
            hit = np.flatnonzero(mixed(key[of] + PLACE[paths.places.data[places]]) < limit)
            of = of[hit]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            live, slot = of[first], places[hit[first]]
            goes = paths.branch.data[slot]
            rare = (goes == UNKNOWN) & (paths.visits.data[node[live]] < OFTEN)
            if rare.any():
                node[live[rare]] = ALONE
                live, slot, goes = live[~rare], slot[~rare], goes[~rare]
            if (goes == UNKNOWN).any():
                new, where = np.unique(slot[goes == UNKNOWN], return_index=True)
                leaves = node[live[goes == UNKNOWN][where]]
                turn = (new - paths.at.data[leaves]).astype(np.uint64)
                made = self._compute(paths.unit.data[leaves], paths.skipped.data[leaves] | np.uint64(1) << turn)
                paths.branch.data[new] = made
                goes = paths.branch.data[slot]
            done[live] = slot - paths.at.data[node[live]] + 1
            node[live] = goes
        return node

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        if max(len(self.paths), len(self.paths.root)) >= self.remembered:
            self.paths = self.paths.thinned(self.remembered // 2)
        units: list[str] = []
        counts = []
        for text in texts:
            own = UNITS.findall(" " + text) if text else []
            units += own
            counts.append(len(own))
        if not units:
            return [b""] * len(texts)
        key = self._keys(texts, counts)
        root = self.paths.root.get
        node = np.fromiter(map(root, units, repeat(UNKNOWN)), np.int32, len(units))
        lacking = np.flatnonzero(node == UNKNOWN)
        if len(lacking):
            node[lacking] = ALONE
            names = [units[i] for i in lacking.tolist()]
            again = np.flatnonzero(self._met(names)).tolist()
            new = dict.fromkeys(names[i] for i in again if len(names[i]) <= WORD)
            if new:
                self._learn(list(new))
                node[lacking[again]] = [root(names[i], ALONE) for i in again]
        if self.limit:
            shared = np.flatnonzero(node >= 0)
            node[shared] = self._walk(node[shared], key[shared])
        apart = np.flatnonzero(node == ALONE)
        shared = np.flatnonzero(node >= 0)
        where = node[shared]
        paths = self.paths
        sizes = np.zeros(len(units), np.int64)
        sizes[shared] = paths.ids_size.data[where]
        alone = self._apart([units[i] for i in apart.tolist()], key[apart])
        sizes[apart] = [len(x) for x in alone]
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]), "<i4")
        out[spread(ends[shared] - sizes[shared], sizes[shared])] = paths.ids.data[spread(paths.ids_at.data[where], sizes[shared])]
        for end, ids in zip(ends[apart].tolist(), alone):
            out[end - len(ids) : end] = ids
        last = np.concatenate([[0], ends])[np.cumsum(counts)].tolist()
        return [out[a:b].tobytes() for a, b in zip([0, *last], last)]

    def _apart(self, units: list[str], key: np.ndarray) -> list:
        """Occurrences that are not remembered: rare or long units, rare branches, and units with unknown characters."""
        out: list = [None] * len(units)
        middle = [i for i, u in enumerate(units) if len(u) <= SHORT]
        for part in self._by_length(np.fromiter((len(units[i]) for i in middle), np.int64, len(middle))):
            at = np.array(middle)[part]
            symbols, sizes, whole = self._symbols([units[i] for i in at.tolist()])
            if len(sizes):
                ids, n, _, _ = self._in_step(symbols, sizes, key[at[whole]] if self.limit else None, None)
                ends = np.cumsum(n).tolist()
                for i, a, b in zip(at[whole].tolist(), [0, *ends], ends):
                    out[i] = ids[a:b]
        return [self.unit(units[i], int(key[i])) if x is None else x for i, x in enumerate(out)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode() if ids else ""


@lru_cache(maxsize=2)
def _model(path: str | None, rate: float, seed: int) -> DropoutBPE:
    """One model for all tasks of a Python worker, with what it remembers."""
    return DropoutBPE(path, rate, seed)


def encode_documents(docs: DataFrame, path: str | None = None, rate: float = 0.1, seed: int = 0, at_once: int = 1 << 18) -> DataFrame:
    """Columns doc_id, ids, n_tokens, ids_crc32 (over 32-bit little-endian ids), lossless (decoding gave
    the text) and decoded_sha256. ``at_once``: characters encoded together."""

    def make():
        model = _model(path, rate, seed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            parts, group, held = [], [], 0
            for text in texts:
                group.append(text)
                held += len(text)
                if held >= at_once:
                    parts += model.packed(group)
                    group, held = [], 0
            parts += model.packed(group)
            same, digests = [], []
            for data, text in zip(parts, texts):
                back = model.decode(np.frombuffer(data, "<i4").tolist())
                same.append(back == text)
                digests.append(hashlib.sha256(back.encode()).hexdigest())
            sizes = [len(data) // 4 for data in parts]
            sums = [zlib.crc32(data) for data in parts]
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same), pa.array(digests, pa.string())],
                names=["doc_id", "ids", "n_tokens", "ids_crc32", "lossless", "decoded_sha256"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs))
    return map_batches(rows, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean, decoded_sha256 string", make)
