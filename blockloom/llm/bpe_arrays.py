"""BPE over many short words at once, in numpy.

`Merges` carries out the merges of all words side by side: a matrix of ids, one row a word,
and in each round the lowest-ranked neighbours of every row become one. `Prefixes` finds the
unique last token of every prefix of all words side by side; a prefix that several words share
is looked at once. `Table` is the hash table that both ask.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

NONE = np.iinfo(np.int32).max
U = np.uint64
_FACTOR = U(0x9E3779B97F4A7C15)


class Table:
    """Non-negative 64-bit keys to values, by open addressing; arrays go in and out. Absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._room(max(16, 4 * len(keys)))
        self.add(keys, values)

    def _room(self, least: int) -> None:
        bits = int(least - 1).bit_length()
        self.shift, self.mask, self.used = U(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)

    def __len__(self) -> int:
        return self.used

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self._room(4 * (self.used + len(keys) + len(old[0])))
            self.add(*old)
        keys, values = np.ascontiguousarray(keys, np.int64), np.asarray(values, np.int64)
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys at one slot the last one wins
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.int64)
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot_ = slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot_]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slot_[hit]]
            rest = rest[~hit & (held >= 0)]
        return out


class Merges:
    """`left`, `right` and `product` list the merges by falling priority."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray) -> None:
        self.table = Table(left.astype(np.int64) << 32 | right.astype(np.int64), np.arange(len(left)))
        self.product = product.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Priority of each merge, NONE where there is none; ids of -1 have none."""
        good = (left >= 0) & (right >= 0)
        out = np.full(left.shape, NONE, np.int32)
        some = self.table.get(left[good].astype(np.int64) << 32 | right[good].astype(np.int64))
        out[good] = np.where(some >= 0, some, NONE)
        return out

    def encode(self, ids: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Rows of ids, padded with -1, after all merges; works in place and returns them. The two ids
        of each row's last merge are written to the rows of `last`, if given."""
        n, wide = ids.shape
        if not n or wide < 2:
            return ids
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        active = np.arange(n)
        cols = np.arange(wide)
        while len(active):
            r = rank[active]
            at = r.argmin(1)
            best = r[np.arange(len(r)), at]
            more = best < NONE
            active, at, r, best = active[more], at[more], r[more], best[more]
            if not len(active):
                break
            rows = np.arange(len(active))
            sub = ids[active]
            if last is not None:
                last[active, 0], last[active, 1] = sub[rows, at], sub[rows, at + 1]
            sub[rows, at] = self.product[best]
            sub = np.take_along_axis(np.pad(sub, ((0, 0), (0, 1)), constant_values=-1), cols + (cols > at[:, None]), 1)
            r = np.take_along_axis(np.pad(r, ((0, 0), (0, 1)), constant_values=NONE), cols[:-1] + (cols[:-1] >= at[:, None]), 1)
            inside = np.flatnonzero(at > 0)
            r[inside, at[inside] - 1] = self.ranks(sub[inside, at[inside] - 1], sub[inside, at[inside]])
            inside = np.flatnonzero(at < wide - 1)
            r[inside, at[inside]] = self.ranks(sub[inside, at[inside]], sub[inside, at[inside] + 1])
            ids[active], rank[active] = sub, r
        return ids


def byte_matrix(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words as rows padded with zeros, and the words' lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(length.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, length


def rank_merges(ranks: dict[bytes, int]) -> Merges:
    """The merges that a table of ranks stands for: any two tokens whose bytes make a third. Ranks
    of merges are the places in the sorted table, so that equal products keep one order."""
    found = [(rank, ranks[t[:i]], ranks[t[i:]]) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    table = np.array(sorted(found), np.int64).reshape(-1, 3)
    return Merges(table[:, 1], table[:, 2], table[:, 0])


class Prefixes:
    """Last token of every prefix, for many words at once.

    A token may end a prefix if byte-pair encoding leaves it apart from the last token before it. Two
    tokens stay apart if no merge across their border would have come before the merges that made
    them. That is told by undoing their merges, the later one first, down to the border: at each
    step the neighbours there must have no merge of lower rank than the one undone last."""

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = 1_000_000) -> None:
        self.merges = rank_merges(ranks)
        self.most_pairs = most_pairs
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        # how a token was made, (0, 1); single bytes are made of nothing
        self.parts = np.full((len(self.tokens), 2), -1, np.int64)
        self.alone = np.zeros(len(self.tokens), bool)  # tokens that encoding makes of their own bytes
        self._tree(ranks)
        self.pairs = Table(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _tree(self, ranks: dict[bytes, int]) -> None:
        """Tree of the tokens read backwards. Tokens that BPE never makes stay out."""
        tokens = sorted(ranks, key=len)
        for lo in range(0, len(tokens), 5000):
            some = tokens[lo : lo + 5000]
            matrix, length = byte_matrix(some)
            last = np.full((len(some), 2), -1, np.int64)
            out = self.merges.encode(np.where(np.arange(matrix.shape[1]) < length[:, None], self.single[matrix], -1).astype(np.int32), last)
            own = np.array([ranks[t] for t in some], np.int64)
            self.alone[own] = (out[:, 0] == own) & ((out[:, 1] if out.shape[1] > 1 else -1) == -1)
            self.parts[own] = last
        edges: dict[int, int] = {}
        ends = [-1]
        for token, rank in ranks.items():
            if not self.alone[rank]:
                continue
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = rank
        self.edges = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.ends = np.array(ends, np.int64)

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves these two tokens (each alone what BPE makes of its bytes) as they are."""
        n = len(left)
        out = np.ones(n, bool)
        rows, a, b = np.arange(n), left.astype(np.int64), right.astype(np.int64)
        # merges across the border count if they come before the merge that was undone last: (rank,
        # strictly) if that was on the left, where the border lies behind it, else (rank or equal)
        limit = np.full(n, NONE, np.int64)
        while len(rows):
            across = self.merges.table.get(a << 32 | b)
            product = np.where(across >= 0, self.merges.product[across], NONE).astype(np.int64)
            bad = product < limit
            out[rows[bad]] = False
            rank_a = np.where(self.parts[a, 0] >= 0, a, -1)
            rank_b = np.where(self.parts[b, 0] >= 0, b, -1)
            go = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            rows, a, b, rank_a, rank_b = rows[go], a[go], b[go], rank_a[go], rank_b[go]
            undo_left = rank_a > rank_b
            limit = np.where(undo_left, rank_a, rank_b + 1)
            a, b = np.where(undo_left, self.parts[a, 1], a), np.where(undo_left, b, self.parts[b, 0])
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`stay`, with what is known already kept in a bounded table."""
        key = left << 32 | right
        known = self.pairs.get(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh, place = np.unique(key[new], return_inverse=True)
            fine = self.stay(fresh >> 32, fresh & 0xFFFFFFFF)
            if len(self.pairs) + len(fresh) > self.most_pairs:
                self.pairs = Table(np.zeros(0, np.int64), np.zeros(0, np.int64))
            self.pairs.add(fresh, fine)
            known[new] = fine[place]
        return known == 1

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. Words are best in byte order,
        since a prefix is looked at once if the word before has it too."""
        matrix, length = byte_matrix(words)
        n, wide = matrix.shape
        if not wide:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        inside = np.arange(wide) < length[:, None]
        same = np.zeros((n, wide), bool)  # prefixes that the word before has too
        same[1:] = np.logical_and.accumulate((matrix[1:] == matrix[:-1]) & inside[1:] & inside[:-1], axis=1)
        end, row = np.nonzero((inside & ~same).T)
        end += 1
        bounds = np.searchsorted(end, np.arange(1, wide + 2))
        node, alive = np.zeros(len(row), np.int64), np.arange(len(row))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for back in range(1, wide + 1):
            node = self.edges.get(node << 8 | matrix[row[alive], end[alive] - back])
            alive, node = alive[node >= 0], node[node >= 0]
            token = self.ends[node]
            hit = token >= 0
            found.append((alive[hit], np.full(int(hit.sum()), back), token[hit]))
            more = end[alive] > back
            alive, node = alive[more], node[more]
            if not len(alive):
                break
        entry, back, token = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(entry, kind="stable")  # entries come by their end
        entry, back, token = entry[order], back[order], token[order]
        at = np.searchsorted(entry, bounds)
        last = np.full((wide + 1, n), -1, np.int64)
        for e in range(1, wide + 1):
            some = slice(at[e - 1], at[e])
            r, b, t = row[entry[some]], e - back[some], token[some]
            good = b == 0
            inner = np.flatnonzero(~good)
            if len(inner):
                good[inner] = self._apart(last[b[inner], r[inner]], t[inner])
            last[e, r[good]] = t[good]
            owner = np.where(same[:, e - 1], 0, np.arange(n))
            last[e] = last[e, np.maximum.accumulate(owner)]
        at, backwards, rows = length.copy(), [], np.arange(n)
        while (at > 0).any():
            some = np.where(at > 0, last[at, rows], -1)
            backwards.append(some)
            at = at - np.where(at > 0, self.size[some], 0)
        table = np.stack(backwards[::-1], 1)
        return table[table >= 0], (table >= 0).sum(1)
