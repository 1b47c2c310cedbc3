"""Sorting the suffixes of a shard by induction, with common-prefix values.

Suffixes that start a rising run after a fall seed the order; all others are
induced from a suffix one place on, taken in order: a pop of suffix i yields
suffix i - 1 for the queue of its first byte. A queue entry carries the suffix
and the pop it came from; its common prefix with its neighbour in the queue is
one more than the least common prefix between the two pops. Since pops are in
order, each queue fills in order, and the 256 queues together are a priority
queue by (byte, pop). Entries beyond ``SPILL`` bytes go to an anonymous file of
the task, read back in turn. The seeds themselves are sorted the same way,
then named, and the text of names is ranked by naming pairs of names until all
differ, each round doubling the reach.
"""

from __future__ import annotations

import tempfile

import numpy as np

SPILL = 64 << 20


class Queues:
    """One first-in first-out queue of (position, source) per byte, on disk beyond a bound."""

    def __init__(self, spill: int = SPILL):
        self.parts: dict[int, list] = {}
        self.held, self.spill, self.file = 0, spill, None

    def push(self, byte: int, position: np.ndarray, source: np.ndarray) -> None:
        self.parts.setdefault(byte, []).append((position, source))
        self.held += position.nbytes + source.nbytes
        if self.held > self.spill:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, part in enumerate(parts):
                if not isinstance(part, int):
                    parts[k] = self.file.tell()
                    np.save(self.file, part[0])
                    np.save(self.file, part[1])
        self.held = 0

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for part in self.parts.pop(byte, []):
            if isinstance(part, int):
                self.file.seek(part)
                part = (np.load(self.file), np.load(self.file))
            else:
                self.held -= part[0].nbytes + part[1].nbytes
            found.append(part)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])


def _by_byte(text: np.ndarray, positions: np.ndarray) -> dict[int, np.ndarray]:
    """Indices into ``positions`` per first byte, in the given order."""
    first = text[positions]
    order = np.argsort(first, kind="stable")
    values, begins = np.unique(first[order], return_index=True)
    return {int(v): part for v, part in zip(values, np.split(order, begins[1:]))}


def _sweep(text, run, wanted, seeds, seed_common, rising: bool):
    """One pass over the bytes. Returns per byte the induced positions and common prefixes, in pop order.

    ``seeds`` are in pop order; within a byte they come after the induced ones.
    """
    queues, common, base = Queues(), np.zeros(len(text) + len(seeds) + 1, dtype=np.int32), 0
    seeded = _by_byte(text, seeds)
    values = np.unique(text)
    out = {}

    def send(byte, positions, first):
        """Queue the wanted predecessors of popped suffixes; those of the same byte are returned."""
        before = positions - 1
        keep = np.flatnonzero((positions > 0) & wanted[before] & (text[before] > 0))
        before, source = before[keep], keep + first
        own = None
        for b, rows in _by_byte(text, before).items():
            if b == byte:
                own = (before[rows], source[rows])
            else:
                queues.push(b, before[rows], source[rows])
        return own

    for byte in values if rising else values[::-1]:
        byte = int(byte)
        block = queues.pop(byte)
        done, last = [], None
        while block is not None and len(block[0]):
            position, source = block
            chain = source if last is None else np.concatenate([[last], source])
            value = np.zeros(len(position), dtype=np.int32)
            if len(chain) > 1:
                least = np.minimum.reduceat(common[: chain[-1] + 1], chain[:-1] + 1)
                value[len(position) - len(least) :] = least + 1
            common[base : base + len(position)] = value
            done.append((position, value))
            last = int(source[-1])
            block = send(byte, position, base)
            base += len(position)
        if done:
            out[byte] = (np.concatenate([p for p, _ in done]), np.concatenate([v for _, v in done]))
        rows = seeded.get(byte)
        if rows is not None:
            position, value = seeds[rows], seed_common[rows].copy()
            value[0] = min(run[out[byte][0][-1]], run[position[0]]) if byte in out else 0
            common[base : base + len(position)] = value
            send(byte, position, base)
            base += len(position)
    return out


def _induce(text, run, small, seeds, seed_common):
    """Positions and common prefixes of the falling, then of the rising suffixes, per byte."""
    falling = _sweep(text, run, ~small, seeds, seed_common, rising=True)
    bytes_down = sorted(falling, reverse=True)
    if bytes_down:
        back = np.concatenate([falling[b][0][::-1] for b in bytes_down])
        # the common prefix with the neighbour popped before, which is the next one up
        shared = np.concatenate([np.concatenate([[0], falling[b][1][:0:-1]]) for b in bytes_down]).astype(np.int32)
    else:
        back, shared = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    rising = _sweep(text, run, small, back, shared, rising=False)
    return falling, rising


def sorted_suffixes(text: np.ndarray):
    """Yield runs (positions, common prefix with the one before) that make up the suffix order.

    ``text`` has 0 after each of its strings and 1 to 256 elsewhere; a 0 is
    less than all else and equal to no other 0, so no prefix passes one.
    """
    n = len(text)
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]])) + 1
    following = change[np.searchsorted(change, np.arange(n), "right")]
    run = (following - np.arange(n)).astype(np.int32)
    run[text == 0] = 1
    small = text < text[np.minimum(following, n - 1)]
    small[text == 0] = True
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds):
        order, common = _sorted_seeds(text, run, small, seeds)
        falling, rising = _induce(text, run, small, seeds[order], common)
    else:
        falling, rising = _induce(text, run, small, seeds, np.zeros(0, dtype=np.int32))
    for byte in sorted(set(falling) | set(rising)):
        position, value = falling.get(byte, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)))
        up, shared = rising.get(byte, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)))
        up = up[::-1]
        shared = np.concatenate([[0], shared[:0:-1]]).astype(np.int32)[: len(up)]
        if len(position) and len(up):
            shared[0] = min(run[position[-1]], run[up[0]])
        yield np.concatenate([position, up]), np.concatenate([value, shared])


def _sorted_seeds(text, run, small, seeds):
    """Order of the seed suffixes, and their common prefixes with the seed before."""
    m = len(seeds)
    order = seeds[np.argsort(text[seeds], kind="stable")]
    _, rising = _induce(text, run, small, order, np.zeros(m, dtype=np.int32))
    index = np.full(len(text), -1, dtype=np.int64)
    index[seeds] = np.arange(m)
    ends = index[seeds[text[seeds] == 0]]
    inner = [rising[b][0][::-1] for b in sorted(rising) if b > 0]
    found = index[np.concatenate(inner)] if inner else np.zeros(0, dtype=np.int64)
    ranked = np.concatenate([ends, found[found >= 0]])
    # name the pieces from seed to seed; equal ones share a name, string ends are their own
    length = np.concatenate([np.diff(seeds), [1]])
    a, b = ranked[:-1], ranked[1:]
    same = (text[seeds[a]] > 0) & (text[seeds[b]] > 0) & (length[a] == length[b])
    same &= _common(text, seeds[a], seeds[b], np.where(same, length[a] + 1, 0)) > length[a]
    name = np.empty(m, dtype=np.int64)
    name[ranked] = np.concatenate([[0], np.cumsum(~same)])
    levels, step = [name], 1
    while name.max() < m - 1:
        beyond = np.concatenate([name[step:], np.full(min(step, m), -1, dtype=np.int64)])[:m] + 1
        key = name * (m + 1) + beyond
        by = np.argsort(key, kind="stable")
        name = np.empty(m, dtype=np.int64)
        name[by] = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
        levels.append(name)
        step *= 2
    order = np.argsort(name)
    a, b = order[:-1].copy(), order[1:].copy()
    begin = seeds[a].copy()
    for k in range(len(levels) - 1, -1, -1):
        equal = np.flatnonzero((a < m) & (b < m))
        equal = equal[levels[k][a[equal]] == levels[k][b[equal]]]
        a[equal] += 1 << k
        b[equal] += 1 << k
    a, b = np.minimum(a, m - 1), np.minimum(b, m - 1)
    extra = _common(text, seeds[a], seeds[b], np.full(len(a), len(text)))
    return order, np.concatenate([[0], seeds[a] - begin + extra]).astype(np.int32)


def _common(text, a, b, most) -> np.ndarray:
    """Lengths of common prefixes at pairs of places, up to ``most`` and never past a 0."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        x, y = a[live] + step, b[live] + step
        ok = (x < len(text)) & (y < len(text))
        ok[ok] = (text[x[ok]] == text[y[ok]]) & (text[x[ok]] > 0)
        live = live[ok]
        out[live] += 1
        step += 1
        live = live[most[live] > step]
    return out
