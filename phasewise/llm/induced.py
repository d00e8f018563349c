"""Suffix arrays and common prefixes by external induced sorting, in numpy.

Sort the suffixes that start at a left-most S position (recursively, on the names of the
substrings between them), then induce all L suffixes from them in ascending order and all S
suffixes from those in descending order.  The queues of both scans are arrays of tuples
(position, common prefix) that are ordered by first character and filled at one head per
character.  All tuples before the first empty place are final, so they are taken together: a
scan is a series of batches, each a few vector operations.  The queues are
unnamed temporary files; a scan reads them in order and writes at their heads.

A suffix that is induced by another has one more character in common with its neighbour than
the two suffixes that induced them; the smallest common prefix between those is kept per
first character.  Common prefixes are exact up to a limit and cut there.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples taken together at most.
BATCH = 1 << 15


def queue(size: int, kind: type, fill: int) -> np.ndarray:
    file = tempfile.TemporaryFile()  # gone when the array is
    own = np.asarray(np.memmap(file, kind, "w+", shape=(size,)))
    own[:] = fill
    return own


def s_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end is smaller than any character."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    differs = np.append(text[1:] != text[:-1], True)
    smaller = np.append(text[:-1] < text[1:], False)
    places = np.flatnonzero(differs)
    return smaller[np.repeat(places, np.diff(places, prepend=-1))]


def names(text: np.ndarray, is_s: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of the substrings from each start to the next one, both ends included."""
    n = len(text)
    code = np.zeros(n + 1, np.int32)
    code[:n] = text
    code[:n] = code[:n] * 2 + is_s + 1
    bits = max(1, int(code.max()).bit_length())
    each = 63 // bits
    length = np.append(starts[1:], n) - starts + 1  # the last one takes in the end
    rank = np.zeros(len(starts), np.int32)
    rows = None
    done = 0
    while rows is None or len(rows):
        at, left = (starts, length) if rows is None else (starts[rows] + done, length[rows] - done)
        key = np.zeros(len(at), np.int64)
        for k in range(each):
            key <<= bits
            key |= np.where(left > k, code[np.minimum(at + k, n)], 0)
        if rows is None:
            rows = np.arange(len(starts), dtype=np.int32)
            order = np.argsort(key)
        else:
            order = np.lexsort((key, rank[rows]))
        rows, key = rows[order], key[order]
        own = rank[rows]
        change = np.append(False, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        # ranks are first places among all rows, so that refining one group leaves the others alone
        group = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        base = np.repeat(group, np.diff(np.append(group, len(own))))
        place = np.maximum.accumulate(np.where(change, np.arange(len(own)), 0))
        rank[rows] = own + np.maximum(place, base) - base
        done += each
        # only ties of substrings with more characters go on
        tied = np.zeros(len(own), bool)
        tied[1:] = ~change[1:]
        tied[:-1] |= ~change[1:]
        rows = rows[tied]
        rows = rows[length[rows] > done]
    used = np.zeros(len(starts), bool)
    used[rank] = True
    return np.cumsum(used, dtype=np.int32)[rank], int(used.sum())


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Characters that the suffixes at a and b have in common, up to the limit; eight at a time while they agree."""
    n = len(text)
    result = np.zeros(len(a), np.int64)
    if text.dtype == np.uint8 and n >= 8:
        words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (n - 7,), (1,))
        rows = np.arange(len(a))
        while len(rows):
            x, y = a[rows] + result[rows], b[rows] + result[rows]
            good = (x < n - 7) & (y < n - 7) & (result[rows] < limit)
            rows = rows[good]
            rows = rows[words[x[good]] == words[y[good]]]
            result[rows] += 8
    rows = np.arange(len(a))
    while len(rows):
        x, y = a[rows] + result[rows], b[rows] + result[rows]
        good = (x < n) & (y < n) & (result[rows] < limit)
        rows = rows[good]
        rows = rows[text[x[good]] == text[y[good]]]
        result[rows] += 1
    return np.minimum(result, limit)


class RangeMinimum:
    """Smallest value of ranges of one batch."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while width * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of values[low:high], high > low."""
        level = np.frexp((high - low).astype(float))[1] - 1
        result = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            table = self.levels[k]
            result[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return result


class Scan:
    """One scan over a queue of tuples grouped by first character, forwards or backwards.

    places: the tuples, -1 where one has to come; heads: the next place of each character;
    shared: common prefix of a tuple with the one scanned before it.
    """

    def __init__(self, text, is_s, places, heads, step, shared=None, limit=0):
        n = len(places)
        self.text, self.step = text, step
        self.wanted = np.zeros(len(text) + 1, bool)  # the last one stands for "before the first"
        self.wanted[:-1] = is_s if step < 0 else ~is_s
        # scanned from the left in either direction
        self.places = places if step > 0 else places[::-1]
        self.heads = heads if step > 0 else n - 1 - heads
        self.shared = shared if shared is None or step > 0 else shared[::-1]
        self.limit = limit
        self.count = np.arange(BATCH)
        if shared is not None:
            self.least = np.zeros(len(heads), np.int64)
            self.seen = np.zeros(len(heads), bool)

    def run(self, borders: np.ndarray) -> None:
        """borders: places whose common prefix with the one scanned before is not yet known."""
        places, n = self.places, len(self.places)
        borders = np.sort(borders) if self.step > 0 else np.sort(n - 1 - borders)
        at, width = 0, 64  # tuples scanned
        while at < n:
            upto = at
            while upto < n and upto - at < BATCH:
                empty = places[upto:min(upto + width, at + BATCH)] < 0
                k = int(empty.argmax())
                if empty[k]:
                    upto += k
                    break
                upto += len(empty)
                width = min(width * 2, BATCH)
            if upto == at:
                raise AssertionError("a queue has a gap")
            width = max(64, min(2 * (upto - at), BATCH))
            batch = np.asarray(places[at:upto])
            if self.shared is None:
                self._induce(batch)
            else:
                for b in borders[np.searchsorted(borders, at):np.searchsorted(borders, upto)].tolist():
                    self.shared[b] = common(self.text, np.asarray(places[b - 1:b]), np.asarray(places[b:b + 1]), self.limit)[0]
                self._induce(batch, np.asarray(self.shared[at:upto]).astype(np.int64))
            at = upto

    def _induce(self, batch: np.ndarray, shared: np.ndarray | None = None) -> None:
        before = batch - 1
        good = self.wanted[before]
        before = before[good]
        size = len(before)
        if not size:
            if shared is not None:
                self.least = np.minimum(self.least, shared.min())
            return
        keys = self.text[before]
        order = keys.argsort(kind="stable")
        keys, before = keys[order], before[order]
        target = self.heads[keys]
        again = keys[1:] == keys[:-1]
        if again.any():  # the number of each tuple among those of its character
            first = self.count[:size].copy()
            first[1:][again] = 0
            target += self.count[:size] - np.maximum.accumulate(first)
        self.places[target] = before
        self.heads[keys] = target + 1  # the last one of a character stays
        if shared is None:
            return
        # the smallest common prefix since the last tuple that led to the same character
        first = np.flatnonzero(np.append(True, ~again))
        chars = keys[first]
        source = np.flatnonzero(good)[order]
        low = np.append(0, source[:-1] + 1)
        low[first] = 0
        ranges = RangeMinimum(shared)
        value = ranges(low, source + 1)
        value[first] = np.where(self.seen[chars], np.minimum(value[first], self.least[chars]), -1)
        self.shared[target] = np.minimum(value + 1, self.limit)
        self.seen[chars] = True
        self.least = np.minimum(self.least, shared.min())
        last = source[np.append(first[1:], size) - 1] + 1
        self.least[chars] = self.limit
        rest = last < len(shared)
        self.least[chars[rest]] = ranges(last[rest], np.full(rest.sum(), len(shared)))


def suffixes(text: np.ndarray, limit: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of an array of numbers >= 0 (8 bits are fastest), and with a limit the characters that each
    suffix has in common with the next one in order (the last: 0), up to the limit."""
    n = len(text)
    kind = np.int32 if n < 2 ** 31 - 2 else np.int64
    if n < 2:
        return np.zeros(n, kind), np.zeros(n, np.int64) if limit else None
    is_s = s_type(text)
    starts = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(kind)
    if len(starts) > 1:
        name, count = names(text, is_s, starts)
        seeds = starts[np.argsort(name)] if count == len(starts) else starts[suffixes(name)[0]]
    else:
        seeds = starts
    sigma = int(text.max()) + 1
    l_count = np.bincount(text[~is_s], minlength=sigma)
    seed_count = np.bincount(text[seeds], minlength=sigma)
    # forwards: for each character its L suffixes, then its seeds; the end comes first of all
    total = np.cumsum(l_count + seed_count)
    begin = total - l_count - seed_count + 1
    places = queue(int(total[-1]) + 1, kind, -1)
    places[0] = n
    rank = np.arange(len(seeds), dtype=kind)
    seed_first = np.cumsum(seed_count) - seed_count
    seed_char = text[seeds]
    seed_place = (begin + l_count - seed_first)[seed_char].astype(kind) + rank
    places[seed_place] = seeds
    shared = None
    borders = np.zeros(0, np.int64)
    if limit:
        shared = queue(len(places), np.int16, 0)
        first = rank == seed_first[seed_char]
        if len(seeds) > 1:
            value = np.append(0, common(text, seeds[:-1], seeds[1:], limit))
            shared[seed_place] = np.where(first, 0, value)
        borders = seed_place[first & (l_count[seed_char] > 0)]
    Scan(text, is_s, places, begin.copy(), 1, shared, limit).run(borders)
    # backwards: for each character its L suffixes, then its S suffixes
    s_count = np.bincount(text[is_s], minlength=sigma)
    total = np.cumsum(l_count + s_count)
    start = total - l_count - s_count
    array = queue(n, kind, -1)
    l_first = np.repeat(start - (np.cumsum(l_count) - l_count), l_count).astype(kind) + np.arange(l_count.sum(), dtype=kind)
    is_l = np.repeat(np.tile([True, False], sigma), np.column_stack([l_count, seed_count]).ravel())
    array[l_first] = places[1:][is_l]
    following = None
    if limit:
        following = queue(n, np.int16, 0)
        # shared tells of the one before; here it is the one after, within the L suffixes of a character
        value = np.append(shared[1:][is_l][1:], 0)
        ends = np.cumsum(l_count)[l_count > 0] - 1
        value[ends] = 0
        following[l_first] = value
        last_l = start + l_count - 1
        borders = last_l[(l_count > 0) & (s_count > 0)]
    del places, shared
    Scan(text, is_s, array, total - 1, -1, following, limit).run(borders if limit else np.zeros(0, np.int64))
    return array, following
