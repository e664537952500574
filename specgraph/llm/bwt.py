"""Burrows-Wheeler transform and common prefixes of many strings, built column by column.

Round t inserts one symbol of every string: the one t places from its end. Where it goes follows from the transform so far: the new suffix c.S ranks
among those that begin with c as the old S's place ranks among the places that hold c. The transform, the common prefixes and the suffixes' names lie in
three sequential files. A round reads them twice from front to end, in buffers of fixed size (once to rank, once to merge), and writes them anew; what
it keeps besides is one place for each string and a few numbers for each symbol.
"""

from __future__ import annotations

import io
import os

import numpy as np

#: Entries of a buffer.
BUFFER = 1 << 17
KINDS = {"bwt": np.dtype(np.uint32), "lcp": np.dtype(np.int32), "names": np.dtype(np.int64)}
_FAR = np.iinfo(np.int32).max


class Files:
    """The three files, in a folder or (without one) in memory. Only whole reads and writes from front to end; a new version replaces the old one when it is done."""

    def __init__(self, folder: str | None) -> None:
        self.folder, self.held = folder, {}

    def reader(self, name: str):
        return open(os.path.join(self.folder, name), "rb") if self.folder else io.BytesIO(self.held[name])

    def writer(self, name: str):
        return open(os.path.join(self.folder, f"{name}.new"), "wb") if self.folder else io.BytesIO()

    def done(self, name: str, out) -> None:
        if self.folder:
            out.close()
            os.replace(os.path.join(self.folder, f"{name}.new"), os.path.join(self.folder, name))
        else:
            self.held[name] = out.getbuffer()

    def whole(self, name: str) -> np.ndarray:
        with self.reader(name) as f:
            return np.frombuffer(f.read(), KINDS[name])


def _take(f, kind: np.dtype, n: int) -> np.ndarray:
    return np.frombuffer(f.read(n * kind.itemsize), kind)


def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of lcp[a + 1 : b + 1] for each a < b."""
    if not len(a):
        return np.zeros(0, lcp.dtype)
    by = np.argsort(a, kind="stable")
    out = np.empty(len(a), lcp.dtype)
    out[by] = np.minimum.reduceat(np.append(lcp, _FAR).astype(lcp.dtype), np.column_stack((a[by] + 1, b[by] + 1)).ravel())[::2]
    return out


class Columns:
    def __init__(self, strings: list[np.ndarray], weights: np.ndarray, folder: str | None = None) -> None:
        """strings: arrays of symbols, 1 and up; weights: what each symbol counts in a common prefix; folder: where the files lie, None: in memory."""
        self.weights = weights
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.concatenate(strings).astype(np.uint32) if len(strings) else np.zeros(0, np.uint32)
        self.files = Files(folder)
        self.at = np.arange(len(strings))  # where each string's latest suffix stands
        self.total = len(strings)
        self.counts = np.zeros(len(weights), np.int64)  # how often the transform holds each symbol
        first = self._symbols(0)
        np.add.at(self.counts, first, 1)
        for name, x in (("bwt", first), ("lcp", np.zeros(len(strings))), ("names", self.ends)):
            out = self.files.writer(name)
            out.write(x.astype(KINDS[name]).tobytes())
            self.files.done(name, out)

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The transform (0: a string's begin), the common prefix of each suffix with the one before, and where in all symbols a suffix begins."""
        return self.files.whole("bwt"), self.files.whole("lcp"), self.files.whole("names")

    def _symbols(self, done: int) -> np.ndarray:
        """What precedes each string's suffix of `done` symbols."""
        more = self.sizes > done
        return np.where(more, self.flat[np.where(more, self.ends - 1 - done, 0)] if len(self.flat) else 0, 0).astype(np.uint32)

    def _ranked(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the places asked (ascending): how often their symbol occurs before. And the new places whose common prefixes change, with these.

        A common prefix changes at a new suffix and right behind it: it is the symbol, and the least prefix between the two places it came from.
        """
        base = len(self.sizes) + np.cumsum(self.counts) - self.counts - self.counts[0]  # where suffixes that begin with a symbol start
        seen = np.zeros(len(self.counts), np.int64)
        run = np.full(len(self.counts), _FAR, np.int32)  # least prefix since a symbol's last place
        open_ = np.zeros(len(self.counts), bool)  # whether that place was asked for
        before, places, values = np.empty(len(asked), np.int64), [], []
        with self.files.reader("bwt") as bwt, self.files.reader("lcp") as lcp:
            for start in range(0, self.total, BUFFER):
                w, least = _take(bwt, KINDS["bwt"], BUFFER), _take(lcp, KINDS["lcp"], BUFFER)
                order = np.argsort(w, kind="stable")
                order = order[np.searchsorted(w[order], 1) :]  # a string's begin is no symbol
                c = w[order]
                head = np.ones(len(c), bool)
                head[1:] = c[1:] != c[:-1]
                heads = np.flatnonzero(head)
                symbols = c[heads]
                occ = np.arange(len(c)) - np.repeat(heads, np.diff(np.append(heads, len(c)))) + seen[c]
                lo, hi = np.searchsorted(asked, [start, start + len(w)])
                wanted = np.zeros(len(w), bool)
                wanted[asked[lo:hi] - start] = True
                nth = np.empty(len(w), np.int64)
                nth[order] = occ
                before[lo:hi] = nth[asked[lo:hi] - start]
                mine = wanted[order]
                behind = np.empty(len(c), bool)
                behind[1:] = mine[:-1]
                behind[heads] = open_[symbols]
                touched = np.flatnonzero((mine | behind) & (occ > 0))
                value = np.empty(len(touched), np.int32)
                far = head[touched]  # the place before lies in an earlier buffer
                x = order[touched]
                if far.any():
                    value[far] = np.minimum(run[c[touched[far]]], np.minimum.accumulate(least)[x[far]])
                value[~far] = _least(least, order[touched[~far] - 1], x[~far])
                places.append(base[c[touched]] + occ[touched])
                values.append(value + self.weights[c[touched]])
                if start + len(w) < self.total:
                    run = np.minimum(run, least.min())
                    tails = np.append(heads, len(c))[1:] - 1
                    rest = np.append(np.minimum.accumulate(least[::-1])[::-1], _FAR)
                    run[symbols] = rest[order[tails] + 1]
                    open_[symbols] = mine[tails]
                    seen[symbols] += np.diff(np.append(heads, len(c)))
        return before, np.concatenate(places), np.concatenate(values)

    def build(self) -> Columns:
        for t in range(int(self.sizes.max(initial=0))):
            active = np.flatnonzero(self.sizes > t)
            active = active[np.argsort(self.at[active], kind="stable")]
            asked, symbol = self.at[active], self._symbols(t)[active]
            before, places, values = self._ranked(asked)
            new = (len(self.sizes) + np.cumsum(self.counts) - self.counts - self.counts[0])[symbol] + before
            by = np.argsort(new)
            spots = new[by]
            following = self._symbols(t + 1)[active]
            old = np.argsort(places)
            self._merge(spots, {"bwt": following[by], "lcp": np.zeros(len(by), np.int32), "names": (self.ends[active] - 1 - t)[by]}, places[old], values[old])
            # An old suffix moves behind the new ones before it.
            free = spots - np.arange(len(spots))
            self.at = self.at + np.searchsorted(free, self.at, "right")
            self.at[active] = new
            self.total += len(active)
            np.add.at(self.counts, following, 1)
        return self

    def _merge(self, spots: np.ndarray, fresh: dict[str, np.ndarray], places: np.ndarray, values: np.ndarray) -> None:
        """The files anew, with fresh entries at spots, and common prefixes of values at places (both ascending)."""
        total = self.total + len(spots)
        for name, kind in KINDS.items():
            out = self.files.writer(name)
            with self.files.reader(name) as f:
                for start in range(0, total, BUFFER):
                    stop = min(total, start + BUFFER)
                    lo, hi = np.searchsorted(spots, [start, stop])
                    part = np.empty(stop - start, kind)
                    is_new = np.zeros(stop - start, bool)
                    is_new[spots[lo:hi] - start] = True
                    part[is_new] = fresh[name][lo:hi]
                    part[~is_new] = _take(f, kind, stop - start - (hi - lo))
                    if name == "lcp":
                        a, z = np.searchsorted(places, [start, stop])
                        part[places[a:z] - start] = values[a:z]
                    out.write(part.tobytes())
            self.files.done(name, out)

    def close(self) -> None:
        self.files.held.clear()
