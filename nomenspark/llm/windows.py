"""Words of any length in linear time, for an encoder of short ones.

- Between two bytes that stand side by side in no token of the vocabulary nothing is ever merged, so a word is cut there.
  In scripts whose letters the vocabulary spells byte by byte, that leaves a few thousand distinct pieces.
- Pieces that are still longer than WINDOW are encoded in overlapping windows, and the results joined at a token that both
  have at the same place. That is exact: a sequence of tokens is the encoding of its bytes if and only if each two
  neighbours are the encoding of theirs, since a merge over a bound between tokens would come up among these two alone just
  as well. Windows that share no token, as in long runs of one character, are taken as one, and encoded anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from .pretokenize import Words

#: Bytes of a window and of its overlap with the next. Windows that had to be joined are long when over MOST bytes.
WINDOW, STRIDE, MOST = 64, 32, 512


class Pieces:
    """Encodes words through contract(list of byte strings) -> (flat ids, ids of each), whose strings have up to MOST bytes
    and through long(byte string) -> ids beyond. tokens: the vocabulary's byte strings with their ids."""

    def __init__(self, tokens: Iterable[tuple[bytes, int]], contract: Callable, long: Callable):
        self.contract, self.long = contract, long
        tokens = list(tokens)
        self.length = np.zeros(max(i for _, i in tokens) + 1, np.int64)
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a token
        for token, i in tokens:
            self.length[i] = len(token)
            self.joined[tuple(np.frombuffer(x, np.uint8) for x in (token[:-1], token[1:]))] = True
        self.known = Words(self._pieces, 100_000)

    def clear(self) -> None:
        self.known.clear()

    def encode(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each) of non-empty words."""
        whole = b"".join(coded)
        data, ends = np.frombuffer(whole, np.uint8), np.cumsum([len(x) for x in coded], dtype=np.int64)
        cuts = np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1
        bounds = np.union1d(np.concatenate([[0], cuts]), ends)
        first = np.searchsorted(bounds, np.concatenate([[0], ends]))  # each word's first bound
        plain = (np.diff(first) == 1) & (np.diff(ends, prepend=0) <= WINDOW)
        lens, parts = np.zeros(len(coded), np.int64), []
        own = np.flatnonzero(plain)
        ids, lens[own] = self.contract([coded[i] for i in own.tolist()])
        parts.append((own, ids))
        own, at = np.flatnonzero(~plain), bounds.tolist()
        ids, lens[own] = self.known.ids([[whole[at[k] : at[k + 1]] for k in range(first[i], first[i + 1])] for i in own.tolist()])
        parts.append((own, ids))
        starts, flat = np.cumsum(lens) - lens, np.empty(int(lens.sum()), np.int32)
        for own, ids in parts:  # a part's ids lie in the order of its words
            n = lens[own]
            flat[np.arange(len(ids)) + np.repeat(starts[own] - (np.cumsum(n) - n), n)] = ids
        return flat, lens

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each) of byte strings of any length, the long ones in windows."""
        spans = [(i, a, min(a + WINDOW, len(x))) for i, x in enumerate(pieces) for a in range(0, max(1, len(x) - STRIDE), STRIDE)]
        known: dict[bytes, np.ndarray] = {}
        while True:
            texts = [pieces[i][a:b] for i, a, b in spans]
            new = list(dict.fromkeys(x for x in texts if x not in known))
            few = [x for x in new if len(x) <= MOST]
            ids, n = self.contract(few)
            known |= zip(few, np.split(ids, np.cumsum(n)[:-1]), strict=True) if few else {}
            known |= {x: self.long(x) for x in new if len(x) > MOST}
            own = [known[x] for x in texts]
            ids, n = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
            at, head = np.repeat(np.arange(len(spans)), n), np.cumsum(n) - n
            piece, start, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
            size = self.length[ids]
            stop = np.cumsum(size)
            stop += np.repeat(start - (stop[head] - size[head]), n)
            begin = stop - size
            # a token that a window and the next one have at the same place
            order = np.lexsort((at, stop, begin, piece[at]))
            x, y = order[:-1], order[1:]
            same = (at[y] == at[x] + 1) & (piece[at[x]] == piece[at[y]]) & (begin[x] == begin[y]) & (stop[x] == stop[y])
            meet = np.full(len(spans), -1)
            meet[at[x[same]]] = stop[x[same]]
            inner = np.concatenate([piece[1:] == piece[:-1], [False]])  # windows with a next one
            apart = inner & (meet < 0)
            if not apart.any():
                break
            first = np.flatnonzero(~np.concatenate([[False], apart[:-1]]))  # of the windows that become one
            last = np.append(first[1:], len(spans)) - 1
            spans = list(zip(piece[first].tolist(), start[first].tolist(), end[last].tolist(), strict=True))
        hi = np.where(inner, meet, end)
        lo = np.where(np.concatenate([[False], inner[:-1]]), np.concatenate([[0], meet[:-1]]), 0)
        used = (begin >= lo[at]) & (stop <= hi[at])
        return ids[used], np.bincount(piece[at[used]], minlength=len(pieces))
