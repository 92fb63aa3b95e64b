"""Banded alignment of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

FAR = 1 << 20
CELLS = 1 << 18  # of one band over all pairs of a block
WORDS = 1 << 21  # of all pairs of a block, each as long as the longest
LOOK = 16  # rows after which pairs that are above the width leave a block


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common start and the common end."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    start = int(differ[0]) if differ.size else short
    a, b = a[start:], b[start:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    end = int(differ[0]) if differ.size else short
    return a[: len(a) - end], b[: len(b) - end]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two bags; the longer length minus it bounds the distance from below."""
    both = 2 * np.concatenate((a, b)).astype(np.int64)
    both[len(a) :] += 1
    both.sort()
    starts = np.flatnonzero(np.diff(both >> 1, prepend=-1))
    surplus = np.add.reduceat(1 - 2 * (both & 1), starts) if starts.size else both
    return (len(both) - int(np.abs(surplus).sum())) // 2


def single_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of three words that stand in a text once, ascending, and where they start; runs are told apart by 16 bits a word."""
    words = words.astype(np.int64)
    runs = words[:-2] << 32 | words[1:-1] << 16 | words[2:]
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))
    single = new[:-1] & new[1:]
    return ordered[single], order[single]


def replaced(a: np.ndarray, b: np.ndarray) -> int:
    """The edits that turn one text into the other without moving a word; they bound the distance from above."""
    short = min(len(a), len(b))
    return max(len(a), len(b)) - int(np.count_nonzero(a[:short] == b[:short]))


def aligned_edits(a: np.ndarray, b: np.ndarray) -> int:
    """The edits of an alignment by runs that stand once in both texts; they bound the distance from above."""
    if min(len(a), len(b)) < 3:
        return max(len(a), len(b))
    (runs, at), (other_runs, other_at) = single_runs(a), single_runs(b)
    _, i, j = np.intersect1d(runs, other_runs, assume_unique=True, return_indices=True)
    order = np.argsort(at[i])
    x, y = at[i][order], other_at[j][order]
    # Runs in the same order on both sides, each with its three words; words of overlapping runs count once.
    rising = (y == np.maximum.accumulate(y)) & (y == np.minimum.accumulate(y[::-1])[::-1])
    x, y = ((z[rising][:, None] + np.arange(3)).ravel() for z in (x, y))
    beyond = lambda z: z > np.concatenate(([-1], np.maximum.accumulate(z)))[: len(z)]
    matched = beyond(x) & beyond(y) & (a[x] == b[y])
    gaps = [np.diff(z[matched], prepend=-1, append=len(w)) - 1 for z, w in ((x, a), (y, b))]
    return int(np.maximum(*gaps).sum())


def band_distances(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances within `width` of the diagonal; a result above `width` only says that it is above.

    A pair leaves the block with its last row, or when all of a row is above the width, since distances never fall along a path.
    """
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    out = np.full(len(pairs), FAR, np.int32)
    # The longest first, so that those still open come before those that have ended.
    held = np.argsort(-sizes[:, 0], kind="stable")
    lengths, goal = sizes[held, 0], (sizes[:, 1] - sizes[:, 0] + width)[held]
    rows, cells = int(lengths[0]), 2 * width + 1
    left = np.zeros((rows, len(pairs)), np.int32)
    # Row i meets the words i - width .. i + width of the other side; -1 stands for none.
    right = np.full((len(pairs), rows + cells), -1, np.int32)
    for k, which in enumerate(held):
        a, b = pairs[which]
        left[: len(a), k] = a
        reach = min(len(b), rows + width)
        right[k, width : width + reach] = b[:reach]
    offset = np.arange(cells, dtype=np.int32)
    now = np.where(offset >= width, offset - width, FAR).astype(np.int32)
    now = np.repeat(now[None], len(pairs), 0)
    for i in range(rows + 1):
        if i:
            best = now + (right[:, i - 1 : i - 1 + cells] != left[i - 1, :, None])
            np.minimum(best[:, :-1], now[:, 1:] + 1, out=best[:, :-1])
            if i <= width:
                best[:, width - i] = i  # no word of the other side is used yet
                best[:, : width - i] = FAR
            best -= offset
            now = np.minimum.accumulate(best, 1, out=best)
            now += offset
        open_ = int(np.searchsorted(-lengths, -i))
        ended = np.arange(open_, len(held))
        ended = ended[(0 <= goal[open_:]) & (goal[open_:] < cells)]
        out[held[ended]] = now[ended, goal[ended]]
        kept = slice(open_)
        if i % LOOK == LOOK - 1:
            hopeful = np.flatnonzero(now[:open_].min(1, initial=FAR) <= width)
            kept = hopeful if hopeful.size <= 0.75 * open_ else kept
        if open_ < len(held) or not isinstance(kept, slice):
            now, right, left = now[kept], right[kept], left[:, kept]
            held, lengths, goal = held[kept], lengths[kept], goal[kept]
        if not len(held):
            break
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """True where 1 - distance / longer length reaches `similarity`; two empty sequences are equal.

    Most pairs are settled by bounds of the distance from below and from above. The band of a pair doubles until its distance is certain or above its limit.
    """
    out = np.zeros(len(pairs), bool)
    open_ = []
    for k, (a, b) in enumerate(pairs):
        longest = max(len(a), len(b))
        limit = int(np.floor((1 - similarity) * longest + 1e-9))
        if abs(len(a) - len(b)) > limit:
            continue
        a, b = trimmed(a, b)
        longest = max(len(a), len(b))
        if longest <= limit or replaced(a, b) <= limit:
            out[k] = True
        elif limit and longest - shared(a, b) <= limit:
            if aligned_edits(a, b) <= limit:
                out[k] = True
            else:
                open_.append((k, a, b, limit))
    width = 8
    while open_:
        open_.sort(key=lambda x: -len(x[1]))
        later, low = [], 0
        while low < len(open_):
            longest = len(open_[low][1]) + 2 * width + 1
            block = open_[low : low + max(1, min(CELLS // (2 * width + 1), WORDS // longest))]
            low += len(block)
            found = band_distances([(a, b) for _, a, b, _ in block], width)
            for item, distance in zip(block, found, strict=True):
                if distance <= min(width, item[3]):
                    out[item[0]] = True
                elif width < item[3]:
                    later.append(item)
        open_, width = later, width * 2
    return out
