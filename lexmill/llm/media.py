"""Copies among a media column: local image descriptors, Hamming-table joins and geometric consensus.

An image is (image_id, width, height, pixels): 8-bit grey values by rows. The test tables hold no pictures, so ``render`` makes the media column of ``pages``: a page's whole
visible text as a picture, ``COLUMNS`` words to a row, each word a 4 x 4 texture of its hash. Any table with these columns works.

1. Corners: on each of ``LEVELS`` halvings of the image, places of the greatest Harris response within ``REACH`` pixels, above a noise floor. Images of few pixels (``SMALL``) are also taken at
   double size, where patches cover a quarter of the area, with the more corners the smaller they are: corners of a wider reach are among those of a narrower one, so a crop has those of its whole.
2. Descriptors: the patch's intensity centroid gives an orientation, in ``TURNS`` steps; ``BITS`` comparisons of smoothed pixel pairs, turned by it, give a 128-bit string. A string may
   occur in several places of its image: all of them match.
3. Hamming tables: a string has four blocks of 32 bits; strings at most 3 apart have an equal block. The strings of all images meet by block, packed by task and in rounds, and the distance is computed exactly.
   Frequent ("hot") strings don't meet each other there; images are compared by all their hot corners at once.
4. Consensus: of each pair of images that met often enough, each match of all their corners votes for the change of level and of orientation and for the shift, on grids that overlap by half; a pair is a copy when at least
   ``MIN_INLIERS`` distinct corners of either image agree. Crops, shifts, quarter turns, halvings and local edits keep enough corners. Where a pair has more than ``PAIRS`` matches, those held first that agree are proof enough.

Images with equal pixels are also found by a hash of them, whether or not they have corners.

Defined cases: images of null or wrongly sized pixels, and those with fewer than ``MIN_INLIERS`` corners (pictures of 8 pixels or less on a side have none), match nothing, but equal pixels; null ids are left out; rows that repeat an id and its pixels are one;
ties of consensus go to the least change; a page of null or empty text is an image of height 0. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._spark import components, cut, stash
from lexmill.llm._words import Words, pieces
from lexmill.session import ship

COLUMNS, CELL = 16, 4
LEVELS, REACH, RADIUS, TURNS, BITS, FLOOR, STACK = 2, 3, 7, 32, 128, 20_000_000_000, 1 << 18
SMALL, SMALL_FLOOR = ((40 * 64, 4), (60 * 64, 6), (88 * 64, 9)), 500_000_000
MIN_INLIERS, MAX_DISTANCE, SHIFT, SEND_MB = 4, 3, 8, 16
_HIDDEN = r"(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
CORNERS = "image_id bigint, h0 bigint, h1 bigint, strings binary, places binary"
LINKS, WEIGHTS = "a bigint, b bigint, inliers int, dx int, dy int, d_level int, d_turn int", "a bigint, b bigint, w bigint"
#: Rounds of a table, and bytes of strings up to which there are none; matches of one pair held at once, and those of several; images and number of the first blocks of strings taken as frequent, and shares of images that are compared by these, at least, and bytes of one; the setting by which Spark removes shuffle files that are done with.
PARTS, LITTLE, PAIRS, VOTES, HOT, MOST_HOT, SHARES, SHARE, CLEANUP = 3, 4_000_000, 1 << 20, 1 << 18, 16, 1 << 16, 4, 16_000_000, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GRIDS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _tests() -> np.ndarray:
    """TURNS x BITS x 4 whole offsets (ax, ay, bx, by): pairs of places within the patch, turned."""
    rng = np.random.default_rng(20240229)
    base = []
    while len(base) < BITS:
        a, b = rng.normal(0, RADIUS / 2, (2, 2))
        if max(np.hypot(*a), np.hypot(*b)) <= RADIUS - 1 and np.hypot(*(a - b)) >= 2:
            base.append((*a, *b))
    base = np.array(base)
    out = np.empty((TURNS, BITS, 4), np.int64)
    for t in range(TURNS):
        c, s = np.cos(2 * np.pi * t / TURNS), np.sin(2 * np.pi * t / TURNS)
        for k in (0, 2):
            out[t, :, k] = np.rint(c * base[:, k] - s * base[:, k + 1])
            out[t, :, k + 1] = np.rint(s * base[:, k] + c * base[:, k + 1])
    return out


_TESTS = _tests()
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = np.argwhere(np.hypot(_YY, _XX) <= RADIUS) - RADIUS


def _around(a: np.ndarray, r: int, join) -> np.ndarray:
    """join (add or maximum) over (2r+1) squares, by doubling; places within r of the border are not defined."""
    for axis in (0, 1):
        x, done, want = a, 1, 2 * r + 1
        cut = (lambda y, i, j: y[i:j]) if axis == 0 else (lambda y, i, j: y[:, i:j])
        n = a.shape[axis]
        if n < want:
            return np.zeros_like(a)
        if join is np.add:
            total = cut(x, 0, n - want + 1).copy()
            for k in range(1, want):
                total += cut(x, k, n - want + 1 + k)
            x = total
        else:
            while done < want:
                step = min(done, want - done)
                m = x.shape[axis] - step
                x = np.maximum(cut(x, 0, m), cut(x, step, m + step))
                done += step
        out = np.zeros_like(a)
        cut(out, r, n - r)[...] = x
        a = out
    return a


def keypoints(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one width: the image of each corner; (x, y, level, turn) in pixels of the full image; descriptors (rows x 2 of uint64).

    The images are stacked and handled at once. All sums are of whole numbers, so a patch gives the same string wherever it lies.
    """
    number = np.arange(len(images))
    made = []
    # small images at double size, few in a stack as they grow by it
    size = np.array([a.size for a in images], np.int64)
    least = 0
    for most, reach in SMALL:
        small = np.flatnonzero((size > least) & (size <= most))
        stack = np.cumsum(4 * size[small]) // STACK
        for s in np.unique(stack):
            some = small[stack == s]
            made += _corners([images[i].repeat(2, 0).repeat(2, 1) for i in some], some, -1, reach, SMALL_FLOOR)
        least = most
    for k in range(LEVELS):
        made += _corners(images, number, k, REACH, FLOOR)
        if k + 1 < LEVELS:
            big = [i for i, a in enumerate(images) if min(a.shape) > 2 * (RADIUS + 1)]
            images, number = [images[i] for i in big], number[big]
            images = [(a[: len(a) // 2 * 2, : a.shape[1] // 2 * 2].reshape(len(a) // 2, 2, -1, 2).sum((1, 3), dtype=np.int32) + 2) // 4 for a in images]
    if not made:
        return np.empty(0, np.int64), np.empty((0, 4)), np.empty((0, 2), np.uint64)
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _corners(images: list[np.ndarray], number: np.ndarray, k: int, reach: int, floor: int) -> list[tuple]:
    """The corners of images at level k as keypoints() gives them; one tuple, or none."""
    m = RADIUS + 1
    big = [i for i, a in enumerate(images) if min(a.shape) > 2 * m]
    images, number = [images[i] for i in big], number[big]
    if not images:
        return []
    height = np.array([len(a) for a in images])
    first = np.cumsum(height) - height
    smooth = _around(np.concatenate(images).astype(np.int32), 1, np.add)
    gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
    gy[1:-1], gx[:, 1:-1] = smooth[2:] - smooth[:-2], smooth[:, 2:] - smooth[:, :-2]
    xx, yy, xy = (_around(g, 2, np.add).astype(np.int64) for g in (gx * gx, gy * gy, gx * gy))
    response = 20 * (xx * yy - xy * xy) - (xx + yy) ** 2
    # corners lie m or more from the border; what neighbours in the stack add stays outside
    image = np.repeat(np.arange(len(images)), height)
    row = np.arange(len(smooth)) - first[image]
    inner = np.full_like(response, -1)
    inside = (row >= m) & (row < height[image] - m)
    inner[inside, m:-m] = response[inside, m:-m]
    greatest = _around(np.pad(inner, reach, constant_values=-1), reach, np.maximum)[reach:-reach, reach:-reach]
    ys, xs = np.nonzero((inner == greatest) & (inner > floor))
    if not len(ys):
        return []
    wide, at = smooth.shape[1], (ys * smooth.shape[1] + xs)[:, None]
    # sums of a patch stay below 2^24, so they are exact in single precision
    patch = smooth.astype(np.float32).ravel().take(at + (_DISC[:, 0] * wide + _DISC[:, 1]))
    centre = (patch @ _DISC.astype(np.float32)).astype(np.float64)
    angle = np.arctan2(centre[:, 0], centre[:, 1])
    turn = np.rint(np.round(angle / (2 * np.pi) * TURNS, 6)).astype(np.int64) % TURNS
    flat = smooth.astype(np.int16).ravel()
    bits = flat.take(at + (_TESTS[:, :, 1] * wide + _TESTS[:, :, 0])[turn]) < flat.take(at + (_TESTS[:, :, 3] * wide + _TESTS[:, :, 2])[turn])
    return [(number[image[ys]], np.stack([xs * 2.0**k + (2.0**k - 1) / 2, row[ys] * 2.0**k + (2.0**k - 1) / 2, np.full(len(xs), k), turn], 1), np.packbits(bits, axis=1).view(np.uint64))]


def render(pages: DataFrame) -> DataFrame:
    """The media column of pages: (image_id, width, height, pixels) from page_id and html."""
    ship(pages.sparkSession)
    seen = pages.select(F.col("page_id").cast("bigint").alias("image_id"), F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), _HIDDEN, " ").alias("text"))

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                w = Words(batch.column(1).slice(a, b - a))
                nibble = (w.hash[:, None] >> (np.arange(CELL * CELL, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
                cells = (nibble * np.uint64(17)).astype(np.uint8).reshape(-1, CELL, CELL)
                out = []
                for r in range(w.n):
                    own = cells[w.first[r] : w.first[r + 1]]
                    rows = -(-len(own) // COLUMNS)
                    grid = np.zeros((rows * COLUMNS, CELL, CELL), np.uint8)
                    grid[: len(own)] = own
                    out.append(grid.reshape(rows, COLUMNS, CELL, CELL).swapaxes(1, 2).tobytes())
                height = [len(x) // (COLUMNS * CELL) for x in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([COLUMNS * CELL] * len(out), pa.int32()), pa.array(height, pa.int32()), pa.array(out, pa.binary())], ["image_id", "width", "height", "pixels"])

    return seen.mapInArrow(run, "image_id bigint, width int, height int, pixels binary")


def corners_of(images: DataFrame, least: int = 1) -> DataFrame:
    """CORNERS of every image: a hash of its pixels, and its strings and places (see _place()), sorted by string; none for images of less than ``least`` corners."""

    def some(batch):
        """Row numbers of about STACK pixels of one width each."""
        w, h = (batch.column(i).fill_null(0).to_numpy() for i in (1, 2))
        size = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
        held, pixels = [], 0
        for i in np.argsort(w, kind="stable"):
            if w[i] <= 0 or h[i] <= 0 or int(w[i]) * int(h[i]) != size[i]:
                continue
            if held and (w[i] != w[held[0]] or pixels + int(w[i]) * int(h[i]) > STACK):
                yield held
                held, pixels = [], 0
            held.append(int(i))
            pixels += int(w[i]) * int(h[i])
        if held:
            yield held

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = b"".join(hashlib.blake2b(b"%d %d " % (w or 0, h or 0) + x, digest_size=16).digest() for w, h, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            mark = np.frombuffer(mark, np.int64).reshape(-1, 2)
            strings, places = [b""] * batch.num_rows, [b""] * batch.num_rows
            for rows in some(batch):
                w, h = batch.column(1)[rows[0]].as_py(), batch.column(2).to_numpy(zero_copy_only=False)
                image, p, d = keypoints([np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(int(h[i]), w) for i in rows])
                x, y = (2 * p[:, 0]).astype(np.int64), (2 * p[:, 1]).astype(np.int64)
                place = (y << 31) | (x << 7) | (p[:, 2].astype(np.int64) + 1 << 5) | p[:, 3].astype(np.int64)
                by = np.lexsort((place, d[:, 1], d[:, 0], image))
                d, place = np.ascontiguousarray(d[by]), place[by]
                end = np.cumsum(np.bincount(image, minlength=len(rows)))
                for i, a, b in zip(rows, [0, *end[:-1]], end, strict=True):
                    if b - a >= least:
                        strings[i], places[i] = d[a:b].tobytes(), place[a:b].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark[:, 0]), pa.array(mark[:, 1]), pa.array(strings, pa.binary()), pa.array(places, pa.binary())], [x.split()[0] for x in CORNERS.split(", ")])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, CORNERS)


def _place(meta: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, level + 1 and turn of corners."""
    return (meta >> 7 & (1 << 24) - 1) / 2, (meta >> 31 & (1 << 24) - 1) / 2, meta >> 5 & 3, meta & 31


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _spread(size: np.ndarray, most: int):
    """(i, k) for k < size[i], about ``most`` at a time: row numbers and counters."""
    end = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
        n = size[a:b]
        # one row of more than ``most`` is cut as well
        for k in range(0, max(1, int(n[0]) if b == a + 1 else 1), most):
            if b == a + 1:
                c = np.arange(k, min(int(n[0]), k + most))
                yield np.full(len(c), a), c
            else:
                i = np.repeat(np.arange(a, b), n)
                yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _matches(a: np.ndarray, b: np.ndarray):
    """Index pairs of strings (rows of two uint64) at most MAX_DISTANCE apart, in pieces. Equal strings are taken as one; few are compared with all, many by their blocks."""
    ha, hb = _starts(a[:, 0], a[:, 1]), _starts(b[:, 0], b[:, 1])
    na, nb = np.diff([*ha, len(a)]), np.diff([*hb, len(b)])
    a, b = a[ha], b[hb]
    ka, kb = a.view(np.uint32).reshape(-1, 4), b.view(np.uint32).reshape(-1, 4)

    def close(i, j):
        return np.bitwise_count(a[i] ^ b[j]).sum(-1, dtype=np.int64) <= MAX_DISTANCE

    def met():
        if len(a) * len(b) <= PAIRS:
            distance = np.bitwise_count(a[:, :1] ^ b[:, 0])
            distance += np.bitwise_count(a[:, 1:] ^ b[:, 1])
            yield np.nonzero(distance <= MAX_DISTANCE)
            return
        for k in range(4):
            by = np.argsort(kb[:, k], kind="stable")
            low, high = (np.searchsorted(kb[by, k], ka[:, k], side) for side in ("left", "right"))
            for i, c in _spread(high - low, PAIRS):
                j = by[low[i] + c]
                ok = close(i, j) & (ka[i, :k] != kb[j, :k]).all(1)
                yield i[ok], j[ok]

    for i, j in met():
        for r, c in _spread(na[i] * nb[j], PAIRS):
            yield ha[i[r]] + c // nb[j[r]], hb[j[r]] + c % nb[j[r]]


def _laid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level, turn and shift of matches: b's place less a's, turned and scaled as the match says."""
    (xa, ya, la, ta), (xb, yb, lb, tb) = _place(a), _place(b)
    level, turn = lb - la, (tb - ta) % TURNS
    angle, scale = turn * (2 * np.pi / TURNS), 2.0**level
    sx = xb - scale * (xa * np.cos(angle) - ya * np.sin(angle))
    sy = yb - scale * (xa * np.sin(angle) + ya * np.cos(angle))
    return level, turn, *(v.astype(np.float32).astype(np.float64) for v in (sx, sy))


def _consensus(pair: np.ndarray, a: np.ndarray, b: np.ndarray, min_inliers: int, grids=GRIDS) -> list[tuple]:
    """(pair, rank, level, turn) of each cell that ``min_inliers`` distinct places of either side agree on; rank begins with the inliers."""
    level, turn, sx, sy = _laid(a, b)
    pair = np.asarray(pair, np.int64)
    out = []
    for gx, gy in grids:
        cx, cy = (np.floor((s + g * SHIFT / 2) / SHIFT).astype(np.int64) for s, g in ((sx, gx), (sy, gy)))
        # most votes stand alone; those whose cell shares its slot with few others are none
        slot = (((pair * 31 + level) * 31 + turn) * 1000003 + cx) * 1000003 + cy
        slot = (slot.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).view(np.int64)
        some = np.flatnonzero(np.bincount(slot)[slot] >= min_inliers) if len(slot) else slot
        by = some[np.lexsort((cy[some], cx[some], turn[some], level[some], pair[some]))]
        size = np.diff([*_starts(pair[by], level[by], turn[by], cx[by], cy[by]), len(by)])
        big = size >= min_inliers
        by, size = by[np.repeat(big, size)], size[big]
        if not len(by):
            continue
        head, cell = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        inliers = np.full(len(size), len(by))
        for v in (a[by], b[by]):
            at = np.lexsort((v, cell))
            inliers = np.minimum(inliers, np.bincount(cell[at][_starts(cell[at], v[at])], minlength=len(size)))
        mx, my = (np.add.reduceat(s[by], head) / size for s in (sx, sy))
        for k in np.flatnonzero(inliers >= min_inliers):
            i = by[head[k]]
            le, tu = int(level[i]), int(turn[i])
            out.append((int(pair[i]), (int(inliers[k]), -abs(le), -tu, -abs(mx[k]) - abs(my[k]), mx[k], my[k]), le, tu))
    return out


def _many(da, qa, db, qb, min_inliers: int) -> list[tuple]:
    """_consensus() of one pair with too many votes to hold. Votes of one piece that agree are proof enough (inliers are then theirs); else each pass over all pieces takes a part of the cells."""
    votes = lambda: ((qa[i], qb[j]) for i, j in _matches(da, db))
    total = 0
    for a, b in votes():
        total += len(a)
        if found := _consensus(np.zeros(len(a), np.int64), a, b, min_inliers):
            return found
    out, of = [], -(-total // PAIRS) * 4
    for grid in GRIDS:
        for n in range(of):
            kept = []
            for a, b in votes():
                level, turn, sx, sy = _laid(a, b)
                cx, cy = (np.floor((s + g * SHIFT / 2) / SHIFT).astype(np.int64) for s, g in ((sx, grid[0]), (sy, grid[1])))
                at = (cx * 7919 + cy * 31 + turn * 3 + level) % of == n
                kept.append((a[at], b[at]))
            a, b = map(np.concatenate, zip(*kept, strict=True))
            out += _consensus(np.zeros(len(a), np.int64), a, b, min_inliers, [grid])
    return out


def _record(found: list[tuple], keys) -> pa.RecordBatch:
    """LINKS of the best cell of each pair that _consensus() gave; keys: (a, b) by pair."""
    best = {}
    for n, rank, level, turn in found:
        best[n] = max(best.get(n, ((-1,),)), (rank, level, turn))
    grid = lambda v: int(np.rint(v / (SHIFT / 2)) * (SHIFT / 2))
    rows = [(*keys[n], rank[0], grid(rank[4]), grid(rank[5]), level, turn) for n, (rank, level, turn) in best.items()]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in LINKS.split(", ")])


def _agree(sides: DataFrame, min_inliers: int) -> DataFrame:
    """Pairs of images by consensus of all their matches, from rows (a, b, image_id, strings, places) of either image of each pair (a, b)."""

    def gather(batches):
        """(a, b, strings and places of a, of b); rows of one pair follow each other."""
        key, held = None, None
        for batch in batches:
            for a, b, i, s, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (a, b) != key:
                    if key is not None:
                        yield key, held
                    key, held = (a, b), ([], [], [], [])
                k = 0 if i == a else 2
                held[k].append(np.frombuffer(s, np.uint64).reshape(-1, 2))
                held[k + 1].append(np.frombuffer(p, np.int64))
        if key is not None:
            yield key, held

    def joined(strings, places):
        if len(strings) == 1:
            return strings[0], places[0]
        # an id with several rows
        s, p = np.concatenate(strings), np.concatenate(places)
        by = np.lexsort((p, s[:, 1], s[:, 0]))
        return s[by], p[by]

    def run(batches):
        keys, votes, held = [], [], 0
        for key, sides in gather(batches):
            if not sides[0] or not sides[2]:
                continue
            (da, qa), (db, qb) = joined(*sides[:2]), joined(*sides[2:])
            own, n = [], 0
            for i, j in _matches(da, db):
                n += len(i)
                if n > PAIRS:
                    break
                own.append((qa[i], qb[j]))
            if n > PAIRS:
                yield _record(_many(da, qa, db, qb, min_inliers), [key])
            elif n >= min_inliers:
                votes += [(np.full(len(x), len(keys)), x, y) for x, y in own]
                keys.append(key)
                held += n
            if held > VOTES:
                yield _record(_consensus(*map(np.concatenate, zip(*votes, strict=True)), min_inliers), keys)
                keys, votes, held = [], [], 0
        if keys:
            yield _record(_consensus(*map(np.concatenate, zip(*votes, strict=True)), min_inliers), keys)

    return sides.select("a", "b", "image_id", "strings", "places").mapInArrow(run, LINKS)


def _plane(v: np.ndarray) -> bytes:
    """Whole numbers by byte planes, which compress."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T.tobytes()


def _is_hot(d: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which strings have a first block that is in ``hot`` (sorted)."""
    key = d.view(np.uint32).reshape(-1, 4)[:, 0]
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(d), bool)


def _parcels(rows: DataFrame, block: int, part: int, parts: int, tasks: int, hot: np.ndarray) -> DataFrame:
    """Table ``block``, the share ``part`` of its keys: (to, parcel), strings of (image_id, root, strings) for the task ``to`` that has their key, once for each image.

    Each comes with its corners and whether it is ``hot``, each image with the number of its hot corners (both up to 255; that of an id with several rows, ``twice``, counts as 255).
    """

    def run(batches):
        for batch in batches:
            ids, roots = (batch.column(i).to_numpy() for i in (0, 1))
            twice = batch.column(3).to_numpy(zero_copy_only=False)
            size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 16
            d = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2)
            image = np.repeat(np.arange(len(ids)), size)
            if not len(image):
                continue
            many = np.minimum(np.bincount(image, _is_hot(d, hot), len(ids)), 255).astype(np.uint8)
            many[twice] = 255
            head = _starts(d[:, 0], d[:, 1], image)
            corners = np.minimum(np.diff([*head, len(image)]), 255)
            d, image = d[head], image[head]
            common = _is_hot(d, hot)
            key = d.view(np.uint32).reshape(-1, 4)[:, block]
            mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            mine = np.flatnonzero(mixed % np.uint64(parts) == part)
            to = (mixed[mine] // np.uint64(parts) % np.uint64(tasks)).astype(np.int64)
            mine = mine[np.lexsort((key[mine], to))]
            to.sort()
            head = _starts(to)
            out = []
            for a, b in zip(head, [*head[1:], len(to)], strict=True):
                m = mine[a:b]
                own, ref = np.unique(image[m], return_inverse=True)
                four = d[m].view(np.uint32).reshape(-1, 4)
                rest = np.ascontiguousarray(np.delete(four, block, 1))
                step = np.diff(four[:, block], prepend=np.uint32(0))
                out.append(b"".join([np.array([len(m), len(own)], np.int64).tobytes(), _plane(np.diff(ids[own], prepend=0)), _plane(ids[own] - roots[own]), many[own].tobytes(), _plane(step), rest.tobytes(), _plane(ref.astype(np.uint32)), corners[m].astype(np.uint8).tobytes(), common[m].astype(np.uint8).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(to[head], pa.int32()), pa.array(out, pa.binary())], ["to", "parcel"])

    return rows.select("image_id", "root", "strings", "twice").mapInArrow(run, "to int, parcel binary").repartitionById(tasks, F.col("to"))


def _opened(batches, block: int):
    """The strings of all parcels: (d, image_id, root, corners, hot, hot corners of the image)."""
    got = []
    for batch in batches:
        for x in batch.column(1).to_pylist():
            n, m = np.frombuffer(x, np.int64, 2)
            at = 16

            def take(kind, count, planes=True):
                nonlocal at
                raw = np.frombuffer(x, np.uint8, int(count) * np.dtype(kind).itemsize, at)  # noqa: B023
                at += len(raw)
                return np.ascontiguousarray(raw.reshape(-1, int(count)).T).view(kind).ravel() if planes else raw.view(kind)

            ids = np.cumsum(take(np.int64, m))
            roots = ids - take(np.int64, m)
            many = take(np.uint8, m, False)
            four = np.empty((n, 4), np.uint32)
            four[:, block] = np.cumsum(take(np.uint32, n), dtype=np.uint32)
            four[:, [k for k in range(4) if k != block]] = take(np.uint32, 3 * n, False).reshape(-1, 3)
            ref = take(np.uint32, n)
            got.append((four.view(np.uint64), ids[ref], roots[ref], take(np.uint8, n, False), take(np.uint8, n, False).astype(bool), many[ref]))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None


def _summed(a, b, w) -> pa.RecordBatch:
    """(a, b, w) with w summed by pair."""
    by = np.lexsort((b, a))
    a, b, w = a[by], b[by], w[by]
    head = _starts(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(np.add.reduceat(w, head) if len(head) else w, pa.int64())], ["a", "b", "w"])


def _chained(parcels: DataFrame) -> DataFrame:
    """Of equal strings: (a, b, w) for each image and the next that has it, w the corners; and for first blocks of strings of HOT images or more a row (block, null, images). Tables of block 0."""

    def run(batches):
        if (got := _opened(batches, 0)) is None:
            return
        d, ids, corners = got[0], got[1], got[3]
        by = np.lexsort((ids, d[:, 1], d[:, 0]))
        d, ids, corners = d[by], ids[by], corners[by].astype(np.int64)
        next_ = np.flatnonzero((d[1:] == d[:-1]).all(1) & (ids[1:] != ids[:-1]))
        yield _summed(ids[next_], ids[next_ + 1], np.minimum(corners[next_], corners[next_ + 1]))
        key = d.view(np.uint32).reshape(-1, 4)[:, 0]
        by = np.lexsort((ids, key))
        key = key[by][_starts(key[by], ids[by])]
        head = _starts(key)
        n = np.diff([*head, len(key)])
        many = n >= HOT
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[head[many]].astype(np.int64)), pa.nulls(int(many.sum()), pa.int64()), pa.array(n[many])], ["a", "b", "w"])

    return parcels.mapInArrow(run, WEIGHTS)


def _near(parcels: DataFrame, block: int) -> DataFrame:
    """(a, b, w, hot) of images a < b in different groups with strings within MAX_DISTANCE that are not both hot, first met by this block: w is at least the corners that either image has in such
    matches, hot the hot corners of that which has fewer."""

    def run(batches):
        if (got := _opened(batches, block)) is None:
            return
        by = np.argsort(got[0].view(np.uint32).reshape(-1, 4)[:, block], kind="stable")
        d, ids, roots, corners, common, many = (x[by] for x in got)
        four = d.view(np.uint32).reshape(-1, 4)
        head = _starts(four[:, block])
        size = np.diff([*head, len(d)])
        several = np.minimum.reduceat(roots, head) < np.maximum.reduceat(roots, head)
        asks = np.flatnonzero(~common & np.repeat(several, size))
        start, size = np.repeat(head, size)[asks], np.repeat(size, size)[asks]
        for r, c in _spread(size, PAIRS):
            i, j = asks[r], start[r] + c
            # a hot string doesn't ask, so it is met whichever image is the first
            ok = np.flatnonzero((roots[i] != roots[j]) & (common[j] | (ids[i] < ids[j])))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(d[i] ^ d[j]).sum(1, dtype=np.int64) <= MAX_DISTANCE
            ok &= (four[i, :block] != four[j, :block]).all(1)
            i, j = i[ok], j[ok]
            if len(i):
                a, b, w, hot = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.maximum(corners[i], corners[j]).astype(np.int64), np.minimum(many[i], many[j]).astype(np.int64)
                by = np.lexsort((b, a))
                a, b = a[by], b[by]
                head = _starts(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(np.add.reduceat(w[by], head)), pa.array(np.maximum.reduceat(hot[by], head))], ["a", "b", "w", "hot"])

    return parcels.mapInArrow(run, WEIGHTS + ", hot bigint")


def _shared(rows: DataFrame, asked: DataFrame, hot: np.ndarray, min_inliers: int, groups: int) -> DataFrame:
    """LINKS between images of different groups by their hot corners alone, of rows (image_id, root, strings, places): those that join all groups which hot corners join. And those of the pairs ``asked``
    (a, b, w) of which all but w of ``min_inliers`` hot corners agree, unless these links join them, with null inliers.

    Images fall in ``groups`` shares; a task has two of them, so it has all matches of a pair, and sends no more links than join what it found.
    """

    def shares(ids):
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % groups

    def ask(batches):
        """A pair's row has side 1 + w and b as its root."""
        for batch in batches:
            a, b, w = (batch.column(k).to_numpy() for k in range(3))
            low, high = np.minimum(shares(a), shares(b)), np.maximum(shares(a), shares(b))
            none = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(high * (high + 1) // 2 + low, pa.int32()), pa.array(1 + w, pa.int32()), batch.column(0), batch.column(1), none, none], ["to", "side", "image_id", "root", "strings", "places"])

    def send(batches):
        for batch in batches:
            size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 16
            d = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2)
            place = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            image, common = np.repeat(np.arange(len(size)), size), _is_hot(d, hot)
            d, place, image = d[common], place[common], image[common]
            ids, roots = (batch.column(i).to_numpy() for i in (0, 1))
            share = shares(ids)
            out = []
            head = _starts(image)
            for a, b in zip(head, [*head[1:], len(image)], strict=True):
                r, s = image[a], share[image[a]]
                for other in range(groups):
                    low, high = min(s, other), max(s, other)
                    out.append((int(high * (high + 1) // 2 + low), int(low < s), int(ids[r]), int(roots[r]), d[a:b].tobytes(), place[a:b].tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["to", "side", "image_id", "root", "strings", "places"])

    def run(batches):
        got = [x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)]
        pairs = [x for x in got if x[1] > 1]
        got = [x for x in got if x[1] < 2]
        # images by side and id; an id may have several rows
        names = sorted({(x[1], x[2]) for x in got})
        number = {x: n for n, x in enumerate(names)}
        image = np.repeat([number[x[1], x[2]] for x in got], [len(x[4]) // 16 for x in got]).astype(np.int64)
        d, place = np.frombuffer(b"".join(x[4] for x in got), np.uint64).reshape(-1, 2), np.frombuffer(b"".join(x[5] for x in got), np.int64)
        if not len(image):
            return
        by = np.lexsort((place, d[:, 1], d[:, 0], image))
        d, place, image = np.ascontiguousarray(d[by]), place[by], image[by]
        ids, n = np.array([x[1] for x in names]), len(names)
        first = np.searchsorted(image, np.arange(n + 1))
        every, bounds_of = (d, place), {x[1]: (first[k], first[k + 1]) for k, x in enumerate(names)}
        enough = np.bincount(image, minlength=n)[image] >= min_inliers
        d, place, image = np.ascontiguousarray(d[enough]), place[enough], image[enough]
        root = np.empty(n, np.int64)
        for x in got:
            root[number[x[1], x[2]]] = x[3]
        label = np.unique(root, return_inverse=True)[1]
        boss = np.arange(n)
        cross = bool(names[-1][0] != names[0][0])
        second = sum(x[0] == 0 for x in names) if cross else n
        # strings and those near each; the corners of each string by image
        by = np.lexsort((d[:, 1], d[:, 0]))
        head = _starts(d[by, 0], d[by, 1])
        string = np.empty(len(d), np.int64)
        string[by] = np.repeat(np.arange(len(head)), np.diff([*head, len(d)]))
        u = np.ascontiguousarray(d[by[head]])
        si, sj = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *_matches(u, u), strict=True))
        by = np.argsort(si, kind="stable")
        sj, nears = sj[by], np.bincount(si, minlength=len(u))
        near = np.cumsum(nears) - nears
        at = np.lexsort((image, string))
        key = string[at] * n + image[at]
        first = np.searchsorted(image, np.arange(n + 1))

        def bounds(x, low, high):
            """For corners x: of each and each string near it, the corners of that string in images low <= b < high that come after its own."""
            size = nears[string[x]]
            of = np.repeat(x, size)
            j = sj[np.repeat(near[string[x]], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)]
            least = np.maximum(low, second if cross else image[of] + 1)
            a = np.searchsorted(key, j * n + least)
            return of, a, np.maximum(np.searchsorted(key, j * n + high) - a, 0)

        def links(i, j):
            """Links of the votes i, j of pairs that are all here."""
            ok = label[image[i]] != label[image[j]]
            i, j = i[ok], j[ok]
            _, pair, count = np.unique(image[i] * n + image[j], return_inverse=True, return_counts=True)
            ok = count[pair] >= min_inliers
            i, j, pair = i[ok], j[ok], pair[ok]
            turned = ids[image[i]] > ids[image[j]]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            ends = dict(zip(pair.tolist(), zip(image[i].tolist(), image[j].tolist(), strict=True), strict=True))
            return _consensus(pair, place[i], place[j], min_inliers), ends

        def top(k):
            while boss[k] != k:
                boss[k] = boss[boss[k]]
                k = boss[k]
            return k

        def joined(found, ends):
            """Of the links, those that join."""
            best = {}
            for x in found:
                best[x[0]] = max(best.get(x[0], x), x, key=lambda v: v[1])
            kept = []
            for k, x in best.items():
                p, q = (top(label[e]) for e in ends[k])
                if p != q:
                    boss[max(p, q)] = min(p, q)
                    kept.append(x)
            if kept:
                label[:] = np.array([top(k) for k in range(n)])[label]
            return _record(kept, {x[0]: tuple(int(ids[e]) for e in ends[x[0]]) for x in kept})

        def met(a, b, low, high):
            """Links of the images a <= i < b with low <= j < high, in pieces of about VOTES votes."""
            i, start, size = bounds(np.arange(first[a], first[b]), low, high)
            total = int(size.sum())
            if not total:
                return
            if total > VOTES and b - a > 1:
                yield from met(a, (a + b) // 2, low, high)
                yield from met((a + b) // 2, b, low, high)
            elif total > VOTES and high - low > 1:
                yield from met(a, b, low, (low + high) // 2)
                yield from met(a, b, (low + high) // 2, high)
            elif total > VOTES:
                if label[a] != label[low]:
                    p, q = (a, low) if ids[a] < ids[low] else (low, a)
                    own = [slice(first[e], first[e + 1]) for e in (p, q)]
                    yield joined(_many(d[own[0]], place[own[0]], d[own[1]], place[own[1]], min_inliers), {0: (p, q)})
            else:
                j = at[np.repeat(start, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)]
                yield joined(*links(np.repeat(i, size), j))

        last = second if cross else n
        step = max(1, int(VOTES // max(1, nears[string].sum() // n)))
        for a in range(0, last, step):
            yield from met(a, min(last, a + step), 0, n)
        group = {x[1]: label[k] for k, x in enumerate(names)}
        for w in range(1, min_inliers):
            keys, votes, held = [], [], 0

            def agreed():
                found = {x[0] for x in _consensus(*map(np.concatenate, zip(*votes, strict=True)), min_inliers - w)} if votes else ()  # noqa: B023
                return [keys[k] for k in found]  # noqa: B023

            kept = []
            for _, side, a, b, _, _ in pairs:
                if side != 1 + w or a not in group or b not in group or group[a] == group[b]:
                    continue
                (ax, ay), (bx, by) = bounds_of[a], bounds_of[b]
                own, size = [], 0
                for i, j in _matches(every[0][ax:ay], every[0][bx:by]):
                    size += len(i)
                    if size > PAIRS:
                        break
                    own.append((every[1][ax:ay][i], every[1][bx:by][j]))
                if size > PAIRS:
                    kept.append((a, b))
                elif size >= min_inliers - w:
                    votes += [(np.full(len(x), len(keys)), x, y) for x, y in own]
                    keys.append((a, b))
                    held += size
                if held > VOTES:
                    kept += agreed()
                    keys, votes, held = [], [], 0
            kept += agreed()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)] + [pa.nulls(len(kept), pa.int32())] * 5, [x.split()[0] for x in LINKS.split(", ")])

    sent = rows.select("image_id", "root", "strings", "places").mapInArrow(send, "to int, side int, image_id bigint, root bigint, strings binary, places binary")
    sent = sent.unionByName(asked.select("a", "b", "w").mapInArrow(ask, sent.schema))
    return sent.repartitionById(groups * (groups + 1) // 2, F.col("to")).drop("to").select(F.lit(0), "side", "image_id", "root", "strings", "places").mapInArrow(run, LINKS)


def _verified(corners: DataFrame, wanted: DataFrame, min_inliers: int, tasks: int, send_mb: int, share: float) -> DataFrame:
    """Those of the pairs ``wanted`` (a, b) that agree, in as many rounds as let each move ``share`` bytes at most."""
    n = wanted.count()
    ends = wanted.select("a", "b", F.explode(F.array("a", "b")).alias("image_id"))
    ends = F.broadcast(ends) if n * 48 <= send_mb * 1_000_000 else ends
    sides = corners.where("length(strings) > 0").join(ends, "image_id")
    size = sides.agg(F.sum(F.length("strings") * 1.5)).first()[0] if n else 0
    rounds = max(1, int(np.ceil(float(size or 0) / share)))
    found = None
    for k in range(rounds):
        some = sides.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) if rounds > 1 else sides
        links = stash(_agree(some.repartition(tasks, "a", "b").sortWithinPartitions("a", "b"), min_inliers), "links")
        found = links if found is None else found.unionByName(links)
    return found


def copies(images: DataFrame, min_inliers: int = MIN_INLIERS, send_mb: int = SEND_MB) -> tuple[DataFrame, DataFrame]:
    """Pairs (image_a, image_b, inliers, dx, dy, d_level, d_turn) with image_a < image_b that span the groups of copies; and groups (image_id, group_id, keep).

    A group of n copies has n * n / 2 pairs, so not all are made. First, of the images that have an equal string, each is paired with the next, and pairs with enough equal corners are
    verified; components of these and of equal pixels are groups. Then all pairs of images in different groups are searched: what consensus of all pairs would join is joined. Of the corners that agree, those with matches of
    two hot strings are hot. If all are, _shared() finds the pair. Else one match at least is met by the Hamming tables, and with the matches met there so many hot ones agree that they are
    ``min_inliers`` together, which _shared() tells: such pairs are verified with all corners. Which strings are hot decides on the time only.
    Every table goes in ``PARTS`` rounds, so that few strings are on the way at once. dx and dy are the shift
    of image_b's corners, on a grid of ``SHIFT`` / 2 pixels. For equal pixels inliers is null and the changes are 0. group_id is the least image_id; images outside any group have no row: see classes().
    """
    spark = images.sparkSession
    ship(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return _copies(images, min_inliers, send_mb)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _copies(images: DataFrame, min_inliers: int, send_mb: int) -> tuple[DataFrame, DataFrame]:
    spark = images.sparkSession
    known = images.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").where("image_id is not null and pixels is not null")
    corners = stash(corners_of(known, min_inliers), "corners", compression="zstd")
    same = corners.groupBy("h0", "h1").agg(F.min("image_id").alias("a"), F.collect_set("image_id").alias("all")).where("size(all) > 1")
    equal = cut(same.select("a", F.explode("all").alias("b")).where("b > a"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = corners.agg(F.sum(F.length("strings"))).first()[0] or 0
    # little goes at once
    parts, share = (PARTS, held / PARTS) if held > LITTLE else (1, LITTLE)
    several = cut(corners.groupBy("image_id").count().where("count > 1").select("image_id", F.lit(True).alias("twice")))
    known = corners.where("length(strings) > 0")
    known = known.withColumn("twice", F.lit(False)) if several.isEmpty() else known.join(several, "image_id", "left").fillna(False, ["twice"])
    alone = known.withColumn("root", F.col("image_id"))
    none = np.empty(0, np.uint32)

    def gathered(name, tables):
        if held <= LITTLE:
            return stash(reduce(DataFrame.unionByName, tables), name)
        return reduce(DataFrame.unionByName, [stash(t, name) for t in tables])

    chain = gathered("chain", (_chained(_parcels(alone, 0, k, parts, tasks, none)) for k in range(parts)))
    hot = chain.where("b is null").orderBy(F.desc("w"), "a").limit(MOST_HOT).collect()
    shares = max(SHARES, -(-24 * sum(r["w"] for r in hot) // SHARE))
    hot = np.array(sorted(r["a"] for r in hot), np.uint32)
    likely = stash(chain.where("b is not null").groupBy("a", "b").agg(F.sum("w").alias("w")).where(F.col("w") >= max(1, min_inliers - 1)).select("a", "b"), "likely")
    first = _verified(corners, likely, min_inliers, tasks, send_mb, share)
    group = cut(components(first.select("a", "b").unionByName(equal)))
    small = F.broadcast(group) if group.count() * 16 <= send_mb * 1_000_000 else group
    grouped = known.join(small.withColumnRenamed("node", "image_id"), "image_id", "left").withColumn("root", F.coalesce("root", "image_id"))
    met = gathered("met", (_near(_parcels(grouped, j, k, parts, tasks, hot), j) for j in range(4) for k in range(parts)))
    near = met.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("hot").alias("hot")).where(F.col("w") + F.col("hot") >= min(min_inliers, 255))
    near = stash(near.select("a", "b", F.least("w", F.lit(min_inliers)).alias("w")), "near")
    wanted, shared = near.where(F.col("w") >= min_inliers).select("a", "b"), None
    if len(hot):
        shared = stash(_shared(grouped, near.where(F.col("w") < min_inliers), hot, min_inliers, shares), "shared")
        wanted = wanted.unionByName(shared.where("inliers is null").select("a", "b"))
    more = _verified(corners, wanted, min_inliers, tasks, send_mb, share)
    if shared is not None:
        more = more.unionByName(shared.where("inliers is not null"))
    zero = F.lit(0)
    alike = equal.select("a", "b", F.lit(None).cast("int").alias("inliers"), zero.alias("dx"), zero.alias("dy"), zero.alias("d_level"), zero.alias("d_turn"))
    pairs = first.unionByName(more).unionByName(alike).withColumnsRenamed({"a": "image_a", "b": "image_b"})
    # groups are linked by their least images, one edge for each
    bound = group.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    last = components(bound.unionByName(more.select("a", "b")))
    return pairs, last.select(F.col("node").alias("image_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def classes(images: DataFrame) -> DataFrame:
    """(image_id, group_id, keep) of every image that has an id: its group of copies, or itself alone."""
    own = images.select(F.col("image_id").cast("bigint").alias("image_id")).where("image_id is not null").distinct()
    return own.join(copies(images)[1], "image_id", "left").select("image_id", F.coalesce("group_id", "image_id").alias("group_id"), F.coalesce("keep", F.lit(True)).alias("keep"))
