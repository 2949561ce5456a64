"""Polygons: well-known binary, clipping by rectangles and areas, for all rings of a batch at a time."""

from __future__ import annotations

import math
import struct

import numpy as np

#: WGS 84: semi-major axis in metres and first eccentricity.
AXIS, ECCENTRICITY = 6378137.0, math.sqrt((2 - 1 / 298.257223563) / 298.257223563)
POLYGON, MULTIPOLYGON = 3, 6
Ring = list[tuple[float, float]]


def polygons(wkb: bytes) -> list[list[np.ndarray]]:
    """The polygons of a Polygon or MultiPolygon, each a list of rings (the outer one first); further dimensions are left out."""
    at = 0

    def read(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, wkb, at)
        at += struct.calcsize(order + form)
        return out

    def head() -> tuple[int, int]:
        nonlocal order, at
        order = "<" if wkb[at] else ">"
        at += 1
        kind = read("I")[0]
        if kind & 0x20000000:
            read("I")  # a reference system
        flat = kind & 0x0FFFFFFF
        return flat % 1000, 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[flat // 1000]

    def polygon(width: int) -> list[np.ndarray]:
        rings = []
        for _ in range(read("I")[0]):
            n = read("I")[0]
            rings.append(np.array(read(f"{n * width}d")).reshape(n, width)[:, :2])
        return rings

    order = "<"
    kind, width = head()
    if kind == POLYGON:
        return [polygon(width)]
    if kind != MULTIPOLYGON:
        raise ValueError(f"neither a polygon nor a multipolygon: type {kind}")
    return [polygon(head()[1]) for _ in range(read("I")[0])]


def multipolygon(parts: list[list[Ring]]) -> bytes:
    """Little-endian WKB of polygons, each a list of rings."""
    out = struct.pack("<BII", 1, MULTIPOLYGON, len(parts))
    for rings in parts:
        out += struct.pack("<BII", 1, POLYGON, len(rings))
        for ring in rings:
            out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    return out


def equal_area_y(lat: np.ndarray) -> np.ndarray:
    """Northing of the ellipsoidal cylindrical equal-area projection, in metres."""
    s, e = np.sin(np.radians(lat)), ECCENTRICITY
    return AXIS * (1 - e * e) / 2 * (s / (1 - (e * s) ** 2) + np.arctanh(e * s) / e)


def _before(ring: np.ndarray) -> np.ndarray:
    """For each point the place of the one before it in its ring. Points of a ring stand together."""
    start = np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]]))
    before = np.arange(len(ring)) - 1
    before[start] = np.concatenate([start[1:], [len(ring)]]) - 1
    return before


def clipped(points: np.ndarray, ring: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of rings lies in their rectangles: points (n, 2) with the ring of each, rectangles (x_min, x_max, y_min, y_max) by ring -> the same.

    All rings are cut by one side at a time.
    """
    for axis, side, sign in ((0, 0, 1), (0, 1, -1), (1, 2, 1), (1, 3, -1)):
        if not len(points):
            break
        limit, before = boxes[ring, side], _before(ring)
        inside = sign * (points[:, axis] - limit) >= 0
        crosses = inside != inside[before]
        p, q = points[before], points
        share = np.divide(limit - p[:, axis], q[:, axis] - p[:, axis], out=np.zeros(len(q)), where=crosses)
        count = crosses.astype(np.int64) + inside
        last = np.cumsum(count)
        out = np.empty((last[-1], 2))
        out[(last - count)[crosses]] = (p + (q - p) * share[:, None])[crosses]
        out[(last - 1)[inside]] = q[inside]
        points, ring = out, np.repeat(ring, count)
    return points, ring


def areas(points: np.ndarray, ring: np.ndarray, n: int) -> np.ndarray:
    """Areas of n rings of degrees in the equal-area projection, in square metres; rings without points have none."""
    if not len(points):
        return np.zeros(n)
    x, y, before = AXIS * np.radians(points[:, 0]), equal_area_y(points[:, 1]), _before(ring)
    return np.abs(np.bincount(ring, x[before] * y - x * y[before], minlength=n)) / 2


def flat_areas(points: np.ndarray, ring: np.ndarray, n: int) -> np.ndarray:
    """Areas of n rings in square degrees."""
    if not len(points):
        return np.zeros(n)
    x, y, before = points[:, 0], points[:, 1], _before(ring)
    return np.abs(np.bincount(ring, x[before] * y - x * y[before], minlength=n)) / 2


def cover(points: np.ndarray, ring: np.ndarray, shape: np.ndarray, hole: np.ndarray, x_lines: np.ndarray, y_lines: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shapes covered by the cells of a grid, through a quadtree over ranges of its lines.

    points (n, 2) with the ring of each; of each ring its shape (rings of one together) and whether it is a hole; low and high borders of
    the grid's lines, (n, 2), in order. Gives blocks that lie wholly inside: shape and ranges i0, i1, j0, j1 of lines; and border cells: shape, i, j, area.

    A block is a shape's part in a range of cells. Those wholly inside are given as they are; others are cut in up to four, and each takes on what its
    ring's edges leave in it, so that a ring's points go down only where its border is. Blocks are cut at cell borders alone: a cell's part of a
    shape has no corners but its own. All blocks of a level are cut at once.
    """
    n_shapes = int(shape.max()) + 1 if len(shape) else 0
    inside: list[np.ndarray] = [np.zeros((0, 5), np.int64)]
    cells: list[tuple] = [(np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0))]
    low, high = np.full((n_shapes, 2), np.inf), np.full((n_shapes, 2), -np.inf)
    np.minimum.at(low, shape[ring], points)
    np.maximum.at(high, shape[ring], points)
    ranges = np.stack([np.searchsorted(x_lines[:, 1], low[:, 0], "right"), np.searchsorted(x_lines[:, 0], high[:, 0]), np.searchsorted(y_lines[:, 1], low[:, 1], "right"), np.searchsorted(y_lines[:, 0], high[:, 1])], axis=1)
    block, owner = shape, np.arange(n_shapes)
    first = True
    while len(ring):
        if first:
            child, parent = ranges, np.arange(n_shapes)
        else:
            # Halves of each side that has more than one line; a block of one line across is cut along the other only.
            mid = (ranges[:, [0, 2]] + ranges[:, [1, 3]] + 1) // 2
            parts = []
            for right in (0, 1):
                for top in (0, 1):
                    part = ranges.copy()
                    part[:, 1 - right] = mid[:, 0]
                    part[:, 3 - top] = mid[:, 1]
                    parts.append(part)
            child, parent = np.concatenate(parts), np.tile(np.arange(len(ranges)), 4)
        some = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3])
        child, parent = child[some], parent[some]
        boxes = np.stack([x_lines[child[:, 0], 0], x_lines[child[:, 1] - 1, 1], y_lines[child[:, 2], 0], y_lines[child[:, 3] - 1, 1]], axis=1)
        # Every ring of a block goes to each of its children, and is cut to it. Children of a block stand together for its rings in turn.
        of_block = np.argsort(parent, kind="stable")
        n_children = np.bincount(parent, minlength=len(ranges))
        start = np.cumsum(n_children) - n_children
        copies = n_children[block]
        new_child = of_block[np.repeat(start[block] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
        new_from = np.repeat(np.arange(len(block)), copies)
        sizes = np.bincount(ring, minlength=len(block))
        at = np.cumsum(sizes) - sizes
        lengths = sizes[new_from]
        pick = np.repeat(at[new_from] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        cut, cut_ring = clipped(points[pick], np.repeat(np.arange(len(new_from)), lengths), boxes[new_child])
        flat = flat_areas(cut, cut_ring, len(new_from))
        new_hole = hole[new_from]
        outer = np.bincount(new_child, np.where(new_hole, 0, flat), minlength=len(child))
        holes = np.bincount(new_child, np.where(new_hole, flat, 0), minlength=len(child))
        owners = owner[parent]
        box_area = (boxes[:, 1] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 2])
        whole = (outer >= box_area * (1 - 1e-12)) & (holes == 0)
        inside.append(np.column_stack([owners[whole], child[whole]]))
        single = ~whole & (child[:, 1] - child[:, 0] == 1) & (child[:, 3] - child[:, 2] == 1) & (outer > 0)
        sign = np.where(new_hole, -1.0, 1.0)
        found = np.bincount(new_child, sign * areas(cut, cut_ring, len(new_from)), minlength=len(child))
        cells.append((owners[single], child[single][:, [0, 2]], found[single]))
        # Go on with the rest, as far as anything of the shape is in it.
        rest = ~whole & ~single & (outer > 0)
        keep = rest[new_child] & (flat > 0)
        number, ring_number = np.cumsum(rest) - 1, np.cumsum(keep) - 1
        stays = keep[cut_ring]
        points, ring = cut[stays], ring_number[cut_ring[stays]]
        block, hole = number[new_child[keep]], new_hole[keep]
        ranges, owner, first = child[rest], owners[rest], False
    return np.concatenate(inside), *(np.concatenate(x) for x in zip(*cells, strict=True))
