"""Surfaces inside a cube of 2 x 2 x 2 voxels, by a rule instead of a table of triangles."""

from __future__ import annotations

import itertools

import numpy as np

#: Corners by number: bit 2 is z, bit 1 is y, bit 0 is x. Edges join corners that differ in one bit.
CORNERS = list(itertools.product((0, 1), repeat=3))
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b).bit_count() == 1]


def _faces() -> list[list[int]]:
    """The corners of each face in turn, counter-clockwise seen from outside."""
    out = []
    for axis in range(3):
        first, second = [a for a in range(3) if a != axis]
        for side in (0, 1):
            ring = []
            for p, q in ((0, 0), (0, 1), (1, 1), (1, 0)):
                at = [0, 0, 0]
                at[axis], at[first], at[second] = side, p, q
                ring.append(at)
            normal = np.cross(np.subtract(ring[1], ring[0]), np.subtract(ring[2], ring[1]))[axis]
            ring = ring if (normal > 0) == (side == 1) else ring[::-1]
            out.append([at[0] * 4 + at[1] * 2 + at[2] for at in ring])
    return out


FACES = _faces()


def loops(code: int) -> list[list[int]]:
    """The closed lines in which the surface around the corners set in `code` is bounded, as lists of edges that it crosses.

    On each face a line leads from where the border goes out of a set corner back to where it came in; so set corners that meet
    only across a face's diagonal are parted, in the same way from both of the cubes that share the face, and the surface of a
    whole volume is closed.
    """
    inside = [bool(code >> k & 1) for k in range(8)]
    number = {frozenset(e): k for k, e in enumerate(EDGES)}
    after = {}
    for ring in FACES:
        for k in range(4):
            if inside[ring[k]] and not inside[ring[(k + 1) % 4]]:
                back = k
                while inside[ring[back - 1]]:
                    back -= 1
                after[number[frozenset((ring[k], ring[(k + 1) % 4]))]] = number[frozenset((ring[back], ring[back - 1]))]
    out = []
    while after:
        line = [min(after)]
        while (then := after.pop(line[-1])) != line[0]:
            line.append(then)
        out.append(line)
    return out


def triangles(code: int) -> list[tuple[int, int, int]]:
    """Each loop as triangles around its first edge; a triangle's corners are the middles of three edges."""
    return [(line[0], b, a) for line in loops(code) for a, b in zip(line[1:], line[2:], strict=False)]


def pieces(vz: float, vy: float, vx: float) -> list[tuple[int, float, float, float, float, float]]:
    """(code, area, nz, ny, nx, moment) of all 256 codes for voxels of this size: the surface's area, the sum of its outward area
    vectors, and that of their products with the triangles' middles. A volume's content is a third of the sum over its cubes
    of moment plus the cube's place times the area vector."""
    size = np.array([vz, vy, vx])
    middle = np.array([(np.array(CORNERS[a]) + np.array(CORNERS[b])) / 2 * size for a, b in EDGES])
    out = []
    for code in range(256):
        area, vector, moment = 0.0, np.zeros(3), 0.0
        for a, b, c in triangles(code):
            own = np.cross(middle[b] - middle[a], middle[c] - middle[a]) / 2
            area += float(np.linalg.norm(own))
            vector += own
            moment += float(own @ (middle[a] + middle[b] + middle[c]) / 3)
        out.append((code, area, *map(float, vector), moment))
    return out
