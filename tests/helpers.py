"""Small hand-made grids and brute-force answers to compare with."""

from __future__ import annotations

import numpy as np

GRID_SCHEMA = "grid_id string, grid_row int, grid_col int, elev float"
GEOMETRY_SCHEMA = (
    "grid_id string, x0 double, dx double, rx double, y0 double, ry double, dy double, width int, height int"
)


def grid_of(spark, values, grid_id="g"):
    """Rows of numbers (None = void) to a grid table and its geometry, one unit per cell, y upwards."""
    rows = [
        (grid_id, r, c, None if v is None else float(v)) for r, line in enumerate(values) for c, v in enumerate(line)
    ]
    geometry = [(grid_id, 0.0, 1.0, 0.0, float(len(values)), 0.0, -1.0, len(values[0]), len(values))]
    return spark.createDataFrame(rows, GRID_SCHEMA), spark.createDataFrame(geometry, GEOMETRY_SCHEMA)


def mask_of(spark, lines, grid_id="g", layer=0):
    """Text lines (# = member) to a mask and its geometry."""
    rows = [(grid_id, layer, r, c) for r, line in enumerate(lines) for c, v in enumerate(line) if v == "#"]
    geometry = [(grid_id, 0.0, 1.0, 0.0, float(len(lines)), 0.0, -1.0, len(lines[0]), len(lines))]
    return (
        spark.createDataFrame(rows, "grid_id string, layer int, grid_row int, grid_col int"),
        spark.createDataFrame(geometry, GEOMETRY_SCHEMA),
    )


def masks_of(spark, shapes, layer=0):
    """Several shapes as grids of one mask, each named after its shape."""
    rows = [
        (name, layer, r, c)
        for name, lines in shapes.items()
        for r, line in enumerate(lines)
        for c, v in enumerate(line)
        if v == "#"
    ]
    geometry = [
        (name, 0.0, 1.0, 0.0, float(len(lines)), 0.0, -1.0, len(lines[0]), len(lines)) for name, lines in shapes.items()
    ]
    return (
        spark.createDataFrame(rows, "grid_id string, layer int, grid_row int, grid_col int"),
        spark.createDataFrame(geometry, GEOMETRY_SCHEMA),
    )


def random_mask(rows, cols, share, seed):
    rng = np.random.default_rng(seed)
    return ["".join("#" if v else "." for v in line) for line in rng.random((rows, cols)) < share]


def flood_components(lines):
    """{(row, col): least linear cell of its 8-connected area} by flood fill."""
    width = len(lines[0])
    left = {(r, c) for r, line in enumerate(lines) for c, v in enumerate(line) if v == "#"}
    found = {}
    while left:
        stack, area = [left.pop()], set()
        while stack:
            r, c = stack.pop()
            area.add((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (r + dr, c + dc) in left:
                        left.remove((r + dr, c + dc))
                        stack.append((r + dr, c + dc))
        least = min(r * width + c for r, c in area)
        found.update({cell: least for cell in area})
    return found


def walk_rings(lines):
    """Corner lists of all rings by walking the sides one by one, keyed by (component, first step)."""
    members = {(r, c) for r, line in enumerate(lines) for c, v in enumerate(line) if v == "#"}
    labels = flood_components(lines)
    move = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}
    facing = {0: (-1, 0), 1: (0, 1), 2: (1, 0), 3: (0, -1)}
    start = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 0)}
    steps = {}
    for r, c in members:
        for side, (dr, dc) in facing.items():
            if (r + dr, c + dc) not in members:
                steps[(r + start[side][0], c + start[side][1], side)] = labels[(r, c)]
    rings = {}
    left = dict(steps)
    while left:
        first = min(left)
        component, ring, step = left[first], [], first
        while step in left:
            del left[step]
            ring.append(step)
            r, c, side = step
            r, c = r + move[side][0], c + move[side][1]
            step = next(
                (r, c, (side + t) % 4) for t in (3, 0, 1) if (r, c, (side + t) % 4) in steps
            )
        assert step == first
        corners = [s[:2] for i, s in enumerate(ring) if ring[i - 1][2] != s[2]]
        rings[(component, first)] = corners
    return rings
