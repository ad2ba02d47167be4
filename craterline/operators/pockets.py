"""The area between the edge of a lattice and its convex hull, as triangles for the inverse look-up.

A lattice whose edge is bent inwards leaves pockets between that edge and its hull. A look-up that
fills the hull gives points there the position on the edge, since all corners of a pocket's
triangles lie on it: on the first column, pixel 0 exactly. Without the fill such a point has no
position at all.

Only the edge of a lattice is gathered, never its area: segments that belong to one cell. One task
per lattice, with arrays of the edge and no object for a node, closes them to loops, finds the hull of the outer loop by a monotone chain and cuts each
pocket into triangles. A pocket whose edge runs straight along its hull segment without turning back is cut
by the same chain, one triangle for every corner the chain drops; any other one, and holes inside the lattice, by
cutting off ears.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage

#: Buckets along each axis of a lattice's box under which its triangles are found; more of them, the root of the triangles, where there are many.
BUCKETS = 64
#: Triangles that leave Python at a time.
ROWS = 10_000
_CORNERS = ("a", "b", "c")
#: Sides with their ends in a fixed order, the sign that is positive inside, and whether the triangle owns them.
_SIDES = ("ab", "bc", "ca")
_SCHEMA = ("grid_id {kind}, " + ", ".join(f"{c}_{v} double" for c in _CORNERS for v in ("lon", "lat", "pixel", "scan"))
           + ", " + ", ".join(f"{s}_lon double, {s}_lat double, {s}_dlon double, {s}_dlat double, {s}_sign double, {s}_own boolean" for s in _SIDES))


def edge_segments(cells: DataFrame) -> DataFrame:
    """Directed segments (from_*, to_*) that belong to one cell only, in the cell's own sense of rotation."""
    corner = lambda p, s: F.struct(F.col(f"p{p}").alias("pixel"), F.col(f"s{s}").alias("scan"), F.col(f"lon{p}{s}").alias("lon"), F.col(f"lat{p}{s}").alias("lat"))
    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    sides = F.explode(F.array(*[F.struct(a.alias("u"), b.alias("v")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]))
    at = lambda c: F.struct(F.col(f"_e.{c}.pixel"), F.col(f"_e.{c}.scan"))
    one = (cells.select("grid_id", sides.alias("_e")).groupBy("grid_id", F.least(at("u"), at("v")).alias("_lo"), F.greatest(at("u"), at("v")).alias("_hi"))
           .agg(F.count("*").alias("_n"), F.first("_e").alias("_e")).filter("_n = 1"))
    return one.select("grid_id", *[F.col(f"_e.{s}.{c}").alias(f"{n}_{c}") for s, n in (("u", "from"), ("v", "to")) for c in ("pixel", "scan", "lon", "lat")])


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def loops(segments: np.ndarray | list[tuple[int, int]]) -> list[np.ndarray]:
    """Closed walks over directed segments; where walks touch, each goes its own way on."""
    pairs = np.asarray(segments, dtype=np.int64).reshape(-1, 2)
    size = int(pairs.max(initial=-1)) + 1
    # The segments of a node stand together, in their order; the last that is left goes next. Some arrays of the nodes, no objects.
    ends = pairs[np.argsort(pairs[:, 0], kind="stable"), 1]
    low = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(np.bincount(pairs[:, 0], minlength=size), out=low[1:])
    ends, low, left = _numbers(ends), _numbers(low[:-1]), _numbers(low[1:])
    seen, walk, found = _numbers(np.full(size, -1)), _numbers(np.zeros(len(pairs) + 1, dtype=np.int64)), []
    for begin in _numbers(pairs[:, 0]):
        while left[begin] > low[begin]:
            walk[0], n = begin, 1
            while True:
                here = walk[n - 1]
                start = seen[here]
                if start >= 0:  # a loop has closed; what came before it goes on
                    found.append(np.array(walk[start:n - 1], dtype=np.int64))
                    for node in walk[start:n - 1]:
                        seen[node] = -1
                    n = start + 1
                    if left[here] == low[here]:
                        break
                seen[here] = n - 1
                if left[here] == low[here]:
                    break
                left[here] -= 1
                walk[n] = ends[left[here]]
                n += 1
            for node in walk[:n]:
                seen[node] = -1
    return found


def _numbers(x: np.ndarray) -> array:
    return array("q", np.ascontiguousarray(x, dtype=np.int64).tobytes())


def hull(points: np.ndarray) -> list[int]:
    """Corners of the convex hull, anticlockwise from the lowest x, by a monotone chain."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    xs, ys = (array("d", np.ascontiguousarray(points[:, k], dtype=np.float64).tobytes()) for k in (0, 1))

    def half(indices):
        chain = array("q")
        for i in indices:
            x, y = xs[i], ys[i]
            while len(chain) > 1:
                o, a = chain[-2], chain[-1]
                if (xs[a] - xs[o]) * (y - ys[o]) - (ys[a] - ys[o]) * (x - xs[o]) > 0:
                    break
                chain.pop()
            chain.append(i)
        return chain[:-1].tolist()

    return half(_numbers(order)) + half(_numbers(order[::-1]))


def triangulate(points: np.ndarray) -> list[list[int]]:
    """Triangles of a simple polygon given anticlockwise; its last side, back to the first corner, is its longest chord."""
    return triangles(points).tolist()


def triangles(points: np.ndarray) -> np.ndarray:
    """``triangulate`` as one array."""
    n = len(points)
    along = (points - points[0]) @ (points[-1] - points[0])
    return _by_chain(points) if n > 2 and (np.diff(along) > 0).all() else np.array(_by_ears(points), dtype=np.int64).reshape(-1, 3)


def _by_chain(points: np.ndarray) -> np.ndarray:
    """Corners that point outwards are cut off, every other one in a round, so triangles grow evenly; at the end the chord is left."""
    out, chain, cut = [], np.arange(len(points)), True
    while cut and len(chain) > 2:
        turns = _cross(points[chain[:-2]], points[chain[1:-1]], points[chain[2:]])
        # Of corners in a row that may go, the first, third and so on go.
        may = turns >= 0
        place = np.arange(len(may))
        last = np.maximum.accumulate(np.where(may, -1, place))
        gone = may & ((place - last) % 2 == 1)
        cut = bool(gone.any())
        at = np.flatnonzero(gone & (turns > 0))
        out.append(np.column_stack([chain[at], chain[at + 1], chain[at + 2]]))
        chain = chain[np.r_[True, ~gone, True]]
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def _by_ears(points: np.ndarray) -> list[tuple[int, int, int]]:
    left, out, at, misses = list(range(len(points))), [], 0, 0
    while len(left) > 2 and misses <= len(left):
        i, j, k = left[at - 1], left[at % len(left)], left[(at + 1) % len(left)]
        a, b, c = points[i], points[j], points[k]
        turn = _cross(a, b, c)
        if turn > 0:
            others = points[[x for x in left if x not in (i, j, k)]]
            inside = (_cross(a[None], b[None], others) >= 0) & (_cross(b[None], c[None], others) >= 0) & (_cross(c[None], a[None], others) >= 0)
            ear = not inside.any()
        else:
            ear = turn == 0
        if ear:
            if turn > 0:
                out.append((i, j, k))
            left.pop(at % len(left))
            at, misses = at % max(len(left), 1), 0
        else:
            at, misses = (at + 1) % len(left), misses + 1
    return out


def _fill(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of the pockets and holes of one lattice from the beginnings, then the ends of its segments (pixel, scan, lon, lat).

    Corners (triangle, corner, value of a node) and, for each side, whether it lies on the hull. Arrays of the edge throughout.
    """
    # A node is its pixel and scan; lexicographic, like the nodes before.
    _, first, place = np.unique(both[:, 0] + 1j * both[:, 1], return_index=True, return_inverse=True)
    nodes, place = both[first], place.ravel()
    del both
    walks = loops(place.reshape(2, -1).T)
    ground = nodes[:, 2:]
    area = lambda w: float(np.sum(ground[w, 0] * np.roll(ground[w, 1], -1) - ground[w, 1] * np.roll(ground[w, 0], -1)))
    areas = [area(w) for w in walks]
    outer = max(range(len(walks)), key=lambda k: abs(areas[k]))
    sense = 1 if areas[outer] > 0 else -1
    polygons: list[tuple[np.ndarray, bool]] = []
    for k, walk in enumerate(walks):
        if areas[k] * sense < 0:  # a hole runs the other way round
            polygons.append((walk if areas[k] > 0 else walk[::-1], False))
    for k, walk in enumerate(walks):
        if areas[k] * sense > 0:
            walk = walk if sense > 0 else walk[::-1]
            corners = sorted(hull(ground[walk]))
            for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
                chain = walk[a:b + 1] if a < b else np.concatenate([walk[a:], walk[:b + 1]])
                # Seen from the pocket the edge runs backwards.
                if len(chain) > 2 and _cross(ground[chain[:1]], ground[chain[-1:]], ground[chain[1:-1]]).max() > 0:
                    polygons.append((chain[::-1], True))
    found, open_ = [np.zeros((0, 3), dtype=np.int64)], [np.zeros((0, 3), dtype=bool)]
    for polygon, open_side in polygons:
        t, last = triangles(ground[polygon]), len(polygon) - 1
        found.append(polygon[t])
        i, j = t, np.roll(t, -1, axis=1)
        open_.append(open_side & (((i == 0) & (j == last)) | ((i == last) & (j == 0))))
    return nodes[np.concatenate(found)], np.concatenate(open_)


def _columns(corners: np.ndarray, on_hull: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``_SCHEMA`` after the grid."""
    out = {f"{c}_{v}": corners[:, k, n] for k, c in enumerate(_CORNERS) for n, v in ((2, "lon"), (3, "lat"), (0, "pixel"), (1, "scan"))}
    for k, side in enumerate(_SIDES):
        (x, y), (u, v) = (corners[:, at % 3, 2:].T for at in (k, k + 1))
        ahead = (x < u) | ((x == u) & (y < v))
        low, high = ([np.where(ahead, a, b) for a, b in ((x, u), (y, v))], [np.where(ahead, b, a) for a, b in ((x, u), (y, v))])
        out |= {f"{side}_lon": low[0], f"{side}_lat": low[1], f"{side}_dlon": high[0] - low[0], f"{side}_dlat": high[1] - low[1],
                f"{side}_sign": np.where(ahead, 1.0, -1.0), f"{side}_own": on_hull[:, k] | ahead}
    return out


def hull_pockets(cells: DataFrame) -> DataFrame:
    """Triangles between the edge of each lattice and its convex hull, and of holes in it.

    Corners come anticlockwise with lon, lat, pixel and scan. Of two triangles at a side one owns it; sides on the hull are owned too. Write the
    table once per product and hand it to ``ground_to_pixel`` or a ``GridPair``.
    """
    kind = cells.schema["grid_id"].dataType.simpleString()
    schema = _SCHEMA.format(kind=kind)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def fill(segments: pa.Table) -> pa.Table:
        grid = segments["grid_id"][0]
        both = np.empty((2, len(segments), 4))
        for k, s in enumerate(("from", "to")):
            for n, c in enumerate(("pixel", "scan", "lon", "lat")):
                both[k, :, n] = segments[f"{s}_{c}"].to_numpy()
        corners, on_hull = _fill(both.reshape(-1, 4))
        del both
        rows = []
        for at in range(0, max(1, len(corners)), ROWS):  # as many at a time as Spark takes
            c = _columns(corners[at:at + ROWS], on_hull[at:at + ROWS])
            rows.append(pa.table([pa.array([grid.as_py()] * len(c["a_lon"]), grid.type), *[pa.array(c[n]) for n in names[1:]]], names=names))
        return pa.concat_tables(rows)

    return edge_segments(cells).groupBy("grid_id").applyInArrow(fill, schema)


def _box(pockets: DataFrame) -> DataFrame:
    """Where the buckets of each lattice begin and how wide they are."""
    low, high = ({v: [F.col(f"{c}_{v}") for c in _CORNERS] for v in ("lon", "lat")} for _ in range(2))
    one = pockets.groupBy("grid_id").agg(*[f for v in ("lon", "lat") for f in (
        F.min(F.least(*low[v])).alias(f"_{v}_min"), F.max(F.greatest(*high[v])).alias(f"_{v}_max"))],
        F.greatest(F.lit(BUCKETS), F.ceil(F.sqrt(F.count("*")))).cast("long").alias("_buckets"))
    step = lambda v: ((F.col(f"_{v}_max") - F.col(f"_{v}_min")) / F.col("_buckets")).alias(f"_{v}_step")
    return one.select(F.col("grid_id").alias("_box_grid"), "_lon_min", "_lat_min", "_buckets", step("lon"), step("lat"))


def _bucket(value: Column, axis: str) -> Column:
    return F.least(F.greatest(F.floor((value - F.col(f"_{axis}_min")) / F.col(f"_{axis}_step")), F.lit(0)), F.col("_buckets") - 1).cast("long")


def fill_from_pockets(points: DataFrame, pockets: DataFrame, grid: str, lon: str, lat: str, pixel: str, scan: str) -> DataFrame:
    """Points without ``pixel`` and ``scan`` get those of the pocket they lie in.

    Every side is tested with its ends in a fixed order, so the two triangles at a side see the same
    number, and only one of them owns it: a point meets one triangle at most and no row is doubled.
    """
    box = stage(_box(pockets))  # a row for each lattice: Spark sees that it is small, whatever the triangles
    t = pockets.join(box, pockets["grid_id"] == box["_box_grid"]).withColumn("_tg", F.col("grid_id"))
    spread = lambda v: F.explode(F.sequence(_bucket(F.least(*[F.col(f"{c}_{v}") for c in _CORNERS]), v), _bucket(F.greatest(*[F.col(f"{c}_{v}") for c in _CORNERS]), v)))
    sides = [f"{s}_{c}" for s in _SIDES for c in ("lon", "lat", "dlon", "dlat", "sign", "own")]
    t = t.withColumn("_tx", spread("lon")).withColumn("_ty", spread("lat")).select(
        "_tg", "_tx", "_ty", *[f"{c}_{v}" for c in _CORNERS for v in ("lon", "lat", "pixel", "scan")], *sides)
    q = points.join(box, points[grid] == box["_box_grid"], "left")
    # Points that have a position get a bucket of their own kind, spread out, which no triangle has.
    open_ = F.col(pixel).isNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()
    rest = [F.col(f"`{f.name}`") for f in points.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    # The small number that look-ups carry (``geometry.SPREAD``), where there is one.
    aside = -1 - (F.col("_spread").cast("long") if "_spread" in points.columns else F.pmod(F.xxhash64(*rest), F.lit(1 << 40)))
    q = q.withColumn("_qx", F.when(open_, _bucket(F.col(lon), "lon")).otherwise(aside)).withColumn("_qy", F.when(open_, _bucket(F.col(lat), "lat")).otherwise(F.lit(-1)))
    x, y = F.col(lon), F.col(lat)

    def side(name: str) -> Column:
        c = lambda n: F.col(f"{name}_{n}")
        value = (c("dlon") * (y - c("lat")) - c("dlat") * (x - c("lon"))) * c("sign")
        return (value > 0) | ((value == 0) & c("own"))

    inside = side("ab") & side("bc") & side("ca")
    j = q.join(t, (q[grid] == t["_tg"]) & (q["_qx"] == t["_tx"]) & (q["_qy"] == t["_ty"]) & inside, "left")
    ux, uy, vx, vy = (F.col(f"{c}_{v}") - F.col(f"a_{v}") for c in ("b", "c") for v in ("lon", "lat"))
    den = ux * vy - uy * vx
    u = ((x - F.col("a_lon")) * vy - (y - F.col("a_lat")) * vx) / den
    v = (ux * (y - F.col("a_lat")) - uy * (x - F.col("a_lon"))) / den
    at = lambda c: F.col(f"a_{c}") + u * (F.col(f"b_{c}") - F.col(f"a_{c}")) + v * (F.col(f"c_{c}") - F.col(f"a_{c}"))
    return j.select(*[F.coalesce(F.col(c), at(n)).alias(c) if (n := {pixel: "pixel", scan: "scan"}.get(c)) else F.col(c) for c in points.columns])
