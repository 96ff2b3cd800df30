"""Distance, nearest, polygon and route joins. Every join is an equi join on grid cells, never a cross join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.functions import geo
from fieldbook.plans.durable import durable
from fieldbook.plans.ordered import running
from fieldbook.plans.skew import MOST_TASKS, dealt, row_blocks, salted_join

_CELL = ["__band", "__col"]


def _degree_cells(radius: float, earth: float):
    """Cell rules for a radius: latitude bands of one radius, columns at least one radius wide in their band."""
    delta = math.degrees(radius / earth) * (1 + 1e-9)

    def width(band: Column) -> Column:
        # widest |latitude| of the band decides; the floor keeps polar bands finite
        top = F.greatest(F.abs(band * delta), F.abs((band + 1) * delta))
        return F.lit(delta) / F.greatest(F.cos(F.radians(F.least(top, F.lit(90.0)))), F.lit(0.01))
    return delta, width


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_xy=("lat", "lon"), right_xy=("rlat", "rlon"),
                earth: float = geo.RADIUS_MI, out: str = "distance", salt_by: Sequence[str] | None = None,
                rows_per_split: int = 100_000, also_on: Sequence[str] = (), bands: Sequence[float] | None = None,
                nearest: int = 5) -> DataFrame:
    """All (left, right) pairs within ``radius`` inclusive, with the distance.

    The larger side should be ``left``: it keeps one row per point, the right side is repeated over the cells its
    radius touches (at most about nine). Hot cells are split by count. ``also_on``
    names columns both sides share that must be equal too. Works across the date line.

    With ``bands`` the pairs are counted where they meet, for ``distance_bands``: one row for a right row and block of left
    rows, with ``out`` a struct of the counts and the ``nearest`` few distances. What that costs grows with the right rows and
    the left rows near a circle's line, not with the pairs.
    """
    if bands is not None and also_on:
        raise ValueError("bands are counted by place alone")
    delta, width = _degree_cells(radius, earth)
    la, lo = F.col(left_xy[0]), F.col(left_xy[1])
    ra, ro = F.col(right_xy[0]), F.col(right_xy[1])
    band = F.floor(la / delta)
    l = (left.where(la.isNotNull() & lo.isNotNull())
         .withColumn("__band", band).withColumn("__col", F.floor(lo / width(F.col("__band")))))
    reach = F.when(F.abs(ra) + delta >= 89.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(delta))) / F.cos(F.radians(ra))))) * (1 + 1e-9))
    r = (right.where(ra.isNotNull() & ro.isNotNull())
         .withColumn("__reach", reach)
         .withColumn("__shift", F.explode(F.filter(
             F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)),
             lambda s: (ro + s - F.col("__reach") <= 180.0) & (ro + s + F.col("__reach") >= -180.0))))
         .withColumn("__band", F.explode(F.sequence(F.floor((ra - delta) / delta), F.floor((ra + delta) / delta))))
         .withColumn("__w", width(F.col("__band")))
         .withColumn("__col", F.explode(F.sequence(
             F.floor((ro + F.col("__shift") - F.col("__reach")) / F.col("__w")),
             F.floor((ro + F.col("__shift") + F.col("__reach")) / F.col("__w")))))
         .drop("__reach", "__w"))
    if bands is not None:
        return _counted(l, r, left_xy, right_xy, radius, earth, out, salt_by or list(left_xy), rows_per_split, bands, nearest)
    r = r.drop("__shift")
    j = salted_join(l, r, [*_CELL, *also_on], salt_by or list(left_xy), rows_per_split=rows_per_split)
    d = geo.haversine(left_xy[0], left_xy[1], right_xy[0], right_xy[1], earth)
    near = F.abs(la - ra) <= delta * (1 + 1e-6) + 1e-9  # spares most of the far pairs the sines
    return j.where(near).withColumn(out, d).where(F.col(out) <= radius).drop(*_CELL)


_COUNTED_ROWS, _DEALT_ROWS = 5_000, 20_000  # right rows of a cell counted in one go, and right rows of a task


def _band_names(edges: Sequence[float]) -> list[str]:
    return ["within_" + f"{e:g}".replace(".", "_") for e in edges]


def _counted(l: DataFrame, r: DataFrame, left_xy, right_xy, radius: float, earth: float, out: str, salt_by: Sequence[str],
             rows_per_split: int, bands: Sequence[float], nearest: int) -> DataFrame:
    """Right rows with the counts and nearest distances of the left rows of each cell they reach. A block's left rows are held
    by a task as numbers; right rows pass by in batches."""
    keep = [c for c in r.columns if c not in (*_CELL, "__shift")]
    kinds = {f.name: f.dataType for f in r.schema.fields}
    r = r.withColumn("__row", F.struct(*keep))
    ra, ro = (F.col(c).cast("double") for c in right_xy)
    r = r.select(*_CELL, "__row", ra.alias("__y"), ro.alias("__x"), "__shift")
    l, r = dealt(l.withColumns({"__y": F.col(left_xy[0]).cast("double"), "__x": F.col(left_xy[1]).cast("double")}), r, _CELL, salt_by,
                 row_blocks(l, r, _CELL, rows_per_split, _COUNTED_ROWS))
    on = [*_CELL, "__lb", "__rb"]
    row = T.StructType([T.StructField(c, kinds[c]) for c in keep])
    none = F.lit(None).cast(row)
    both = l.select(*on, F.lit(0).alias("__side"), "__y", "__x", F.lit(0.0).alias("__shift"), none.alias("__row")).unionByName(
        r.select(*on, F.lit(1).alias("__side"), "__y", "__x", "__shift", "__row"))
    tasks = min(MOST_TASKS, max(int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(r.count() / _DEALT_ROWS)))
    names, few = ["total", "inside", *_band_names(bands)], f"nearest_{nearest}"
    radius, bands = float(radius), [float(e) for e in bands]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        from fieldbook.operators import rings
        block, held, places = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            *key, side, y, x, shift = (b.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            key = np.stack(key)
            new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (side[1:] != side[:-1])]
            cut = [*np.flatnonzero(new).tolist(), len(side)]
            for begin, end in zip(cut[:-1], cut[1:]):
                if tuple(key[:, begin]) != block:
                    block, held, places = tuple(key[:, begin]), [], None
                if side[begin] == 0:
                    held.append((y[begin:end], x[begin:end]))
                    continue
                if not held:
                    continue
                places = places or rings.Places(*(np.concatenate(c) for c in zip(*held)), earth)
                rows = begin + np.flatnonzero(np.isfinite(y[begin:end]) & np.isfinite(x[begin:end]))
                if not len(rows):
                    continue
                sums, near = rings.tally(y[rows], x[rows], shift[rows], places, radius, bands, nearest)
                met = np.flatnonzero(sums[0] > 0)
                ends = np.r_[0, np.cumsum([len(near[k]) for k in met.tolist()])].astype(np.int32)
                flat = np.concatenate([near[k] for k in met.tolist()] or [np.empty(0)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(8).take(pa.array(rows[met])), *(pa.array(s[met]) for s in sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["__row", *names, few])

    schema = T.StructType([T.StructField("__row", row), *(T.StructField(c, T.LongType()) for c in names),
                           T.StructField(few, T.ArrayType(T.DoubleType()))])
    got = both.repartition(tasks, *on).sortWithinPartitions(*on, "__side").mapInArrow(count, schema)
    return got.select("__row.*", F.struct(*names, few).alias(out))


def nearest_join(left: DataFrame, right: DataFrame, left_id: str, right_cols: Sequence[str], cap: float,
                 left_xy=("lat", "lon"), right_xy=("rlat", "rlon"), earth: float = geo.RADIUS_MI,
                 tie: str | None = None, steps: Sequence[float] | None = None) -> DataFrame:
    """Nearest right row per left row, or nulls when none lies within ``cap`` (a gap, not a value).

    The radius widens step by step and only rows without a hit go on, so dense areas never pay for the cap. Unless told,
    it starts where a point would meet about ``_FIRST_HITS`` places if they lay evenly, and grows four times a step: a point
    that met nothing has few places around it, so what a step meets grows with the points, not with points times places.
    Rows at one place are reduced to the one that wins its ties first.
    """
    tie = tie or right_cols[0]
    points = left.select(left_id, *left_xy)
    places = right.groupBy(*right_xy).agg(F.min_by(F.struct(*right_cols), F.struct(tie)).alias("__r"), F.min(F.struct(tie)).alias("__tie"))
    places = durable(places.where(F.col(right_xy[0]).isNotNull() & F.col(right_xy[1]).isNotNull()))
    steps = steps or _widening(places, right_xy, cap, earth)
    found = None
    for share in steps:
        j = radius_join(points, places, cap * share, left_xy, right_xy, earth, "__d", [left_id])
        best = durable(j.groupBy(left_id)
                       .agg(F.min_by(F.struct(F.col("__d").alias("distance"), F.col("__r")),
                                     F.struct("__d", "__tie")).alias("__n")))
        found = best if found is None else found.unionByName(best)
        if share != steps[-1]:
            points = durable(points.join(best.select(left_id), left_id, "left_anti"))
    return left.join(found, left_id, "left").select(left.columns + ["__n.distance"] + [f"__n.__r.{c}" for c in right_cols])


_FIRST_HITS = 4.0


def _widening(places: DataFrame, xy: Sequence[str], cap: float, earth: float) -> list[float]:
    """Shares of the cap to try, from a circle that holds about ``_FIRST_HITS`` places of the area they span."""
    y, x = F.col(xy[0]), F.col(xy[1])
    n, south, north, west, east = places.agg(F.count(F.lit(1)), F.min(y), F.max(y), F.min(x), F.max(x)).first()
    if not n:
        return [1.0]
    mile = math.radians(1.0) * earth
    area = max((north - south) * mile, cap) * max((east - west) * mile * math.cos(math.radians((north + south) / 2)), cap)
    first = math.sqrt(_FIRST_HITS * area / (math.pi * n)) / cap
    shares = [1.0]
    while shares[0] / 4 >= first and len(shares) < 8:
        shares.insert(0, shares[0] / 4)
    return shares if len(shares) > 1 else [0.25, 1.0]


def _cover(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> tuple[Column, Column]:
    return (F.sequence(F.floor(x0 / size), F.floor(x1 / size)), F.sequence(F.floor(y0 / size), F.floor(y1 / size)))


def with_cells(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"__band": F.floor(F.col(y) / size), "__col": F.floor(F.col(x) / size)})


def shapes_over_cells(shapes: DataFrame, rings: str, size: float, pad: float = 0.0) -> DataFrame:
    """Repeat each polygon over the cells its padded bounding box touches."""
    pts = F.flatten(F.col(rings))
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    cols, bands = _cover(F.array_min(xs) - pad, F.array_max(xs) + pad, F.array_min(ys) - pad, F.array_max(ys) + pad,
                         size)
    return shapes.withColumn("__band", F.explode(bands)).withColumn("__col", F.explode(cols))


def point_in_polygon(points: DataFrame, shapes: DataFrame, x: str, y: str, rings: str, size: float,
                     salt_by: Sequence[str], how: str = "inner") -> DataFrame:
    """Points with the polygons that hold them (even-odd over all rings, so holes are out)."""
    j = salted_join(with_cells(points, x, y, size), shapes_over_cells(shapes, rings, size), _CELL, salt_by)
    hit = j.where(geo.inside(x, y, F.col(rings))).drop(*_CELL)
    return hit if how == "inner" else points.join(hit.select(*salt_by).distinct(), list(salt_by), "left_anti")


def polygon_distance_join(points: DataFrame, shapes: DataFrame, x: str, y: str, rings: str, cap: float,
                          salt_by: Sequence[str], out: str = "distance") -> DataFrame:
    """Points within ``cap`` of a polygon with the distance, 0 inside."""
    size = max(cap, 1e-9)
    j = salted_join(with_cells(points, x, y, size), shapes_over_cells(shapes, rings, size, cap), _CELL, salt_by)
    return j.withColumn(out, geo.ring_distance(x, y, F.col(rings))).where(F.col(out) <= cap).drop(*_CELL)


def polygon_gap(a: Column, b: Column) -> Column:
    """Edge-to-edge distance of two polygons; 0 when a vertex of one lies in the other."""
    va, vb = F.flatten(a), F.flatten(b)
    touch = F.exists(va, lambda p: geo.inside(p[0], p[1], b)) | F.exists(vb, lambda p: geo.inside(p[0], p[1], a))

    def least(vertices, rings):
        edges = geo.edges_of(rings)
        return F.array_min(F.transform(vertices, lambda p: F.array_min(F.transform(
            edges, lambda s: geo.segment_distance2(p[0], p[1], s.x1, s.y1, s.x2, s.y2)))))
    return F.when(touch, 0.0).otherwise(F.sqrt(F.least(least(va, b), least(vb, a))))


def polygon_pairs_within(a: DataFrame, b: DataFrame, rings_a: str, rings_b: str, id_a: str, id_b: str, cap: float,
                         size: float, out: str = "gap") -> DataFrame:
    """Pairs of polygons whose gap is at most ``cap``. A pair meeting in several cells is measured once."""
    l = shapes_over_cells(a, rings_a, size)
    r = shapes_over_cells(b, rings_b, size, cap)
    pairs = salted_join(l.select(id_a, *_CELL), r.select(id_b, *_CELL), _CELL, [id_a]).select(id_a, id_b).distinct()
    j = pairs.join(a.select(id_a, rings_a), id_a).join(b.select(id_b, rings_b), id_b)
    return j.withColumn(out, polygon_gap(F.col(rings_a), F.col(rings_b))).where(F.col(out) <= cap).select(id_a, id_b, out)


def overlap_shares(shapes: DataFrame, layer: DataFrame, shape_id: str, rings: str, layer_id: str, layer_rings: str,
                   samples: int, size: float) -> DataFrame:
    """Share of each shape covered by each layer polygon, from an even sample of points inside the shape."""
    pts = (shapes.withColumn("__p", F.explode(geo.sample_grid(F.col(rings), samples)))
           .withColumns({"__x": F.col("__p.x"), "__y": F.col("__p.y")})
           .where(geo.inside("__x", "__y", F.col(rings))).select(shape_id, "__x", "__y"))
    total = pts.groupBy(shape_id).agg(F.count(F.lit(1)).alias("points"))
    hit = point_in_polygon(pts, layer.select(layer_id, layer_rings), "__x", "__y", layer_rings, size,
                           [shape_id, "__x", "__y"])
    n = hit.groupBy(shape_id, layer_id).agg(F.count(F.lit(1)).alias("hits"))
    areas = shapes.select(shape_id, geo.area(F.col(rings)).alias("area"))
    return (n.join(total, shape_id).join(areas, shape_id)
            .withColumn("share", F.col("hits") / F.col("points"))
            .withColumn("covered_area", F.col("share") * F.col("area")))


def line_segments(lines: DataFrame, line_id: str, coords: str) -> DataFrame:
    """Segments of polylines with metres at their start, counted along the line."""
    n = F.size(coords)
    seg = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        i.alias("seg"), F.element_at(coords, i)[0].alias("x1"), F.element_at(coords, i)[1].alias("y1"),
        F.element_at(coords, i + 1)[0].alias("x2"), F.element_at(coords, i + 1)[1].alias("y2")))
    d = lines.where(n > 1).select(line_id, F.explode(seg).alias("s")).select(line_id, "s.*")
    d = d.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    d = running(d, [line_id], ["seg"], None, {"m_end": ("sum", "length")})
    return d.withColumn("m_start", F.col("m_end") - F.col("length"))


def locate_on_line(points: DataFrame, segments: DataFrame, point_id: str, x: str, y: str, line_id: str,
                   buffer: float) -> DataFrame:
    """Nearest place on each line within ``buffer``: metres along it and metres off it."""
    size = max(buffer, 1e-9)
    cols, bands = _cover(F.least("x1", "x2") - buffer, F.greatest("x1", "x2") + buffer,
                         F.least("y1", "y2") - buffer, F.greatest("y1", "y2") + buffer, size)
    s = segments.withColumn("__band", F.explode(bands)).withColumn("__col", F.explode(cols))
    j = salted_join(with_cells(points, x, y, size), s, _CELL, [point_id])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(
        (F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    j = j.withColumn("__t", t).withColumn("off_m", F.hypot(
        F.col("x1") + F.col("__t") * dx - F.col(x), F.col("y1") + F.col("__t") * dy - F.col(y)))
    j = j.where(F.col("off_m") <= buffer).withColumn("along_m", F.col("m_start") + F.col("__t") * F.col("length"))
    best = j.groupBy(point_id, line_id).agg(
        F.min_by(F.struct("along_m", "off_m"), F.struct("off_m", "seg")).alias("b"))
    return best.select(point_id, line_id, "b.along_m", "b.off_m")


def downstream(located: DataFrame, start: DataFrame, line_id: str, start_m: str) -> DataFrame:
    """Located points at or below the start point on the same line, with metres downstream.

    ``start`` holds one row per line (the outfall's own position).
    """
    return (located.join(start.select(line_id, F.col(start_m).alias("__m0")), line_id)
            .where(F.col("along_m") >= F.col("__m0"))
            .withColumn("downstream_m", F.col("along_m") - F.col("__m0")).drop("__m0"))


def route_metres(reaches: DataFrame, starts: DataFrame, reach: str, head: str, tail: str, length: str,
                 most: float | None = None) -> DataFrame:
    """(reach, head_m): the reaches that water from the starts runs through, with the least metres from a start to their head.

    ``starts`` has node and m, metres already gone there: a start inside a reach is that reach's head with minus the metres
    before it. Each round carries the nodes that came nearer over their outgoing reaches, until none does or ``most`` metres
    are passed, so loops end; a reach should be a whole polyline between two forks, since there is a round for each reach of
    the longest way. Reaches without nodes or length carry nothing.
    """
    edges = reaches.where(F.col(length) >= 0).select(F.col(head).alias("node"), F.col(tail).alias("__to"), F.col(length).alias("__len"))
    known = starts.where("node IS NOT NULL AND m IS NOT NULL").groupBy("node").agg(F.min("m").alias("m"))
    known = durable(known.withColumn("nearer", F.lit(True)))
    while not known.where("nearer").isEmpty():
        step = edges.join(known.where("nearer"), "node").select(F.col("__to").alias("node"), (F.col("m") + F.col("__len")).alias("__m"))
        step = step.where("node IS NOT NULL" if most is None else (F.col("node").isNotNull() & (F.col("__m") <= most)))
        met = known.select("node", "m", F.lit(None).cast("double").alias("__m")).unionByName(
            step.select("node", F.lit(None).cast("double").alias("m"), "__m")).groupBy("node").agg(F.min("m").alias("m"), F.min("__m").alias("__m"))
        known = durable(met.select("node", F.least("m", "__m").alias("m"), F.coalesce(
            F.col("__m") < F.col("m"), F.col("m").isNull()).alias("nearer")))
    return reaches.join(known.select(F.col("node").alias(head), F.col("m").alias("head_m")), head).select(reach, "head_m")


def along_routes(points: DataFrame, reaches: DataFrame, metres: DataFrame, point_id: str, x: str, y: str, reach: str, coords: str,
                 route: str, buffer: float) -> DataFrame:
    """(point, route, along_m, off_m): points within ``buffer`` of a route at or below the start, each on its first route only.

    ``reaches`` have a route number, 1 for the main one; ``metres`` comes from ``route_metres``. A point whose nearest place on
    a route lies above the start is not on that route, but may be on the next. Of places equally near the least reach counts.
    """
    own = line_segments(reaches.select(reach, coords), reach, coords)
    s = own.join(metres, reach).join(reaches.select(reach, route), reach)
    s = s.withColumns({"m_start": F.col("m_start") + F.col("head_m"), "seg": F.struct(reach, "seg")})
    hits = locate_on_line(points, s, point_id, x, y, route, buffer).where("along_m >= 0")
    return hits.groupBy(point_id).agg(F.min(F.struct(route, "along_m", "off_m")).alias("b")).select(
        point_id, f"b.{route}", "b.along_m", "b.off_m")


def neighbourhood_range(cells: DataFrame, keys: Sequence[str], x: str, y: str, value: str) -> DataFrame:
    """For each cell with a row: its value and the least and greatest of the nine around it; no row means 0."""
    shifts = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = (cells.select(*keys, x, y, value).withColumn("__s", F.explode(shifts))
              .select(*keys, (F.col(x) + F.col("__s.dx")).alias(x), (F.col(y) + F.col("__s.dy")).alias(y),
                      F.col(value), ((F.col("__s.dx") == 0) & (F.col("__s.dy") == 0)).alias("__own")))
    g = spread.groupBy(*keys, x, y).agg(
        F.max(F.when(F.col("__own"), F.col(value))).alias(value), F.count(F.lit(1)).alias("__n"),
        F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return (g.where(F.col(value).isNotNull())
            .withColumn("lo", F.when(F.col("__n") < 9, F.least("__lo", F.lit(0.0))).otherwise(F.col("__lo")))
            .withColumn("hi", F.when(F.col("__n") < 9, F.greatest("__hi", F.lit(0.0))).otherwise(F.col("__hi")))
            .drop("__n", "__lo", "__hi"))


_FOLD_ROWS = 1_000_000


def distance_bands(df: DataFrame, keys: Sequence[str], distance: str, edges: Sequence[float],
                   nearest: int = 5) -> DataFrame:
    """Counts within each band (cumulative), counts inside, and the nearest few distances as text.

    The rows are read once: each task folds them to one row a key with its counts and nearest distances, and only those
    travel. A null distance counts in the total alone. Rows that ``radius_join`` has counted already (its ``bands``) are only
    summed; bands it has not counted raise.
    """
    names = _band_names(edges)
    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    counted = ["total", "inside", *names]
    out = (f"{types}, " if keys else "") + ", ".join(f"`{c}` long" for c in counted) + ", __near array<double>"

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        def folded(rows):
            t = pa.Table.from_batches(rows)
            code = np.zeros(len(t), np.int64)
            for k in keys:
                c = t.column(k).combine_chunks().dictionary_encode()
                own = c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
                code = np.unique(code * (len(c.dictionary) + 1) + own, return_inverse=True)[1].astype(np.int64)
            d = t.column(distance).combine_chunks()
            known = d.is_valid().to_numpy(zero_copy_only=False)
            v = d.fill_null(float("inf")).to_numpy(zero_copy_only=False).astype(np.float64)
            order = np.lexsort((v, ~known, code))
            code, v, known = code[order], v[order], known[order]
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            n = np.diff(np.r_[start, len(code)])
            sums = [n, np.add.reduceat((known & (v == 0)).astype(np.int64), start)]
            sums += [np.add.reduceat((known & (v <= e)).astype(np.int64), start) for e in edges]
            few = np.minimum(np.add.reduceat(known.astype(np.int64), start), nearest)
            ends = np.r_[0, np.cumsum(few)].astype(np.int32)
            at = np.repeat(start - ends[:-1], few) + np.arange(ends[-1])
            near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[at], pa.float64()))
            first = pa.array(order[start])
            cols = [t.column(k).combine_chunks().take(first) for k in keys] + [pa.array(s.astype(np.int64)) for s in sums] + [near]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, *counted, "__near"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= _FOLD_ROWS:
                yield folded(held)
                held, size = [], 0
        if held:
            yield folded(held)

    if isinstance(df.schema[distance].dataType, T.StructType):
        part = df.select(*keys, *[F.col(distance)[c].alias(c) for c in counted], F.col(distance)[f"nearest_{nearest}"].alias("__near"))
    else:
        part = df.select(*keys, F.col(distance).cast("double").alias(distance)).mapInArrow(fold, out)
    g = part.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in counted],
                                F.flatten(F.collect_list("__near")).alias("__near"))
    few = F.transform(F.slice(F.array_sort("__near"), 1, nearest), lambda v: F.format_number(F.round(v, 3), 3))
    return g.select(*keys, *counted, F.concat_ws(", ", few).alias("nearest"))
