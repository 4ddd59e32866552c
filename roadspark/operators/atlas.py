"""Paint baked into an atlas: from painted shapes and lanes to strips of pixels, their places on pages, and the pages.

A chain of tables: which paint comes near which lane (boxes by cells), where its corners lie in the lane (the lane's own
triangles, in columns), how many texels a lane's strip has, where strips go on pages (packed by sheet: each sheet is a
packing of its own, so no task packs more than one), each strip's pixels, and each page's.  Only drawing a strip, packing a
sheet and composing a page are kernels, each over one lane, one sheet or one page.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions import scalar
from roadspark.operators import kernels, mesh, spatial
from roadspark.operators.graph import spread, stored

#: Groups that a junction doesn't show.
LANE_LINES = ("LaneMarkings",)


def drawn(rings: Sequence[np.ndarray], width: int, height: int, samples: int) -> np.ndarray:
    """Coverage (0 to 255) of a strip's pixels by rings in pixels, together; each pixel is looked at samples by samples
    times."""
    hit = np.zeros((height * samples, width * samples), bool)
    for r in rings:
        low = np.clip(np.floor(r.min(0) * samples).astype(int), 0, None)
        high = np.minimum(np.ceil(r.max(0) * samples).astype(int), [width * samples, height * samples])
        if (high <= low).any():
            continue
        x, y = (np.arange(low[k], high[k]) + 0.5 for k in (0, 1))
        at = np.stack(np.meshgrid(x, y), axis=-1).reshape(-1, 2) / samples
        hit[low[1] : high[1], low[0] : high[0]] |= kernels.contains(r, at).reshape(len(y), len(x))
    share = hit.reshape(height, samples, width, samples).mean(axis=(1, 3))
    return np.round(share * 255).astype(np.uint8)


class Atlas:
    """lanes (lane, seq, lx, ly, lz, rx, ry, rz; kind, sheet) with paint (id, grp, ring: array of x, y) baked on.

    sizes: lane, sheet, w, h.  near: lane, id, grp.  strips: lane, sheet, page, px, py, w, h, pixels (bytes, row by row from
    the lane's start), coverage (in pixels).  pages: sheet, page, strips, pixels, coverage.  emptied: grp, shapes, baked: a
    group all of whose shapes are baked is drawn no more.  Lanes without an extent have no strip; paint of fewer than three
    corners is left out; what of it lies beside the lane is cut off; junctions (kind 'Junctions') take no lane_lines.
    """

    def __init__(self, lanes: DataFrame, paint: DataFrame, *, texel: float = 0.05, step: int = 32, page: int = 4096, reach: float = 0.6, samples: int = 4, lane_lines: Sequence[str] = LANE_LINES, cell: float = 25.0) -> None:
        self.page, self.samples = page, samples
        self.frames = stored(mesh.lane_frame(lanes, ["lane"]))
        w, h = scalar.lane_pixels(F.col("width"), F.col("length"), texel=texel, step=step, page=page)
        one = self.frames.groupBy("lane").agg(*(F.first(c).alias(c) for c in ("sheet", "kind", "width", "length")))
        self.sizes = stored(one.select("lane", "sheet", "kind", w.cast("int").alias("w"), h.cast("int").alias("h")).filter("w > 0 and h > 0"))
        at = lambda axis: F.transform("ring", lambda p: p[axis])
        box = paint.filter(F.size("ring") >= 3).select("id", "grp", "ring", F.array_min(at(0)).alias("x0"), F.array_min(at(1)).alias("y0"), F.array_max(at(0)).alias("x1"), F.array_max(at(1)).alias("y1"))
        self.paint = stored(box)
        ends = lambda f, g, c, by: (g(f(f"l{c}", f"r{c}")) + by)
        around = self.frames.groupBy("lane").agg(F.first("kind").alias("kind"), *(ends(f, g, c, by).alias(f"{c}{n}") for c in "xy" for n, f, g, by in ((0, F.least, F.min, -reach), (1, F.greatest, F.max, reach))))
        met = spatial.touching_boxes(around.withColumnRenamed("lane", "id"), self.paint.select("id", "grp", "x0", "y0", "x1", "y1"), cell)
        keep = ~((F.col("a_kind") == "Junctions") & F.col("b_grp").isin(*lane_lines))
        self.near = stored(met.filter(keep).select(F.col("a_id").alias("lane"), F.col("b_id").alias("id"), F.col("b_grp").alias("grp")))

    def places(self) -> DataFrame:
        """lane, sheet, page, px, py, w, h: widest strips first, down columns of one width."""
        page = self.page
        kinds = {c: self.sizes.schema[c].dataType.simpleString() for c in ("lane", "sheet")}

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("lane").reset_index(drop=True)
            at = pd.DataFrame(kernels.shelf_pack(list(zip(pdf["w"], pdf["h"])), page), columns=["page", "px", "py"])
            return pd.concat([pdf[["lane", "sheet"]], at, pdf[["w", "h"]]], axis=1)

        rows = self.sizes.select("lane", "sheet", "w", "h")
        return spread(rows, "sheet").groupBy("sheet").applyInPandas(run, f"lane {kinds['lane']}, sheet {kinds['sheet']}, page int, px int, py int, w int, h int")

    def strips(self) -> DataFrame:
        samples, kind = self.samples, self.sizes.schema["lane"].dataType.simpleString()
        corner = self.near.join(self.paint.select("id", F.posexplode("ring").alias("k", "p")), "id")
        points = corner.select("lane", F.struct("id", "k").alias("corner"), F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))
        placed = mesh.lane_project(points, self.frames, ["lane"], "corner").select("lane", "corner.id", "corner.k", "u", "v")
        shapes = placed.groupBy("lane", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "u", "v"))), lambda c: F.array(c["v"], c["u"])).alias("ring"))
        drawn_on = shapes.groupBy("lane").agg(F.collect_list("ring").alias("rings"))
        rows = self.places().join(drawn_on, "lane", "left")

        def draw(batches):
            for pdf in batches:
                out = []
                for w, h, rings in zip(pdf["w"], pdf["h"], pdf["rings"]):
                    own = [np.array([list(p) for p in r], float) * [w, h] for r in rings] if rings is not None else []
                    out.append(drawn(own, int(w), int(h), samples))
                yield pdf.drop(columns="rings").assign(pixels=[o.tobytes() for o in out], coverage=[float(o.sum()) / 255 for o in out])

        rows = rows.withColumn("rings", F.coalesce("rings", F.array().cast("array<array<array<double>>>")))
        names = "lane {}, sheet {}, page int, px int, py int, w int, h int, pixels binary, coverage double".format(kind, self.sizes.schema["sheet"].dataType.simpleString())
        return spread(rows.select("lane", "sheet", "page", "px", "py", "w", "h", "rings"), "lane").mapInPandas(draw, names)

    def pages(self, strips: DataFrame) -> DataFrame:
        size, kind = self.page, strips.schema["sheet"].dataType.simpleString()

        def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            image = np.zeros((size, size), np.uint8)
            for px, py, w, h, b in zip(pdf["px"], pdf["py"], pdf["w"], pdf["h"], pdf["pixels"]):
                image[py : py + h, px : px + w] = np.frombuffer(b, np.uint8).reshape(h, w)
            return pd.DataFrame([(key[0], int(key[1]), len(pdf), image.tobytes(), float(image.sum()) / 255)], columns=["sheet", "page", "strips", "pixels", "coverage"])

        return strips.groupBy("sheet", "page").applyInPandas(compose, f"sheet {kind}, page int, strips int, pixels binary, coverage double")

    def emptied(self) -> DataFrame:
        on = self.near.join(self.sizes.select("lane"), "lane", "left_semi").select("id").distinct().withColumn("on", F.lit(1))
        return self.paint.join(on, "id", "left").groupBy("grp").agg(F.count("*").alias("shapes"), F.count("on").alias("baked"))

    def uvs(self) -> DataFrame:
        """lane, seq, side (0 left, 1 right), page, u and v of every cross-section's ends."""
        v = self.frames.select("lane", "seq", "station", "length", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).join(self.places(), "lane")
        u, w = scalar.strip_uv(F.col("station"), F.col("length"), F.col("side"), *(F.col(c) for c in ("px", "py", "w", "h")), self.page)
        return v.select("lane", "seq", "side", "page", u.alias("u"), w.alias("v"))


def by_tile(x: Column, y: Column, size: float) -> Column:
    """A sheet for each tile of the map: its name as text."""
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))
