"""Readers and writers of the formats that road surveys come in and results go out in."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import scalar as C

# ---------------------------------------------------------------- OSM-XML maps

_TAG = "array<struct<_k: string, _v: string>>"
NODE = f"_id long, _lat double, _lon double, tag {_TAG}"
WAY = f"_id long, nd array<struct<_ref: long>>, tag {_TAG}"
RELATION = f"_id long, member array<struct<_type: string, _ref: long, _role: string>>, tag {_TAG}"


def _tags(column: str = "tag") -> Column:
    return F.map_from_entries(F.transform(F.coalesce(F.col(column), F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"])))


def _xml(spark: SparkSession, path: str, row: str, schema: str, strict: bool) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("mode", "FAILFAST" if strict else "DROPMALFORMED").schema(schema).load(path)


#: How points come to metres: name -> (x, y) of lat, lon, lat0, lon0; local is equirectangular, mercator is scaled to
#: true lengths at the origin.
PROJECTORS = {
    "local-cartesian": C.to_local,
    "mercator": lambda lat, lon, lat0, lon0: tuple(v * (C.TILE_RADIUS * math.cos(math.radians(lat0))) for v in (F.radians(lon) - math.radians(lon0), F.asinh(F.tan(F.radians(lat))) - math.asinh(math.tan(math.radians(lat0))))),
}


def project_points(point: DataFrame, lat0: float, lon0: float, projector: str = "local-cartesian") -> DataFrame:
    """point (point_id, lat, lon, ele) with x, y and z in metres about an origin: each distinct point once, whatever the
    number of lines that it is in.  An unknown projector is an error."""
    if projector not in PROJECTORS:
        raise ValueError(f"no projector is called {projector!r}; there are {', '.join(PROJECTORS)}")
    x, y = PROJECTORS[projector](F.col("lat"), F.col("lon"), lat0, lon0)
    return point.dropDuplicates(["point_id"]).select("point_id", x.alias("x"), y.alias("y"), F.col("ele").alias("z"))


def polylines(tables: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """Vertices (way_id, seq, point_id, x, y, z, tags) of all ways, their points looked up."""
    return tables["way"].join(points, "point_id").select("way_id", "seq", "point_id", "x", "y", "z", "tags")


def read_osm(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """point, way (a row a vertex) and lanelet tables of a map; not strict leaves out bad elements."""
    node = _xml(spark, path, "node", NODE, strict)
    way = _xml(spark, path, "way", WAY, strict)
    rel = _xml(spark, path, "relation", RELATION, strict).withColumn("tags", _tags())
    point = node.select(F.col("_id").alias("point_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags")).withColumn("ele", F.coalesce(F.try_element_at("tags", F.lit("ele")).cast("double"), F.lit(0.0)))
    vertex = way.select(F.col("_id").alias("way_id"), _tags().alias("tags"), F.posexplode("nd").alias("seq", "nd")).select("way_id", "seq", F.col("nd._ref").alias("point_id"), "tags")
    role = lambda r: F.element_at(F.filter("member", lambda m: m["_role"] == r), 1)["_ref"]
    lane = rel.filter(F.try_element_at("tags", F.lit("type")) == "lanelet").select(F.col("_id").alias("lanelet_id"), role("left").alias("left_way"), role("right").alias("right_way"), "tags")
    return {"point": point, "way": vertex, "lanelet": lane}


def lane_ends(tables: dict[str, DataFrame]) -> DataFrame:
    """Lane ends (lane_id, s_lo, s_hi, e_lo, e_hi): the pairs of point ids that the two bounds begin and end with."""
    tips = tables["way"].groupBy("way_id").agg(F.min_by("point_id", "seq").alias("first"), F.max_by("point_id", "seq").alias("last"))
    l, r = (tips.select(F.col("way_id").alias(f"{p}_way"), F.col("first").alias(f"{p}_first"), F.col("last").alias(f"{p}_last")) for p in ("left", "right"))
    j = tables["lanelet"].join(l, "left_way").join(r, "right_way")
    pair = lambda f, n: f(f"left_{n}", f"right_{n}")
    return j.select(F.col("lanelet_id").alias("lane_id"), pair(F.least, "first").alias("s_lo"), pair(F.greatest, "first").alias("s_hi"), pair(F.least, "last").alias("e_lo"), pair(F.greatest, "last").alias("e_hi"))


# ---------------------------------------------------------------- grids as JSON

GRID = "x0 double, y0 double, cell double, nx int, ny int, z array<double>, support array<int>"


def grid_to_json(cells: DataFrame, x0: float, y0: float, cell: float, nx: int, ny: int) -> DataFrame:
    """One JSON document of a grid (ix, iy, z, support), row-major; z to 3 places, support cut to whole cells.

    A grid file is one document by its format, so its cells meet in one row; nx * ny bounds it.
    """
    rows = cells.select((F.col("iy") * nx + F.col("ix")).alias("at"), F.bround("z", 3).alias("z"), F.col("support").cast("int").alias("support"))
    ordered = rows.agg(F.sort_array(F.collect_list(F.struct("at", "z", "support"))).alias("g"))
    body = F.struct(*(F.lit(v).alias(n) for n, v in (("x0", x0), ("y0", y0), ("cell", cell), ("nx", nx), ("ny", ny))), F.col("g.z").alias("z"), F.col("g.support").alias("support"))
    return ordered.select(F.to_json(body).alias("value"))


def grid_from_json(df: DataFrame) -> DataFrame:
    """Cells (ix, iy, z, support) of grid documents (value)."""
    g = df.select(F.from_json("value", GRID).alias("g")).select("g.*")
    return g.select("nx", F.posexplode(F.arrays_zip("z", "support")).alias("at", "c")).select((F.col("at") % F.col("nx")).alias("ix"), F.expr("cast(at div nx as int)").alias("iy"), F.col("c.z").alias("z"), F.col("c.support").alias("support"))


# ---------------------------------------------------------------- ledgers

# The ledger's fields, which other tools read.
LEDGER = "building long, area_m2 double, roof string, brush_up double, used boolean, tries int, error string, yaw_deg double, scale double, scale_xy array<double>, stretch double, stretch_deg double, centre array<double>, base_z double, footprint_iou double, height_m double, sunk_m double, procedural_height_m double, image string, styled string, glb string, mesh string, took_seconds double, bytes long, vertices long, triangles long"
_KNOWN = [f.split()[0] for f in LEDGER.split(", ")]


def read_ledger(df: DataFrame) -> DataFrame:
    """Ledger rows of JSON lines (value): known fields typed, absent ones by their defaults (no area, not used, one
    try), the others kept in extra."""
    every = F.from_json("value", "map<string,string>")
    known = F.from_json("value", LEDGER)
    extra = F.map_filter(every, lambda k, _: ~k.isin(_KNOWN))
    defaults = {"area_m2": F.lit(0.0), "used": F.lit(False), "tries": F.lit(1)}
    k = df.select(known.alias("k"), extra.alias("extra")).select("k.*", "extra")
    return k.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def ledger_document(df: DataFrame, scene: str, kept_above: float = 0.80) -> DataFrame:
    """One JSON document of a ledger: its summary, and all rows by building.  One document by its format, so the rows,
    one a building of a scene, meet in one."""
    row = ledger_json(df, ["building"]).select(F.struct("building", "value").alias("row"))
    good = F.col("used") & F.col("footprint_iou").isNotNull()
    sums = df.agg(F.count("*").alias("attempted"), F.count_if("used").alias("used"), F.coalesce(F.sum("tries"), F.lit(0)).alias("generations"), F.count_if(F.col("tries") > 1).alias("retried"), F.bround(F.avg(F.when(good, F.col("footprint_iou"))), 4).alias("mean"), F.bround(F.min(F.when(good, F.col("footprint_iou"))), 4).alias("min"))
    rows = row.agg(F.sort_array(F.collect_list("row")).alias("rows"))
    head = F.to_json(F.struct(F.lit(scene).alias("scene"), "attempted", "used", F.lit(kept_above).alias("kept_above"), "generations", "retried", F.struct("mean", "min").alias("footprint_iou")))
    body = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"buildings":['), F.array_join(F.transform("rows", lambda r: r["value"]), ","), F.lit("]}"))
    return sums.withColumn("head", head).crossJoin(rows).select(body.alias("value"))


def split_report(df: DataFrame) -> DataFrame:
    """Reports (building, report: JSON) as what the ledger knows and what it keeps in extra: building, known, extra."""
    every = F.from_json("report", "map<string,string>")
    return df.select("building", F.map_filter(every, lambda k, _: k.isin(_KNOWN)).alias("known"), F.map_filter(every, lambda k, _: ~k.isin(_KNOWN)).alias("extra"))


def ledger_json(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Ledger rows as JSON lines (value, beside the columns keep), nulls left out, extra fields beside the known ones."""
    body = F.to_json(F.struct(*_KNOWN))
    more = F.to_json("extra")
    joined = F.when(F.coalesce(F.size("extra"), F.lit(0)) > 0, F.concat(F.expr("left(value, length(value) - 1)"), F.when(F.col("value") != "{}", ",").otherwise(""), F.substring(more, 2, 1 << 30))).otherwise(F.col("value"))
    return df.withColumn("value", body).select(*(keep or []), joined.alias("value"))


# ---------------------------------------------------------------- meshes


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """OBJ text (at, value): vertices (vid, x, y, z) to four places, faces (fid, idx from 0) counted from 1."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").cast("long").alias("at"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.col("fid").cast("long").alias("at"), F.concat(F.lit("f "), F.array_join(F.transform("idx", lambda i: (i + 1).cast("string")), " ")).alias("value"))
    return v.unionByName(f)


def parse_glb(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 3) and triangles (m, 3) of all primitives of a binary glTF file."""
    magic, version, _ = struct.unpack_from("<4sII", data, 0)
    if magic != b"glTF" or version != 2:
        raise ValueError("no binary glTF 2 file")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<I4s", data, at)
        chunks.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size
    doc, blob = json.loads(chunks[b"JSON"]), chunks.get(b"BIN\0", b"")
    # Component types and element counts of the format.
    kinds = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
    counts = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}

    def values(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view, kind, n = doc["bufferViews"][a["bufferView"]], np.dtype(kinds[a["componentType"]]), counts[a["type"]]
        begin, row = view.get("byteOffset", 0) + a.get("byteOffset", 0), kind.itemsize * n
        step = view.get("byteStride", row)
        raw = np.frombuffer(blob, np.uint8, (a["count"] - 1) * step + row if a["count"] else 0, begin)
        rows = np.lib.stride_tricks.as_strided(raw, (a["count"], row), (step, 1))
        return np.ascontiguousarray(rows).view(kind).reshape(a["count"], n)

    parts = [part for shape in doc.get("meshes", ()) for part in shape["primitives"]]
    points = [values(part["attributes"]["POSITION"]).astype(np.float64) for part in parts]
    sizes = np.array([len(p) for p in points], np.int64)
    # a primitive without indices uses its vertices in order; every one's numbers start behind those before it
    corners = [values(part["indices"]).astype(np.int64).ravel() if "indices" in part else np.arange(n) for part, n in zip(parts, sizes)]
    shifted = [c + at for c, at in zip(corners, np.cumsum(sizes) - sizes)]
    return np.concatenate([np.zeros((0, 3)), *points]), np.concatenate([np.zeros(0, np.int64), *shifted]).reshape(-1, 3)


def read_glb(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, vertices and faces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                v, f = parse_glb(data)
                yield pa.RecordBatch.from_pylist([{"path": name, "vertices": v.tolist(), "faces": f.tolist()}], schema=pa.schema([("path", pa.string()), ("vertices", pa.list_(pa.list_(pa.float64()))), ("faces", pa.list_(pa.list_(pa.int64())))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, vertices array<array<double>>, faces array<array<long>>")


def list_sheets(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Files of a folder by name, with the floors that their names declare."""
    from roadspark.functions.scalar import sheet_floors

    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "length").withColumn("floors", sheet_floors(F.col("name")))


# ---------------------------------------------------------------- terrain tiles


def relief_scale(spark: SparkSession, *, amplitude: float = 2.5, extent: float | None = None, steps: int = 192, **relief) -> DataFrame:
    """One row, scale: what brings a relief (metres, octaves, roughness, warp, seed) to an amplitude from its lowest to
    its highest place, measured on one wide patch so that all tiles share it; 0 for a flat one."""
    extent = relief.get("metres", 140.0) * 24 if extent is None else extent
    n = spark.range(steps * steps).select((F.col("id") % steps * (extent / (steps - 1))).alias("x"), (F.expr(f"id div {steps}") * (extent / (steps - 1))).alias("y"))
    spread = C.with_fbm(n, "x", "y", "v", **relief).agg((F.max("v") - F.min("v")).alias("s"))
    return spread.select(F.when(F.col("s") > 1e-9, amplitude / F.col("s")).otherwise(0.0).alias("scale"))


def invented_tiles(tiles: DataFrame, *, zoom: int = 15, size: int = 256, latitude: float = 35.0, amplitude: float = 2.5, **relief) -> DataFrame:
    """Pixels (tx, ty, px, py, z) of procedural elevation for tiles (tx, ty): a function of the place on the globe, so
    that neighbouring tiles meet, in column expressions alone."""
    side = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    p = tiles.select("tx", "ty").withColumn("px", side).withColumn("py", side)
    n = float(1 << zoom)
    lon = ((F.col("tx") + (F.col("px") + 0.5) / size) / n * 2 - 1) * math.pi
    lat = F.atan(F.sinh((1 - (F.col("ty") + (F.col("py") + 0.5) / size) / n * 2) * math.pi))
    # one stretch for all tiles, that at the map's own latitude
    p = p.withColumns({"_e": lon * (C.TILE_RADIUS * math.cos(math.radians(latitude))), "_s": lat * C.TILE_RADIUS})
    scale = F.broadcast(relief_scale(tiles.sparkSession, amplitude=amplitude, **relief))  # one row
    return C.with_fbm(p, "_e", "_s", "relief", **relief).crossJoin(scale).select("tx", "ty", "px", "py", (F.col("relief") * F.col("scale")).alias("z"))


def cached_tiles(spark: SparkSession, folder: str, *, layer: str = "dem", zoom: int = 15, size: int = 256) -> DataFrame:
    """Pixels (tx, ty, px, py, z) of the elevation tiles in a folder: raw 24-bit pixels, <layer>_<zoom>_<tx>_<ty>.rgb.
    The files are scanned by Spark, so the folder may be in any store; a tile that is absent has no rows, and one of
    another length (half a download) is left out; pixels without data are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        py, px = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))
        for batch in batches:
            for tx, ty, data in zip(*(batch.column(c).to_pylist() for c in ("tx", "ty", "content"))):
                r, g, b = np.frombuffer(data, np.uint8).astype(np.int64).reshape(-1, 3).T
                code = r << 16 | g << 8 | b
                metres = np.where(code >= 1 << 23, code - (1 << 24), code) * 0.01
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(size * size, v, np.int32)) for v in (tx, ty)), pa.array(px), pa.array(py), pa.array(metres, mask=code == 1 << 23)], names=["tx", "ty", "px", "py", "z"])

    f = spark.read.format("binaryFile").option("pathGlobFilter", f"{layer}_{zoom}_*.rgb").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    at = [F.regexp_extract(name, r"_(\d+)_(\d+)\.rgb$", k).cast("int") for k in (1, 2)]
    return f.filter(F.col("length") == 3 * size * size).select(at[0].alias("tx"), at[1].alias("ty"), "content").mapInArrow(run, "tx int, ty int, px int, py int, z double")
