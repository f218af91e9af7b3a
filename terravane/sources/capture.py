"""Captures: metadata and vector files, images, depth rasters, and what is dropped on the way in."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geodesy as G
from terravane.functions import panorama as P
from terravane.functions import text as T

#: Optional columns of the metadata and their types; missing ones are added as nulls.
OPTIONAL = {"thumbnail_key": "string", "thumbnail_file": "string", "depth": "double", "geokeyframe_id": "bigint", "label": "string", "detection_score": "double"}
IMAGES = ("jpg", "jpeg", "png", "webp")
DIMENSIONS = 1024


def with_optional(df: DataFrame) -> DataFrame:
    """df with all optional columns, and NaN depths as null."""
    for name, kind in OPTIONAL.items():
        df = df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind))
    return df.withColumn("depth", T.nan_to_null(F.col("depth")))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """metadata.parquet of a capture folder, or of each of its child folders, with the folder as capture.

    Half-precision columns are not readable as Parquet here; they are expected as floats.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.parquet").parquet(folder)
    return with_optional(df.withColumn("capture", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))


def read_vectors(spark: SparkSession, folder: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """capture, row_index, embedding of headerless little-endian half-precision matrices (embeddings.npy); a ragged file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "embeddings.npy").load(folder)

    def decode(it):
        for df in it:
            for path, content in zip(df["path"], df["content"], strict=True):
                flat = np.frombuffer(content, "<f2")
                if len(flat) % dimensions:
                    raise ValueError(f"{path} is no matrix of {dimensions} columns")
                m = flat.reshape(-1, dimensions).astype(np.float32)
                for a in range(0, len(m), 4096):
                    yield pd.DataFrame({"capture": path.split("/")[-2], "row_index": np.arange(a, min(a + 4096, len(m))), "embedding": list(m[a : a + 4096])})

    return files.select("path", "content").mapInPandas(decode, "capture string, row_index long, embedding array<float>")


def aligned(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Metadata with its vectors by row; a row on one side only is an error."""
    both = metadata.join(vectors.withColumn("__v", F.lit(True)), ["capture", "row_index"], "full_outer")
    whole = F.col("__v").isNotNull() & F.col("video_keyframe_id").isNotNull()
    return both.withColumn("row_index", F.when(whole, F.col("row_index")).otherwise(F.raise_error(F.lit("metadata and embeddings differ in length")).cast("long"))).drop("__v")


def images_of(files: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Image files (path) with the keyframe of that file name, never of its stem; other suffixes and unknown names are left out."""
    ok = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)
    return files.where(ok).withColumn("image", T.basename(F.col("path"))).join(keyframes.select("image", "keyframe"), "image")


def unmatched_images(files: DataFrame, keyframes: DataFrame) -> DataFrame:
    ok = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)
    return files.where(ok).withColumn("image", T.basename(F.col("path"))).join(keyframes.select("image"), "image", "left_anti")


def usable_rows(rows: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Index rows of known keyframes whose box has its 16 bytes, decoded as theta, phi, width, height with phi upwards."""
    kept = rows.join(keyframes.select("image", F.col("keyframe").alias("geokeyframe_id")), "image").where(F.length("spherical_box") == 16)
    return kept.withColumn("__b", unpacked_floats(F.col("spherical_box"), 4)).select("*", *[F.get("__b", i).alias(n) for i, n in enumerate(("theta", "__down", "width", "height"))]).withColumn("phi", -F.col("__down")).drop("__b", "__down")


def dropped_rows(rows: DataFrame, keyframes: DataFrame) -> DataFrame:
    """How many index rows go for want of a keyframe, of a box, or of 16 bytes in it."""
    k = rows.join(keyframes.select("image", F.lit(True).alias("__k")), "image", "left")
    return k.agg(F.count_if(F.col("__k").isNull()).alias("unknown_keyframe"), F.count_if(F.col("__k").isNotNull() & F.col("spherical_box").isNull()).alias("missing_box"), F.count_if(F.col("__k").isNotNull() & (F.length("spherical_box") != 16)).alias("short_box"))


def unpacked_floats(blob, n: int):
    """Little-endian single-precision numbers of a blob, as doubles."""

    bytes_ = lambda i: [F.conv(F.hex(F.substring(blob, 4 * i + k + 1, 1)), 16, 10).cast("long") for k in range(4)]

    def whole(i):
        b = bytes_(i)
        word = b[0] + b[1] * 256 + b[2] * 65536 + b[3] * 16777216
        return G.let(word, _float_of)

    return F.array(*[whole(i) for i in range(n)])


def _float_of(word):
    sign = F.when(F.shiftright(word, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    power, rest = F.shiftright(word, 23).bitwiseAND(F.lit(255).cast("long")), word.bitwiseAND(F.lit((1 << 23) - 1).cast("long")) / float(1 << 23)
    return F.when(power == 0, sign * rest * F.lit(2.0**-126)).otherwise(sign * (1 + rest) * F.pow(F.lit(2.0), power - 127))


def polygon_points(blob):
    """Pairs of single-precision numbers as an array of structs u, v; a blob of any other length is empty."""
    n = F.when(F.length(blob) % 8 == 0, F.length(blob) / 8).otherwise(F.lit(0)).cast("int")
    number = lambda at: G.let(sum((F.conv(F.hex(F.substring(blob, at + k + 1, F.lit(1))), 16, 10).cast("long") * 256**k for k in range(4)), F.lit(0).cast("long")), _float_of)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(number(i * 8).alias("u"), number(i * 8 + 4).alias("v")))).otherwise(F.array().cast("array<struct<u:double,v:double>>"))


def read_tiff(content: bytes) -> np.ndarray:
    """The first image of an uncompressed single-channel 16-bit TIFF."""
    end = {b"II": "<", b"MM": ">"}[content[:2]]
    at = struct.unpack(end + "I", content[4:8])[0]
    tags = {}
    for k in range(struct.unpack(end + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(end + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        size = {3: "H", 4: "I"}.get(kind)
        if size:
            raw = content[at + 10 + 12 * k : at + 14 + 12 * k]
            width = struct.calcsize(size) * n
            if width > 4:
                start = struct.unpack(end + "I", raw)[0]
                raw = content[start : start + width]
            tags[tag] = struct.unpack(end + size * n, raw[:width])
    if tags.get(259, (1,))[0] != 1 or tags.get(258, (16,))[0] != 16:
        raise ValueError("only uncompressed 16-bit images are read")
    data = b"".join(content[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(data, end + "u2").reshape(tags[257][0], tags[256][0])


def depth_choice(files: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All depth files of each keyframe in order of preference: {stem}.zarr, {id}.zarr, {stem}.tif, {id}.tif."""
    f = files.withColumn("file", T.basename(F.col("path")))
    stem = F.regexp_replace("image", r"\.[^.]*$", "")
    wanted = keyframes.select("keyframe", F.posexplode(F.array(*[F.concat(n, F.lit(s)) for s in (".zarr", ".tif") for n in (stem, F.col("keyframe").cast("string"))])).alias("priority", "file"))
    return wanted.join(f, "file").groupBy("keyframe").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "path"))), lambda s: s["path"]).alias("paths"))


def sampled_depths(rows: DataFrame, rasters: DataFrame) -> DataFrame:
    """rows (keyframe, id, theta, phi) with the depth at the nearest pixel of their keyframe's raster (keyframe, content); null where there is none or it can't be read.

    A raster is decoded once for the rows of its keyframe.
    """

    def sample(key, df: pd.DataFrame, raster: pd.DataFrame) -> pd.DataFrame:
        out = df[["keyframe", "id"]].copy()
        out["raw"] = pd.array([None] * len(df), dtype="Int64")
        for content in raster["content"]:
            try:
                image = read_tiff(content)
            except (KeyError, ValueError, struct.error):
                continue
            h, w = image.shape
            col = np.mod(np.round((df["theta"].to_numpy() + np.pi) / (2 * np.pi) * w).astype(int), w)
            row = np.clip(np.round((np.pi / 2 - df["phi"].to_numpy()) / np.pi * h).astype(int), 0, h - 1)
            out["raw"] = image[row, col].astype(int)
            break
        return out

    raw = rows.groupBy("keyframe").cogroup(rasters.groupBy("keyframe")).applyInPandas(sample, "keyframe long, id long, raw long")
    return raw.select("keyframe", "id", P.decode_depth(F.col("raw")).alias("depth"))


def lifted(rows: DataFrame, poses: DataFrame) -> DataFrame:
    """Rows with the place of their object: along their view from their keyframe's pose at their depth; a row without its keyframe is an error."""
    j = rows.join(poses.select("keyframe", "position", "orientation"), "keyframe", "left")
    pose = F.when(F.col("position").isNotNull(), F.col("position")).otherwise(F.raise_error(F.lit("a row of an unknown keyframe")).cast(poses.schema["position"].dataType))
    return j.withColumn("object_position", G.lift(pose, F.col("orientation"), F.col("theta"), F.col("phi"), F.col("depth"))).drop("position", "orientation")
