"""Files: frames and results as Parquet, JSON trees with arrays, raw detector images, optional HDF5."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.functions.text import parse_header
from wavesift.sources.frames import FRAMES


def write_frames(frames: DataFrame, path: str, scan: str = "scan", chunk_size: int = 1000) -> None:
    """Append frames, partitioned by scan and chunk, so that readers skip what they don't ask for."""
    out = frames.withColumn("scan", F.lit(scan)).withColumn("chunk", F.floor(F.col("frame_idx") / chunk_size).cast("int"))
    out.write.mode("append").partitionBy("scan", "chunk").parquet(path)


def read_frames(spark: SparkSession, path: str, scan: str | None = None, chunks: list[int] | None = None) -> DataFrame:
    """Frames of a scan and of chunks; both are partition filters."""
    df = spark.read.parquet(path)
    if scan is not None:
        df = df.filter(F.col("scan") == scan)
    if chunks is not None:
        df = df.filter(F.col("chunk").isin(chunks))
    return df


def stream_frames(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Frames as chunks of them arrive in a folder that write_frames appends to."""
    reader = spark.readStream.schema(FRAMES + ", scan string, chunk int")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


STORAGES = "container string, storage_id string, layer int, height int, width int, re array<double>, im array<double>"


def write_result(spark: SparkSession, path: str, state, iter_info: DataFrame | None = None, params: str = "{}") -> None:
    """Probe and object layers, the iteration log and the parameters of a run."""
    rows = []
    for name, stack in (("probe", state.probe), ("obj", state.obj)):
        for k, a in enumerate(stack):
            rows.append((name, "S00", k, *a.shape, a.real.ravel().tolist(), a.imag.ravel().tolist()))
    spark.createDataFrame(rows, STORAGES).write.mode("overwrite").parquet(f"{path}/content")
    spark.createDataFrame([(params,)], "params string").write.mode("overwrite").parquet(f"{path}/params")
    if iter_info is not None:
        iter_info.write.mode("overwrite").parquet(f"{path}/iter_info")


def read_layer(spark: SparkSession, path: str, what: str = "probe", storage_id: str | None = None, layer: int | None = None) -> np.ndarray:
    """One layer, or all layers of a container, as a complex array."""
    df = spark.read.parquet(f"{path}/content").filter(F.col("container") == what)
    if storage_id is not None:
        df = df.filter(F.col("storage_id") == storage_id)
    if layer is not None:
        df = df.filter(F.col("layer") == layer)
    rows = df.orderBy("storage_id", "layer").collect()
    out = np.stack([(np.array(r["re"]) + 1j * np.array(r["im"])).reshape(r["height"], r["width"]) for r in rows])
    return out[0] if layer is not None else out


def read_result(spark: SparkSession, path: str):
    """(state, parameters) of a run."""
    from wavesift.operators.engines import State

    return State(read_layer(spark, path, "probe"), read_layer(spark, path, "obj")), json.loads(spark.read.parquet(f"{path}/params").first()[0])


def _pack(v):
    if isinstance(v, np.ndarray):
        return {"__array__": base64.b64encode(np.ascontiguousarray(v).tobytes()).decode(), "dtype": v.dtype.str, "shape": list(v.shape)}
    if isinstance(v, complex):
        return {"__complex__": [v.real, v.imag]}
    if isinstance(v, dict):
        return {k: _pack(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [_pack(x) for x in v]
    return v.item() if isinstance(v, np.generic) else v


def _unpack(v):
    if isinstance(v, dict):
        if "__array__" in v:
            return np.frombuffer(base64.b64decode(v["__array__"]), v["dtype"]).reshape(v["shape"])
        if "__complex__" in v:
            return complex(*v["__complex__"])
        return {k: _unpack(x) for k, x in v.items()}
    return [_unpack(x) for x in v] if isinstance(v, list) else v


def dumps(tree: dict) -> str:
    """A tree of dictionaries, lists, numbers, strings and arrays as JSON."""
    return json.dumps(_pack(tree))


def loads(text: str, *keys: str) -> dict:
    """The tree again, or only the keys that are asked for."""
    tree = _unpack(json.loads(text))
    return {k: tree[k] for k in keys} if keys else tree


def decode_image(raw: bytes, kind: str) -> tuple[np.ndarray, dict[str, str]]:
    """(image, header): 'edf' has a text header that gives shape and type, 'raw' 16-bit square images after none."""
    if kind == "edf":
        end = raw.index(b"}") + 1
        head = parse_header(raw[:end].decode("ascii", "replace"))
        start = -(-end // 512) * 512
        types = {"UnsignedShort": "u2", "SignedShort": "i2", "UnsignedInteger": "u4", "SignedInteger": "i4", "UnsignedLong": "u4", "FloatValue": "f4", "Float": "f4", "DoubleValue": "f8"}
        order = ">" if head.get("ByteOrder", "").startswith("High") else "<"
        w, h = int(head["Dim_1"]), int(head["Dim_2"])
        return np.frombuffer(raw, order + types[head["DataType"]], w * h, start).reshape(h, w), head
    if kind == "raw":
        n = int((len(raw) // 2) ** 0.5)
        return np.frombuffer(raw, "<u2", n * n).reshape(n, n), {}
    raise ValueError(f"no image format {kind!r}")


def encode_edf(image: np.ndarray) -> bytes:
    """A 32-bit float EDF image."""
    head = f"{{\nByteOrder = LowByteFirst ;\nDataType = FloatValue ;\nDim_1 = {image.shape[1]} ;\nDim_2 = {image.shape[0]} ;\n"
    size = -(-(len(head) + 2) // 512) * 512
    return (head + " " * (size - len(head) - 2) + "}\n").encode() + image.astype("<f4").tobytes()


def read_images(spark: SparkSession, path: str, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """EDF and RAW images of a glob, one row each: path, height, width, intensity (float32 bytes), header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                a, head = decode_image(raw, p.rpartition(".")[2].lower())
                a = a[roi[0] : roi[1], roi[2] : roi[3]] if roi else a
                rows.append((p, *a.shape, a.astype("<f4").tobytes(), json.dumps(head)))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "intensity", "header"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, height int, width int, intensity binary, header string")


@dataclass(frozen=True)
class Corrections:
    """What is done to each image: dark, flat, mask of good pixels, norm by frame, rows and columns that are kept."""

    dark: np.ndarray | None = None
    flat: np.ndarray | None = None
    mask: np.ndarray | None = None
    norm: np.ndarray | None = None
    crop: tuple[int, int, int, int] | None = None

    def apply(self, index: int, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(image, mask) of frame ``index``; dead pixels of the flat are masked."""
        x, m = image.astype(float), np.ones(image.shape) if self.mask is None else np.asarray(self.mask, float)
        if self.dark is not None:
            x = np.maximum(x - self.dark, 0)
        if self.flat is not None:
            x, m = np.where(self.flat > 0, x / np.where(self.flat > 0, self.flat, 1), 0), m * (self.flat > 0)
        if self.norm is not None:
            x = x / np.asarray(self.norm).ravel()[index]
        if self.crop is not None:
            x, m = (a[self.crop[0] : self.crop[1], self.crop[2] : self.crop[3]] for a in (x, m))
        return x, m


def read_stack(spark: SparkSession, open_: Callable, shape: tuple[int, ...], slow, fast, resolution: float = 1.0, corrections: Corrections | None = None, partitions: int | None = None, **subset) -> DataFrame:
    """Frames of a stack of images with their places on the object.

    ``open_()`` gives, on an executor, a function from a frame's number to its image;
    ``shape`` is that of the stack. Positions are in the unit of ``resolution``, an
    object pixel; the least of those that are used is pixel 0. ``subset`` (box, skip,
    keep, order) is scan_layout's. Frames come in the order of their ``frame_idx``, which
    counts those that are used; images must be square after the crop.
    """
    from wavesift.sources.layouts import scan_layout

    own = corrections or Corrections()
    layout = scan_layout(tuple(shape[:-2]), slow, fast, **subset)
    low = [min((p[k] for p in layout), default=0.0) for k in (1, 2)]
    places = [(k, i, round((y - low[0]) / resolution), round((x - low[1]) / resolution)) for k, (i, y, x) in enumerate(layout)]
    index = spark.createDataFrame(places, "frame_idx long, at long, r0 int, c0 int")
    n_parts = partitions or max(1, min(len(places) // 64, 4096))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = open_()
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                rows = []
                for row in pdf.iloc[start : start + 64].itertuples():
                    x, m = own.apply(int(row.at), np.asarray(image(int(row.at))))
                    if x.shape[0] != x.shape[1]:
                        raise ValueError(f"images of {x.shape} are not square; crop them")
                    rows.append((row.frame_idx, row.r0, row.c0, x.shape[0], x.astype("<f4").tobytes(), (m > 0).astype(np.uint8).tobytes()))
                yield pd.DataFrame(rows, columns=["frame_idx", "r0", "c0", "n", "intensity", "mask"])

    return index.repartitionByRange(n_parts, "frame_idx").mapInPandas(run, FRAMES)


def read_npy(spark: SparkSession, path: str, slow, fast, resolution: float = 1.0, corrections: Corrections | None = None, partitions: int | None = None, **subset) -> DataFrame:
    """Frames of a .npy file that all executors can open; images are read one by one."""
    shape = np.load(path, mmap_mode="r").shape

    def open_():
        data = np.load(path, mmap_mode="r")
        return lambda i: data[np.unravel_index(i, shape[:-2])]

    return read_stack(spark, open_, shape, slow, fast, resolution, corrections, partitions, **subset)


def read_hdf5(spark: SparkSession, path: str, intensity: str, slow: str, fast: str, resolution: float = 1.0, partitions: int | None = None, dark: str | None = None, flat: str | None = None, mask: str | None = None, norm: str | None = None, keep: str | None = None, crop: tuple[int, int, int, int] | None = None, **subset) -> DataFrame:
    """Frames of an HDF5 file that all executors can open; needs h5py, which is optional. Names are those of its datasets."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py module") from e
    with h5py.File(path, "r") as f:
        shape = f[intensity].shape
        read = lambda k: None if k is None else np.asarray(f[k])
        average = lambda a: a if a is None or a.ndim == 2 else a.reshape(-1, *a.shape[-2:]).mean(axis=0)
        ys, xs = read(slow), read(fast)
        corrections = Corrections(average(read(dark)), average(read(flat)), read(mask), read(norm), crop)
        if keep is not None:
            subset["keep"] = read(keep)

    def open_():
        data = h5py.File(path, "r")[intensity]
        return lambda i: data[np.unravel_index(i, shape[:-2])]

    return read_stack(spark, open_, shape, ys, xs, resolution, corrections, partitions, **subset)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """part, column and type of everything a result or a frame table holds."""
    rows = []
    for part in ("content", "iter_info", "params", ""):
        try:
            df = spark.read.parquet(f"{path}/{part}".rstrip("/"))
        except AnalysisException:
            continue
        rows += [(part or "table", name, kind) for name, kind in df.dtypes]
        if part == "params":
            break
    return spark.createDataFrame(rows, "part string, column string, type string")


def run_paths(home: str, run: str, engine: str = "", iterations: int = 0) -> dict[str, str]:
    """Where a run keeps its results, its autosaves and its frames."""
    base = f"{home.rstrip('/')}/{run}"
    return {"result": f"{base}/result_{engine}_{iterations:04d}", "autosave": f"{base}/autosave", "frames": f"{base}/frames"}
