"""Columnar binary packs: a magic, version and header length, a JSON header with a table of sections, then little-endian arrays, each aligned to 8 bytes.

Road packs say FWR1, place packs FWP1. They are read as binary files, one row for each section; a pack is one region, so it is bounded. Tables in Parquet are
what the engine works on; packs are for exchange.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format.
MAGICS, VERSION, ALIGN = (b"FWR1", b"FWP1"), 1, 8
KINDS = {"uint8": "<u1", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def _gap(n: int) -> int:
    return -n % ALIGN


def packed(meta: dict, sections: dict[str, np.ndarray], magic: bytes = MAGICS[0]) -> bytes:
    """A pack's bytes; equal data gives equal bytes."""
    body, table = bytearray(), []
    for name, values in sections.items():
        kind = values.dtype.name
        if kind not in KINDS:
            raise ValueError(f"{name}: {kind} has no place in a pack")
        body += bytes(_gap(len(body)))
        table.append({"name": name, "dtype": kind, "offset": len(body), "length": int(values.size)})
        body += np.ascontiguousarray(values, KINDS[kind]).tobytes()
    head = json.dumps(meta | {"sections": table}, separators=(",", ":")).encode()
    head += b" " * _gap(12 + len(head))
    return magic + struct.pack("<II", VERSION, len(head)) + head + bytes(body)


def header(data: bytes) -> tuple[dict, int]:
    """Metadata, and where the sections start. Only the first bytes of a pack are needed."""
    if data[:4] not in MAGICS:
        raise ValueError("not a pack")
    version, n = struct.unpack_from("<II", data, 4)
    if version != VERSION:
        raise ValueError(f"pack version {version}")
    return json.loads(data[12 : 12 + n]), 12 + n


def unpacked(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    meta, start = header(data)
    arrays = {s["name"]: np.frombuffer(data, KINDS[s["dtype"]], s["length"], start + s["offset"]) for s in meta["sections"]}
    return {k: v for k, v in meta.items() if k != "sections"}, arrays


def strings(blob: np.ndarray) -> list[str]:
    """A table of strings, each ended by a zero byte."""
    return blob.tobytes().decode().split("\0")[:-1]


def restarted(deltas: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values from steps that start anew at `starts`."""
    sums = np.cumsum(deltas.astype(np.int64))
    before = np.r_[0, sums][starts]
    group = np.searchsorted(starts, np.arange(len(deltas)), "right") - 1
    return sums - before[group]


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, meta (JSON) of each pack."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_headers, "path string, meta string")


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"path": b["path"], "meta": [json.dumps(header(c)[0]) for c in b["content"]]})


def sections(spark: SparkSession, path: str) -> DataFrame:
    """path, name, dtype, values (doubles, exact up to 2^53) of each section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                _, arrays = unpacked(content)
                yield pd.DataFrame({"path": p, "name": list(arrays), "dtype": [a.dtype.name for a in arrays.values()], "values": [a.astype("f8") for a in arrays.values()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, dtype string, values array<double>")


def road_edges(spark: SparkSession, path: str) -> DataFrame:
    """path, edge_id, src, dst, geom_id, rev, time_s, class, h0, h1 of road packs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                meta, a = unpacked(content)
                n = len(a["edge_dst"])
                src = np.repeat(np.arange(len(a["node_out_ptr"]) - 1), np.diff(a["node_out_ptr"].astype(np.int64)))
                yield pd.DataFrame(
                    {
                        "path": p, "edge_id": np.arange(n), "src": src, "dst": a["edge_dst"].astype(np.int64), "geom_id": a["edge_geom"].astype(np.int64), "rev": (a["edge_flags"] & 1).astype(bool), "time_s": a["edge_time"].astype("f8"),
                        "class": [meta["highway_classes"][c] for c in a["edge_class"]], "h0": a["edge_h0"] / 100.0, "h1": a["edge_h1"] / 100.0,
                    }
                )

    schema = "path string, edge_id long, src long, dst long, geom_id long, rev boolean, time_s double, class string, h0 double, h1 double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def vertices(spark: SparkSession, path: str) -> DataFrame:
    """path, geom_id, k, lon_q, lat_q (millionths of a degree) of the geometries of road packs: steps that start anew with each geometry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                _, a = unpacked(content)
                ends = a["geom_ptr"].astype(np.int64)
                of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                yield pd.DataFrame({"path": p, "geom_id": of, "k": np.arange(len(of)) - ends[:-1][of], "lon_q": restarted(a["geom_dlon"], ends[:-1]), "lat_q": restarted(a["geom_dlat"], ends[:-1])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, geom_id long, k long, lon_q long, lat_q long")


def geom_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, geom_id, label of road packs; empty where a pack has no labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                _, a = unpacked(content)
                names = np.array(strings(a["labels"]) if "labels" in a else [""], object)
                yield pd.DataFrame({"path": p, "geom_id": np.arange(len(a["geom_label"])), "label": names[a["geom_label"].astype(np.int64)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, geom_id long, label string")


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Publish one region's pack. The bytes are written under another name in the same folder; a single rename that may overwrite makes them visible."""
    jvm = spark._jvm
    hadoop, conf = jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.partial")
    out = part.getFileSystem(conf).create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    kind = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(part.getFileSystem(conf).getUri(), conf).rename(part.getFileSystem(conf).makeQualified(part), target.getFileSystem(conf).makeQualified(target), how)
