"""Binary and small point formats as a Spark data source: ``spark.read.format("points").option("kind", ...)``.

Files of fixed records are split into ranges of records, one task each; others
are one task a file. Batches go to the JVM as Arrow.
"""

from __future__ import annotations

import glob
import math
import os

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.dims import SPARK, canonical, type_of

#: Records of a task and of a batch.
SPLIT, BATCH = 2_000_000, 65_536
SPARK_OF = {"i1": "int8", "i2": "int16", "i4": "int32", "i8": "int64", "u1": "uint8", "u2": "uint16", "u4": "uint32", "u8": "uint64", "f4": "float", "f8": "double"}


def _known(name: str, kind: str) -> str:
    t = type_of(canonical(name))
    return "double" if canonical(name) in ("X", "Y", "Z") else t if canonical(name) != name or t != "double" else kind


# ---- LAS ------------------------------------------------------------------

# Record lengths and parts of the point formats.
LAS_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


def las_dtype(fmt: int, length: int) -> np.dtype:
    f = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Intensity", "<u2")]
    if fmt < 6:
        f += [("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("UserData", "u1"), ("PointSourceId", "<u2")]
        if fmt in (1, 3, 4, 5):
            f.append(("GpsTime", "<f8"))
        if fmt in (2, 3, 5):
            f += [(c, "<u2") for c in ("Red", "Green", "Blue")]
    else:
        f += [("flags", "u1"), ("flags2", "u1"), ("class", "u1"), ("UserData", "u1"), ("angle", "<i2"), ("PointSourceId", "<u2"), ("GpsTime", "<f8")]
        if fmt in (7, 8, 10):
            f += [(c, "<u2") for c in ("Red", "Green", "Blue")]
        if fmt in (8, 10):
            f.append(("Infrared", "<u2"))
    if fmt in (4, 5, 9, 10):
        f.append(("wave", "V29"))
    have = np.dtype(f).itemsize
    return np.dtype(f + ([("extra", f"V{length - have}")] if length > have else []))


@dataclass
class LasHeader:
    fmt: int
    length: int
    count: int
    offset: int
    scale: tuple
    shift: tuple
    bounds: tuple
    version: tuple
    header_size: int
    vlrs: int


def las_header(path: str) -> LasHeader:
    with open(path, "rb") as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    size, offset, vlrs = struct.unpack_from("<HII", h, 94)
    fmt, length, count = struct.unpack_from("<BHI", h, 104)
    if fmt & 0x80:
        raise ValueError("compressed LAS needs a codec that is not installed")
    d = struct.unpack_from("<12d", h, 131)
    if h[25] >= 4 and len(h) >= 255:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    return LasHeader(fmt & 0x3F, length, count, offset, d[:3], d[3:6], d[6:], (h[24], h[25]), size, vlrs)


def las_extra(path: str, h: LasHeader) -> list[tuple[str, str, float, float]]:
    """(name, numpy type, scale, offset) of the described extra bytes."""
    kinds = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
    with open(path, "rb") as f:
        f.seek(h.header_size)
        for _ in range(h.vlrs):
            head = f.read(54)
            user, rec, n = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
            data = f.read(n)
            if user == b"LASF_Spec" and rec == 4:
                out = []
                for k in range(0, n - 191, 192):
                    e = data[k : k + 192]
                    kind, opts = e[2], e[3]
                    name = e[4:36].split(b"\0")[0].decode("utf-8", "replace")
                    scale = struct.unpack_from("<d", e, 112)[0] if opts & 8 else 1.0
                    shift = struct.unpack_from("<d", e, 136)[0] if opts & 16 else 0.0
                    out.append((name, kinds.get(kind, f"V{opts}"), scale, shift))
                return out
    return []


class Las:
    def __init__(self, path: str, **_):
        self.path, self.h = path, las_header(path)
        self.extra = las_extra(path, self.h)

    def fields(self):
        f = self.h.fmt
        names = ["X", "Y", "Z", "Intensity", "ReturnNumber", "NumberOfReturns", "ScanDirectionFlag", "EdgeOfFlightLine", "Classification", "Synthetic", "KeyPoint", "Withheld", "Overlap", "ScanAngleRank", "UserData", "PointSourceId"]
        if f >= 6:
            names.append("ScanChannel")
        if f in (1, 3, 4, 5) or f >= 6:
            names.append("GpsTime")
        if f in (2, 3, 5, 7, 8, 10):
            names += ["Red", "Green", "Blue"]
        if f in (8, 10):
            names.append("Infrared")
        out = [(n, type_of(n)) for n in names]
        return out + [(n, "double" if s != 1 or o else SPARK_OF[k.lstrip("<")]) for n, k, s, o in self.extra if not k.startswith("V")]

    def count(self):
        return self.h.count

    def read(self, start, stop):
        h = self.h
        dt = las_dtype(h.fmt, h.length)
        for a in range(start, stop, BATCH):
            n = min(BATCH, stop - a)
            r = np.fromfile(self.path, dt, n, offset=h.offset + a * h.length)
            out = {c: r[c] * s + o for c, s, o in zip("XYZ", h.scale, h.shift)}
            fl = r["flags"]
            if h.fmt < 6:
                cls = r["class"] & 31
                out |= {"ReturnNumber": fl & 7, "NumberOfReturns": fl >> 3 & 7, "ScanDirectionFlag": fl >> 6 & 1, "EdgeOfFlightLine": fl >> 7, "Synthetic": r["class"] >> 5 & 1, "KeyPoint": r["class"] >> 6 & 1, "Withheld": r["class"] >> 7}
                # class 12 of the older formats says overlap
                out |= {"Overlap": (cls == 12).astype("u1"), "Classification": cls, "ScanAngleRank": r["angle"].astype("f4")}
            else:
                f2 = r["flags2"]
                out |= {"ReturnNumber": fl & 15, "NumberOfReturns": fl >> 4, "Synthetic": f2 & 1, "KeyPoint": f2 >> 1 & 1, "Withheld": f2 >> 2 & 1, "Overlap": f2 >> 3 & 1, "ScanChannel": f2 >> 4 & 3, "ScanDirectionFlag": f2 >> 6 & 1, "EdgeOfFlightLine": f2 >> 7, "Classification": r["class"], "ScanAngleRank": (r["angle"] * 0.006).astype("f4")}
            for c in ("Intensity", "UserData", "PointSourceId", "GpsTime", "Red", "Green", "Blue", "Infrared"):
                if c in (dt.names or ()):
                    out[c] = r[c]
            if self.extra and "extra" in dt.names:
                e = r["extra"].view([(f"e{k}", kind) for k, (_, kind, _, _) in enumerate(self.extra)] + ([("rest", f"V{dt['extra'].itemsize - sum(np.dtype(x[1]).itemsize for x in self.extra)}")] if dt["extra"].itemsize > sum(np.dtype(x[1]).itemsize for x in self.extra) else []))
                for k, (name, kind, s, o) in enumerate(self.extra):
                    if not kind.startswith("V"):
                        out[name] = e[f"e{k}"] if s == 1 and not o else e[f"e{k}"] * s + o
            yield out


# ---- formats of fixed records ---------------------------------------------


class Records:
    """Little- or big-endian records behind ``skip`` bytes; subclasses say how columns follow."""

    dtype: np.dtype
    skip = 0

    def __init__(self, path: str, **options):
        self.path, self.options = path, options

    def count(self):
        return (os.path.getsize(self.path) - self.skip) // self.dtype.itemsize

    def fields(self):
        return [(n, _known(n, SPARK_OF[self.dtype[n].str[1:]])) for n in self.dtype.names]

    def columns(self, r):
        return {n: r[n] for n in self.dtype.names}

    def read(self, start, stop):
        for a in range(start, stop, BATCH):
            yield self.columns(np.fromfile(self.path, self.dtype, min(BATCH, stop - a), offset=self.skip + a * self.dtype.itemsize))


SBET = ["GpsTime", "Y", "X", "Z", "XVelocity", "YVelocity", "ZVelocity", "Roll", "Pitch", "Azimuth", "WanderAngle", "XBodyAccel", "YBodyAccel", "ZBodyAccel", "XBodyAngRate", "YBodyAngRate", "ZBodyAngRate"]
SBET_ANGLES = ("Y", "X", "Roll", "Pitch", "Azimuth", "WanderAngle", "XBodyAngRate", "YBodyAngRate", "ZBodyAngRate")


class Sbet(Records):
    dtype = np.dtype([(n, "<f8") for n in SBET])

    def columns(self, r):
        degrees = str(self.options.get("angles_as_degrees", "true")).lower() == "true"
        return {n: np.degrees(r[n]) if degrees and n in SBET_ANGLES else r[n] for n in SBET}


class Smrmsg(Records):
    dtype = np.dtype([(n, "<f8") for n in ("GpsTime", "NorthPositionRMS", "EastPositionRMS", "DownPositionRMS", "NorthVelocityRMS", "EastVelocityRMS", "DownVelocityRMS", "RollRMS", "PitchRMS", "HeadingRMS")])


class Qfit(Records):
    def __init__(self, path, **options):
        super().__init__(path, **options)
        with open(path, "rb") as f:
            head = f.read(8)
        self.order = "<" if struct.unpack("<i", head[:4])[0] in (40, 48, 56) else ">"
        size = struct.unpack(self.order + "i", head[:4])[0]
        if size not in (40, 48, 56):
            raise ValueError("QFIT records have 10, 12 or 14 words")
        self.words = size // 4
        self.skip = size  # one header record; more header records are read as points at the origin
        names = ["OffsetTime", "Y", "X", "Z", "StartPulse", "ReflectedPulse", "Azimuth", "Pitch", "Roll"]
        names += {10: [], 12: ["Pdop", "PulseWidth"], 14: ["PassiveSignal", "PassiveY", "PassiveX", "PassiveZ"]}[self.words] + ["time"]
        self.dtype = np.dtype([(n, self.order + "i4") for n in names])

    def fields(self):
        return [(n, type_of(n)) for n in self.dtype.names if n != "time"]

    def columns(self, r):
        zs = float(self.options.get("scale_z", 0.001))
        out = {"OffsetTime": r["OffsetTime"], "Y": r["Y"] / 1e6, "X": r["X"] / 1e6, "Z": r["Z"] * zs, "StartPulse": r["StartPulse"], "ReflectedPulse": r["ReflectedPulse"]}
        if str(self.options.get("flip_coordinates", "true")).lower() == "true":
            out["X"] = np.where(out["X"] > 180, out["X"] - 360, out["X"])
        out |= {n: (r[n] / 1e3).astype("f4" if n != "Azimuth" else "f8") for n in ("Azimuth", "Pitch", "Roll")}
        if self.words == 12:
            out |= {"Pdop": (r["Pdop"] / 10).astype("f4"), "PulseWidth": r["PulseWidth"].astype("f4")}
        if self.words == 14:
            out |= {"PassiveSignal": r["PassiveSignal"], "PassiveY": r["PassiveY"] / 1e6, "PassiveX": r["PassiveX"] / 1e6, "PassiveZ": r["PassiveZ"] * zs}
        return out


class Terrasolid(Records):
    """TerraScan binary, record formats 1 and 2."""

    def __init__(self, path, **options):
        super().__init__(path, **options)
        with open(path, "rb") as f:
            h = f.read(56)
        size, version, tag = struct.unpack_from("<iii", h, 0)
        self.n, self.units = struct.unpack_from("<ii", h, 16)
        self.origin = struct.unpack_from("<3d", h, 24)
        self.time, self.color = struct.unpack_from("<ii", h, 48)
        self.skip = size
        f = [("Classification", "u1"), ("PointSourceId", "u1"), ("echo", "<u2"), ("X", "<i4"), ("Y", "<i4"), ("Z", "<i4")] if version == 20010129 else [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("Classification", "u1"), ("echo", "u1"), ("Flag", "u1"), ("Mark", "u1"), ("PointSourceId", "<u2"), ("Intensity", "<u2")]
        if self.time:
            f.append(("OffsetTime", "<u4"))
        if self.color:
            f += [(c, "u1") for c in ("Red", "Green", "Blue", "Alpha")]
        self.dtype = np.dtype(f)
        self.version = version

    def count(self):
        return self.n

    def fields(self):
        names = ["ReturnNumber", "NumberOfReturns", *(["Intensity"] if self.version == 20010129 else [])]
        return [(n, type_of(n)) for n in self.dtype.names if n != "echo"] + [(n, type_of(n)) for n in names]

    def columns(self, r):
        out = {n: r[n] for n in self.dtype.names if n != "echo"}
        for n, o in zip("XYZ", self.origin):
            out[n] = (r[n] - o) / self.units
        echo = r["echo"] >> 14 if self.version == 20010129 else r["echo"]
        if self.version == 20010129:
            out["Intensity"] = r["echo"] & 0x3FFF
        out["ReturnNumber"] = np.array([1, 1, 2, 3])[np.minimum(echo, 3)]
        out["NumberOfReturns"] = np.array([1, 2, 3, 3])[np.minimum(echo, 3)]
        return out


class Whole:
    """Formats read as one task a file; ``load`` gives the columns."""

    def __init__(self, path: str, **options):
        self.path, self.options, self._data = path, options, None

    def data(self):
        if self._data is None:
            self._data = self.load()
        return self._data

    def fields(self):
        return [(n, _known(n, SPARK_OF[v.dtype.str[1:]])) for n, v in self.data().items()]

    def count(self):
        return len(next(iter(self.data().values()), ()))

    def read(self, start, stop):
        for a in range(start, stop, BATCH):
            yield {n: v[a : min(stop, a + BATCH)] for n, v in self.data().items()}


PLY_KIND = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


class Ply(Whole):
    def load(self):
        with open(self.path, "rb") as f:
            lines = []
            while not lines or lines[-1] != "end_header":
                line = f.readline()
                if not line:
                    raise ValueError("PLY header without an end")
                lines.append(line.decode("ascii", "replace").strip())
            body = f.read()
        fmt = next(x.split()[1] for x in lines if x.startswith("format"))
        elements: list = []
        for x in lines:
            w = x.split()
            if w[:1] == ["element"]:
                elements.append((w[1], int(w[2]), []))
            elif w[:1] == ["property"]:
                elements[-1][2].append(w[1:])
        name, n, props = elements[0]
        if name != "vertex" or any(p[0] == "list" for p in props):
            raise ValueError("PLY vertices of plain properties must come first")
        names = [canonical(p[-1]) for p in props]
        if fmt == "ascii":
            rows = [r.split() for r in body.decode("ascii", "replace").split("\n")[:n]]
            return {c: np.array([float(r[k]) for r in rows]).astype(PLY_KIND[p[0]]) for k, (c, p) in enumerate(zip(names, props))}
        dt = np.dtype([(c, ("<" if fmt == "binary_little_endian" else ">") + PLY_KIND[p[0]]) for c, p in zip(names, props)])
        r = np.frombuffer(body, dt, n)
        return {c: r[c].astype(r[c].dtype.newbyteorder("=")) for c in names}


class Pcd(Whole):
    def load(self):
        head: dict[str, list[str]] = {}
        with open(self.path, "rb") as f:
            while "DATA" not in head:
                line = f.readline()
                if not line:
                    raise ValueError("PCD header without DATA")
                w = line.decode("ascii", "replace").split()
                if w and not w[0].startswith("#"):
                    head[w[0].upper()] = w[1:]
            body = f.read()
        names = [canonical(c) for c in head["FIELDS"]]
        kinds = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
        n, way = int(head["POINTS"][0]), head["DATA"][0]
        if way == "ascii":
            rows = [r.split() for r in body.decode("ascii", "replace").split("\n") if r.strip()][:n]
            return {c: np.array([float(r[k]) for r in rows]).astype(t) for k, (c, t) in enumerate(zip(names, kinds))}
        if way != "binary":
            raise ValueError("binary_compressed PCD is not supported")
        r = np.frombuffer(body, np.dtype([(c, "<" + t) for c, t in zip(names, kinds)]), n)
        return {c: r[c] for c in names}


class Ptx(Whole):
    """Gridded scans, each with its 4 x 4 matrix; ``discard_missing_points``: leave out points at the scanner."""

    def load(self):
        with open(self.path) as f:
            lines = f.read().split("\n")
        drop = str(self.options.get("discard_missing_points", "true")).lower() == "true"
        out, at = [], 0
        while at + 10 <= len(lines) and lines[at].strip():
            n = int(lines[at]) * int(lines[at + 1])
            m = np.array([[float(v) for v in lines[at + 6 + k].split()] for k in range(4)])
            rows = [x.split() for x in lines[at + 10 : at + 10 + n]]
            wide = max(map(len, rows), default=4)
            r = np.array([[float(v) for v in x] + [0.0] * (wide - len(x)) for x in rows])
            if drop and len(r):
                r = r[(r[:, :3] != 0).any(axis=1)]
            xyz = np.c_[r[:, :3], np.ones(len(r))] @ m
            out.append(np.c_[xyz[:, :3], r[:, 3] * 4095, r[:, 4:7] if wide >= 7 else np.zeros((len(r), 3))])
            at += 10 + n
        a = np.concatenate(out) if out else np.empty((0, 7))
        cols = {c: a[:, k] for k, c in enumerate("XYZ")} | {"Intensity": np.rint(a[:, 3]).astype("u2")}
        return cols | {c: a[:, 4 + k].astype("u2") for k, c in enumerate(("Red", "Green", "Blue"))}


class Obj(Whole):
    def load(self):
        v = []
        with open(self.path) as f:
            for line in f:
                w = line.split()
                if w[:1] == ["v"]:
                    v.append([float(x) for x in w[1:4]])
        a = np.array(v).reshape(-1, 3)
        return {c: a[:, k] for k, c in enumerate("XYZ")}


def obj_faces(path: str) -> list[tuple[int, int, int]]:
    """Triangles as 0-based vertex rows; polygons as fans."""
    out = []
    with open(path) as f:
        for line in f:
            w = line.split()
            if w[:1] == ["f"]:
                i = [int(x.split("/")[0]) - 1 for x in w[1:]]
                out += [(i[0], i[k], i[k + 1]) for k in range(1, len(i) - 1)]
    return out


class Bpf(Whole):
    """Version 3 files without compression; dimension-, point- and byte-major."""

    def load(self):
        with open(self.path, "rb") as f:
            b = f.read()
        if b[:8] != b"BPF!0003":
            raise ValueError("BPF version 3 is needed")
        size, dims, way, packed = struct.unpack_from("<iBBB", b, 8)
        n = struct.unpack_from("<i", b, 16)[0]
        if packed:
            raise ValueError("compressed BPF is not supported")
        at = 176
        offs = struct.unpack_from(f"<{dims}d", b, at)
        names = [b[at + 24 * dims + 32 * k : at + 24 * dims + 32 * k + 32].split(b"\0")[0].decode("ascii", "replace") for k in range(dims)]
        raw = np.frombuffer(b, "u1", n * dims * 4, size)
        if way == 0:
            v = raw.view("<f4").reshape(dims, n)
        elif way == 1:
            v = raw.view("<f4").reshape(n, dims).T
        else:
            v = np.ascontiguousarray(raw.reshape(dims, 4, n).transpose(0, 2, 1)).view("<f4").reshape(dims, n)
        return {canonical(c): v[k].astype("f8") + offs[k] for k, c in enumerate(names)}


KINDS = {"las": Las, "sbet": Sbet, "smrmsg": Smrmsg, "qfit": Qfit, "terrasolid": Terrasolid, "ply": Ply, "pcd": Pcd, "ptx": Ptx, "obj": Obj, "bpf": Bpf}


@dataclass
class _Part(InputPartition):
    path: str
    seq: int
    start: int
    stop: int


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if not os.path.basename(p).startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


def _own(options) -> dict:
    return {k: v for k, v in dict(options).items() if k not in ("path", "kind")}


class PointSource(DataSource):
    """Options: path (file, folder or pattern), kind, and those of the kind. ``pid``: file number * 2^40 + record."""

    @classmethod
    def name(cls):
        return "points"

    def schema(self):
        kind = KINDS[self.options["kind"]]
        f = kind(_paths(self.options["path"])[0], **_own(self.options)).fields()
        return T.StructType([T.StructField("pid", T.LongType()), *(T.StructField(n, SPARK[t]) for n, t in f)])

    def reader(self, schema):
        return _Reader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema = options, schema

    def partitions(self):
        out, kind = [], KINDS[self.options["kind"]]
        for seq, p in enumerate(_paths(self.options["path"])):
            if issubclass(kind, Whole):
                out.append(_Part(p, seq, 0, -1))
            else:
                n = kind(p, **_own(self.options)).count()
                out += [_Part(p, seq, a, min(n, a + SPLIT)) for a in range(0, n, SPLIT)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        src = KINDS[self.options["kind"]](part.path, **_own(self.options))
        stop = src.count() if part.stop < 0 else part.stop
        at = part.start
        names = [f.name for f in self.schema.fields]
        arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in self.schema.fields])
        for cols in src.read(part.start, stop):
            n = len(next(iter(cols.values())))
            cols["pid"] = (part.seq << 40) + np.arange(at, at + n)
            at += n
            zero = np.zeros(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols.get(c, zero))).cast(arrow.field(c).type, safe=False) for c in names], schema=arrow)


def _arrow(t):
    return {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "byte": pa.int8(), "float": pa.float32(), "double": pa.float64()}.get(t.typeName(), pa.decimal128(20, 0))


@dataclass
class _Wrote(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """One whole file a task, in a folder: las, ply, pcd, sbet or bpf. Rows come as Arrow batches.

    Files have a name of their own in every write, so appending replaces nothing; they get it when all tasks are
    done, and what a failed job wrote is removed.
    """

    def __init__(self, options, schema):
        self.options, self.schema, self.job = options, schema, uuid.uuid4().hex[:12]

    def write(self, batches):
        from pyspark import TaskContext

        names = [f.name for f in self.schema.fields]
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return _Wrote("", 0)
        data = pa.Table.from_batches(parts)
        folder, kind = self.options["path"].removeprefix("file://"), self.options["kind"]
        os.makedirs(folder, exist_ok=True)
        c = TaskContext.get()
        path = os.path.join(folder, f".part-{self.job}-{c.partitionId():05d}-{c.taskAttemptId()}.{kind}")
        cols = {n: data.column(n).cast(pa.float64() if n != "pid" else pa.int64(), safe=False).fill_null(0).to_numpy() for n in names}
        if "pid" in cols:
            order = np.argsort(cols.pop("pid"), kind="stable")
            cols = {n: v[order] for n, v in cols.items()}
        cols.pop("view_id", None)
        WRITERS[kind](path, cols, self.options)
        return _Wrote(path, data.num_rows)

    def commit(self, messages):
        for m in messages:
            if m and m.path:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, name[1:]))

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


def write_las(path: str, cols: dict[str, np.ndarray], options: dict) -> None:
    """LAS 1.4 in format 7 (or ``dataformat_id`` 6 to 8), or 1.2 in 0 to 3. Scaled values must fit 32 bits."""
    fmt = int(options.get("dataformat_id", 7))
    n = len(cols["X"])
    dt = las_dtype(fmt, LAS_LENGTH[fmt])
    r = np.zeros(n, dt)
    get = lambda c: np.rint(cols.get(c, np.zeros(n)))
    scale = [float(options.get(f"scale_{c}", 0.01)) for c in "xyz"]
    shift = [float(options.get(f"offset_{c}", 0.0)) if options.get(f"offset_{c}") != "auto" else math.floor(cols[c.upper()].min()) for c in "xyz"]
    for c, s, o in zip("XYZ", scale, shift):
        v = np.rint((cols[c] - o) / s)
        if n and (np.abs(v).max() > 2**31 - 1 or np.isnan(v).any()):
            raise ValueError(f"{c} does not fit: choose another scale or offset")
        r[c] = v
    for c in ("Intensity", "UserData", "PointSourceId", "Red", "Green", "Blue", "Infrared"):
        if c in dt.names:
            r[c] = np.clip(get(c), 0, np.iinfo(dt[c]).max)
    if "GpsTime" in dt.names:
        r["GpsTime"] = cols.get("GpsTime", np.zeros(n))
    bit = lambda c, m, k: (get(c).astype(int) & m) << k
    if fmt < 6:
        cls = get("Classification").astype(int)
        cls = np.where(get("Overlap") > 0, 12, cls)
        r["flags"] = bit("ReturnNumber", 7, 0) | bit("NumberOfReturns", 7, 3) | bit("ScanDirectionFlag", 1, 6) | bit("EdgeOfFlightLine", 1, 7)
        r["class"] = (cls & 31) | bit("Synthetic", 1, 5) | bit("KeyPoint", 1, 6) | bit("Withheld", 1, 7)
        r["angle"] = np.clip(get("ScanAngleRank"), -90, 90)
    else:
        r["flags"] = bit("ReturnNumber", 15, 0) | bit("NumberOfReturns", 15, 4)
        r["flags2"] = bit("Synthetic", 1, 0) | bit("KeyPoint", 1, 1) | bit("Withheld", 1, 2) | bit("Overlap", 1, 3) | bit("ScanChannel", 3, 4) | bit("ScanDirectionFlag", 1, 6) | bit("EdgeOfFlightLine", 1, 7)
        r["class"] = get("Classification")
        r["angle"] = np.clip(np.rint(cols.get("ScanAngleRank", np.zeros(n)) / 0.006), -30000, 30000)
    size = 375 if fmt >= 6 else 227
    h = bytearray(size)
    h[:4] = b"LASF"
    h[24], h[25] = 1, 4 if fmt >= 6 else 2
    h[26:58] = str(options.get("system_id", "nubila")).encode()[:32].ljust(32, b"\0")
    h[58:90] = str(options.get("software_id", "nubila")).encode()[:32].ljust(32, b"\0")
    struct.pack_into("<HII", h, 94, size, size, 0)
    by_return = [int((get("ReturnNumber") == k).sum()) for k in range(1, 16)]
    struct.pack_into("<BHI5I", h, 104, fmt, dt.itemsize, n if fmt < 6 else 0, *(by_return[:5] if fmt < 6 else [0] * 5))
    b = [x for c, s, o in zip("XYZ", scale, shift) for x in ((r[c].max() * s + o, r[c].min() * s + o) if n else (0.0, 0.0))]
    struct.pack_into("<12d", h, 131, *scale, *shift, *b)
    if fmt >= 6:
        struct.pack_into("<QQIQ15Q", h, 227, 0, 0, 0, n, *by_return)
    with open(path, "wb") as f:
        f.write(h)
        r.tofile(f)


def write_ply(path: str, cols: dict[str, np.ndarray], options: dict) -> None:
    way = options.get("storage_mode", "ascii")
    names = {"X": "x", "Y": "y", "Z": "z"}
    digits = int(options.get("precision", 3))
    n = len(cols["X"])
    fmt = {"ascii": "ascii", "little endian": "binary_little_endian", "big endian": "binary_big_endian"}[way]
    head = f"ply\nformat {fmt} 1.0\nelement vertex {n}\n" + "".join(f"property double {names.get(c, c)}\n" for c in cols) + "end_header\n"
    with open(path, "wb") as f:
        f.write(head.encode())
        if fmt == "ascii":
            f.write("".join(" ".join(f"{v:.{digits}f}" for v in row) + "\n" for row in zip(*cols.values())).encode())
        else:
            f.write(np.stack(list(cols.values()), axis=1).astype("<f8" if "little" in fmt else ">f8").tobytes())


def write_pcd(path: str, cols: dict[str, np.ndarray], options: dict) -> None:
    way, n, digits = options.get("compression", "ascii"), len(cols["X"]), int(options.get("precision", 2))
    names = {"X": "x", "Y": "y", "Z": "z"}
    k = len(cols)
    head = f"VERSION 0.7\nFIELDS {' '.join(names.get(c, c) for c in cols)}\nSIZE {' '.join(['8'] * k)}\nTYPE {' '.join(['F'] * k)}\nCOUNT {' '.join(['1'] * k)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {way}\n"
    with open(path, "wb") as f:
        f.write(head.encode())
        if way == "ascii":
            f.write("".join(" ".join(f"{v:.{digits}f}" for v in row) + "\n" for row in zip(*cols.values())).encode())
        elif way == "binary":
            f.write(np.stack(list(cols.values()), axis=1).astype("<f8").tobytes())
        else:
            raise ValueError("compressed PCD is not supported")


def write_sbet(path: str, cols: dict[str, np.ndarray], options: dict) -> None:
    n = len(next(iter(cols.values())))
    degrees = str(options.get("angles_are_degrees", "true")).lower() == "true"
    get = lambda c: cols.get(c, np.zeros(n))
    np.stack([np.radians(get(c)) if degrees and c in SBET_ANGLES else get(c) for c in SBET], axis=1).astype("<f8").tofile(path)


def write_bpf(path: str, cols: dict[str, np.ndarray], options: dict) -> None:
    way = {"dimension": 0, "point": 1, "byte": 2}[options.get("format", "dimension").lower()]
    n, dims = len(cols["X"]), len(cols)
    offs = [float(np.floor(v.min())) if n else 0.0 for v in cols.values()]
    v = np.stack([c - o for c, o in zip(cols.values(), offs)]).astype("<f4")
    size = 176 + dims * 56
    h = bytearray(size)
    h[:8] = b"BPF!0003"
    struct.pack_into("<iBBBBi", h, 8, size, dims, way, 0, 0, n)
    struct.pack_into("<16d", h, 32, *np.eye(4).ravel())
    struct.pack_into(f"<{dims}d", h, 176, *offs)
    struct.pack_into(f"<{dims}d", h, 176 + 8 * dims, *(c.min() if n else 0.0 for c in cols.values()))
    struct.pack_into(f"<{dims}d", h, 176 + 16 * dims, *(c.max() if n else 0.0 for c in cols.values()))
    for k, c in enumerate(cols):
        h[176 + 24 * dims + 32 * k : 176 + 24 * dims + 32 * k + 32] = c.encode()[:32].ljust(32, b"\0")
    body = v if way == 0 else v.T if way == 1 else np.ascontiguousarray(v).view("u1").reshape(dims, n, 4).transpose(0, 2, 1)
    with open(path, "wb") as f:
        f.write(h)
        f.write(np.ascontiguousarray(body).tobytes())


WRITERS = {"las": write_las, "ply": write_ply, "pcd": write_pcd, "sbet": write_sbet, "bpf": write_bpf}


def read_points(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    spark.dataSource.register(PointSource)
    return spark.read.format("points").options(kind=kind, path=path, **options).load()


def write_points(df: DataFrame, kind: str, path: str, **options) -> None:
    df.sparkSession.dataSource.register(PointSource)
    df.write.format("points").options(kind=kind, path=path, **options).mode("append").save()


