"""NetCDF files of the classic formats as a Spark data source: scans by byte ranges and a committed sink.

A scan decodes the header once, turns range filters on index and coordinate columns into index
ranges, and deals the first two dimensions out to tasks; a task reads only the bytes of its ranges. The
sink lays the whole file out before any row is there, so every task writes its values at
their final offsets in a hidden file; the commit counts cells and renames, an abort removes.
"""

from __future__ import annotations

import datetime as dt
import glob
import itertools
import json
import math
import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "netcdf3"
#: Bytes of selected values that a task reads, about.
PARTITION_BYTES = 32 << 20
#: Rows of a batch, about.
BATCH_ROWS = 1 << 17

# Fixed values of the file format: tags, types by number, fill values by type.
DIMENSIONS, VARIABLES, ATTRIBUTES = 0x0A, 0x0B, 0x0C
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILLS = {">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36}

_EPOCH = np.datetime64("1970-01-01T00:00:00", "us")
_UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
_MONTH_STARTS = np.cumsum([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30])


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: str
    begin: int
    attributes: dict = field(default_factory=dict)

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


@dataclass(frozen=True)
class Header:
    """Dimensions with their lengths, the record dimension if any, variables, bytes of a record, and attributes of the file."""

    dims: dict[str, int]
    record: str | None
    variables: dict[str, Variable]
    record_bytes: int
    attributes: dict

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d] for d in v.dims)


class _Cursor:
    """Big-endian values one after the other, read in blocks as they are needed."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.data, self.at, self.wide = read, b"", 0, False

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.read(len(self.data), max(1 << 16, self.at + n - len(self.data)))
            if not more:
                raise ValueError("the header ends too early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else struct.unpack(">I", self.take(4))[0]

    def name(self) -> str:
        n = self.count()
        return self.take(n + -n % 4)[:n].decode()

    def list_of(self, tag: int) -> range:
        found, n = self.int(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"tag {found} where {tag} is due")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.list_of(ATTRIBUTES):
            name, kind, n = self.name(), KINDS[self.int()], self.count()
            size = n * np.dtype(kind).itemsize
            raw = self.take(size + -size % 4)[:size]
            values = raw.decode(errors="replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out


def parse_header(read: Callable[[int, int], bytes]) -> Header:
    """The header behind ``read`` (offset, length); what is no classic file raises."""
    c = _Cursor(read)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError(f"not a classic NetCDF file: {magic!r}")
    c.wide = magic[3] == 5
    records = c.count()
    lengths = [(c.name(), c.count()) for _ in c.list_of(DIMENSIONS)]
    names = [d for d, _ in lengths]
    record = next((d for d, n in lengths if n == 0), None)
    attributes = c.attributes()
    variables = {}
    for _ in c.list_of(VARIABLES):
        name = c.name()
        dims = tuple(names[c.count()] for _ in range(c.count()))
        own, kind = c.attributes(), KINDS[c.int()]
        c.count()  # the stored size, which the dimensions give
        begin = c.int() if magic[3] == 1 else struct.unpack(">q", c.take(8))[0]
        variables[name] = Variable(name, dims, kind, begin, own)
    dims = dict(lengths)
    sizes = [math.prod([v.width, *[dims[d] for d in v.dims[1:]]]) for v in variables.values() if v.dims[:1] == (record,) and record]
    record_bytes = sum(n + -n % 4 for n in sizes) if len(sizes) != 1 else sizes[0]
    if record:
        unknown = records == (2**63 - 1 if c.wide else 2**32 - 1) or records < 0
        if unknown:
            raise ValueError("the file was not closed: its number of records is unknown")
        dims[record] = records
    return Header(dims, record, variables, record_bytes, attributes)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow reaches, for reads at offsets."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def header_of(path: str) -> Header:
    with opened(path) as f:
        return parse_header(lambda at, n: f.read_at(n, at))


def read_ranges(read: Callable[[int, int], bytes], h: Header, v: Variable, ranges: dict[str, tuple[int, int]]) -> np.ndarray:
    """The values of a variable within the index ranges. Only their bytes are read, up to whole rows of the last dimensions."""
    shape = h.shape(v)
    spans = [ranges.get(d, (0, n)) for d, n in zip(v.dims, shape, strict=True)]
    if not shape:
        return np.frombuffer(read(v.begin, v.width), v.kind).reshape(())
    lo, hi = spans[0]
    inner = math.prod(shape[1:]) * v.width
    stride = h.record_bytes if v.dims[0] == h.record else inner
    whole = all(s == (0, n) for s, n in zip(spans[1:], shape[1:], strict=True))
    if whole and stride == inner:
        raw = read(v.begin + lo * stride, (hi - lo) * inner)
        return np.frombuffer(raw, v.kind).reshape(hi - lo, *shape[1:])
    block = math.prod(shape[2:]) * v.width
    first, last = spans[1] if len(shape) > 1 else (0, 1)
    parts = [read(v.begin + k * stride + first * block, (last - first) * block) for k in range(lo, hi)]
    rows = np.frombuffer(b"".join(parts), v.kind)
    if len(shape) == 1:
        return rows
    return rows.reshape(hi - lo, last - first, *shape[2:])[(slice(None), slice(None), *[slice(a, b) for a, b in spans[2:]])]


def _no_leap_days(offset: np.ndarray, since: dt.datetime) -> np.ndarray:
    """Microseconds of a calendar without leap days as times; none falls on the 29th of February."""
    day = offset // _UNITS["day"] + since.year * 365 + int(_MONTH_STARTS[since.month - 1]) + since.day - 1
    year, of_year = day // 365, day % 365
    month = np.searchsorted(_MONTH_STARTS, of_year, "right") - 1
    dates = (year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + month.astype("timedelta64[M]")
    rest = (of_year - _MONTH_STARTS[month]) * _UNITS["day"] + offset % _UNITS["day"]
    return dates.astype("datetime64[us]") + rest.astype("timedelta64[us]")


def _since(v: Variable) -> tuple[int, dt.datetime, bool] | None:
    """Microseconds of a unit, the date it counts from, and whether leap days are left out; None for what is no time."""
    unit, _, date = str(v.attributes.get("units", "")).partition(" since ")
    calendar = str(v.attributes.get("calendar", "standard")).lower()
    plain = unit.strip().lower().rstrip("s")
    if plain not in _UNITS or calendar not in ("standard", "gregorian", "proleptic_gregorian", "noleap", "365_day"):
        return None
    since = dt.datetime.fromisoformat(date.strip().removesuffix("UTC").strip())
    return _UNITS[plain], since.astimezone(dt.UTC).replace(tzinfo=None) if since.tzinfo else since, calendar in ("noleap", "365_day")


def decoded(v: Variable, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as their column has them, and which are missing: scale and offset undone, times as datetime64."""
    fills = [v.attributes[k] for k in ("_FillValue", "missing_value") if k in v.attributes] or [FILLS[v.kind]] * (v.kind in FILLS)
    missing = np.zeros(raw.shape, bool)
    for f in fills:
        missing |= raw == np.dtype(v.kind).type(f)
    native = raw.astype(raw.dtype.newbyteorder("="))
    time = _since(v)
    if time:
        unit, since, no_leap = time
        offset = np.rint(np.where(missing, 0, native).astype(np.float64) * unit).astype(np.int64)
        return (_no_leap_days(offset, since) if no_leap else np.datetime64(since, "us") + offset.astype("timedelta64[us]")), missing
    if {"scale_factor", "add_offset"} & set(v.attributes):
        return native * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0)), missing
    if native.dtype.kind == "f":
        missing |= np.isnan(native)
    return native, missing


def _column_type(v: Variable) -> T.DataType:
    if _since(v):
        return T.TimestampType()
    if {"scale_factor", "add_offset"} & set(v.attributes) or v.kind == ">f8":
        return T.DoubleType()
    return {"f": T.FloatType(), "i": T.IntegerType(), "u": T.LongType()}[np.dtype(v.kind).kind] if v.width < 8 else T.LongType()


def row_dims(h: Header) -> tuple[str, ...]:
    """Dimensions of a row: those of the variable with the most (the largest, then the first of them)."""
    numeric = [v for v in h.variables.values() if v.kind != "S1"]
    if not numeric:
        raise ValueError("no variable of numbers")
    return max(numeric, key=lambda v: (len(v.dims), math.prod(h.shape(v)))).dims


def columns_of(h: Header) -> dict[str, Variable]:
    """Variables that a row holds: numbers over some of its dimensions."""
    dims = set(row_dims(h))
    return {k: v for k, v in h.variables.items() if v.kind != "S1" and set(v.dims) <= dims}


def schema_of(h: Header) -> T.StructType:
    """One index column a dimension (``<name>_idx``), one column a variable."""
    indices = [T.StructField(f"{d}_idx", T.IntegerType(), False) for d in row_dims(h)]
    return T.StructType([*indices, *[T.StructField(k, _column_type(v)) for k, v in columns_of(h).items()]])


@dataclass
class Piece(InputPartition):
    """Index ranges of one file."""

    path: str
    header: Header
    ranges: dict[str, tuple[int, int]]


class NetCDFReader(DataSourceReader):
    """Scan of files with one set of variables; range filters on indices and one-dimensional coordinates choose what is read."""

    def __init__(self, paths: list[str], schema: T.StructType, partition_bytes: int = PARTITION_BYTES):
        self.paths, self.schema, self.partition_bytes = paths, schema, partition_bytes
        self.headers = {p: header_of(p) for p in paths}
        self.ranges = {p: {d: (0, h.dims[d]) for d in row_dims(h)} for p, h in self.headers.items()}
        for p, h in self.headers.items():
            lacking = [c for c in schema.names if c not in schema_of(h).names]
            if lacking:
                raise ValueError(f"{p} lacks {lacking}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._narrow(f):
                yield f  # Spark applies it to the rows

    def _narrow(self, f: Filter) -> bool:
        """Narrow the ranges by one filter; true if no row outside it is left."""
        holds = {
            EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y,
        }.get(type(f))
        if holds is None or len(f.attribute) != 1:
            return False
        column, exact = f.attribute[0], True
        for p, h in self.headers.items():
            dims = row_dims(h)
            if column.removesuffix("_idx") in dims and column.endswith("_idx"):
                dim = column.removesuffix("_idx")
                ok = holds(np.arange(h.dims[dim]), f.value)
            elif column in columns_of(h) and len(h.variables[column].dims) == 1:
                dim = h.variables[column].dims[0]
                with opened(p) as file:
                    values, missing = decoded(h.variables[column], read_ranges(lambda at, n: file.read_at(n, at), h, h.variables[column], {}))
                ok = holds(values, _comparable(f.value)) & ~missing
            else:
                return False
            at = np.flatnonzero(ok)
            lo, hi = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
            a, b = self.ranges[p][dim]
            self.ranges[p][dim] = (max(a, lo), max(max(a, lo), min(b, hi)))
            exact &= len(at) == hi - lo
        return exact

    def partitions(self) -> list[Piece]:
        out = []
        for p, h in self.headers.items():
            ranges = self.ranges[p]
            dims = row_dims(h)
            used = [v for k, v in columns_of(h).items() if k in self.schema.names and v.dims == dims]
            cell = sum(v.width for v in used) or 8
            inner = math.prod(b - a for a, b in (ranges[d] for d in dims[2:]))
            second = ranges[dims[1]] if len(dims) > 1 else (0, 1)
            rows = max(1, self.partition_bytes // max(1, cell * inner))
            steps = max(1, rows // max(1, second[1] - second[0]))
            for a in range(*ranges[dims[0]], steps):
                for c in range(*second, rows if steps == 1 else max(1, second[1] - second[0])):
                    cut = {dims[0]: (a, min(a + steps, ranges[dims[0]][1]))}
                    if len(dims) > 1:
                        cut[dims[1]] = (c, min(c + rows, second[1])) if steps == 1 else second
                    if inner:
                        out.append(Piece(p, h, {**ranges, **cut}))
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no pieces
            return
        with opened(partition.path) as file:
            yield from batches_of(lambda at, n: file.read_at(n, at), partition.header, partition.ranges, self.schema)


def _comparable(value):
    if isinstance(value, dt.datetime):
        return np.datetime64(value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value, "us")
    return value


def batches_of(read: Callable[[int, int], bytes], h: Header, ranges: dict[str, tuple[int, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows within the ranges, in order of the dimensions, some steps of the first one at a time."""
    dims = row_dims(h)
    lo, hi = ranges[dims[0]]
    cells = math.prod(b - a for a, b in (ranges[d] for d in dims[1:]))
    steps = max(1, BATCH_ROWS // max(1, cells))
    fixed = {k: read_ranges(read, h, v, ranges) for k, v in columns_of(h).items() if k in schema.names and dims[0] not in v.dims}
    for a in range(lo, hi, steps):
        now = {**ranges, dims[0]: (a, min(a + steps, hi))}
        shape = tuple(now[d][1] - now[d][0] for d in dims)
        columns = []
        for f in schema:
            dim = f.name.removesuffix("_idx")
            if f.name not in h.variables and dim in dims:
                values = np.arange(*now[dim], dtype=np.int32).reshape([-1 if d == dim else 1 for d in dims])
                missing = np.zeros((1,) * len(dims), bool)
            else:
                v = h.variables[f.name]
                values, missing = decoded(v, fixed[f.name] if f.name in fixed else read_ranges(read, h, v, now))
                order = sorted(range(len(v.dims)), key=lambda k: dims.index(v.dims[k]))
                of = {v.dims[k]: values.shape[k] for k in order}
                values, missing = (x.transpose(order).reshape([of.get(d, 1) for d in dims]) for x in (values, missing))
            flat, gone = (np.broadcast_to(x, shape).reshape(-1) for x in (values, missing))
            kind = {"timestamp": pa.timestamp("us", tz="UTC"), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[f.dataType.simpleString()]
            columns.append(pa.array(flat if pa.types.is_timestamp(kind) else flat.astype(kind.to_pandas_dtype()), pa.timestamp("us") if pa.types.is_timestamp(kind) else kind, mask=gone).cast(kind))
        yield pa.RecordBatch.from_arrays(columns, schema.names)


# ---- sink

_NUMBERS = {"short": 3, "int": 4, "float": 5, "double": 6, "bigint": 10, "timestamp": 6}


def _named(name: str, wide: bool) -> bytes:
    raw = name.encode()
    return struct.pack(">q" if wide else ">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(values: dict, wide: bool) -> bytes:
    count = ">q" if wide else ">i"
    if not values:
        return struct.pack(">i", 0) + struct.pack(count, 0)
    out = [struct.pack(">i", ATTRIBUTES), struct.pack(count, len(values))]
    for name, value in values.items():
        if isinstance(value, str):
            number, raw, n = 2, value.encode(), len(value.encode())
        else:
            kind = value[0] if isinstance(value, tuple) else ("double" if isinstance(value, float) else "int")
            number, given = _NUMBERS[kind], value[1] if isinstance(value, tuple) else value
            raw, n = np.array([given], KINDS[number]).tobytes(), 1
        out += [_named(name, wide), struct.pack(">i", number), struct.pack(count, n), raw, b"\0" * (-len(raw) % 4)]
    return b"".join(out)


def lay_out(dims: dict[str, int], variables: dict[str, dict], attributes: dict | None = None) -> tuple[bytes, Header, int]:
    """The header's bytes, the header and the file's length for variables {name: {dims, type, attributes}} of fixed dimensions.

    Files take the format with 64-bit offsets; one with a variable of 2 GiB or more that with 64-bit sizes.
    """
    sizes = {k: math.prod([np.dtype(KINDS[_NUMBERS[v["type"]]]).itemsize, *[dims[d] for d in v["dims"]]]) for k, v in variables.items()}
    wide = any(n > 2**31 - 5 for n in sizes.values()) or any(n > 2**31 - 1 for n in dims.values()) or any(v["type"] == "bigint" for v in variables.values())
    count, names = ">q" if wide else ">i", list(dims)

    def build(begins: dict[str, int]) -> bytes:
        out = [b"CDF\x05" if wide else b"CDF\x02", struct.pack(count, 0), struct.pack(">i", DIMENSIONS), struct.pack(count, len(dims))]
        out += [_named(d, wide) + struct.pack(count, n) for d, n in dims.items()]
        out += [_attributes(attributes or {}, wide), struct.pack(">i", VARIABLES), struct.pack(count, len(variables))]
        for k, v in variables.items():
            number = _NUMBERS[v["type"]]
            own = dict(v.get("attributes", {}))
            if KINDS[number] in FILLS and "_FillValue" not in own:
                own["_FillValue"] = ({3: "short", 4: "int", 5: "float", 6: "double"}[number], FILLS[KINDS[number]])
            if v["type"] == "timestamp":
                own["units"] = "seconds since 1970-01-01 00:00:00"
            out += [_named(k, wide), struct.pack(count, len(v["dims"])), *[struct.pack(count, names.index(d)) for d in v["dims"]], _attributes(own, wide)]
            out += [struct.pack(">i", number), struct.pack(count, sizes[k] + -sizes[k] % 4), struct.pack(">q", begins[k])]
        return b"".join(out)

    begins = dict.fromkeys(variables, 0)
    at = len(build(begins))
    for k, n in sizes.items():
        begins[k], at = at, at + n + -n % 4
    raw = build(begins)
    return raw, parse_header(lambda a, n: raw[a : a + n]), at


@dataclass
class Written(WriterCommitMessage):
    """Cells that a task wrote, by index of the first dimension: how many, and the sum of their places."""

    cells: dict[int, tuple[int, int]]


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: files are written at offsets, which needs a folder that driver and executors mount")
    return path


class NetCDFWriter(DataSourceArrowWriter):
    """One file by all tasks. A repeated task writes the same bytes to the same places."""

    def __init__(self, path: str, layout: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.layout = _local(path), overwrite, layout
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        for k, v in layout["variables"].items():
            v["type"] = schema[k].dataType.simpleString()
            if v["type"] not in _NUMBERS:
                raise ValueError(f"{k}: no type of the format holds {v['type']}")
        raw, self.header, size = lay_out(layout["dims"], layout["variables"], layout.get("attributes"))
        folder, name = os.path.split(self.path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        os.makedirs(folder or ".", exist_ok=True)
        with open(self.hidden, "xb") as f:
            f.write(raw)
            f.truncate(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        dims, cells = list(self.layout["dims"].items()), {}
        with open(self.hidden, "r+b", buffering=0) as f:
            for batch in iterator:
                places = {d: batch.column(d).to_numpy(zero_copy_only=False).astype(np.int64) for d, _ in dims}
                for d, n in dims:
                    if len(places[d]) and not (places[d].min() >= 0 and places[d].max() < n):
                        raise ValueError(f"{d} leaves 0 to {n - 1}")
                for k, v in self.header.variables.items():
                    self._put(f, v, batch.column(k), places)
                inner = np.zeros(batch.num_rows, np.int64)
                for d, n in dims[1:]:
                    inner = inner * n + places[d]
                steps, at = np.unique(places[dims[0][0]], return_inverse=True)
                for s, n, total in zip(steps.tolist(), np.bincount(at).tolist(), (np.bincount(at, inner)).tolist(), strict=True):
                    have = cells.get(s, (0, 0))
                    cells[s] = (have[0] + n, have[1] + int(total))
            os.fsync(f.fileno())
        return Written(cells)

    def _put(self, f, v: Variable, column: pa.Array, places: dict[str, np.ndarray]) -> None:
        """Values to their offsets, one write for each run of neighbouring places."""
        if not len(column):
            return
        if pa.types.is_timestamp(column.type):
            values = column.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False) / 1e6
        else:
            values = column.to_numpy(zero_copy_only=False)
        raw = np.where(np.asarray(column.is_null()), FILLS.get(v.kind, 0), values).astype(v.kind)
        at = np.zeros(len(raw), np.int64)
        for d in v.dims:
            at = at * self.header.dims[d] + places[d]
        order = np.argsort(at, kind="stable")
        at, raw = at[order], raw[order]
        last = np.append(at[1:] != at[:-1], True)  # of several values of one place the last stays
        at, raw = at[last], raw[last]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
        for a, b in itertools.pairwise(cuts.tolist()):
            os.pwrite(f.fileno(), raw[a:b].tobytes(), v.begin + int(at[a]) * v.width)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            (first, steps), *rest = self.layout["dims"].items()
            each = math.prod(n for _, n in rest)
            held: dict[int, list[int]] = {}
            for m in messages:
                for s, (n, total) in (m.cells if m else {}).items():
                    have = held.setdefault(s, [0, 0])
                    have[0], have[1] = have[0] + n, have[1] + total
            wrong = [s for s in range(steps) if held.get(s) != [each, each * (each - 1) // 2]]
            if wrong:
                raise ValueError(f"{first} {wrong[:5]}: cells are missing or there twice")
            if self.overwrite:
                os.replace(self.hidden, self.path)
            else:
                os.link(self.hidden, self.path)  # raises if another job was first
                os.remove(self.hidden)
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class NetCDFSource(DataSource):
    """``spark.read.format("netcdf3")`` after :func:`register_format`; options ``path`` or ``paths`` (JSON), ``partitionBytes``, ``layout`` (JSON, to write)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _paths(self) -> list[str]:
        given = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        out = []
        for p in given:
            found = sorted(glob.glob(p)) if any(c in p for c in "*?[") and "://" not in p else [p]
            if not found:
                raise FileNotFoundError(p)
            out += found
        return out

    def schema(self) -> T.StructType:
        return schema_of(header_of(self._paths()[0]))

    def reader(self, schema: T.StructType) -> NetCDFReader:
        return NetCDFReader(self._paths(), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> NetCDFWriter:
        return NetCDFWriter(self.options["path"], json.loads(self.options["layout"]), schema, overwrite)


def register_format(spark: SparkSession) -> SparkSession:
    """Make the format known to the session and let filters reach it."""
    from ..session import make_importable

    make_importable(spark).dataSource.register(NetCDFSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_netcdf(spark: SparkSession, paths: str | list[str], features: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of all files: an index column a dimension, and all variables or the coordinates and ``features`` alone (others are not read).

    A coordinate is a variable over fewer dimensions than a row has. Missing values are null, times timestamps; index columns are
    named after the dimension with ``_idx`` behind it. Files must agree in their variables. A file without records gives no rows.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    source = NetCDFSource({"paths": json.dumps(files)})
    h = header_of(source._paths()[0])
    whole = schema_of(h)
    if features is not None:
        lacking = [f for f in features if f not in whole.names]
        if lacking:
            raise ValueError(f"{files[0]} lacks {lacking}")
        dims = row_dims(h)
        whole = T.StructType([f for f in whole if f.name in features or f.name not in h.variables or h.variables[f.name].dims != dims])
    reader = register_format(spark).read.format(FORMAT).schema(whole).option("paths", json.dumps(files))
    return reader.option("partitionBytes", str(partition_bytes)).load()


def write_netcdf(df: DataFrame, path: str, dims: dict[str, int] | list[str], variables: dict[str, list[str]], attributes: dict[str, dict] | None = None, overwrite: bool = False) -> None:
    """One file of all rows. ``dims``: index columns, outermost first, with their lengths (a list: the largest index and one); ``variables``: columns and the dimensions each is over.

    Every cell must be there once, else nothing is left behind and the job raises; nulls become fill values. A column over fewer
    dimensions than a row has must agree in all rows of a place.
    """
    spark = register_format(df.sparkSession)
    names = list(dims)
    if not isinstance(dims, dict):
        top = df.agg(*[F.max(d).alias(d) for d in names]).first()
        if top[0] is None:
            raise ValueError("no cells to write")
        dims = {d: int(top[d]) + 1 for d in names}
    layout = {"dims": dims, "variables": {k: {"dims": list(v), "attributes": (attributes or {}).get(k, {})} for k, v in variables.items()}}
    shown = df.select(*[F.col(d).cast("int").alias(d) for d in names], *[c for c in variables if c not in names])
    dealt = shown.repartitionByRange(*names[:2]).sortWithinPartitions(*names)
    dealt.write.format(FORMAT).option("layout", json.dumps(layout)).mode("overwrite" if overwrite else "append").save(path)
