"""Matrix folders: raw arrays by rows, read in row ranges.

A folder holds ``manifest.json`` and, for each part of consecutive rows, little-endian arrays. Layout ``rows`` (compressed sparse rows):
``NAME.indptr`` (int64, rows + 1 places in the part's own arrays), ``NAME.indices`` (int32 columns) and ``NAME.data`` (float32). Layout ``dense``:
``NAME.data`` alone (float32, row after row). The manifest has ``layout``, ``n_rows``, ``n_cols`` and ``parts``: name, first_row,
rows, nnz. Beside these may lie the tables ``cells`` (row, context, pert, ...) and ``genes`` (col, gene) as Parquet.

``spark.read.format("matrix")`` gives one record a row: (row long, cols array<int>, vals array<float>), entries that are not zero. Row ranges of some ``entries`` stored values are planned from
the manifest alone; ranges of small parts that follow each other share a partition. Comparisons on ``row`` are pushed
into the scan (``spark.sql.python.filterPushdown.enabled``): parts they rule out are not opened, and of those that stay only the wanted rows' bytes are
read, neighbours in one piece. A column-major folder is refused when the read is planned. Files are reached through pyarrow's file systems, so the folder may lie in any
store that these know.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from screenloom.operators.ordered import places
from screenloom.sources.shared import materialised
from screenloom.sources.sinks import exists

ENTRIES = 1 << 22
#: A partition is a Python task: beyond these, partitions of less than ENTRIES values take more values instead of becoming more.
MOST_PARTITIONS = 256
#: Rows that one task writes, as one part or several.
TASK_ROWS = 1 << 16
BATCH_ROWS = 4096
SCHEMA = "row long, cols array<int>, vals array<float>"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict:
    fs, at = file_system(path)
    with fs.open_input_file(f"{at}/manifest.json") as f:
        found = json.loads(f.read())
    if found.get("layout") not in ("rows", "dense"):
        raise ValueError(f"layout {found.get('layout')!r} of {path}: only rows and dense can be read by rows; convert a column-major matrix first")
    return found


@dataclass
class Rows(InputPartition):
    """Row ranges of parts: (part, first, end) in the part's own rows."""

    ranges: list[tuple[dict, int, int]]


def planned(parts: Sequence[dict], low: int, high: int, entries: int) -> list[list[tuple[dict, int, int]]]:
    """Partitions of the rows low .. high: large parts are cut evenly by their rows, neighbouring small pieces stand together.

    Some ``entries`` values each; where that made more than MOST_PARTITIONS, as many more as it takes, up to ENTRIES.
    """
    wanted = [(p, max(0, low - p["first_row"]), min(p["rows"], high - p["first_row"]), max(1.0, p["nnz"] / max(1, p["rows"]))) for p in sorted(parts, key=lambda p: p["first_row"])]
    values = sum(max(0, end - first) * weight for _, first, end, weight in wanted)
    entries = max(entries, min(ENTRIES, math.ceil(values / MOST_PARTITIONS)))
    out: list[list[tuple[dict, int, int]]] = []
    room = 0.0
    for part, first, end, weight in wanted:
        if first >= end:
            continue
        pieces = max(1, math.ceil((end - first) * weight / entries))
        cuts = [first + (end - first) * i // pieces for i in range(pieces + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            cost = (b - a) * weight
            if out and cost <= room:
                out[-1].append((part, a, b))
                room -= cost
            else:
                out.append([(part, a, b)])
                room = entries - cost
    return out


def spans(rows: np.ndarray) -> list[tuple[int, int]]:
    """Ascending distinct rows as runs [first, end) of neighbours."""
    if not len(rows):
        return []
    breaks = np.flatnonzero(np.diff(rows) != 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(rows, breaks)]


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, entries: int) -> None:
        self.path, self.entries = path, entries
        self.manifest = read_manifest(path)
        self.low, self.high, self.only = 0, int(self.manifest["n_rows"]), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or not isinstance(value, (int, tuple)) or isinstance(value, bool):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else {v for v in value if v is not None}
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> Sequence[Rows]:
        low, high = self.low, self.high
        if self.only is not None:
            kept = [r for r in self.only if low <= r < high]
            low, high = (min(kept), max(kept) + 1) if kept else (0, 0)
        return [Rows(r) for r in planned(self.manifest["parts"], low, high, self.entries)] or [Rows([])]

    def __getstate__(self) -> dict:
        """What tasks need: each has its own parts in its partition, and not those of the whole folder."""
        return self.__dict__ | {"manifest": {k: v for k, v in self.manifest.items() if k != "parts"}}

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(self.path)
        for part, first, end in partition.ranges:
            own = np.arange(first, end)
            if self.only is not None:
                wanted = np.array(sorted(r - part["first_row"] for r in self.only), dtype=np.int64)
                own = wanted[(wanted >= first) & (wanted < end)]
            for a, b in spans(own):
                for x in range(a, b, BATCH_ROWS):
                    yield self._batch(fs, f"{at}/{part['name']}", part, x, min(b, x + BATCH_ROWS))

    def _array(self, fs: pafs.FileSystem, name: str, kind: str, first: int, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        with fs.open_input_file(name) as f:
            got = f.read_at(count * size, first * size)
        if len(got) != count * size:
            raise ValueError(f"{name} ends before entry {first + count}")
        return np.frombuffer(got, dtype=kind)

    def _batch(self, fs: pafs.FileSystem, name: str, part: dict, a: int, b: int) -> pa.RecordBatch:
        width = int(self.manifest["n_cols"])
        if self.manifest["layout"] == "dense":
            table = self._array(fs, f"{name}.data", "<f4", a * width, (b - a) * width).reshape(b - a, width)
            row, cols = np.nonzero(table)
            vals, ends = table[row, cols], np.cumsum(np.bincount(row, minlength=b - a))
        else:
            places = self._array(fs, f"{name}.indptr", "<i8", a, b - a + 1)
            cols = self._array(fs, f"{name}.indices", "<i4", int(places[0]), int(places[-1] - places[0]))
            vals = self._array(fs, f"{name}.data", "<f4", int(places[0]), int(places[-1] - places[0]))
            ends = places[1:] - places[0]
            if (np.diff(places) < 0).any() or len(cols) and (cols.min() < 0 or cols.max() >= width):
                raise ValueError(f"{name}: places or columns out of order in rows {a} to {b}")
            if not vals.all():  # stored zeros
                before = np.concatenate([[0], np.cumsum(vals != 0)])
                cols, vals, ends = cols[vals != 0], vals[vals != 0], before[ends]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (cols.astype(np.int32), vals.astype(np.float32))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int64) + part["first_row"]), *lists], names=["row", "cols", "vals"])


class MatrixSource(DataSource):
    """``spark.read.format("matrix").option("entries", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("entries", ENTRIES)))


def read_matrix(spark: SparkSession, path: str, entries: int = ENTRIES) -> DataFrame:
    """(row, cols, vals) of a matrix folder; filters on ``row`` reach the scan."""
    read_manifest(path)  # what can't be read is refused here, before any plan
    spark.dataSource.register(MatrixSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("matrix").option("entries", str(entries)).load(path)


def read_screen(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(cells, counts, genes) of an input folder: a matrix folder, or the tables ``cells`` and ``counts`` and perhaps ``genes`` themselves.

    A cell of a matrix folder is known by its row. ``genes`` has (gene, file_ord, pos).
    """
    if exists(spark, f"{path}/manifest.json"):
        genes = spark.read.parquet(f"{path}/genes")
        entries = read_matrix(spark, path).select(F.col("row").alias("cell_id"), F.explode(F.arrays_zip("cols", "vals")).alias("e"))
        counts = entries.select("cell_id", F.col("e.cols").alias("col"), F.col("e.vals").alias("value")).join(genes.select("col", "gene"), "col").select("cell_id", "gene", "value")
        cells = spark.read.parquet(f"{path}/cells")
        return cells.select(F.col("row").alias("cell_id"), *[c for c in cells.columns if c not in ("row", "cell_id")]), counts, genes.select("gene", F.lit(0).alias("file_ord"), F.col("col").alias("pos"))
    genes = spark.read.parquet(f"{path}/genes") if exists(spark, f"{path}/genes") else None
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/counts"), genes


# --- writing ----------------------------------------------------------------------------------------


def matrix_rows(cells: DataFrame, counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(row, cols, vals) and the cells' columns: cells numbered by ``cell_id``, entries in the order of ``genes`` (gene, col)."""
    numbered = places(materialised(cells), ["cell_id"], name="row")  # counted, sampled and dealt: three reads
    entries = counts.join(genes.select("gene", "col"), "gene").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("value").cast("float").alias("value")))).alias("e"))
    joined = numbered.join(entries, "cell_id", "left")
    kinds = {"cols": "array<int>", "vals": "array<float>"}
    told = {n: F.coalesce(F.col(f"e.{c}"), F.array().cast(kinds[n])) for n, c in (("cols", "col"), ("vals", "value"))}
    return joined.withColumns(told).drop("e")


def write_matrix(rows: DataFrame, path: str, n_cols: int, layout: str = "rows", part_rows: int = 1 << 16) -> dict:
    """Write (row, cols, vals), rows numbered from 0 without gaps, as a matrix folder; its manifest, which comes last.

    Each ``part_rows`` rows are one part, known by the row's number alone. It is written by one task under a name of its own and moved
    into place when whole, so that a repeated task leaves the same files. Tasks are dealt some TASK_ROWS rows, or one part.
    """
    if layout not in ("rows", "dense"):
        raise ValueError(f"unknown layout: {layout}")

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = []
        tables = [b for b in it if b.num_rows]
        if tables:
            table = pa.Table.from_batches(tables)
            row = table["row"].to_numpy()
            if (np.diff(row) != 1).any():
                raise ValueError(f"rows are not numbered without gaps from {row[0]} to {row[-1]}")
            lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(table["cols"]).to_numpy())]).astype("<i8")
            flat = [table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("cols", "vals")]
            name = f"part-{row[0]:012d}"
            fs, at = file_system(path)
            fs.create_dir(at, recursive=True)
            if layout == "dense":
                full = np.zeros((len(row), n_cols), dtype="<f4")
                full[np.repeat(np.arange(len(row)), np.diff(lengths)), flat[0]] = flat[1]
                files = {"data": full}
            else:
                files = {"indptr": lengths, "indices": flat[0].astype("<i4"), "data": flat[1].astype("<f4")}
            for kind, values in files.items():
                with fs.open_output_stream(f"{at}/.{name}.{kind}.{id(values)}") as out:
                    out.write(values.tobytes())
                fs.move(f"{at}/.{name}.{kind}.{id(values)}", f"{at}/{name}.{kind}")
            told.append((name, int(row[0]), len(row), int(lengths[-1])))
        columns = list(zip(*told, strict=True)) if told else [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["name", "first_row", "rows", "nnz"])

    dealt = rows.select("row", "cols", "vals", F.call_function("div", F.col("row"), F.lit(part_rows)).alias("_part"))
    tasks = max(1, -(-dealt.count() // max(part_rows, TASK_ROWS)))
    ordered = dealt.repartition(tasks, "_part").sortWithinPartitions("row")

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may hold several ranges; each is a part of its own
        held: list[pa.RecordBatch] = []
        now = None
        for batch in it:
            number = batch.column("_part").to_numpy()
            for piece in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if len(piece):
                    if now is not None and number[piece[0]] != now:
                        yield from save(iter(held))
                        held = []
                    now = number[piece[0]]
                    held.append(batch.slice(int(piece[0]), len(piece)).select(["row", "cols", "vals"]))
        yield from save(iter(held))

    parts = ordered.mapInArrow(each, "name string, first_row long, rows long, nnz long").collect()  # a row for each part
    found = sorted((p.asDict() for p in parts), key=lambda p: p["first_row"])
    n_rows, at_row = sum(p["rows"] for p in found), 0
    for p in found:
        if p["first_row"] != at_row:
            raise ValueError(f"rows are not numbered without gaps: {at_row} is missing")
        at_row += p["rows"]
    manifest = {"layout": layout, "n_rows": n_rows, "n_cols": n_cols, "parts": found}
    fs, at = file_system(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps(manifest, sort_keys=True).encode())
    return manifest


def write_screen(cells: DataFrame, counts: DataFrame, genes: DataFrame, path: str, layout: str = "rows", part_rows: int = 1 << 16) -> dict:
    """Cells, counts and genes (gene, col) as a matrix folder with its tables; the manifest comes last."""
    rows = materialised(matrix_rows(cells, counts, genes))
    genes.select(F.col("col").cast("int").alias("col"), "gene").write.parquet(f"{path}/genes")
    rows.drop("cols", "vals").write.parquet(f"{path}/cells")
    return write_matrix(rows, path, genes.count(), layout, part_rows)
