"""Large delimited files, read in ranges.

Spark deals a file out by byte ranges of whole lines. Whether a range begins inside a quoted field follows from the
ranges before it: each is scanned once for both cases, and the outcomes are strung together, a few numbers for each
range. Then every range is parsed by itself. A record that goes on in later ranges is put together from their
beginnings, and records are numbered by what the ranges before hold.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..storage import cut
from . import limits, paths

#: Characters by which the delimiter is told, and records handed to Spark at a time.
SAMPLE, BATCH = 4096, 5000


def delimiter_of(text: str) -> str:
    """Sniffed from the first 4096 characters among comma, semicolon, tab and bar; a comma where that fails."""
    try:
        return csv.Sniffer().sniff(text[:SAMPLE], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


class Header:
    """The columns of a file: the last one of each normalized name counts."""

    def __init__(self, names: list[str], required: list[list[str]], kind: str, key_of):
        if not names:
            raise ValueError("CSV sin encabezados (fieldnames vacios)")
        self.size, self.keys = len(names), {key_of(h): k for k, h in enumerate(names)}
        self.last = sorted({h: k for k, h in enumerate(names)}.values())
        missing = [group[0] for group in required if not any(a in self.keys for a in group)]
        if missing:
            raise ValueError(f"CSV {kind} sin columnas requeridas: {', '.join(missing)}")

    def cells(self, record: list[str]) -> tuple[list[tuple[str, str | None]], int] | None:
        """Texts by column and how many cells they count as; None for a record without any text."""
        n = len(record)
        if not any(record[k].strip() for k in self.last if k < n) and not any(x.strip() for x in record[self.size :]):
            return None
        return [(key, record[k] if k < n else None) for key, k in self.keys.items()], len(self.last) + (n > self.size)


def pieces(line: bytes) -> list[bytes]:
    """A line's parts that end in a carriage return of their own, and the rest; with line feed."""
    if b"\r" not in line[:-1]:
        return [line + b"\n"]
    body, end = (line[:-1], b"\r\n") if line.endswith(b"\r") else (line, b"\n")
    *first, last = body.split(b"\r")
    return [*(x + b"\r" for x in first), last + end]


def quoted_after(piece: bytes, quoted: bool, delimiter: bytes) -> bool:
    """Whether a quoted field is open after a piece, by the rules of Python's csv."""
    if b'"' not in piece:
        return quoted
    at, end, first = 0, len(piece), not quoted
    while quoted or at < end:
        if quoted:
            at = piece.find(b'"', at)
            if at < 0:
                return True
            if piece[at + 1 : at + 2] == b'"':
                at += 2
                continue
            at, quoted = at + 1, False
            first = piece[at : at + 1] == delimiter
            at += first
        elif first and piece[at : at + 1] == b'"':
            at, quoted, first = at + 1, True, False
        else:
            at = piece.find(delimiter, at)
            if at < 0:
                return False
            at, first = at + 1, True
    return False


def _blank(piece: bytes) -> bool:
    return not piece.strip(b"\r\n")


def _runs(batches) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(path, range, lines) for each run of rows of one range."""

    def rows():
        for batch in batches:
            yield from zip(batch.column("path").to_pylist(), batch.column("rango").to_pylist(), batch.column("value").to_pylist(), strict=True)

    for (path, start), run in groupby(rows(), key=lambda r: r[:2]):
        yield path, start, (r[2] for r in run)


def _head(lines: Iterator[bytes]) -> tuple[str, list[str]]:
    """Delimiter and names of a file's first record."""
    taken: list[bytes] = []
    size = 0
    for line in lines:
        taken.extend(pieces(line))
        size += len(line) + 1
        if size >= 4 * SAMPLE:
            break
    delimiter = delimiter_of(b"".join(taken).decode("utf-8", "replace"))
    quoted = False
    first: list[bytes] = []
    for piece in (*taken, *(p for line in lines for p in pieces(line))):
        first.append(piece)
        quoted = quoted_after(piece, quoted, delimiter.encode())
        if not quoted:
            break
    return delimiter, next(csv.reader(_text(first), delimiter=delimiter), [])


def _text(found: list[bytes]) -> io.StringIO:
    return io.StringIO(b"".join(found).decode("utf-8", "replace"), newline="")


def raw_table(spark: SparkSession, path: str, kind: str, required: list[list[str]], key_of, cfg: Config, least: int) -> DataFrame:
    """Records of the files over `least` bytes: (archivo, fila, celdas, n, error, nota), written.

    The driver holds a header for each such file and a few numbers for each range of it.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).where(meta["file_size"] > least)
    lines = lines.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("rango"), F.col("value").cast("binary").alias("value"), meta["file_size"].alias("bytes"))
    sizes = {r["path"]: r["bytes"] for r in lines.where("rango = 0").groupBy("path").agg(F.first("bytes").alias("bytes")).collect()}
    lines = lines.drop("bytes")
    most = limits.caps(cfg, "max_tabular_rows", "max_tabular_cells")

    def heads(batches):
        for file, _, run in _runs(batches):
            delimiter, names = _head(run)
            yield pa.RecordBatch.from_pydict({"path": [file], "delimitador": [delimiter], "nombres": pa.array([names], pa.list_(pa.string()))})

    headers = {r["path"]: (r["delimitador"], r["nombres"]) for r in lines.where("rango = 0").mapInArrow(heads, "path string, delimitador string, nombres array<string>").collect()}

    def scan(batches):
        for file, start, run in _runs(batches):
            delimiter = headers[file][0].encode()
            tracks, size = [[False, 0], [True, 0]], 0
            for piece in (p for line in run for p in pieces(line)):
                size += len(piece)
                blank = _blank(piece)
                for track in tracks:
                    if not track[0] and not blank:
                        track[1] += 1
                    track[0] = quoted_after(piece, track[0], delimiter)
            yield pa.RecordBatch.from_pydict({"path": [file], "rango": pa.array([start], pa.int64()), "pasos": pa.array([[int(x) for t in tracks for x in t]], pa.list_(pa.int64())), "bytes": pa.array([size], pa.int64())})

    ranges = lines.mapInArrow(scan, "path string, rango long, pasos array<long>, bytes long").collect()
    # records that are open where a file ends without a line feed
    ends: dict[str, tuple[int, int]] = {}
    plan: dict[tuple[str, int], tuple[bool, int, int, int]] = {}
    for file, own in groupby(sorted(ranges, key=lambda r: (r["path"], r["rango"])), key=lambda r: r["path"]):
        quoted, before, opened, number, size = False, 0, 0, 0, 0
        for r in own:
            size += r["bytes"]
            # quoted at the start, records before; the range and record that are open
            plan[file, r["rango"]] = (quoted, before, opened, number)
            end, n = r["pasos"][2:] if quoted else r["pasos"][:2]
            before += n
            if end and n:
                opened, number = r["rango"], before - 1
            quoted = bool(end)
        if quoted and size > sizes[file]:
            ends[file] = (opened, number)
    shared = spark.sparkContext.broadcast((headers, plan, ends))
    schema = pa.schema([("archivo", pa.string()), ("fila", pa.int64()), ("celdas", pa.map_(pa.string(), pa.string())), ("n", pa.int64()), ("error", pa.string()), ("nota", pa.string()), ("path", pa.string()), ("de", pa.int64()), ("orden", pa.int64()), ("parte", pa.binary())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def noted(name: str, delimiter: str) -> tuple:
        return (name, 0, [], 0, None, json.dumps({"delimiter": delimiter}, separators=(",", ":")), None, None, None, None)

    def parsed(header: Header, delimiter: str, found: list[bytes], name: str, first: int):
        """Rows of whole records, of which the first is number `first` of the file's records (the header is 0)."""
        k = first
        for record in csv.reader(_text(found), delimiter=delimiter):
            if record:
                if k and (row := header.cells(record)):
                    yield (name, k + 1, row[0], row[1], None, None, None, None, None, None)
                k += 1

    def read(batches):
        headers, plan, _ = shared.value
        for file, start, run in _runs(batches):
            name, (delimiter, names) = paths.relative(path, file, True), headers[file]
            quoted, k, opened, number = plan[file, start]
            counter = limits.Counter(**most)
            try:
                header = Header(names, required, kind, key_of)
            except ValueError as e:
                if start == 0:
                    yield batch_of([(name, 0, [], 0, str(e), None, None, None, None, None), noted(name, delimiter)])
                continue
            rows = [noted(name, delimiter)] if start == 0 else []
            whole: list[bytes] = []
            current: list[bytes] = []
            goes_on, n = quoted, 0

            def counted(found, first, name=name, header=header, delimiter=delimiter, counter=counter):
                for row in parsed(header, delimiter, found, name, first):
                    yield row
                    counter.add(max_tabular_rows=1, max_tabular_cells=row[3])

            try:
                for piece in (p for line in run for p in pieces(line)):
                    current.append(piece)
                    n += not quoted and not _blank(piece)
                    quoted = quoted_after(piece, quoted, delimiter.encode())
                    if quoted:
                        continue
                    if goes_on:
                        rows.append((None, number, None, None, None, None, file, opened, start, b"".join(current)))
                        goes_on = False
                    else:
                        whole.extend(current)
                    current = []
                    if n >= BATCH:
                        rows.extend(counted(whole, k))
                        k, n, whole = k + n, 0, []
                        yield batch_of(rows)
                        rows = []
                rows.extend(counted(whole, k))
            except limits.Exceeded:
                # the file fails by what is counted over all its ranges; this one need not go on
                pass
            except csv.Error as e:
                rows.append((name, 0, [], 0, str(e), None, None, None, None, None))
            else:
                if current:
                    rows.append((None, number if goes_on else k + n - 1, None, None, None, None, file, opened if goes_on else start, start, b"".join(current)))
            if rows:
                yield batch_of(rows)

    def joined(batches):
        headers, _, ends = shared.value
        for batch in batches:
            rows = []
            for file, opened, number, parts in zip(*(batch.column(c).to_pylist() for c in ("path", "de", "fila", "partes")), strict=True):
                found = b"".join(p["parte"] for p in parts)
                if ends.get(file) == (opened, number):
                    found = found[:-1]
                name, (delimiter, names) = paths.relative(path, file, True), headers[file]
                try:
                    rows.extend(parsed(Header(names, required, kind, key_of), delimiter, [found], name, number))
                except csv.Error as e:
                    rows.append((name, 0, [], 0, str(e), None, None, None, None, None))
            if rows:
                yield batch_of(rows)

    ddl = "archivo string, fila long, celdas map<string,string>, n long, error string, nota string, path string, de long, orden long, parte binary"
    kept = ["archivo", "fila", "celdas", "n", "error", "nota"]
    found = cut(lines.mapInArrow(read, ddl))
    # a record that crosses ranges is one group
    crossing = found.where("parte IS NOT NULL").groupBy("path", "de", "fila").agg(F.sort_array(F.collect_list(F.struct("orden", "parte"))).alias("partes"))
    rows = cut(found.where("parte IS NULL").select(kept).unionByName(crossing.select("path", "de", "fila", "partes").mapInArrow(joined, ddl).select(kept)))
    return rows.unionByName(_over(rows, most))


def _over(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """The error of each file that goes over a cap, with the count at which a read in order would have stopped."""
    data = rows.where("n > 0")
    sums = data.groupBy("archivo").agg(F.count("*").alias("filas"), F.sum("n").alias("celdas_"))
    over = sums.where((F.col("filas") > most["max_tabular_rows"]) | (F.col("celdas_") > most["max_tabular_cells"])).select(F.col("archivo").alias("a"))
    order = Window.partitionBy("archivo").orderBy("fila").rowsBetween(Window.unboundedPreceding, 0)
    run = data.join(over, F.col("archivo") == F.col("a"), "left_semi").select("archivo", "fila", F.count("*").over(order).alias("r"), F.sum("n").over(order).alias("c"))
    many = F.col("r") > most["max_tabular_rows"]
    first = run.where(many | (F.col("c") > most["max_tabular_cells"])).groupBy("archivo").agg(F.min(F.struct("fila", "r", "c")).alias("s")).select("archivo", "s.*")
    error = F.when(many, F.concat(F.lit(f"{limits.MARK}max_tabular_rows:"), F.col("r"))).otherwise(F.concat(F.lit(f"{limits.MARK}max_tabular_cells:"), F.col("c")))
    return first.select("archivo", F.lit(0).cast("long").alias("fila"), F.create_map().cast("map<string,string>").alias("celdas"), F.lit(0).cast("long").alias("n"), error.alias("error"), F.lit(None).cast("string").alias("nota"))
