"""XLSX sheets, inflated and parsed as streams.

A task holds a compressed file, the current row, the texts of the sheets' first rows, the places of blank texts, and a
file's shared texts up to HELD bytes. Shared texts beyond that go their own way: as a table of (file, number, text), joined
to the cells by Spark.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..storage import cut
from . import limits, paths, sax

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows handed to Spark at a time.
BATCH = 5000
#: Bytes of a file's shared texts, with what Python adds to each, that a task holds to put them into their cells itself.
HELD, ADDED = 4 * 2**20, 150
#: A cell: its column and its text, or the number of a shared text.
Cell = tuple[int, "str | int"]


def _starts(book: zipfile.ZipFile, part: str) -> Iterator[tuple[str, str, dict]]:
    """(parent, name, attributes) of every element of a part."""
    open_: list[str] = [""]
    found: list[tuple[str, str, dict]] = []

    def start(name, attributes):
        found.append((open_[-1], name, attributes))
        open_.append(name)

    with book.open(part) as stream:
        for _ in sax.feed(stream, start, lambda _: open_.pop(), lambda _: None):
            yield from found
            found.clear()


def shared_texts(book: zipfile.ZipFile) -> Iterator[tuple[int, str]]:
    """Shared texts with their numbers."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return
    done: list[str] = []
    parts: list[str] = []
    inside = [False]

    def start(name, _):
        inside[0] = name == f"{_MAIN}t"
        if name == f"{_MAIN}si":
            parts.clear()

    def end(name):
        inside[0] = False
        if name == f"{_MAIN}si":
            done.append("".join(parts))

    n = 0
    with book.open("xl/sharedStrings.xml") as stream:
        for _ in sax.feed(stream, start, end, lambda t: parts.append(t) if inside[0] else None):
            for text in done:
                yield n, text
                n += 1
            done.clear()


def _column(reference: str | None, place: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return place
    at = 0
    for ch in letters[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _value(kind: str, style: int, text: str, dates: set[int]) -> str | int:
    if kind == "s":
        return int(text)
    if kind == "b":
        return str(text == "1")
    if kind != "n":
        return text
    if style in dates:
        return str((dt.datetime(1899, 12, 30) + dt.timedelta(days=float(text))).date())
    return str(int(text)) if re.fullmatch(r"-?\d+", text) else str(float(text))


def sheet_rows(book: zipfile.ZipFile, part: str, dates: set[int]) -> Iterator[tuple[int, list[Cell]]]:
    """Cells of a sheet by row number; dates as yyyy-mm-dd."""
    done: list[tuple[int, list[Cell]]] = []
    row: list = [0, [], 0]
    cell: dict = {}
    texts: list[str] = []
    inside = [""]

    def start(name, a):
        local = name.removeprefix(_MAIN)
        if local == "row":
            row[:] = [int(a.get("r", 0)), [], 0]
        elif local == "c":
            cell.update(at=_column(a.get("r"), row[2]), kind=a.get("t", "n"), style=int(a.get("s", 0)))
            row[2] += 1
            texts.clear()
        inside[0] = local

    def end(name):
        local, inside[0] = name.removeprefix(_MAIN), ""
        if local == "c":
            if cell["kind"] == "inlineStr":
                row[1].append((cell["at"], "".join(texts)))
            elif texts:
                row[1].append((cell["at"], _value(cell["kind"], cell["style"], "".join(texts), dates)))
        elif local == "row":
            done.append((row[0], row[1]))

    def text(t):
        # v holds a value, t a text of an inline string
        if inside[0] == ("t" if cell.get("kind") == "inlineStr" else "v"):
            texts.append(t)

    with book.open(part) as stream:
        for _ in sax.feed(stream, start, end, text):
            yield from done
            done.clear()


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells that show dates."""
    own: dict[int, str] = {}
    formats: list[int] = []
    if "xl/styles.xml" in book.namelist():
        for parent, name, a in _starts(book, "xl/styles.xml"):
            if name == f"{_MAIN}numFmt":
                own[int(a["numFmtId"])] = re.sub(r'"[^"]*"|\[[^\]]*\]', "", a.get("formatCode", "")).lower()
            elif (parent, name) == (f"{_MAIN}cellXfs", f"{_MAIN}xf"):
                formats.append(int(a.get("numFmtId", 0)))
    return {i for i, f in enumerate(formats) if 14 <= f <= 22 or 27 <= f <= 36 or 50 <= f <= 58 or re.search("[dy]|m(?!m?:)", own.get(f, ""))}


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    targets = {a["Id"]: a["Target"] for _, _, a in _starts(book, "xl/_rels/workbook.xml.rels") if "Id" in a and "Target" in a}
    found = [(a.get("name"), targets[a[f"{_REL}id"]]) for _, name, a in _starts(book, "xl/workbook.xml") if name == f"{_MAIN}sheet"]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found]


def _text(value: str | int, texts: dict[int, str]) -> str:
    return texts[value] if isinstance(value, int) else value


def records(content: bytes, required: list[list[str]], kind: str, key_of, note: dict, most_texts: int, room: int = HELD):
    """What the first sheet holds whose first row has every required column.

    Shared texts that find no room come first, as (number, text); then records as (row number, texts by header, numbers of
    such texts by header, cells counted). Rows without any text are left out.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    dates, heads = date_styles(book), []
    for name, part in sheets(book):
        first = next(sheet_rows(book, part, dates), None)
        heads.append((name, part, first[1] if first and first[0] == 1 else None))
    wanted = {v for _, _, cells in heads for _, v in cells or () if isinstance(v, int)}
    known: dict[int, str] = {}
    held: dict[int, str] = {}
    blank: set[int] = set()
    for number, text in shared_texts(book):
        if number >= most_texts:
            raise limits.Exceeded("max_tabular_cells", number + 1)
        if number in wanted:
            known[number] = text
        if not text.strip():
            blank.add(number)
        if (room := room - 4 * len(text) - ADDED) >= 0:
            held[number] = text
        else:
            yield number, text
    for name, part, cells in heads:
        keys = {key_of(t): at for at, v in cells or () if key_of(t := _text(v, known))}
        if cells is None or not all(any(a in keys for a in group) for group in required):
            continue
        note["hoja"] = name
        rows = sheet_rows(book, part, dates)
        next(rows)
        for k, cells_ in rows:
            row = dict(cells_)
            if any(v not in blank if isinstance(v, int) else v.strip() for v in row.values()):
                own = {key: held.get(v, v) if isinstance(v := row.get(at), int) else v for key, at in keys.items()}
                yield k, {key: v for key, v in own.items() if not isinstance(v, int)}, {key: v for key, v in own.items() if isinstance(v, int)}, len(cells)
        return
    raise ValueError(f"XLSX {kind} sin hoja con columnas requeridas: {', '.join(g[0] for g in required)}")


def raw_table(files: DataFrame, root: str, kind: str, required: list[list[str]], key_of, cfg: Config, room: int = HELD) -> DataFrame:
    """Records of workbooks, (path, content): (archivo, fila, celdas, n, error, nota), parsed once and written."""
    most = limits.caps(cfg, "max_tabular_rows", "max_tabular_cells")
    texts = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("archivo", pa.string()), ("fila", pa.int64()), ("celdas", texts), ("cifras", pa.map_(pa.string(), pa.int64())), ("n", pa.int64()), ("error", pa.string()), ("nota", pa.string()), ("cifra", pa.int64()), ("texto", pa.string())])

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, note, counter = paths.relative(root, file), {}, limits.Counter(**most)
                rows: list[tuple] = []
                try:
                    for found in records(content.as_py(), required, kind, key_of, note, most["max_tabular_cells"], room):
                        if len(found) == 2:
                            rows.append((name, None, None, None, None, None, None, *found))
                        else:
                            k, cells, numbers, n = found
                            counter.add(max_tabular_rows=1, max_tabular_cells=n)
                            rows.append((name, k, list(cells.items()), list(numbers.items()), n, None, None, None, None))
                        if len(rows) == BATCH:
                            yield batch_of(rows)
                            rows = []
                except Exception as e:
                    rows.append((name, 0, [], [], 0, str(e) or type(e).__name__, None, None, None))
                if note:
                    rows.append((name, 0, [], [], 0, None, json.dumps(note, separators=(",", ":")), None, None))
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "archivo string, fila long, celdas map<string,string>, cifras map<string,long>, n long, error string, nota string, cifra long, texto string"
    both = cut(files.select("path", "content").mapInArrow(read, ddl))
    kept = ["archivo", "fila", "celdas", "n", "error", "nota"]
    named = both.where("cifra IS NOT NULL").select(F.col("archivo").alias("de"), "cifra", "texto")
    rows = both.where("cifra IS NULL")
    if named.isEmpty():
        return rows.select(kept)
    asks = rows.where(F.size("cifras") > 0).select("archivo", "fila", "celdas", "n", F.explode("cifras").alias("clave", "numero"))
    told = asks.join(named, (F.col("archivo") == F.col("de")) & (F.col("numero") == F.col("cifra")), "left")
    told = told.groupBy("archivo", "fila").agg(F.first("celdas").alias("celdas"), F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("clave", "texto"))).alias("mas"))
    none = F.lit(None).cast("string")
    told = told.select("archivo", "fila", F.map_concat("celdas", "mas").alias("celdas"), "n", none.alias("error"), none.alias("nota"))
    return cut(rows.where(F.size("cifras") == 0).select(kept).unionByName(told))
