"""Text and Parquet files opened inside tasks: headers from the first block, rows as a stream, nothing on the driver.

A table of files (path, start, end) goes in. Each task opens its files by itself, with pyarrow's file systems, reads the
header from a bounded first block and streams the rows under it. What happened to a file comes out as one more row, so
a scan and its report are the same pass.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext

#: Bytes of the first block, and how far it may grow while the header is not complete.
HEADER_BLOCK = 64 << 10
HEADER_LIMIT = 1 << 20
#: Bytes parsed at a time; a single row must fit.
PARSE_BLOCK = 8 << 20
#: Bytes of a piece of a file whose lines can be read apart.
PIECE_BYTES = 64 << 20
#: Rows of small files that are sent on together.
SENT_ROWS = 10_000

OK = "ok"
UNREADABLE = "could not read file"
INCOMPLETE = "last row incomplete"


@lru_cache(maxsize=16)
def _store(scheme: str, host: str) -> pafs.FileSystem:
    if scheme in ("", "file"):
        return pafs.LocalFileSystem()
    return pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it. A store that pyarrow does not know is an error, not an unreadable file."""
    scheme = urlsplit(quote(path, safe="/:@")).scheme
    if scheme in ("", "file"):
        return _store("", ""), "/" + path.removeprefix("file:").lstrip("/")
    host, _, rest = path.split("://", 1)[1].partition("/")
    inside = f"{host}/{rest}" if scheme in ("s3", "s3a", "gs", "gcs", "abfs", "abfss") else f"/{rest}"
    return _store("s3" if scheme == "s3a" else scheme, host), inside


def open_stream(path: str) -> pa.NativeFile:
    """A file from its beginning; gzip is undone."""
    store, inside = locate(path)
    return store.open_input_stream(inside, compression="gzip" if path.endswith(".gz") else None)


def read_header(path: str, sep: str = ",") -> list[str] | None:
    """Names in the first row, found in the first block; None for a file that is empty or has no end to its first row."""
    with open_stream(path) as stream:
        return _header(stream, sep)


def _header(stream, sep: str) -> list[str] | None:
    block = b""
    while len(block) < HEADER_LIMIT:
        more = stream.read(HEADER_BLOCK)
        block += more
        at = -1
        while (at := block.find(b"\n", at + 1)) >= 0:
            if block.count(b'"', 0, at) % 2 == 0:
                return _names(block[:at], sep)
        if not more:
            return _names(block, sep) if block.strip() else None
    return None


def _small(path: str) -> bytes | None:
    """All of a plain file that fits in the first blocks, so that it is opened once."""
    if path.endswith(".gz"):
        return None
    with open_stream(path) as stream:
        content = stream.read(HEADER_LIMIT)
        return content if len(content) < HEADER_LIMIT and not stream.read(1) else None


def _names(row: bytes, sep: str) -> list[str]:
    text = row.decode("utf-8", "replace").lstrip("﻿").rstrip("\r")
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


class Lines(io.RawIOBase):
    """The lines that begin in [start, end) of a file; the last one is given an end if it has none.

    ``tail`` has the last bytes of the file itself, ``quotes`` the number of quotation marks so far.
    """

    def __init__(self, source, start: int = 0, end: int | None = None):
        self.source, self.at, self.end, self.tail, self.over = source, start, end, b"", False
        self.ahead, self.quotes = b"", 0
        if start:
            source.seek(start - 1)
            self._skip_line()

    def readable(self) -> bool:
        return True

    def _skip_line(self) -> None:
        """To the first line that begins at ``start`` or later."""
        self.at -= 1
        while block := self.source.read(1 << 16):
            found = block.find(b"\n")
            if found >= 0:
                self.ahead, self.at = block[found + 1 :], self.at + found + 1
                break
            self.at += len(block)
        self.over = not block or (self.end is not None and self.at >= self.end)

    def read(self, size: int = -1) -> bytes:
        size = size if size and size > 0 else 1 << 20
        out = b""
        # filled up, since the parser wants whole rows in its first block
        while not self.over and len(out) < size:
            block = self.ahead or self.source.read(size - len(out))
            self.ahead = b""
            if not block:
                self.over = True
                return out + (b"\n" if self.tail and not self.tail.endswith(b"\n") else b"")
            if self.end is not None and self.at + len(block) >= self.end:
                stop = block.find(b"\n", max(0, self.end - 1 - self.at))
                if stop >= 0:
                    block, self.over = block[: stop + 1], True
            self.at += len(block)
            self.quotes += block.count(b'"')
            self.tail = (self.tail + block)[-4096:]
            out += block
        return out


def _as_text(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def csv_batches(
    path: str, columns: Sequence[str], start: int = 0, end: int | None = None, sep: str = ",", multi_line: bool = True
) -> Iterator[pa.RecordBatch | str]:
    """Batches of the named columns as text, then the file's status.

    Rows with too few values are filled with nulls, further values are dropped, bytes that are no UTF-8 are replaced. An
    empty value is null, a quoted one is empty text. Where reading breaks, the rows before are kept.
    """
    rows = 0
    try:
        whole = start == 0 and end is None
        content = _small(path) if whole else None
        header = read_header(path, sep) if content is None else _header(io.BytesIO(content), sep)
        if header is None:
            yield UNREADABLE
            return
        lacking = [c for c in columns if c not in header]
        if lacking:
            yield "missing columns: " + ", ".join(lacking)
            return
        # a repeated name gets its place appended, so that the first one keeps the plain name
        names = [c if c not in header[:i] else f"{c}_{i}" for i, c in enumerate(header)]
        ragged: list[str] = []

        def odd(row: pacsv.InvalidRow) -> str:
            ragged.append(row.text)
            return "skip"

        store, inside = locate(path)
        if content is not None:
            source = io.BytesIO(content)
        else:
            source = open_stream(path) if whole else store.open_input_file(inside)
        with source:
            lines = Lines(source, start, end)
            reader = pacsv.open_csv(
                pa.PythonFile(lines, mode="r"),
                pacsv.ReadOptions(column_names=names, skip_rows_after_names=1 if start == 0 else 0, block_size=PARSE_BLOCK, use_threads=False),
                pacsv.ParseOptions(delimiter=sep, newlines_in_values=multi_line, invalid_row_handler=odd),
                pacsv.ConvertOptions(
                    column_types=dict.fromkeys(names, pa.binary()), include_columns=list(columns),
                    strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""],
                ),
            )
            last, places = "", [names.index(c) for c in columns]
            for batch in reader:
                rows += batch.num_rows
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([_as_text(c) for c in batch.columns], names=list(columns))
                if ragged:
                    rows, last = rows + len(ragged), ragged[-1]
                    yield _filled(ragged, places, columns, sep)
                    ragged.clear()
            if ragged:
                rows, last = rows + len(ragged), ragged[-1]
                yield _filled(ragged, places, columns, sep)
            cut = lines.quotes % 2 or last and not lines.tail.endswith((b"\n", b"\r")) and lines.tail.decode("utf-8", "replace").endswith(last[-1000:])
        yield INCOMPLETE if cut else OK
    except StopIteration:
        yield OK
    except (OSError, pa.ArrowException, EOFError) as error:
        if isinstance(error, pa.ArrowInvalid) and "Empty CSV file" in str(error):
            yield OK  # a header and nothing below, or a piece without a line of its own
        else:
            yield f"damaged after {rows} rows" if rows else UNREADABLE


def _filled(texts: list[str], places: list[int], columns: Sequence[str], sep: str) -> pa.RecordBatch:
    """Rows whose number of values is not that of the header."""
    split = [next(csv.reader(io.StringIO(t, newline=""), delimiter=sep), []) for t in texts]
    arrays = [pa.array([(v[p] or None) if p < len(v) else None for v in split], pa.string()) for p in places]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def csv_task(columns: Sequence[str], sep: str = ",", multi_line: bool = True):
    """For ``mapInArrow`` over (path, start, end): rows (_path, _status, columns); each piece ends with its status alone."""
    schema = pa.schema([(n, pa.string()) for n in ("_path", "_status", *columns)])

    def labeled(path: str, found: pa.RecordBatch | str) -> pa.RecordBatch:
        if isinstance(found, str):
            arrays = [pa.array([path]), pa.array([found]), *[pa.nulls(1, pa.string()) for _ in columns]]
        else:
            arrays = [pa.repeat(pa.scalar(path), found.num_rows), pa.nulls(found.num_rows, pa.string()), *found.columns]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in batch.to_pylist():
                for found in csv_batches(piece["path"], columns, piece["start"], piece["end"], sep, multi_line):
                    held.append(labeled(piece["path"], found))
                    rows += held[-1].num_rows
                    if rows >= SENT_ROWS:
                        yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                        held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return run


# --- directories ------------------------------------------------------------------


def _hidden(name: str) -> bool:
    """What Spark's sources take for no data."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def folders_below(path: str) -> list[str]:
    """The directories in a directory, in order; none if it is not there."""
    store, inside = locate(path)
    found = store.get_file_info(pafs.FileSelector(inside, allow_not_found=True))
    return sorted(f"{path}/{f.base_name}" for f in found if f.type == pafs.FileType.Directory)


def list_task(pattern: str):
    """For ``mapInArrow`` over folders: (path, length) of the files in them whose names match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths = [], []
            for folder in batch.column(0).to_pylist():
                store, inside = locate(folder)
                for file in store.get_file_info(pafs.FileSelector(inside, allow_not_found=True)):
                    if file.type == pafs.FileType.File and not _hidden(file.base_name) and fnmatch.fnmatchcase(file.base_name, pattern):
                        paths.append(f"{folder}/{file.base_name}")
                        lengths.append(file.size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    return run


#: Characters that Spark writes as %XX in the name of a partition's directory.
ESCAPED = frozenset([chr(c) for c in range(1, 32)] + list("\"#%'*/:=?\\\x7f{[]^"))


def partition_folder(column: str, value: str | None) -> str:
    """The directory of a value, named as Spark's writers do."""
    if not value:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


def csv_writer(path: str, columns: Sequence[str]):
    """For ``mapInArrow`` over (repo_id, text columns) sorted by repo_id: a CSV file per repository, and how many.

    A task that is run again writes the same files again.
    """
    schema = pa.schema([(c, pa.string()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = locate(path)
        name, number = f"part-{TaskContext.get().partitionId():05d}.csv", 0
        folder, sink, writer = None, None, None
        try:
            for batch in batches:
                runs = pc.run_end_encode(batch.column(0))
                start = 0
                for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    wanted = partition_folder("repo_id", value)
                    if wanted != folder:
                        if writer is not None:
                            writer.close()
                            sink.close()
                        folder, number = wanted, number + 1
                        store.create_dir(f"{inside}/{folder}", recursive=True)
                        sink = store.open_output_stream(f"{inside}/{folder}/{name}")
                        writer = pacsv.CSVWriter(sink, schema)
                    part = [pc.cast(c, pa.string()) for c in batch.columns[1:]]
                    writer.write_batch(pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in part], schema=schema))
                    start = end
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    return run


# --- what is in a file ----------------------------------------------------------


def _describe_csv(path: str, sep: str) -> tuple:
    header, rows, status = read_header(path, sep), 0, UNREADABLE
    if header:
        for found in csv_batches(path, header[:1], sep=sep):
            if isinstance(found, str):
                status = found
            else:
                rows += found.num_rows
    return (None, 0, status, None) if status == UNREADABLE else (len(header), rows, status, None)


def _record(line: bytes) -> dict | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _describe_json(path: str, document_allowed: bool) -> tuple:
    good = bad = 0
    columns, first = None, None
    with open_stream(path) as stream, io.BufferedReader(_Raw(stream)) as lines:
        for line in lines:
            if not line.strip():
                continue
            record = _record(line)
            first = record is not None if first is None else first
            good, bad = good + (record is not None), bad + (record is None)
            if columns is None and record is not None:
                columns = len(record)
    if first is False and document_allowed:
        with open_stream(path) as stream:
            try:
                whole = json.loads(stream.read())
            except ValueError:
                whole = None
        records = whole if isinstance(whole, list) else [whole]
        if records and all(isinstance(r, dict) for r in records):
            return len({k for r in records for k in r}), len(records), OK, True
    if not good:
        return None, 0, UNREADABLE, False
    return columns, good, f"{bad} unreadable lines" if bad else OK, False


class _Raw(io.RawIOBase):
    """A pyarrow stream for Python's line reading."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        block = self.source.read(len(buffer))
        buffer[: len(block)] = block
        return len(block)


def describe(path: str, fmt: str) -> tuple[int | None, int | None, str, bool | None]:
    """(columns, rows, status, whether a JSON file is one document) of one file, from its footer or as a stream."""
    try:
        if fmt == "parquet":
            store, inside = locate(path)
            with store.open_input_file(inside) as file:
                found = pq.ParquetFile(file)
                return len(found.schema_arrow.names), found.metadata.num_rows, OK, None
        if fmt in ("csv", "tsv"):
            return _describe_csv(path, "\t" if fmt == "tsv" else ",")
        if fmt in ("json", "jsonl"):
            return _describe_json(path, fmt == "json")
        return None, None, "no reader", None
    except (OSError, EOFError, pa.ArrowException, UnicodeDecodeError):
        return None, 0, UNREADABLE, None
