"""Dictionary archives: ZIP files of positional JSON arrays, read into typed rows.

Archives are read as parts: a row for the text of an index, a row without a text for each bank that there is, and a row for
each element of its array. Banks are decompressed and cut as a stream, so neither an archive nor a bank has to fit in a task.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossmill.functions import structured
from glossmill.functions.text import nonblank
from glossmill.sources.elements import NotAnArray, elements

PART = "path string, ord int, member string, kind string, pos long, text string, error string"
UNTITLED = "Unknown Dictionary"
#: Bytes that are read at once, rows and bytes of their texts that are handed on together, and the longest element: what a
#: variant can hold.
CHUNK, ROWS, BATCH, LONGEST = 1 << 20, 8192, 2 << 20, 128 << 20
#: Bytes of members, as they are when decompressed, that a task reads together; a larger member is a task of its own.
TASK = 32 << 20
#: pos of the row that says that there is a bank, and of the row that tells an error.
HEAD = -1

_SCHEMA = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("member", pa.string()), ("kind", pa.string()), ("pos", pa.int64()), ("text", pa.string()), ("error", pa.string())])


def kind_of(member: str) -> str | None:
    if member.endswith("index.json"):
        return "index"
    if not member.endswith(".json"):
        return None
    return "terms" if "term_bank_" in member else "meta" if "term_meta_bank_" in member else None


def _parts(path: str, ord_: int, member: str, chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The rows of one member. A damaged one ends with a row that has an error; rows before it count for nothing then."""
    kind, pos = kind_of(member), 0
    try:
        if kind == "index":
            yield path, ord_, member, kind, 0, b"".join(chunks).decode("utf-8", "replace"), None
            return
        yield path, ord_, member, kind, HEAD, None, None
        for raw in elements(chunks) if kind else ():
            if len(raw) > LONGEST:
                raise NotAnArray(f"element {pos} has more than {LONGEST} bytes")
            yield path, ord_, member, kind, pos, raw.decode("utf-8", "replace"), None
            pos += 1
    except (NotAnArray, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:  # damaged, unknown method, encrypted
        yield path, ord_, member, None, HEAD, None, str(e) or type(e).__name__


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or "")
        if len(held) >= ROWS or size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _chunks(file, info: zipfile.ZipInfo) -> Iterator[bytes]:
    """The bytes of a member, as they are decompressed; its place, size and checksum are those of the central directory."""
    if info.flag_bits & 1:
        raise zipfile.BadZipFile("encrypted")
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"compression method {info.compress_type}")
    file.seek(info.header_offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins at its place")
    file.seek(sum(struct.unpack("<HH", header[26:30])), os.SEEK_CUR)
    inflate = zlib.decompressobj(-15) if info.compress_type == zipfile.ZIP_DEFLATED else None
    left, check, size = info.compress_size, 0, 0
    while left:
        raw = file.read(min(CHUNK, left))
        if not raw:
            raise EOFError("the file ends within the member")
        left -= len(raw)
        while raw:
            out = inflate.decompress(raw, CHUNK) if inflate else raw
            raw = inflate.unconsumed_tail if inflate else b""
            check, size = zlib.crc32(out, check), size + len(out)
            yield out
    out = inflate.flush() if inflate else b""
    if zlib.crc32(out, check) != info.CRC or size + len(out) != info.file_size:
        raise zipfile.BadZipFile("wrong checksum")
    yield out


def _directory(file) -> list[zipfile.ZipInfo]:
    """The members of an archive by its central directory."""
    try:
        return zipfile.ZipFile(file).infolist()
    except ValueError as e:  # of pyarrow, for a file that is shorter than any archive
        raise zipfile.BadZipFile("File is not a zip file") from e


def _of_archive(path: str, file) -> Iterator[tuple]:
    try:
        listed = _directory(file)
    except (zipfile.BadZipFile, OSError) as e:
        yield path, HEAD, None, None, HEAD, None, str(e)
        return
    for ord_, info in enumerate(listed):
        if not info.is_dir() and info.filename.endswith(".json"):
            yield from _parts(path, ord_, info.filename, _chunks(file, info))


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield from _batches(_of_archive(path.as_py(), io.BytesIO(content.as_buffer())))


def members(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all archives at a path that Spark can read, up to 2 GiB an archive, which one task reads as a whole."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzipped(files: DataFrame) -> DataFrame:
    """Parts of files(path, content)."""
    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(_unzip, PART)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, ord_, member, text, error in zip(*(batch.column(k) for k in range(5)), strict=True):
                if error.as_py() is not None or text.as_py() is None or member.as_py() is None:
                    yield path.as_py(), ord_.as_py(), member.as_py(), None, HEAD, None, error.as_py()
                    continue
                whole = memoryview(text.as_buffer())
                yield from _parts(path.as_py(), ord_.as_py(), member.as_py(), (bytes(whole[k : k + CHUNK]) for k in range(0, len(whole), CHUNK)))

    yield from _batches(rows())


def parts(rows: DataFrame) -> DataFrame:
    """Parts from rows that are parts already, or from members(path, ord, member, text, error), an error being optional."""
    if "pos" in rows.columns:
        return rows
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.select("path", F.col("ord").cast("int").alias("ord"), "member", "text", error.alias("error")).mapInArrow(_cut, PART)


class _Members(InputPartition):
    """What a task reads: (path, place, what the central directory says of it, or an error)."""

    def __init__(self, members: list[tuple[str, int, tuple | None, str | None]]):
        self.members = members


_INFO = ("filename", "header_offset", "compress_size", "file_size", "CRC", "compress_type", "flag_bits")


def _file_system(path: str):
    """(file system, path in it) of a path or URI that pyarrow knows: local, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    elif path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that the pattern of its last part matches."""
    from pyarrow import fs

    system, inner = _file_system(path)
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch(f.base_name, last))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [inner] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[InputPartition]:
        """A task a member, small ones together, from the central directories: the tails of the files are all that is read here."""
        system, _ = _file_system(self.path)
        found: list[tuple] = []
        for path in _listed(self.path):
            try:
                with system.open_input_file(path) as file:
                    listed = _directory(file)
            except (zipfile.BadZipFile, OSError) as e:
                found.append((path, HEAD, None, str(e)))
                continue
            found += [(path, k, tuple(getattr(i, name) for name in _INFO), None) for k, i in enumerate(listed) if not i.is_dir() and i.filename.endswith(".json")]
        tasks: list[list[tuple]] = []
        size = 0
        for member in found:
            own = member[2][_INFO.index("file_size")] if member[2] else 0
            if not tasks or size + own > self.task_bytes:
                tasks.append([])
                size = 0
            tasks[-1].append(member)
            size += own
        return [_Members(t) for t in tasks]

    def _rows(self, members: list[tuple]) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for path, ord_, told, error in members:
            if told is None:
                yield path, HEAD, None, None, HEAD, None, error
                continue
            info = zipfile.ZipInfo()
            for name, value in zip(_INFO, told, strict=True):
                setattr(info, name, value)
            with system.open_input_file(path) as file:
                yield from _parts(path, ord_, info.filename, _chunks(file, info))

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        yield from _batches(self._rows(partition.members))


class DictionaryArchives(DataSource):
    """spark.read.format("dictionary_archive").load(path): the parts of archives, members of any size.

    A task reads one member, or several of `taskBytes` bytes together (uncompressed, 32 MiB unless the option says otherwise).
    The path is a file, a folder or a pattern in a store that pyarrow reads; members() reads from any store that Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "dictionary_archive"

    def schema(self) -> str:
        return PART

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("taskBytes", TASK)))


def _zipped(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _file_system(folder)
        path, out, archive, n = None, None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out is not None:
                archive.close()
                out.close()
                system.move(f"{inner}/.{path}.{token}", f"{inner}/{path}")
                out = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "members"])

        token = uuid.uuid4().hex
        for batch in batches:
            for to, member, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if to.as_py() != path or out is None:
                    yield from close()
                    path, n = to.as_py(), 0
                    out = system.open_output_stream(f"{inner}/.{path}.{token}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(member.as_py(), text.as_buffer().to_pybytes())
                n += 1
        yield from close()

    return write


def write(members: DataFrame, folder: str) -> DataFrame:
    """Writes members(path, ord, member, text) as archives below a folder that all tasks reach; (path, members) of each, once read.

    path is a file's name. A file appears as a whole when it is done, and a task that runs again replaces it by the same one.
    """
    system, inner = _file_system(folder)
    system.create_dir(inner, recursive=True)
    rows = members.filter("text is not null").select("path", "member", "text", "ord").repartition("path").sortWithinPartitions("path", "ord")
    return rows.select("path", "member", "text").mapInArrow(_zipped(folder), "path string, members long")


def streamed(spark: SparkSession, path: str, task_bytes: int | None = None) -> DataFrame:
    """Parts of all archives at a path, by the data source: archives and members may have any size."""
    spark.dataSource.register(DictionaryArchives)
    return spark.read.format(DictionaryArchives.name()).option("taskBytes", task_bytes or TASK).load(path)


def member_kind(member: Column) -> Column:
    return F.when(member.endswith("index.json"), "index").when(member.contains("term_bank_") & member.endswith(".json"), "terms").when(member.contains("term_meta_bank_") & member.endswith(".json"), "meta")


def parsed(rows: DataFrame) -> DataFrame:
    """parts() with the elements of banks as variants, v. Store it: everything below reads it more than once."""
    element = (F.col("pos") >= 0) & F.col("kind").isin("terms", "meta")
    return parts(rows).withColumn("v", F.when(element, F.try_parse_json("text")))


def errors(rows: DataFrame) -> DataFrame:
    """(path, ord, member, error): what cannot be read, one row each: files, members, and members with an element that is no JSON."""
    known = _with_variants(rows)
    broken = known.filter("error is not null").select("path", "ord", "member", "error")
    bad = known.filter("pos >= 0 and kind in ('terms', 'meta') and v is null").groupBy("path", "ord", "member").agg(F.min("pos").alias("pos"))
    return broken.unionByName(bad.select("path", "ord", "member", F.format_string("element %d is no JSON", "pos").alias("error"))).groupBy("path", "ord", "member").agg(F.min("error").alias("error"))


def _with_variants(rows: DataFrame) -> DataFrame:
    return rows if "v" in rows.columns else parsed(rows)


def readable(rows: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """The parts of members that are read as a whole, without the column of errors, and rows without kind for the others.

    wrong is errors(rows), if it is stored already.
    """
    known = _with_variants(rows)
    bad = (errors(known) if wrong is None else wrong).select("path", "ord", "member")
    kept = ["path", "ord", "member", "kind", "pos", "text", "v"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("pos", "long"), ("text", "string"), ("v", "variant"))]
    return known.join(bad.select("path", "ord"), ["path", "ord"], "left_anti").select(*kept).unionByName(bad.select("path", "ord", "member", *none))


def index(rows: DataFrame) -> DataFrame:
    """(path, title, version, revision, meta_only) of each archive that can be opened; the last index counts."""
    last = F.max_by(F.when(F.col("kind") == "index", F.col("text")), F.when(F.col("kind") == "index", F.col("ord")))
    found = _readable_once(rows).filter(F.col("member").isNotNull()).groupBy("path").agg(last.alias("text"), F.coalesce(F.bool_or(F.col("kind") == "meta"), F.lit(False)).alias("meta"), F.coalesce(F.bool_or(F.col("kind") == "terms"), F.lit(False)).alias("terms"))
    field = lambda name: F.get_json_object("text", f"$.{name}")
    return found.select("path", F.coalesce(field("title"), F.lit(UNTITLED)).alias("title"), F.coalesce(field("format"), field("version"), F.lit("3")).alias("version"), F.coalesce(field("revision"), F.lit("")).alias("revision"), (F.col("meta") & ~F.col("terms")).alias("meta_only"))


def _readable_once(rows: DataFrame) -> DataFrame:
    return rows if "v" in rows.columns and "error" not in rows.columns else readable(rows)


def _elements(rows: DataFrame, kind: str) -> DataFrame:
    """The elements of the members of a kind that are arrays themselves."""
    return _readable_once(rows).filter((F.col("kind") == kind) & (F.col("pos") >= 0) & F.schema_of_variant("v").startswith("ARRAY")).select("path", "ord", "pos", "v")


def _item(k: int) -> Column:
    return F.to_json(F.try_variant_get("v", f"$[{k}]", "variant"))


def _text(k: int, null_as_text: bool = False) -> Column:
    """Element k as text: the parts of a list are joined by ", ", an object is its JSON; a JSON null (unless it is to be "null") or nothing is empty."""
    listed = F.array_join(F.try_variant_get("v", f"$[{k}]", "array<string>"), ", ")
    null = F.when(F.is_variant_null(F.try_variant_get("v", f"$[{k}]", "variant")), "null") if null_as_text else F.lit(None).cast("string")
    return F.coalesce(null, listed, F.try_variant_get("v", f"$[{k}]", "string"), F.lit(""))


def terms(rows: DataFrame, null_as_text: bool = False) -> DataFrame:
    """Entries of term banks, in the order of members and elements; short and blank ones are dropped. ids are not set here."""
    found = _elements(rows, "terms").filter(F.try_variant_get("v", "$[5]", "variant").isNotNull())
    found = found.select("path", "ord", "pos", _text(0).alias("expression"), _text(1).alias("given"), _text(2, null_as_text).alias("tags"), structured.definitions(_item(5)).alias("definitions"), F.coalesce(F.try_variant_get("v", "$[6]", "int"), F.lit(0)).alias("sequence_number"), _text(7, null_as_text).alias("more_tags"))
    found = found.filter(nonblank(F.col("expression")) | nonblank(F.col("given")))
    reading = F.when(nonblank(F.col("given")), F.col("given")).otherwise(F.col("expression"))
    pos = F.concat_ws(", ", F.when(nonblank(F.col("tags")), F.col("tags")), F.when(nonblank(F.col("more_tags")), F.col("more_tags")))
    titles = index(rows).select("path", F.col("title").alias("dictionary_name"))
    return found.join(titles, "path").select("path", "ord", "pos", "expression", reading.alias("reading"), "definitions", F.lit(0).alias("frequency"), F.lit("").alias("pitch_accent"), pos.alias("parts_of_speech"), "dictionary_name", "sequence_number")


def usable_meta(rows: DataFrame) -> DataFrame:
    """(path, ord, pos, expression, type, frequency, pitch): the ranks and accents that say something. Store it: meta() and meta_counts() both read it."""
    if "pitch" in rows.columns:
        return rows
    found = _elements(rows, "meta").filter(F.try_variant_get("v", "$[2]", "variant").isNotNull())
    found = found.select("path", "ord", "pos", _text(0).alias("expression"), _text(1).alias("type"), _item(2).alias("payload")).filter(F.col("type").isin("freq", "pitch"))
    found = found.withColumns({"frequency": F.when(F.col("type") == "freq", structured.frequency("payload")), "pitch": F.when(F.col("type") == "pitch", structured.pitch("payload"))})
    return found.filter((F.col("frequency") > 0) | nonblank(F.col("pitch"))).drop("payload")


def meta_counts(rows: DataFrame) -> DataFrame:
    """(path, n): how many expressions' ranks and how many expressions' accents each archive sets."""
    return usable_meta(rows).groupBy("path").agg(F.count_distinct("expression", "type").alias("n"))


def meta(rows: DataFrame) -> DataFrame:
    """(expression, type, frequency, pitch): for each expression and type the last usable payload in member and element order."""
    at = F.struct("path", "ord", "pos")
    return usable_meta(rows).groupBy("expression", "type").agg(F.max_by("frequency", at).alias("frequency"), F.max_by("pitch", at).alias("pitch"))
