"""A sink of notes: cards go to a deck as one export, which is there as a whole or not at all.

df.write.format("note_deck").option("path", folder).option("deck", name).option("export", id).mode("append").save()

Every task writes a file that nobody reads yet and says so to the driver. The driver then finds the deck, or makes it, and names
the files in a small file of the export. An export that is there already adds nothing, so a job can be run again.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from glossmill.operators.cards import FIELDS
from glossmill.sources.archive import _file_system

#: What tells a note from the others of its deck.
KEYS = ("expression", "reading")


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    notes: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, deck: str, export: str):
        self.path, self.deck, self.export, self.token = path, deck, export, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = _file_system(self.path)
        folder = posixpath.join(inner, "notes", f"{self.export}-{self.token}")
        file, writer, n = posixpath.join(folder, f"{uuid.uuid4().hex}.parquet"), None, 0
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(file)
                    writer = pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                n += batch.num_rows
        if writer is None:
            return _Written(None, 0)
        writer.close()
        out.close()
        return _Written(posixpath.relpath(file, inner), n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = _file_system(self.path)
        if any(e["export"] == self.export for e in exports(self.path)):
            return self.abort(messages)
        deck = deck_id(self.path, self.deck)
        content = {"deck": deck, "name": self.deck, "export": self.export, "files": [m.file for m in messages if m and m.file], "notes": sum(m.notes for m in messages if m)}
        _appear(system, posixpath.join(inner, "exports"), self.export, content)

    def abort(self, messages: list[_Written | None]) -> None:
        system, inner = _file_system(self.path)
        folder = posixpath.join(inner, "notes", f"{self.export}-{self.token}")
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


def _appear(system, folder: str, name: str, content: dict) -> None:
    """A small file that is there as a whole at once."""
    system.create_dir(folder, recursive=True)
    aside = posixpath.join(folder, f".{uuid.uuid4().hex}")
    with system.open_output_stream(aside) as out:
        out.write(json.dumps(content, ensure_ascii=False, sort_keys=True).encode())
    system.move(aside, posixpath.join(folder, f"{name}.json"))


def _listed(path: str, kind: str) -> list[dict]:
    from pyarrow import fs

    system, inner = _file_system(path)
    found = system.get_file_info(fs.FileSelector(posixpath.join(inner, kind), allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.base_name.endswith(".json") and f.base_name[0] != "."), key=lambda f: f.base_name):
        with system.open_input_file(info.path) as file:
            out.append(json.loads(file.read()))
    return out


def exports(path: str) -> list[dict]:
    """What has been exported: deck, name, export, files and number of notes of each."""
    return _listed(path, "exports")


def deck_id(path: str, name: str) -> int:
    """The number of the deck of that name, which is made if it is not there."""
    decks = _listed(path, "decks")
    found = next((d["deck"] for d in decks if d["name"] == name), None)
    if found is None:
        found = max((d["deck"] for d in decks), default=0) + 1
        system, inner = _file_system(path)
        _appear(system, posixpath.join(inner, "decks"), f"{found:08d}", {"deck": found, "name": name})
    return found


class NoteDeck(DataSource):
    """The sink; options: path, deck, and export, which names the export (else each is a new one)."""

    @classmethod
    def name(cls) -> str:
        return "note_deck"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("notes are only added: use mode append")
        return _Writer(self.options["path"], self.options["deck"], self.options.get("export") or uuid.uuid4().hex)


def export_notes(cards: DataFrame, path: str, deck: str, export: str) -> None:
    """Adds cards(expression, reading, fields of a card) to a deck as one export; one that is there already is not computed again."""
    if any(e["export"] == export for e in exports(path)):
        return
    spark = cards.sparkSession
    spark.dataSource.register(NoteDeck)
    cards.select(*[F.col(c).cast("string").alias(c) for c in (*KEYS, *(f"field_{f}" for f in FIELDS))]).write.format("note_deck").option("path", path).option("deck", deck).option("export", export).mode("append").save()


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(deck, name, export, expression, reading, fields) of all exports; of a note that several exports have, the first one's."""
    schema = ", ".join(f"{c} string" for c in (*KEYS, *(f"field_{f}" for f in FIELDS)))
    found = exports(path)
    system, inner = _file_system(path)
    rows = spark.createDataFrame([], f"deck long, name string, export string, {schema}")
    for k in found:
        if k["files"]:
            rows = rows.union(spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in k["files"]]).select(F.lit(k["deck"]).cast("long").alias("deck"), F.lit(k["name"]).alias("name"), F.lit(k["export"]).alias("export"), "*"))
    fields = [c for c in rows.columns if c not in ("deck", "name", *KEYS)]
    return rows.groupBy("deck", "name", *KEYS).agg(F.min(F.struct(*fields)).alias("x")).select("deck", "name", "x.export", *KEYS, *[f"x.{c}" for c in fields if c != "export"])
