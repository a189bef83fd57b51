"""Problem 5: far too many small files.

Files are joined byte by byte into containers, without parsing: newline-delimited files after a look at their first and last bytes (byte-order mark, header line,
missing line end), complete zstandard frames as they are, since a row of frames is itself a valid stream. Every task writes its own containers; the
manifest holds container, place, length and SHA-256 of each member, and ``verify`` reads the containers against it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.storage import materialize, shared_dir

#: Bytes of content in a container.
TARGET = 64 << 20
_BOM, _ZSTD = b"\xef\xbb\xbf", b"\x28\xb5\x2f\xfd"
MANIFEST = "container string, seq int, offset long, stored long, length long, sha256 string, stored_sha256 string"


def line_member(data: bytes, first: bool, header: bool = False) -> bytes:
    """The bytes of a newline-delimited file that go into a container: without a byte-order mark, with a line feed at the end, and, where files carry a header line, without it in all but the first."""
    if data.startswith(_BOM):
        data = data[3:]
    if header and not first:
        cut = data.find(b"\n")
        data = data[cut + 1 :] if cut >= 0 else b""
    return data if not data or data.endswith(b"\n") else data + b"\n"


def frames_complete(data: bytes) -> bool:
    """Whether ``data`` is one zstandard frame or more, each complete."""
    import zstandard

    while data:
        if not data.startswith(_ZSTD):
            return False
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            d.decompress(data)
        except zstandard.ZstdError:
            return False
        if not d.eof:
            return False
        data = d.unused_data
    return True


def as_frame(data: bytes, level: int = 3) -> bytes:
    """``data`` as one zstandard frame that carries its length and a checksum."""
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress(data)


class _Writer:
    """Writes the containers of one task. Names are those of the task's partition, so a task that runs again replaces its own files."""

    def __init__(self, folder: str, partition: int, target: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.partition, self.target, self.number = partition, target, -1
        self.parts: list[bytes] = []
        self.offset = self.content = self.seq = 0

    def name(self) -> str:
        return f"part-{self.partition:06d}-{max(self.number, 0):04d}.bin"

    def add(self, data: bytes, length: int) -> tuple[str, int, int, int]:
        """(container, seq, offset, stored)"""
        if self.number < 0 or self.content and self.content + length > self.target:
            self.close()
            self.number += 1
        place = (self.name(), self.seq, self.offset, len(data))
        self.parts.append(data)
        self.offset += len(data)
        self.content += length
        self.seq += 1
        return place

    def close(self) -> None:
        if self.parts:
            temporary = f"{self.root}/.{self.name()}.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(temporary) as out:
                for p in self.parts:
                    out.write(p)
            self.fs.move(temporary, f"{self.root}/{self.name()}")
        self.parts, self.offset, self.content, self.seq = [], 0, 0, 0


def compact(members: DataFrame, body: str, folder: str | None = None, kind: str = "frame", target: int = TARGET, total_bytes: int | None = None, header: bool = False) -> tuple[DataFrame, str]:
    """Write all members into containers in ``folder`` and return their manifest and the folder.

    ``body`` is the column of contents, text (its UTF-8 bytes) or binary; the other columns pass into the manifest, but for ones named as the manifest's own,
    which are replaced. kind: ``frame`` (each content becomes one zstandard frame), ``zstd`` (contents are complete frames already and are joined as they
    are), ``lines`` (newline-delimited contents). A member with a null content isn't a file and is left out; an empty one is kept with length 0. A member
    larger than ``target`` fills a container alone. Repeated rows are members of their own. An empty table gives an empty manifest. ``total_bytes`` sets how many tasks,
    and so how few containers, there are; without it the table's own partitions stand. ``length`` is that of the content before any change.
    """
    if kind not in ("frame", "zstd", "lines"):
        raise ValueError(f"no kind {kind}")
    spark = members.sparkSession
    folder = folder or f"{shared_dir(spark)}/corpusloom/containers-{uuid.uuid4().hex}"
    # a folder without a scheme lies in the cluster's default file system
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = re.sub(r"^file:/+", "file:///", uri)
    own = {x.split()[0] for x in MANIFEST.split(", ")}
    keep = [c for c in members.columns if c != body and c not in own]
    source = members.select(*keep, F.col(body).cast("binary").alias("__body")).filter("__body is not null")
    if total_bytes:
        source = source.coalesce(max(1, -(-total_bytes // target)))
    extra = source.drop("__body").schema
    schema = spark.createDataFrame([], MANIFEST).schema
    for f in reversed(extra.fields):
        schema.fields.insert(0, f)
        schema.names.insert(0, f.name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Writer(uri, TaskContext.get().partitionId(), target)
        for b in batches:
            rows = []
            for value in b.column(b.num_columns - 1):
                data = value.as_buffer().to_pybytes()
                if kind == "zstd" and not frames_complete(data):
                    raise ValueError("a member isn't a complete zstandard frame")
                stored = as_frame(data) if kind == "frame" else data if kind == "zstd" else line_member(data, out.seq == 0 or out.content + len(data) > target, header)
                rows.append((*out.add(stored, len(data)), len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(stored).hexdigest()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)
        out.close()

    return materialize(source.mapInArrow(run, schema), "manifest"), uri


def verify(manifest: DataFrame, folder: str, kind: str = "frame") -> DataFrame:
    """(container, n_members, n_bytes, n_stored, ok): each container read once and held against the manifest.

    ok: the file is as long as its members, they lie side by side, the SHA-256 of each member's stored bytes is the manifest's, and its length and SHA-256 are those of its content (not for
    ``lines``, since line ends may have been added).
    """
    per = manifest.groupBy("container").agg(F.sort_array(F.collect_list(F.struct("seq", "offset", "stored", "length", "sha256", "stored_sha256"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for name, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with where.open_input_stream(f"{root}/{name}") as f:
                    data = memoryview(f.read())
                at, ok = 0, True
                for k, m in enumerate(members):
                    ok &= m["seq"] == k and m["offset"] == at
                    part = data[at : at + m["stored"]]
                    at += m["stored"]
                    ok &= hashlib.sha256(part).hexdigest() == m["stored_sha256"]
                    if kind != "lines":
                        content = d.decompress(part) if kind == "frame" else bytes(part)
                        ok &= len(content) == m["length"] and hashlib.sha256(content).hexdigest() == m["sha256"]
                ok &= at == len(data)
                yield pa.RecordBatch.from_pydict({"container": [name], "n_members": pa.array([len(members)], pa.int64()), "n_bytes": pa.array([sum(m["length"] for m in members)], pa.int64()), "n_stored": pa.array([at], pa.int64()), "ok": [ok]})

    return per.mapInArrow(run, "container string, n_members long, n_bytes long, n_stored long, ok boolean")


def read_members(spark, manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with a column ``content``: each member read back from its container of frames, by place and length."""
    schema = manifest.withColumn("content", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        d = zstandard.ZstdDecompressor()
        held: tuple[str, bytes] = ("", b"")
        for b in batches:
            out = []
            for name, at, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("container", "offset", "stored"))):
                if held[0] != name:
                    with where.open_input_stream(f"{root}/{name}") as f:
                        held = (name, f.read())
                out.append(d.decompress(held[1][at : at + n]).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=schema.names)

    return manifest.repartition("container").sortWithinPartitions("container", "seq").mapInArrow(run, schema)


def same_records(files: DataFrame, manifest: DataFrame, key: list[str], file_id: str = "file_id", kind: str = "file_kind") -> DataFrame:
    """(file_a, file_b), file_a < file_b: files of one kind whose members have the same url, length and SHA-256.

    ``files`` name their member by the columns ``key``, which the manifest has too, beside ``url``. Rows listed twice count once. Files without a
    member, and members with a null url, are in no pair.
    """
    at = files.select(file_id, kind, *key).distinct().join(manifest.select(*key, "url", "length", "sha256").distinct(), key).filter("url is not null")
    group = [kind, "url", "length", "sha256"]
    several = at.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = materialize(at.join(several, group).select(*group, F.col(file_id).cast("long").alias("f")).distinct(), "copies")
    return again.withColumnRenamed("f", "file_a").join(again.withColumnRenamed("f", "file_b"), group).filter("file_a < file_b").select("file_a", "file_b").distinct()
