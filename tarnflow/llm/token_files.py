"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with checksums.

Layout of a file (all integers little-endian):

* data frames, each the zstandard frame of up to FRAME ids as unsigned 32-bit integers;
* one skippable frame with the compressed index: for each document its id, whether the id is null, and the
  number of ids up to its end;
* the seek table of the zstandard seekable format, again a skippable frame, so any zstandard
  reader can still decompress the whole file: an entry for each frame with compressed size, decompressed size and
  the low 32 bits of the XXH64 of the content.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch
from .pretokens import encoded

#: Fixed values of the file format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids in a data frame.
FRAME = 1 << 18
#: Bytes of text whose ids a file holds, about; its index is in memory while it is written.
FILE_BYTES = 64_000_000


def _low32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes one file; documents in the order given."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        self.out, self.size = out, frame * 4
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held = [], 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.tokens = 0

    def _frame(self, data: bytes) -> None:
        z = self.zip.compress(data)
        self.out.write(z)
        self.table.append((len(z), len(data), _low32(data)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.tokens += len(ids) // 4
        self.ids.append(doc_id)
        self.ends.append(self.tokens)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.size:
            data = b"".join(self.held)
            whole = len(data) // self.size * self.size
            for k in range(0, whole, self.size):
                self._frame(data[k : k + self.size])
            self.held, self.n_held = [data[whole:]], len(data) - whole

    def close(self) -> None:
        if self.n_held:
            self._frame(b"".join(self.held))
        nulls = np.array([i is None for i in self.ids], dtype="u1").tobytes()
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8").tobytes()
        index = self.zip.compress(struct.pack("<Q", len(self.ids)) + ids + nulls + np.array(self.ends, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.table.append((len(index) + 8, 0, _low32(index)))
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)


class TokenFileReader:
    """Reads a file; only the frames that hold the requested documents are read and decompressed."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offsets, self.sums = np.concatenate([[0], np.cumsum(table[:, 0])]), table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:-1, 1])])
        index = self._at(int(self.offsets[n - 1]) + 8, int(table[n - 1, 0]) - 8)
        if _low32(index) != self.sums[n - 1]:
            raise ValueError("the index is damaged")
        index = zstandard.ZstdDecompressor().decompress(index)
        (k,) = struct.unpack_from("<Q", index)
        self.ids, self.nulls = np.frombuffer(index, "<i8", k, 8), np.frombuffer(index, "u1", k, 8 + 8 * k)
        self.ends = np.frombuffer(index, "<i8", k, 8 + 9 * k)
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))
            if _low32(data) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, data)
        return self._last[1]

    def document(self, n: int) -> bytes:
        """Id bytes of the n-th document of the file."""
        lo, hi = 4 * int(self.ends[n - 1]) if n else 0, 4 * int(self.ends[n])
        out, k = [], int(np.searchsorted(self.starts, lo, "right")) - 1
        while lo < hi:
            own = self.frame(k)
            part = own[lo - int(self.starts[k]) : hi - int(self.starts[k])]
            out.append(part)
            lo, k = lo + len(part), k + 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[bytes]:
        """Id bytes of every document with this id; files are in ascending order of ids."""
        first = int(self.nulls.sum())  # nulls stand first
        lo, hi = (first + int(np.searchsorted(self.ids[first:], doc_id, side)) for side in ("left", "right"))
        return [self.document(n) for n in range(lo, hi)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents to files below `path`, ascending by id across and within them.

    Returns the manifest, one row a file: `(part, path, n_docs, n_tokens, base)` with `base` the number of ids in
    the files before. There are so many files that each takes about FILE_BYTES of text, if `files` doesn't say. Documents are dealt by ranges of
    ids and, where those are equal, of a hash of the text and of the row's number, so a file is one task's work and no id a hot one; a task writes under a name
    of its own and renames at the end, so a task that is run again replaces its file by an equal one. The manifest
    (a row a file) is all that reaches the driver. `path` must be a folder that executors share, in any
    file system that pyarrow opens by URI.

    A null or empty text is the end id alone, a very long one goes over many frames. Null ids stand first. Repeated rows are written repeatedly, in
    any order among themselves. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name, own = f"{root}/part-{part:07d}.tok", f"{root}/.{part:07d}-{uuid.uuid4().hex}"
        writer, out = None, None
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), encoded((x.as_py() for x in batch.column(1)), tokenizer), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = TokenFileWriter(out)
                writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(writer.ids)], "n_tokens": [writer.tokens]})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if files is None:
        files = max(partitions(spark), -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    own = own.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    dealt = own.repartitionByRange(files, "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")
    rows = sorted(dealt.mapInArrow(run, "part long, path string, n_docs long, n_tokens long").collect())
    manifest, base = [], 0
    for r in rows:
        manifest.append((*r, base))
        base += r.n_tokens
    return spark.createDataFrame(manifest, "part long, path string, n_docs long, n_tokens long, base long")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of every document in the files of a manifest."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(name) as source:
                    reader = TokenFileReader(source, source.size())
                    for at in range(0, len(reader.ids), 20_000):
                        to = min(at + 20_000, len(reader.ids))
                        ends = reader.ends[at:to]
                        starts = np.concatenate([[reader.ends[at - 1] if at else 0], ends[:-1]])
                        sums = [zlib.crc32(reader.document(n)) for n in range(at, to)]
                        ids = pa.array(reader.ids[at:to], pa.int64(), mask=reader.nulls[at:to].astype(bool))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_roundtrip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Writes the files to a fresh folder below the shared one and reads every document back."""
    path = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, tokenizer, end_id), path)


def open_token_file(path: str) -> TokenFileReader:
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    source = fs.open_input_file(name)
    return TokenFileReader(source, source.size())
