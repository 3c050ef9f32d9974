"""Files of tasks in the shared folder, through pyarrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

#: Bytes of a row group, as held in memory.
GROUP_BYTES = 16 << 20


def open_fs(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


def attempt_name(prefix: str) -> str:
    """A name that no other attempt of any task uses; what a lost attempt leaves is never listed in a manifest."""
    return f"{prefix}-{uuid.uuid4().hex}"


def filed(kernel, folder: str, schema: pa.Schema):
    """A batch kernel that writes what ``kernel`` yields to a Parquet file in the local ``folder`` and yields the file's name; without rows, neither."""

    def rows(batches):
        name, out, held = attempt_name("part") + ".parquet", None, []

        def flush() -> None:
            nonlocal out
            out = out or pq.ParquetWriter(f"{folder}/{name}", schema, filesystem=pafs.LocalFileSystem(), compression="zstd", compression_level=1)
            out.write_table(pa.Table.from_batches(held))
            held.clear()

        try:
            for batch in batches if kernel is None else kernel(batches):
                if batch.num_rows:
                    held.append(batch.select(schema.names).cast(schema))
                if sum(b.nbytes for b in held) >= GROUP_BYTES:
                    flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return rows
