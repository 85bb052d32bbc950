"""A streaming source of response bodies that are still being written.

A folder has a file for each search, ``<place>~<document_id>~<request_id>``, which grows while its body arrives, and beside it ``<same name>.done`` once it is complete.
Places order the files: a new file's name comes after all names that were there before, as with a counter or a time. A micro-batch reads what the files have grown by since the last one, each
file in a partition of its own, and names the bytes by where they begin; so a replayed batch gives the same chunks.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pagewright.streaming.framing import CHUNKS

DONE = ".done"


def _folder(path: str):
    """(file system, path in it) of a folder, by its URI; the schemes are those of ``pyarrow.fs``, and a path without one is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if ":/" in path else (fs.LocalFileSystem(), path)


class Growth(InputPartition):
    def __init__(self, name: str, begin: int, end: int, last: bool):
        self.name, self.begin, self.end, self.last = name, begin, end, last


class ChunkReader(DataSourceStreamReader):
    """Offsets hold the sizes of files that are not complete, or behind one that isn't (``open``), and the name up to which all are complete and were read (``through``)."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("chunkbytes", 1 << 20))

    def initialOffset(self) -> dict:
        return {"through": "", "open": {}}

    def _files(self) -> dict[str, tuple[int, bool]]:
        from pyarrow import fs

        system, folder = _folder(self.path)
        listed = lambda: [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.count("~") >= 2]
        marks = {f.base_name for f in listed() if f.base_name.endswith(DONE)}  # before the sizes, which are final where there is a mark
        return {f.base_name: (f.size, f.base_name + DONE in marks) for f in listed() if not f.base_name.endswith(DONE)}

    def latestOffset(self) -> dict:
        through, open_ = "", {}
        for name, (size, done) in sorted(self._files().items()):
            if done and not open_:
                through = name
            else:
                open_[name] = [size, done]
        # sizes of files up to ``through`` are final, so the name says all
        return {"through": through, "open": open_}

    def partitions(self, start: dict, end: dict) -> list[Growth]:
        now = {name: size for name, (size, _) in self._files().items() if start["through"] < name <= end["through"]}
        ends = {name: (size, True) for name, size in now.items()} | {name: tuple(x) for name, x in end["open"].items()}
        out = []
        for name, (size, done) in sorted(ends.items()):
            begin, was_done = start["open"].get(name, (0, False))
            if size > begin or done and not was_done:
                out.append(Growth(name, begin, size, done and not was_done))
        return out

    def read(self, partition: Growth):
        system, folder = _folder(self.path)
        _, document, request = partition.name.split("~", 2)
        at = partition.begin
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            while at < partition.end:
                data = file.read_at(min(self.most, partition.end - at), at)
                yield document, request, at, data, partition.last and at + len(data) == partition.end
                at += len(data)
        if partition.last and partition.begin == partition.end:
            yield document, request, at, b"", True


class ChunkFiles(DataSource):
    """``spark.dataSource.register(ChunkFiles)``, then ``spark.readStream.format("pagewright_chunks").load(folder)``: document_id, request_id, begin, bytes, last. Option ``chunkBytes``: bytes of a row at most."""

    @classmethod
    def name(cls) -> str:
        return "pagewright_chunks"

    def schema(self) -> str:
        return CHUNKS

    def streamReader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)
