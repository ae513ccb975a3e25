"""A stream of file changes: a Python data source whose offsets are numbered snapshots of a folder's listing.

    spark.dataSource.register(FileChanges)
    spark.readStream.format("file_changes").options(root=..., state=..., maxFiles=100).load()

`state` is a folder on a file system that the driver keeps (local, HDFS or an object store). When a batch is due the
folder is listed and compared with the last snapshot; at most `maxFiles` of the differences, by path, make the next one,
so no batch is larger and what is left waits for the next. The changes of a snapshot are on disk before its number is
an offset, so a batch that runs again after a failure reads the same ones, and each change arrives once across
restarts. Texts are read by the tasks. A renamed file is a deletion and a creation; a file that goes while its batch
runs has no text, and its deletion follows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Changes a batch and changes a task.
MOST_FILES, A_TASK = 1000, 64


def differences(old: dict[str, list], new: dict[str, list]) -> list[tuple[str, str]]:
    """(path, create, change or delete) between two listings (path -> what tells a version of a file), by path."""
    found = [(p, "create" if p not in old else "change") for p in new if old.get(p) != new[p]]
    return sorted(found + [(p, "delete") for p in old if p not in new])


class Task(InputPartition):
    def __init__(self, rows: list) -> None:
        self.rows = rows


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, type string, ts timestamp, seq long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.state = options["root"].rstrip("/"), options["state"].rstrip("/")
        self.most = int(options.get("maxfiles", MOST_FILES))
        self.endings = tuple(e for e in options.get("extensions", "").split(",") if e)

    @staticmethod
    def _at(place: str):
        from pyarrow import fs

        if "://" in place or place.startswith("file:"):
            return fs.FileSystem.from_uri(place)
        return fs.LocalFileSystem(), place

    def _listed(self) -> dict[str, list]:
        from pyarrow import fs

        files, base = self._at(self.root)
        found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        rows = ((i.path[len(base) :].lstrip("/"), i) for i in found if i.type == fs.FileType.File)
        return {p: [i.mtime_ns or 0, i.size] for p, i in rows if not self.endings or p.endswith(self.endings)}

    def _load(self, name: str):
        files, base = self._at(self.state)
        try:
            with files.open_input_stream(f"{base}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _save(self, name: str, value) -> None:
        files, base = self._at(self.state)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/.{name}") as f:
            f.write(json.dumps(value).encode())
        files.move(f"{base}/.{name}", f"{base}/{name}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        kept = self._load("listing.json") or {"snapshot": 0, "files": {}}
        listed = self._listed()
        changes = differences(kept["files"], listed)[: self.most]
        if not changes:
            return {"snapshot": kept["snapshot"]}
        n, now = kept["snapshot"] + 1, dt.datetime.now(dt.UTC).timestamp()
        self._save(f"changes-{n}.json", [[p, kind, now] for p, kind in changes])
        files = kept["files"]
        for p, kind in changes:
            if kind == "delete":
                files.pop(p)
            else:
                files[p] = listed[p]
        self._save("listing.json", {"snapshot": n, "files": files})
        return {"snapshot": n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        rows = []
        for n in range(start["snapshot"] + 1, end["snapshot"] + 1):
            found = self._load(f"changes-{n}.json")
            if found is None:
                raise OSError(f"the changes of snapshot {n} are not in {self.state}")
            rows += [(*c, n * 2**32 + k) for k, c in enumerate(found)]
        return [Task(rows[i : i + A_TASK]) for i in range(0, len(rows), A_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, base = self._at(self.root)
        for path, kind, at, seq in partition.rows:
            text = None
            if kind != "delete":
                try:
                    with files.open_input_stream(f"{base}/{path}") as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    text = None
            yield path, kind, dt.datetime.fromtimestamp(at, dt.UTC).replace(tzinfo=None), seq, text

    def commit(self, end: dict) -> None:
        """The changes of batches that are done are not needed again; the last ones stay for a restart."""
        files, base = self._at(self.state)
        for n in range(end["snapshot"] - 1, 0, -1):
            try:
                files.delete_file(f"{base}/changes-{n}.json")
            except FileNotFoundError:
                break
