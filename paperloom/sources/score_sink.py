"""A sink that scores prompts while it writes them, and keeps every reply as soon as it can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.sources.scores import DONE, score_schema

Batches = Iterator[pd.DataFrame]


@dataclass
class Kept(WriterCommitMessage):
    """The parts that one task has written, and what they hold."""

    parts: list[str] = field(default_factory=list)
    papers: int = 0
    tokens: int = 0
    errors: int = 0

    def add(self, name: str, rows: pa.Table) -> None:
        self.parts.append(name)
        self.papers += rows.num_rows
        self.tokens += sum(t or 0 for t in rows.column("tokens").to_pylist())
        self.errors += rows.num_rows - rows.column("error").null_count


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for the workers: local or shared disks, HDFS, S3, GCS or Azure."""
    scheme, _, rest = folder.partition(":")
    return fs.FileSystem.from_uri("file:///" + rest.lstrip("/") if scheme == "file" else folder)


def put(files: fs.FileSystem, path: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Writes a file under a hidden name and gives it its own when it is whole."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/_new-{uuid.uuid4().hex}-{name}"
    with files.open_output_stream(hidden) as stream:
        write(stream)
    files.move(hidden, path)


class ScoreWriter(DataSourceArrowWriter):
    """Asks the scorer for the prompts of a task, and writes a part for every ``every`` papers.

    A part stays whatever becomes of the task. A repeated task reads what the earlier ones of its partition
    have kept and asks for the rest, so the loss of a task costs at most ``every`` calls, and those that wait.
    """

    def __init__(self, scorer: Callable[[Batches], Batches], id_type: T.DataType, folder: str, every: int):
        self.scorer, self.folder, self.every = scorer, folder, every
        self.schema = to_arrow_schema(score_schema(id_type))

    def earlier(self, files: fs.FileSystem, path: str, partition: int) -> Kept:
        """What earlier attempts of this partition have kept."""
        found = Kept()
        for entry in files.get_file_info(fs.FileSelector(f"{path}/{partition:06}", allow_not_found=True)):
            if not entry.base_name.startswith("_"):
                found.add(f"{partition:06}/{entry.base_name}", pq.read_table(files.open_input_file(entry.path), columns=["tokens", "error"]))
        return found

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Kept:
        files, path = store(self.folder)
        task = TaskContext.get()
        partition, attempt = task.partitionId(), task.taskAttemptId()
        files.create_dir(f"{path}/{partition:06}", recursive=True)
        kept = self.earlier(files, path, partition)
        done: set = set()
        for name in kept.parts:
            done.update(pq.read_table(files.open_input_file(f"{path}/{name}"), columns=["paper_id"]).column(0).to_pylist())

        def prompts() -> Batches:
            """Each paper once: its copies come one after the other."""
            last = None
            for batch in iterator:
                for at in range(0, batch.num_rows, self.every):
                    rows = batch.slice(at, self.every)
                    ids, wanted = rows.column("paper_id").to_pylist(), []
                    for k, paper in enumerate(ids):
                        if paper != last and paper not in done:
                            wanted.append(k)
                        last = paper
                    if wanted:
                        yield rows.select(["paper_id", "prompt"]).take(pa.array(wanted)).to_pandas()

        def keep(some: list[pa.Table]) -> None:
            rows = pa.concat_tables(some)
            name = f"{partition:06}/{attempt}-{len(kept.parts):06}.parquet"
            put(files, f"{path}/{name}", lambda stream: pq.write_table(rows, stream))
            kept.add(name, rows)

        waiting: list[pa.Table] = []
        for scored in self.scorer(prompts()):
            waiting.append(pa.Table.from_pandas(scored[self.schema.names], self.schema, preserve_index=False))
            if sum(t.num_rows for t in waiting) >= self.every:
                keep(waiting)
                waiting = []
        if waiting:
            keep(waiting)
        return kept

    def commit(self, messages: list[Kept | None]) -> None:
        """The manifest: which parts make up the run, and what they hold."""
        files, path = store(self.folder)
        files.create_dir(path, recursive=True)
        found = [m for m in messages if m is not None]
        content = {
            "parts": sorted(p for m in found for p in m.parts),
            "papers": sum(m.papers for m in found), "tokens": sum(m.tokens for m in found), "errors": sum(m.errors for m in found),
        }
        put(files, f"{path}/{DONE}", lambda stream: stream.write(json.dumps(content).encode()))

    def abort(self, messages: list[Kept | None]) -> None:
        """Nothing to undo: replies that were paid for stay."""


def register(spark: SparkSession, scorer: Callable[[Batches], Batches], id_type: T.DataType) -> str:
    """The format name of a sink for rows ``paper_id, prompt`` that asks this scorer.

    Its options are ``folder``, the folder of the run, and ``every``, papers of a part.
    """
    format_name = f"scored_{uuid.uuid4().hex}"

    class ScoreSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema: T.StructType, overwrite: bool) -> ScoreWriter:
            return ScoreWriter(scorer, id_type, self.options["folder"], int(self.options["every"]))

    spark.dataSource.register(ScoreSink)
    return format_name
