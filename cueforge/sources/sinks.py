"""Where plans and timelines are written."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.sources import wav


def plan_json(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(file_id, json): each file's plan as one JSON array in file order; [] for a file without cues."""
    own = plan.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_ms", "end_ms", "stretch_ratio", "text"))).alias("cues"))
    plain = F.transform("cues", lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["stretch_ratio"].alias("stretch_ratio"), c["text"].alias("text")))
    return files.select("file_id").join(own, "file_id", "left").select("file_id", F.coalesce(F.to_json(plain), F.lit("[]")).alias("json"))


def console(plan: DataFrame) -> DataFrame:
    return plan.select("file_id", "ord", F.format_string("[%d–%d] %s", "start_ms", "end_ms", "text").alias("line"))


def wav_files(chunks: DataFrame, rate: int = wav.DEFAULT_RATE) -> DataFrame:
    """(file_id, wav): whole files from rendered chunks. A timeline is capped in time, so a file stays under 2 GB."""

    def join(table: pa.Table) -> pa.Table:
        order = table.sort_by("chunk")
        body = b"".join(x.as_py() for x in order.column("pcm"))
        return pa.table({"file_id": table.column("file_id")[:1], "wav": pa.array([wav.encode(body, rate)], pa.binary())})

    return chunks.groupBy("file_id").applyInArrow(join, "file_id string, wav binary")


def write_files(files: DataFrame, folder: str, content: str, suffix: str) -> DataFrame:
    """Write each row's content to folder/stem + suffix, a folder that all executors share; returns (path, bytes).

    The stem is the last part of file_id without its extension. A file is
    renamed into place, so a repeated task leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data.encode() if isinstance(data, str) else data
                if suffix == ".json":
                    data = json.dumps(json.loads(data), indent=2).encode()
                path = os.path.join(folder, os.path.splitext(os.path.basename(name))[0] + suffix)
                draft = f"{path}.{os.getpid()}.part"
                with open(draft, "wb") as f:
                    f.write(data)
                os.replace(draft, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select(F.col("file_id").cast("string"), content).mapInArrow(write, "path string, bytes long")
