"""A sink of files: rows of a file are written one after the other, and a manifest is written once all tasks are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "studylake_files"
MANIFEST = "manifest.json"


def _source():
    """The data source; its classes are made here so that tasks get them by value."""
    import json
    import uuid
    from dataclasses import dataclass

    import pyarrow.fs as pafs
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        listing: str
        files: int
        size: int

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str):
            self.path = path

        def place(self):
            return pafs.FileSystem.from_uri(self.path)

        def write(self, batches):
            fs, root = self.place()
            fs.create_dir(f"{root}/_parts", recursive=True)
            listing, at, out, entries, size = f"_parts/{uuid.uuid4().hex}.jsonl", None, None, [], 0
            try:
                with fs.open_output_stream(f"{root}/{listing}") as told:
                    for batch in batches:
                        for name, body in zip(batch.column("filename").to_pylist(), batch.column("body").to_pylist()):
                            if name != at:
                                if out is not None:
                                    out.close()
                                at, out = name, fs.open_output_stream(f"{root}/{name}")
                                told.write((json.dumps({"filename": name}) + "\n").encode())
                                entries.append(None)
                            elif body is not None:
                                size += out.write(b"\n")
                            size += out.write((body or "").encode())
            finally:
                if out is not None:
                    out.close()
            return Written(listing, len(entries), size)

        def commit(self, messages):
            fs, root = self.place()
            done = [m for m in messages if m is not None]
            with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
                out.write(json.dumps({"count": sum(m.files for m in done), "bytes": sum(m.size for m in done), "parts": sorted(m.listing for m in done if m.files)}).encode())

        def abort(self, messages):
            """Files of the tasks that had ended go; those of a task that failed are overwritten by the next run, or not listed."""
            fs, root = self.place()
            for m in messages:
                if m is not None:
                    with fs.open_input_stream(f"{root}/{m.listing}") as told:
                        names = [json.loads(line)["filename"] for line in told.read().decode().splitlines()]
                    for name in [*names, m.listing]:
                        fs.delete_file(f"{root}/{name}")

    class Files(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return Files


def write_files(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write ``(filename, body)`` rows under a new folder that driver and executors share (SNK-12).

    Rows of a file, by ``order``, are joined by line breaks and streamed into it, so a file of any length needs no memory. The
    names lie in one list a task, and ``manifest.json``, written when all tasks have succeeded, counts the files and names
    these lists: a folder without it is unfinished.
    """
    spark = rows.sparkSession
    spark.dataSource.register(_source())
    dealt = rows.repartition("filename").sortWithinPartitions("filename", *(order or []))
    dealt.select(F.col("filename").cast("string"), F.col("body").cast("string")).write.format(FORMAT).mode("append").option("path", path).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, body)`` of the files that a finished folder's manifest lists."""
    manifest = spark.read.schema("count long, bytes long, parts array<string>").json(f"{path}/{MANIFEST}").first()
    if not manifest.parts:
        return spark.createDataFrame([], "filename string, body string")
    names = spark.read.schema("filename string").json([f"{path}/{p}" for p in manifest.parts])
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.*").select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("coded"), F.col("value").alias("body"))
    return names.join(whole.select(F.url_decode(F.replace("coded", F.lit("+"), F.lit("%2B"))).alias("filename"), "body"), "filename")
