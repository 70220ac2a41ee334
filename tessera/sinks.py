"""Cluster files, histogram tables, reports, and files with names of their own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """One line `min_dist:(A,B)(C)` for each clustering; members and clusters sorted."""
    members = clusters.groupBy("clustering_id", "min_dist", "cluster_id").agg(F.array_sort(F.collect_list("complex_id")).alias("m"))
    lines = members.groupBy("clustering_id", "min_dist").agg(F.array_sort(F.collect_list(F.concat(F.lit("("), F.array_join("m", ","), F.lit(")")))).alias("c"))
    return lines.select("clustering_id", F.concat(F.col("min_dist").cast("string"), F.lit(":"), F.array_join("c", "")).alias("value"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Text files of clusterings in order, within files and by the files' names, each of a
    task of its own; what a retried task left is not committed. Existing ones are not
    overwritten."""
    cluster_lines(clusters).repartitionByRange("clustering_id").sortWithinPartitions("clustering_id").select("value").write.mode("errorifexists").text(path)


def histogram_table(histogram: DataFrame, bins: int) -> DataFrame:
    """(complex_id, atom_1, atom_2, bin0, ...) from rows (complex, type_a, type_b, bin, n)."""
    return histogram.groupBy(F.col("complex").alias("complex_id"), F.col("type_a").alias("atom_1"), F.col("type_b").alias("atom_2")).agg(*[F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("n"))), F.lit(0)).alias(f"bin{k}") for k in range(bins)])


def write_histograms(histogram: DataFrame, bins: int, path: str) -> None:
    """A file `<complex>.hist` for each complex: comma-separated values with a header."""
    table = histogram_table(histogram, bins)
    names = [c for c in table.columns if c != "complex_id"]
    lines = table.select(F.col("complex_id").alias("name"), F.struct("atom_1", "atom_2").alias("at"), F.concat_ws(",", *names).alias("line"))
    write_named(lines, path, ".hist", ",".join(names))


def write_report(table: DataFrame, path: str) -> None:
    """Tab-separated values with a header."""
    table.write.mode("errorifexists").csv(path, header=True, sep="\t")


def write_named(lines: DataFrame, path: str, ending: str, header: str = "") -> None:
    """One text file for each name of rows (name, at, line), lines in the order of `at`,
    in a folder that must not hold anything. Many tasks write, a file in one of them."""
    lines.sparkSession.dataSource.register(NamedFiles)
    rows = lines.select(F.col("name").cast("string").alias("name"), "at", "line").repartition("name").sortWithinPartitions("name", "at")
    rows.select("name", "line").write.format("named_files").mode("append").option("ending", ending).option("header", header).save(path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFiles(DataSource):
    """A sink of rows (name, line), those of a name next to each other."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        out = NamedFilesWriter(self.options["path"], self.options.get("ending", ""), self.options.get("header", ""))
        out.claim()
        return out


class NamedFilesWriter(DataSourceArrowWriter):
    """A task writes a file aside and moves it to its name when it is whole, so a retried
    or doubled task puts the same file in the same place. `_SUCCESS` comes last; a job
    that fails takes its folder with it."""

    def __init__(self, path: str, ending: str, header: str):
        self.path, self.ending, self.header = path, ending, header

    def place(self) -> tuple[fs.FileSystem, str]:
        place, root = fs.FileSystem.from_uri(self.path)
        return place, root.rstrip("/")

    def claim(self) -> None:
        place, root = self.place()
        found = place.get_file_info(root)
        if found.type == fs.FileType.File or (found.type == fs.FileType.Directory and place.get_file_info(fs.FileSelector(root))):
            raise FileExistsError(f"{self.path} exists")
        place.create_dir(f"{root}/_temporary", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        place, root = self.place()
        aside, name, out, files = f"{root}/_temporary/{uuid.uuid4().hex}", None, None, 0

        def end() -> None:
            if out is not None:
                out.close()
                place.move(aside, f"{root}/{quote(name, safe='')}{self.ending}")

        for batch in iterator:
            for owner, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or owner != name:
                    if not owner:
                        raise ValueError("a file without a name")
                    end()
                    name, out, files = owner, place.open_output_stream(aside), files + 1
                    if self.header:
                        out.write(f"{self.header}\n".encode())
                out.write(f"{'' if line is None else line}\n".encode())
        end()
        return Written(files)

    def commit(self, messages: list) -> None:
        place, root = self.place()
        place.delete_dir(f"{root}/_temporary")
        with place.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        place, root = self.place()
        place.delete_dir(root)
