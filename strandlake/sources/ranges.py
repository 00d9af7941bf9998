"""Python data sources that read parts of binary or multi-line files: FASTQ by byte ranges, PLINK by blocks of variants.

Files are opened through pyarrow's file systems, so any store it knows works from any executor.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a part.
PART_BYTES = 32 << 20


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files, hidden ones and markers left out."""
    from pyarrow import fs

    system, p = open_fs(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(p))
    root = path.rstrip("/")
    return sorted((f"{root}/{i.base_name}", i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


class FastqReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self):
        return [Part(f, a, min(n, a + self.part_bytes)) for f, n in files_of(self.path) for a in range(0, n, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[tuple]:
        """Records whose @ lies in the part. A record begins at a line with @ whose second next line begins with +, while the line between has letters only."""
        system, p = open_fs(partition.path)
        with system.open_input_file(p) as raw, io.BufferedReader(raw, 1 << 20) as f:
            at = partition.start
            f.seek(max(0, at - 1))
            if at and f.read(1) != b"\n":
                at += len(f.readline())
            lines: list[bytes] = []
            while True:
                while len(lines) < 4:
                    line = f.readline()
                    if not line:
                        break
                    lines.append(line)
                if not lines or at >= partition.stop:
                    return
                if len(lines) >= 3 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and lines[1][:1] not in (b"@", b"+"):
                    if len(lines) < 4:
                        raise ValueError("the last record is cut off")
                    head, seq, qual = (x.rstrip(b"\r\n").decode() for x in (lines[0][1:], lines[1], lines[3]))
                    if len(seq) != len(qual):
                        raise ValueError(f"sequence and quality of {head} differ in length")
                    at += sum(map(len, lines))
                    lines = []
                    yield head.split(None, 1)[0] if head else "", head, seq, qual
                else:
                    if partition.start == 0 and at == 0 and lines[0].strip():
                        raise ValueError("not a FASTQ file")
                    at += len(lines[0])
                    lines = lines[1:]


class Fastq(DataSource):
    """spark.read.format("fastq").load(path); option part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "identifier string, description string, sequence string, quality string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class PlinkReader(DataSourceReader):
    """Two bits a genotype, variants one behind the other: a block of variants is a byte range."""

    def __init__(self, prefix: str, part_bytes: int):
        self.prefix, self.part_bytes = prefix, part_bytes

    def _lines(self, suffix: str) -> list[list[str]]:
        system, p = open_fs(f"{self.prefix}.{suffix}")
        with system.open_input_file(p) as f:
            return [x.split() for x in f.read().decode().splitlines() if x.strip()]

    def partitions(self):
        n = len(self._lines("fam"))
        width = (n + 3) // 4
        size = files_of(f"{self.prefix}.bed")[0][1] - 3
        step = max(1, self.part_bytes // max(1, width))
        return [Part(f"{self.prefix}.bed", a, min(size // width, a + step)) for a in range(0, size // width, step)] if width else []

    def read(self, partition: Part) -> Iterator[tuple]:
        samples, variants = self._lines("fam"), self._lines("bim")
        width = (len(samples) + 3) // 4
        dosage = (2, None, 1, 0)  # of the first allele: 00, 01 missing, 10, 11
        system, p = open_fs(partition.path)
        with system.open_input_file(p) as f:
            if f.read(3) != b"\x6c\x1b\x01":
                raise ValueError("not a variant-major PLINK file")
            f.seek(3 + partition.start * width)
            for v in range(partition.start, partition.stop):
                raw = f.read(width)
                chrom, snp, _, pos, a1, a2 = variants[v][:6]
                for s, row in enumerate(samples):
                    yield chrom, snp, int(pos), a1, a2, row[1], dosage[raw[s // 4] >> 2 * (s % 4) & 3]


class Plink(DataSource):
    """spark.read.format("plink").load(prefix): a row for each variant and sample, with the dosage of the first allele."""

    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return "chrom string, snp string, pos long, allele1 string, allele2 string, sample string, dosage int"

    def reader(self, schema) -> DataSourceReader:
        return PlinkReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def register(spark) -> None:
    for source in (Fastq, Plink):
        spark.dataSource.register(source)
