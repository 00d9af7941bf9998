"""SAM text and BAM files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from strandlake.sources.ranges import files_of, open_fs

SCHEMA = "qname string, flag int, refname string, pos long, mapq int, cigar string, mate_refname string, mate_pos long, template_length long, seq string, qual string, tags map<string,string>"
# Fixed values of the format: letters of bases and of operations.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fields and the tags; positions are 0-based, * and a position of 0 are null."""
    f = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.element_at("f", i + 1)
    none = lambda c: F.nullif(c, F.lit("*"))
    zero = lambda c: F.nullif(c.cast("long") - 1, F.lit(-1).cast("long"))
    tags = F.transform(F.slice("f", 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 20).alias("value")))
    mate = F.when(at(6) == "=", at(2)).otherwise(at(6))
    return f.select(
        at(0).alias("qname"), at(1).cast("int").alias("flag"), none(at(2)).alias("refname"), zero(at(3)).alias("pos"), at(4).cast("int").alias("mapq"), none(at(5)).alias("cigar"),
        none(mate).alias("mate_refname"), zero(at(7)).alias("mate_pos"), at(8).cast("long").alias("template_length"), none(at(9)).alias("seq"), none(at(10)).alias("qual"), F.map_from_entries(tags).alias("tags"),
    )


class Blocks:
    """Decompressed bytes of a file of gzip members, read as they are asked for."""

    def __init__(self, f):
        self.f, self.held, self.unzip, self.rest = f, b"", zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            raw = self.rest or self.f.read(1 << 20)
            if not raw:
                break
            self.held += self.unzip.decompress(raw)
            self.rest = b""
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        out, self.held = self.held[:n], self.held[n:]
        return out


def _tags(raw: bytes) -> dict[str, str]:
    sizes = {"c": "b", "C": "B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
    out, at = {}, 0
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[key], at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            out[key], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            size = struct.calcsize(sizes[sub])
            out[key] = ",".join([sub, *(str(struct.unpack_from(sizes[sub], raw, at + 5 + i * size)[0]) for i in range(n))])
            at += 5 + n * size
        else:
            out[key] = str(struct.unpack_from(sizes[kind], raw, at)[0])
            at += struct.calcsize(sizes[kind])
    return out


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    """A partition is a file. Equality on refname is pushed: other records are skipped before they are decoded."""

    def __init__(self, path: str):
        self.path, self.refname = path, None

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute == ("refname",):
                self.refname = x.value
            yield x

    def partitions(self):
        return [Part(f) for f, _ in files_of(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, p = open_fs(partition.path)
        with system.open_input_file(p) as f:
            b = Blocks(f)
            if b.read(4) != b"BAM\1":
                raise ValueError("not a BAM file")
            b.read(struct.unpack("<i", b.read(4))[0])
            refs = []
            for _ in range(struct.unpack("<i", b.read(4))[0]):
                name = b.read(struct.unpack("<i", b.read(4))[0])[:-1].decode()
                b.read(4)
                refs.append(name)
            while head := b.read(4):
                raw = b.read(struct.unpack("<i", head)[0])
                ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", raw)
                refname = refs[ref] if ref >= 0 else None
                if self.refname is not None and refname != self.refname:
                    continue
                at = 32 + l_name
                name = raw[32 : at - 1].decode()
                ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
                at += 4 * n_cigar
                packed = raw[at : at + (l_seq + 1) // 2]
                seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq]
                at += len(packed)
                quality = raw[at : at + l_seq]
                qual = None if not l_seq or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
                cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or None
                yield name, flag, refname, pos if pos >= 0 else None, mapq, cigar, refs[mate] if mate >= 0 else None, mate_pos if mate_pos >= 0 else None, size, seq or None, qual, _tags(raw[at + l_seq :])


class Bam(DataSource):
    """spark.read.format("bam").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Also lets filters reach Python data sources, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bam)
