import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.plans import lineage
from strandlake.sources import alignments, tables


def test_lineage(spark):
    g = lineage.Lineage()
    a = g.record("read", path="x")
    b = g.record("filter", [a], low=3)
    c = g.record("join", [a, b])
    assert {(r.ancestor, r.depth) for r in g.ancestors(spark, c).collect()} == {(a, 1), (b, 1)}
    assert {r.descendant for r in g.descendants(spark, a).collect()} == {b, c}
    back = lineage.Lineage.from_json(g.to_json())
    assert back.difference(g) == ([], [], []) and g.find("^fil") == [b]
    back.record("more", [c], key="k")
    assert back.difference(g)[0] == ["k"] and len(g.merged(back).nodes) == 4 and "-->" in g.to_mermaid()
    with pytest.raises(ValueError):
        g.record("x", ["nobody"])


def test_content_hash(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, {"k": 1}), (2, None, {"k": 1})], "a long, b string, c map<string,int>")
    same = df.repartition(3).orderBy(F.desc("a"))
    assert lineage.content_hash(df) == lineage.content_hash(same) != lineage.content_hash(df.limit(2))
    assert lineage.content_hash(df.withColumnRenamed("a", "z")) != lineage.content_hash(df)


def bam(records, refs):
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000) for r in refs)
    for name, flag, ref, pos, cigar, seq, qual in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(x << 4 | y for x, y in zip(codes[::2], codes[1::2]))
        raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(qual) + b"NMC\x05RGZx1\0"
        body += struct.pack("<i", len(raw)) + raw
    return b"".join(gzip.compress(body[i : i + 61]) for i in range(0, len(body), 61)) + gzip.compress(b"")


def test_bam_and_sam(spark, tmp_path):
    alignments.register(spark)
    recs = [("r1", 0, 0, 9, [(3, "M"), (2, "I")], "ACGTN", [30, 31, 32, 33, 34]), ("r2", 4, -1, -1, [], "AC", [255, 255]), ("r3", 16, 1, 0, [(4, "M")], "TTTT", [2, 2, 2, 2])]
    (tmp_path / "a.bam").write_bytes(bam(recs, ["chr1", "chr2"]))
    df = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    rows = {r.qname: r for r in df.collect()}
    r = rows["r1"]
    assert (r.refname, r.pos, r.cigar, r.seq, r.qual, r.tags) == ("chr1", 9, "3M2I", "ACGTN", "?@ABC", {"NM": "5", "RG": "x1"})
    assert (rows["r2"].refname, rows["r2"].pos, rows["r2"].cigar, rows["r2"].qual) == (None, None, None, None)
    assert [r.qname for r in df.where("refname = 'chr2'").collect()] == ["r3"]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\tchr1\t10\t60\t3M2I\t=\t50\t45\tACGTN\t?@ABC\tNM:i:5\tRG:Z:x1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    s = {r.qname: r for r in alignments.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert (s["r1"].pos, s["r1"].mate_refname, s["r1"].mate_pos, s["r1"].tags) == (9, "chr1", 49, {"NM": "5", "RG": "x1"}) and s["r2"].pos is None and s["r2"].refname is None


def test_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    m = tables.read_jaspar(spark, put("j", ">MA1 x\nA [1 2]\nC [ 3 4 ]\nG [0 0]\nT [5 6]\n>MA2 y\nA 1 0\nC 0 1\nG 0 0\nT 0 0\n"))
    assert {(r.matrix, r.pos, r.sym): r.n for r in m.where("matrix = 'MA1'").collect()}[("MA1", 2, "C")] == 4.0 and m.count() == 16
    g = {(r["pop"], r.individual, r.locus): r.alleles for r in tables.read_genepop(spark, put("g", "title\nl1\nl2\nPop\ni1, 0101 0002\ni2, 0102 0202\nPOP\ni3, 010101 001002\n")).collect()}
    assert g[(1, "i1", 1)] == [1, 1] and g[(1, "i1", 2)] is None and g[(1, "i2", 1)] == [1, 2] and g[(2, "i3", 2)] == [1, 2]
    s = tables.read_scop(spark, put("s", "# c\nd1\t1abc\tA:\ta.1.1\t99\tcl=1,cf=2\n")).first()
    assert (s.sid, s.sunid, s.hierarchy) == ("d1", 99, {"cl": "1", "cf": "2"})
    c = tables.read_cath(spark, put("c", "1oaiA00 1 10 8 10 1 1 1 1 1 59 1.0\n")).first()
    assert (c.domain, c.superfamily, c.length, c.resolution) == ("1oaiA00", "1.10.8.10", 59, 1.0)
    k = tables.read_kegg(spark, put("k", "ENTRY       hsa1  Pathway\nNAME        Some path\nCLASS       M; x\nGENE        10  AA; long\n            11  BB; other\nCOMPOUND    C1\n///\n")).first()
    assert (k.entry, k.name, [(x.id, x.name) for x in k.genes]) == ("hsa1", "Some path", [("10", "AA"), ("11", "BB")])
    b = tables.read_bismark(spark, put("b", "c1\t5\t5\t50\t2\t6\nshort\n")).first()
    assert (b.lo, b.level) == (5, 0.25)
