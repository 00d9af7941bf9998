from pyspark.sql import functions as F

from strandlake.sources import flat, ranges


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)
    return str(p)


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first one\nacgt\nNNNN\n>s2\r\nAC\r\n\n>s3 empty\n")
    got = sorted(tuple(r) for r in flat.read_fasta(spark, path).collect())
    assert got == [("s1", "s1 first one", "ACGTNNNN"), ("s2", "s2", "AC"), ("s3", "s3 empty", "")]
    flat.write_fasta(flat.read_fasta(spark, path), str(tmp_path / "out"), width=3)
    assert sorted(tuple(r) for r in flat.read_fasta(spark, str(tmp_path / "out")).collect()) == got


def test_fastq_by_byte_ranges(spark, tmp_path):
    ranges.register(spark)
    recs = [(f"r{i} x", "ACGTA"[: i % 5 + 1], "@+I#!"[: i % 5 + 1]) for i in range(200)]
    path = put(tmp_path, "a.fq", "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in recs))
    for n in (37, 111, 1 << 20):
        df = spark.read.format("fastq").option("part_bytes", n).load(path)
        assert sorted((r.description, r.sequence, r.quality) for r in df.collect()) == sorted(recs)
    flat.write_fastq(df, str(tmp_path / "out"))
    assert spark.read.format("fastq").load(str(tmp_path / "out")).count() == 200


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nchr1\t10\ta\tA\tT\t.\tPASS\tAC=1;AN=4\tGT:DP\t0/1:12\t1/1:8\nshort\t1\nchr2\t20\tb\tC\tG\t10\n")
    rows = flat.read_vcf(spark, path).orderBy("pos").collect()
    assert [(r.chrom, r.pos, r.qual) for r in rows] == [("chr1", 10, None), ("chr2", 20, 10.0)]
    assert rows[0].samples == ["0/1:12", "1/1:8"] and rows[1].samples == [] and rows[1].filter is None
    assert flat.vcf_header(spark, path).first().samples == ["S1", "S2"]
    flat.write_vcf(flat.read_vcf(spark, path), str(tmp_path / "out"))
    assert flat.read_vcf(spark, str(tmp_path / "out")).count() == 2


def test_bed_gff_intervals(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "# c\nchr1\t0\t10\tname\nchr1\t10\nchr2\t20\t30\n")
    assert sorted((r.chrom, r.lo, r.hi) for r in flat.bed_to_ranges(flat.read_bed(spark, bed)).collect()) == [("chr1", 1, 10), ("chr2", 21, 30)]
    gff = put(tmp_path, "a.gff", "##gff-version 3\nchr1\tx\tgene\t5\t9\t.\t+\t.\tID=g1;Note=a%2Cb,c\n")
    r = flat.read_gff(spark, gff).first()
    assert (r.lo, r.hi, r.score, r.phase, r.attributes) == (5, 9, None, None, {"ID": ["g1"], "Note": ["a,b", "c"]})
    flat.write_gff(flat.read_gff(spark, gff), str(tmp_path / "out"))
    assert flat.read_gff(spark, str(tmp_path / "out")).first() == r
    csv = put(tmp_path, "a.csv", "Chromosome,begin,right,score\nc1,3,9,7\n")
    assert tuple(flat.read_intervals(spark, csv).first()) == ("c1", 3, 9, ".", {"score": "7"})


def test_plink(spark, tmp_path):
    ranges.register(spark)
    # 3 variants x 4 samples; dosages of the first allele by row: 0 1 2 0 / 1 0 1 1 / 2 1 0 missing
    code = {2: 0, None: 1, 1: 2, 0: 3}
    want = [[0, 1, 2, 0], [1, 0, 1, 1], [2, 1, 0, None]]
    put(tmp_path, "p.bed", b"\x6c\x1b\x01" + bytes(sum(code[d] << 2 * i for i, d in enumerate(row)) for row in want))
    put(tmp_path, "p.bim", "".join(f"1 rs{i} 0 {100 + i} A G\n" for i in range(3)))
    put(tmp_path, "p.fam", "".join(f"f s{i} 0 0 1 1\n" for i in range(4)))
    rows = spark.read.format("plink").option("part_bytes", 1).load(str(tmp_path / "p")).collect()
    assert {(r.snp, r["sample"]): r.dosage for r in rows} == {(f"rs{i}", f"s{j}"): want[i][j] for i in range(3) for j in range(4)}


def test_other_formats(spark, tmp_path):
    tab = put(tmp_path, "b.tab", "q\ts\t99.5\t10\t0\t0\t1\t10\t5\t14\t1e-5\t50.1\n")
    assert flat.read_blast_tabular(spark, tab).first().bitscore == 50.1
    xml = put(tmp_path, "b.xml", "<BlastOutput><Hit><Hit_id>h</Hit_id><Hit_def>d</Hit_def><Hit_len>9</Hit_len><Hit_hsps><Hsp><Hsp_bit-score>5.5</Hsp_bit-score><Hsp_evalue>0.1</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>4</Hsp_query-to><Hsp_hit-from>2</Hsp_hit-from><Hsp_hit-to>5</Hsp_hit-to><Hsp_identity>4</Hsp_identity><Hsp_align-len>4</Hsp_align-len></Hsp></Hit_hsps></Hit></BlastOutput>")
    r = flat.read_blast_xml(spark, xml).first()
    assert (r.subject, r.q_end, r.bitscore) == ("h", 4, 5.5)
    gb = put(tmp_path, "a.gb", "LOCUS       AB1 10 bp\nDEFINITION  two\n            lines.\nACCESSION   AB1\nSOURCE      x\n  ORGANISM  Homo\nFEATURES             Location/Qualifiers\n     gene            1..5\n                     /gene=\"g\"\n     CDS             complement(2..\n                     4)\n                     /x=\"y\"\nORIGIN\n        1 acgta cgtac\n//\n")
    r = flat.read_genbank(spark, gb).first()
    assert (r.locus, r.accession, r.definition, r.organism, r.sequence) == ("AB1", "AB1", "two lines.", "Homo", "ACGTACGTAC")
    assert [(f.key, f.location) for f in r.features] == [("gene", "1..5"), ("CDS", "complement(2..4)")]
    pdb = put(tmp_path, "a.pdb", "ATOM      1  CA  ALA A  10      11.104   6.134  -6.504  1.00  0.00           C\nTER\n")
    r = flat.read_pdb(spark, pdb).first()
    assert (r.atom, r.residue, r.chain, r.resseq, r.x, r.z, r.element) == ("CA", "ALA", "A", 10, 11.104, -6.504, "C")
    med = put(tmp_path, "m.txt", "PMID- 12\nTI  - A long\n      title\nAU  - X\nAU  - Y\n\nPMID- 13\nTI  - B\n")
    got = {r.pmid: r.fields for r in flat.read_medline(spark, med).collect()}
    assert got["12"]["TI"] == ["A long title"] and got["12"]["AU"] == ["X", "Y"] and set(got) == {"12", "13"}
    maf = put(tmp_path, "m.maf", "#v\n" + "\t".join(flat.MAF_COLUMNS) + "\nTP53\tS1\tMissense\tSNP\t17\t5\t5\tA\tT\n")
    assert flat.read_maf(spark, maf).select(F.col("Start_Position")).first()[0] == 5
