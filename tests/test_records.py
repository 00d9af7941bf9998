import random

from strandlake.sources import records as rec


def test_fasta_index_and_regions(spark, tmp_path):
    r = random.Random(2)
    seqs = {f"s{k}": "".join(r.choices("ACGT", k=r.choice([1, 59, 60, 61, 500]))) for k in range(8)}
    (tmp_path / "a.fa").write_text("".join(f">{n} text\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
    index = rec.fasta_index(spark, f"{tmp_path}/a.fa")
    assert {x["name"]: x["length"] for x in index.collect()} == {n: len(s) for n, s in seqs.items()}
    regions = [(n, a, a + r.randint(0, 130)) for n, s in seqs.items() for a in (0, r.randint(0, len(s)), 59)]
    got = {(x["name"], x["start"], x["stop"]): x["sequence"] for x in rec.fetch_fasta(index, spark.createDataFrame(regions, "name string, start long, stop long")).collect()}
    assert got == {(n, a, min(b, len(seqs[n]))): seqs[n][a:b] for n, a, b in regions if a < min(b, len(seqs[n]))}


def test_entries(spark, tmp_path):
    (tmp_path / "e.embl").write_text("ID   X1; SV 1;\nAC   X1;\nDE   one\nDE   two\nOS   Homo sapiens\nSQ   Sequence 12 BP;\n     acgtac gtacgt        12\n//\nID   X2;\nAC   X2; X3;\nDE   three\nSQ   Sequence 4 BP;\n     aaaa  4\n//\n")
    got = sorted(map(tuple, rec.read_embl(spark, f"{tmp_path}/e.embl").collect()))
    assert got == [("X1", "one two", "Homo sapiens", "ACGTACGTACGT"), ("X2", "three", "", "AAAA")]
    (tmp_path / "s.dat").write_text("ID   P1_HUMAN  Reviewed;\nAC   P00001; Q1;\nDE   RecName: Full=Some protein {ECO:1};\nGN   Name=ABC1; Synonyms=X;\nOS   Homo sapiens.\nOX   NCBI_TaxID=9606;\nSQ   SEQUENCE   6 AA;\n     MKVLAA\n//\n")
    assert tuple(rec.read_swissprot(spark, f"{tmp_path}/s.dat").first()) == ("P1_HUMAN", "P00001", "Some protein", "ABC1", "Homo sapiens", "9606", "MKVLAA")


def test_mmcif_and_motifs(spark, tmp_path):
    names = ["group_PDB", "id", "label_atom_id", "label_comp_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "auth_seq_id", "auth_asym_id"]
    (tmp_path / "x.cif").write_text("data_X\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in names) + 'ATOM 1 N ALA 1.0 2.0 3.5 9.0 5 A\nHETATM 2 "O\'" HOH 0 0 0 1 6 B\n#\nloop_\n_other.x\n1\n')
    a, b = sorted(rec.read_mmcif(spark, f"{tmp_path}/x.cif").drop("path").collect(), key=lambda r: r["id"])
    assert a.asDict() == {"record": "ATOM", "id": 1, "atom": "N", "residue": "ALA", "chain": "A", "resseq": 5, "x": 1.0, "y": 2.0, "z": 3.5, "bfactor": 9.0} and b["atom"] == "O'"
    (tmp_path / "m.meme").write_text("MEME version 4\n\nMOTIF one\nletter-probability matrix: alength= 4 w= 2\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n\nMOTIF two x\nletter-probability matrix: w= 1\n0 0 1 0\n")
    got = [tuple(r) for r in rec.read_meme(spark, f"{tmp_path}/m.meme").orderBy("motif", "pos").collect()]
    assert got == [("one", 1, 0.1, 0.2, 0.3, 0.4), ("one", 2, 1.0, 0.0, 0.0, 0.0), ("two", 1, 0.0, 0.0, 1.0, 0.0)]
    (tmp_path / "t.nex").write_text("#NEXUS\nBEGIN TREES;\nTREE a = [&R] ((A,B),C);\n  tree * b = (A,(B,C));\nEND;\n")
    assert sorted(map(tuple, rec.read_nexus_trees(spark, f"{tmp_path}/t.nex").collect())) == [("a", "((A,B),C);"), ("b", "(A,(B,C));")]


def test_alignments_round_trip(spark, tmp_path):
    rows = [("a", "ACGT-" * 30), ("long_name", "AC--T" * 30)]
    for kind, read in (("clustal", rec.read_clustal), ("stockholm", rec.read_stockholm), ("phylip", rec.read_phylip)):
        (tmp_path / kind).write_text(rec.alignment_text(rows, kind))
        assert sorted((x["name"], x["sequence"]) for x in read(spark, f"{tmp_path}/{kind}").collect()) == rows, kind
    assert rec.alignment_text(rows, "fasta").count("\n") == 8
