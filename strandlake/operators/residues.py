"""Residues and chains of the flat table of atoms: summaries, selections, distances, hydrogen bonds and torsion regions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.blocks import near_counts
from strandlake.operators.structure import LETTERS, backbone_torsions, near_pairs

# Names of water, and the borders of torsion regions in degrees.
WATERS = ("HOH", "WAT", "H2O", "DOD")
RESIDUE = ["structure", "chain", "resseq"]


def is_protein(residue: Column) -> Column:
    return F.upper(residue).isin(*LETTERS)


def is_water(residue: Column) -> Column:
    return F.upper(residue).isin(*WATERS)


def is_ligand(residue: Column) -> Column:
    return ~is_protein(residue) & ~is_water(residue)


def structure_summary(atoms: DataFrame) -> DataFrame:
    """Chains, residues, atoms, water and ligand atoms of each structure."""
    return atoms.groupBy("structure").agg(
        F.count_distinct("chain").alias("chains"), F.count_distinct("chain", "resseq").alias("residues"), F.count(F.lit(1)).alias("atoms"),
        F.count_if(is_water(F.col("residue"))).alias("water_atoms"), F.count_if(is_ligand(F.col("residue"))).alias("ligand_atoms"),
    )


def chain_summary(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("structure", "chain").agg(F.count_distinct("resseq").alias("residues"), F.count(F.lit(1)).alias("atoms"), F.min("resseq").alias("first"), F.max("resseq").alias("last"), F.avg("bfactor").alias("bfactor"))


def residue_bfactor(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy(*RESIDUE).agg(F.min("residue").alias("residue"), F.avg("bfactor").alias("bfactor"), F.max("bfactor").alias("highest"))


def selection(text: str) -> Column:
    """A condition on atoms from words: chain A, resid 5 or 5:9, resname GLY, name CA, protein, water, ligand, backbone; and, or, not, brackets."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    single = {"protein": is_protein(F.col("residue")), "water": is_water(F.col("residue")), "ligand": is_ligand(F.col("residue")), "backbone": F.col("atom").isin("N", "CA", "C", "O"), "all": F.lit(True)}
    fields = {"chain": "chain", "resname": "residue", "name": "atom"}
    at = 0

    def values() -> list[str]:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at].lower() not in {"and", "or", "not", "(", ")", "resid", *fields, *single}:
            out.append(tokens[at])
            at += 1
        if not out:
            raise ValueError(f"a value is missing in {text!r}")
        return out

    def term() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"{text!r} ends too soon")
        word, at = tokens[at].lower(), at + 1
        if word == "not":
            return ~term()
        if word == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"a bracket stays open in {text!r}")
            at += 1
            return inner
        if word in single:
            return single[word]
        if word in fields:
            return F.col(fields[word]).isin(*values())
        if word == "resid":
            out = F.lit(False)
            for v in values():
                low, _, high = v.partition(":")
                out = out | F.col("resseq").between(int(low), int(high or low))
            return out
        raise ValueError(f"{word!r} is no selector")

    def both() -> Column:
        nonlocal at
        out = term()
        while at < len(tokens) and tokens[at].lower() == "and":
            at += 1
            out = out & term()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at].lower() == "or":
            at += 1
            out = out | both()
        return out

    found = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} is not expected in {text!r}")
    return found


def select_atoms(atoms: DataFrame, text: str) -> DataFrame:
    return atoms.where(selection(text))


def select_residues(atoms: DataFrame, text: str) -> DataFrame:
    return select_atoms(atoms, text).groupBy(*RESIDUE).agg(F.min("residue").alias("residue"))


def residue_distances(atoms: DataFrame, cutoff: float, atom: str = "CA") -> DataFrame:
    """Pairs of residues whose atoms of one name lie within a cutoff."""
    return near_pairs(atoms.where(F.col("atom") == atom), ["structure"], "id", "xyz", cutoff, ("chain", "resseq"))


def interface_residues(atoms: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """Residues with an atom within a cutoff of an atom of another chain, and how many such pairs."""
    return near_counts(atoms, "structure", "id", "xyz", cutoff, "chain", "resseq").withColumnRenamed("n", "contacts")


def _angle(a: Column, b: Column, c: Column) -> Column:
    """At b, in degrees, of points that are structs (x, y, z)."""
    u, v = [a[k] - b[k] for k in "xyz"], [c[k] - b[k] for k in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))))))


def hydrogen_bonds(atoms: DataFrame, cutoff: float = 3.5, least_angle: float = 120.0) -> DataFrame:
    """Backbone N of one residue near the O of another, with both angles C-N..O and N..O-C wide enough. Pairs meet through cells of space."""
    at = lambda *names: F.max(F.when(F.col("atom").isin(*names), F.struct("x", "y", "z")))
    r = atoms.groupBy(*RESIDUE).agg(at("N").alias("n"), at("C").alias("c"), at("O", "OXT").alias("o")).where("c is not null")
    ends = F.explode(F.array(F.struct(F.lit("N").alias("kind"), F.col("n").alias("p")), F.struct(F.lit("O").alias("kind"), F.col("o").alias("p"))))
    points = r.select(*RESIDUE, "c", ends.alias("e")).where("e.p is not null")
    points = points.select(*RESIDUE, "c", "e.kind", "e.p", "e.p.x", "e.p.y", "e.p.z", F.struct("chain", "resseq", "e.kind").alias("id"))
    pairs = near_pairs(points, ["structure"], "id", "xyz", cutoff, ("kind", "chain", "resseq", "p", "c")).where("kind_a <> kind_b")
    donor_first = F.col("kind_a") == "N"
    side = lambda c, donor: F.when(donor_first == F.lit(donor), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    bonds = pairs.select("structure", *[side(c, d).alias(f"{who}_{c}") for who, d in (("donor", True), ("acceptor", False)) for c in ("chain", "resseq", "p", "c")], "distance")
    bonds = bonds.where("donor_chain <> acceptor_chain or donor_resseq <> acceptor_resseq")
    angle = F.least(_angle(F.col("donor_c"), F.col("donor_p"), F.col("acceptor_p")), _angle(F.col("donor_p"), F.col("acceptor_p"), F.col("acceptor_c")))
    return bonds.withColumn("angle", angle).where(F.col("angle") >= least_angle).drop("donor_p", "donor_c", "acceptor_p", "acceptor_c")


def ramachandran_region(phi: Column, psi: Column, residue: Column) -> Column:
    r = F.upper(residue)
    return (
        F.when(phi.isNull() | psi.isNull() | F.isnan(phi) | F.isnan(psi), "unknown")
        .when((r == "PRO") & phi.between(-105, -35) & psi.between(-80, 180), "proline_preferred")
        .when((r == "GLY") & phi.between(0, 180) & psi.between(-40, 180), "glycine_allowed")
        .when(phi.between(-160, -30) & psi.between(-90, 45), "alpha_helix")
        .when(phi.between(-180, -40) & psi.between(90, 180), "beta_sheet")
        .when(phi.between(30, 100) & psi.between(-90, 90), "left_handed_helix")
        .when(r == "GLY", "glycine_allowed")
        .otherwise("loop")
    )


def ramachandran_profile(atoms: DataFrame) -> DataFrame:
    names = atoms.groupBy(*RESIDUE).agg(F.min("residue").alias("residue"))
    t = backbone_torsions(atoms).join(names, RESIDUE)
    return t.withColumn("region", ramachandran_region(F.col("phi"), F.col("psi"), F.col("residue")))


def to_pdb(atoms: DataFrame) -> Column:
    """One ATOM line of an atom, by the columns of the format."""
    coordinate = lambda c: F.lpad(F.format_string("%.3f", F.col(c)), 8, " ")
    return F.concat(
        F.lit("ATOM  "), F.lpad((F.col("id") % 100000).cast("string"), 5, " "), F.lit(" "), F.rpad(F.concat(F.when(F.length("atom") < 4, " ").otherwise(""), F.col("atom")), 4, " "), F.lit(" "),
        F.lpad("residue", 3, " "), F.lit(" "), F.substring("chain", 1, 1), F.lpad((F.col("resseq") % 10000).cast("string"), 4, " "), F.lit("    "), *[coordinate(c) for c in "xyz"],
        F.lit("  1.00"), F.lpad(F.format_string("%.2f", F.col("bfactor")), 6, " "), F.lit(" " * 10), F.lpad(F.substring("atom", 1, 1), 2, " "),
    )


def write_pdb(atoms: DataFrame, path: str) -> None:
    """Sorted by structure, chain, residue and atom number, a folder for each structure."""
    rows = atoms.select("structure", "chain", "resseq", "id", to_pdb(atoms).alias("value")).repartition("structure").sortWithinPartitions("structure", "chain", "resseq", "id")
    rows.select("structure", "value").write.mode("overwrite").partitionBy("structure").text(path)
