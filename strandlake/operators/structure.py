"""Atoms as one flat table: geometry, contacts, torsions; points in the plane: neighbours and autocorrelation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Atomic masses, and one-letter codes of residues.
MASSES = {"C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "H": 1.008, "P": 30.974}
LETTERS = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def mass(atom: Column) -> Column:
    """By the element, which is the first letter of an atom's name."""
    return lookup(MASSES, F.substring(atom, 1, 1), 12.011)


def center_of_mass(df: DataFrame, by: list[str]) -> DataFrame:
    m = mass(F.col("atom"))
    return df.groupBy(*by).agg(*[(F.sum(m * F.col(c)) / F.sum(m)).alias(c) for c in "xyz"])


def bounding_box(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def radius_of_gyration(df: DataFrame, by: list[str]) -> DataFrame:
    """From sums, in one pass: sum m r2 / sum m less the squared centre."""
    m = mass(F.col("atom"))
    r2 = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    s = df.groupBy(*by).agg(F.sum(m).alias("_m"), F.sum(m * r2).alias("_r"), *[F.sum(m * F.col(c)).alias(f"_{c}") for c in "xyz"])
    mean2 = sum(((F.col(f"_{c}") / F.col("_m")) ** 2 for c in "xyz"), F.lit(0.0))
    return s.select(*by, F.sqrt(F.col("_r") / F.col("_m") - mean2).alias("radius"))


def sequences(df: DataFrame) -> DataFrame:
    """One letter a residue, in order, of each chain; a chain's residues meet in one row."""
    letters = df.groupBy("structure", "chain", "resseq").agg(F.min("residue").alias("r"))
    one = F.struct("resseq", lookup(LETTERS, F.col("r"), "X").alias("l"))
    return letters.groupBy("structure", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["l"]), "").alias("sequence"))


def near_pairs(df: DataFrame, by: list[str], key: str, axes: str, cutoff: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b at most a cutoff apart, with their distance. Points meet through cells as wide as the cutoff, so work follows density, not the square of all.

    One side has each point in all cells around it, which no estimate of sizes counts: it must not be broadcast.
    """
    cell = [F.floor(F.col(c) / cutoff) for c in axes]
    left = df.select(*by, F.col(key).alias("a"), *[F.col(c).alias(f"{c}1") for c in axes], *[F.col(c).alias(f"{c}_a") for c in carry], *[x.alias(f"_{i}") for i, x in enumerate(cell)])
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)]) for s in itertools.product((-1, 0, 1), repeat=len(axes))])
    right = df.select(*by, F.col(key).alias("b"), *[F.col(c).alias(f"{c}2") for c in axes], *[F.col(c).alias(f"{c}_b") for c in carry], F.explode(steps).alias("s"), *[x.alias(f"_c{i}") for i, x in enumerate(cell)])
    right = right.select(*by, "b", *[f"{c}2" for c in axes], *[f"{c}_b" for c in carry], *[(F.col(f"_c{i}") + F.col(f"s.d{i}")).alias(f"_{i}") for i in range(len(axes))])
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in axes), F.lit(0.0)))
    pairs = left.join(right.hint("merge"), [*by, *[f"_{i}" for i in range(len(axes))]]).where("a < b").withColumn("distance", d)
    return pairs.where(F.col("distance") <= cutoff).select(*by, "a", "b", *[f"{c}_{s}" for c in carry for s in "ab"], "distance")


def chain_contacts(df: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """Contacts of CA atoms between different chains."""
    p = near_pairs(df.where("atom = 'CA'"), ["structure"], "id", "xyz", cutoff, ("chain",)).where("chain_a <> chain_b")
    return p.groupBy("structure", F.least("chain_a", "chain_b").alias("chain_a"), F.greatest("chain_a", "chain_b").alias("chain_b")).agg(F.count(F.lit(1)).alias("contacts"))


def disulfides(df: DataFrame, cutoff: float = 2.2) -> DataFrame:
    return near_pairs(df.where("residue = 'CYS' and atom = 'SG'"), ["structure"], "id", "xyz", cutoff)


def flexible(df: DataFrame, percentile: float = 0.9) -> DataFrame:
    """Residues whose mean B factor reaches a percentile of their structure's residues."""
    r = df.groupBy("structure", "chain", "resseq").agg(F.avg("bfactor").alias("b"))
    limit = r.groupBy("structure").agg(F.percentile("b", percentile).alias("_p"))
    return r.join(limit, "structure").where(F.col("b") >= F.col("_p")).drop("_p")


def torsion(p: list[Column]) -> Column:
    """Dihedral angle, in degrees, of four points that are structs (x, y, z)."""
    sub = lambda a, b: [a[c] - b[c] for c in "xyz"]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2)))


def backbone_torsions(df: DataFrame) -> DataFrame:
    """phi and psi of each residue with whole neighbours numbered one less and one more."""
    at = lambda name: F.max(F.when(F.col("atom") == name, F.struct("x", "y", "z")))
    r = df.groupBy("structure", "chain", "resseq").agg(at("N").alias("n"), at("CA").alias("ca"), at("C").alias("c"))
    w = Window.partitionBy("structure", "chain").orderBy("resseq")
    r = r.withColumns({"_c": F.when(F.lag("resseq").over(w) == F.col("resseq") - 1, F.lag("c").over(w)), "_n": F.when(F.lead("resseq").over(w) == F.col("resseq") + 1, F.lead("n").over(w))})
    k = F.col
    return r.select("structure", "chain", "resseq", torsion([k("_c"), k("n"), k("ca"), k("c")]).alias("phi"), torsion([k("n"), k("ca"), k("c"), k("_n")]).alias("psi"))


def collapse_altlocs(df: DataFrame, by: list[str]) -> DataFrame:
    """One atom of each alternative: the largest occupancy, then the first label."""
    rest = [c for c in df.columns if c not in by]
    best = F.min(F.struct((-F.col("occupancy")).alias("_o"), F.col("altloc").alias("_a"), F.struct(*rest).alias("_r")))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, "b._r.*")


# --- points in the plane ---------------------------------------------------------------------------------------------


def degrees(df: DataFrame, key: str, radius: float) -> DataFrame:
    p = near_pairs(df, [], key, "xy", radius)
    both = p.select(F.explode(F.array("a", "b")).alias(key))
    n = both.groupBy(key).agg(F.count(F.lit(1)).alias("neighbours"))
    return df.select(key).join(n, key, "left").select(key, F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def moran(df: DataFrame, key: str, value: str, radius: float) -> DataFrame:
    """Moran's I with neighbours within a radius: one row."""
    mean = F.broadcast(df.agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("v")))
    p = near_pairs(df, [], key, "xy", radius, (value,)).crossJoin(mean)
    s = p.agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col(f"{value}_a") - F.col("m")) * (F.col(f"{value}_b") - F.col("m"))).alias("c"), F.max("v").alias("v"))
    return s.select("pairs", (F.col("c") / F.col("pairs") / F.col("v")).alias("moran_i"))


def neighbour_labels(df: DataFrame, key: str, label: str, radius: float) -> DataFrame:
    """How often spots of two labels are neighbours."""
    p = near_pairs(df, [], key, "xy", radius, (label,))
    return p.groupBy(F.least(f"{label}_a", f"{label}_b").alias("label_a"), F.greatest(f"{label}_a", f"{label}_b").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
