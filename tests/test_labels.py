from pyspark.sql import functions as F

from strandlake.operators import labels as lb


def test_known_labels(spark):
    row = spark.range(1).select(
        lb.tier(F.lit("stop_gained")), lb.tier(F.lit("synonymous_variant")), lb.tier(F.lit("?")), lb.impact(F.lit("missense_variant")),
        lb.star_allele(F.lit("CYP2C19"), F.lit("rs4244285")), lb.activity(F.lit("*1/*4")), lb.metabolizer(lb.activity(F.lit("*2+*2"))), lb.motif_hits(F.lit("TATA"), ("TW",)),
    ).first()
    assert tuple(row) == (1, 4, 3, "MODERATE", "*2", 1.0, "normal_metabolizer", 2)
