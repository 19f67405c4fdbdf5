"""Range joins between spans and places; an equal file is always part of the join, so no cross product is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines in a bucket of the range join.
BUCKET = 64


def containing(spans: DataFrame, places: DataFrame) -> DataFrame:
    """Every (span, place) of a file with span.start <= place.start and place.stop <= span.stop.

    ``spans(span, file, start, stop)``, ``places(place, file, at, until)``. A span stands in each bucket of lines that
    it meets, a place in the bucket of its start, so a file with any share of the rows is dealt over its buckets.
    """
    cut = lambda c: F.floor(F.col(c) / BUCKET)
    s = spans.withColumn("bucket", F.explode(F.sequence(cut("start"), cut("stop"))))
    p = places.withColumn("bucket", cut("at"))
    return s.join(p, ["file", "bucket"]).where("start <= at and until <= stop").drop("bucket")


def innermost(spans: DataFrame, places: DataFrame) -> DataFrame:
    """The span that holds each place most closely: the latest start, then the earliest stop, then the span's id."""
    of = W.partitionBy("place").orderBy(F.desc("start"), "stop", "span")
    return containing(spans, places).withColumn("k", F.row_number().over(of)).where("k = 1").select("place", "span", "file")
