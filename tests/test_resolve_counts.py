"""Counts in place of lists of candidates."""

import random

from pyspark.sql import functions as F

from factloom.operators import resolve

SYMBOLS = "id string, name string, qualified_name string, file string, signature string, definition boolean, kind string"
REFERENCES = "id string, owner_id string, raw_name string, target_module string, file string, call_kind string, type_use boolean, receiver_unsafe boolean"


def test_counts_equal_the_lists(spark, monkeypatch):
    rng = random.Random(5)
    pick = rng.choice
    symbols = [(f"s{k}", pick("abc"), pick(["m.a", "m.b", "a", "n.a"]), pick("xy"), pick(["", "i", None]), rng.random() < 0.4, pick(["Function", "Class"])) for k in range(14)]
    symbols += symbols[:2]  # a symbol that stands twice is one candidate
    refs = [(f"r{k}", pick(["o", "s1", "s2", "s5", "s9"]), pick(["a", "b", ".m.a.", "n.a", "zz", "m.c", ""]), pick(["m", "n", None]), pick("xyz"), pick(["direct", "direct", "indirect"]), pick([True, False, None]), pick([True, False])) for k in range(400)]
    refs, symbols = spark.createDataFrame(refs, REFERENCES), spark.createDataFrame(symbols, SYMBOLS)
    columns = ["id", "status", "resolved_id", "strategy", "n_candidates", "confidence"]
    want = sorted(map(tuple, resolve.resolve(refs, symbols).withColumn("n_candidates", F.size("candidates").cast("long")).select(columns).collect()), key=str)
    for most in (50_000, 0):  # broadcast, and by shuffle
        monkeypatch.setattr(resolve, "BROADCAST_ANSWERS", most)
        assert sorted(map(tuple, resolve.resolve_counts(refs, symbols).select(columns).collect()), key=str) == want
    assert {w[1] for w in want} == {"resolved", "ambiguous", "unresolved"} and len({w[3] for w in want}) == 5
