"""Effect contracts of functions: agreed callees, acquire/release pairs, consumed parameters, bindings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that mark the halves of a pair; fixed values.
ACQUIRE = ("acquire", "acquires", "acquired", "acquiring", "tryacquire", "try", "lock", "locks", "locked", "locking")
RELEASE = ("release", "releases", "released", "releasing", "unlock", "unlocks", "unlocked", "unlocking")
#: Words of a name in camel or snake case; a run of capitals is one word. Fixed value.
NAME_WORDS = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"


def agreed_callees(calls: DataFrame) -> DataFrame:
    """(file, owner, line, callee) of the sites of ``calls(file, owner, line, callee)`` that name exactly one callee."""
    rows = calls.groupBy("file", "owner", "line").agg(F.min("callee").alias("callee"), F.max("callee").alias("other"))
    return rows.where("callee = other").drop("other")


def words(name: Column) -> Column:
    """Lower-cased words of a name in camel or snake case."""
    return F.transform(F.regexp_extract_all(name, F.lit(NAME_WORDS), F.lit(0)), F.lower)


def pair_half(name: Column) -> Column:
    """acquire, release, or null if the name has words of neither or of both kinds."""
    a = F.arrays_overlap(words(name), F.array(*map(F.lit, ACQUIRE)))
    r = F.arrays_overlap(words(name), F.array(*map(F.lit, RELEASE)))
    return F.when(a & ~r, "acquire").when(r & ~a, "release")


def pair_stem(name: Column) -> Column:
    """The name's words without those of its half, joined; null without a half or if none is left."""
    rest = F.array_join(F.filter(words(name), lambda w: ~w.isin(*ACQUIRE, *RELEASE)), "")
    return F.when(pair_half(name).isNotNull() & (rest != ""), rest)


def pairs(functions: DataFrame) -> DataFrame:
    """(stem, acquire, release) for the functions ``functions(name, subject)`` that share a stem and a subject."""
    rows = functions.select("name", "subject", pair_half(F.col("name")).alias("half"), pair_stem(F.col("name")).alias("stem")).where("stem is not null").distinct()
    a = rows.where("half = 'acquire'").select("stem", "subject", F.col("name").alias("acquire"))
    return a.join(rows.where("half = 'release'").select("stem", "subject", F.col("name").alias("release")), ["stem", "subject"]).select("stem", "acquire", "release").distinct()


def _split(text: str | None) -> list[str]:
    inner = (text or "").strip()
    start = inner.find("(")
    depth, part, out = 0, "", []
    for c in inner[start + 1 :] if start >= 0 else "":
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            if depth == 0:
                break
            depth -= 1
        if c == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
    out.append(part)
    names = []
    for p in out:
        bare = p.split("=")[0].split(":")[0].split("[")[0]
        pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", bare)
        found = [pointer[1]] if pointer else re.findall(r"\w+", bare)
        if found and found[-1] != "void":
            names.append(found[-1])
    return names


def parameters(signature: Column | str) -> Column:
    """Names of the parameters of a signature: split at commas outside brackets, last identifier of each (of a function
    pointer the name it points from), without defaults."""

    def split(values: pd.Series) -> pd.Series:
        return values.map(_split)

    return F.pandas_udf(split, T.ArrayType(T.StringType()))(signature)


def consumed(functions: DataFrame, releases: DataFrame) -> DataFrame:
    """(name, ordinal) of functions that release exactly one of their parameters on every body of that name.

    ``functions(owner, name, params)``, ``releases(owner, subject)``; names whose bodies disagree go.
    """
    met = functions.join(releases, "owner").withColumn("ordinal", F.array_position("params", F.col("subject")) - 1).where("ordinal >= 0")
    rows = met.groupBy("name").agg(F.min("ordinal").alias("ordinal"), F.max("ordinal").alias("other"))
    return rows.where("ordinal = other").select("name", F.col("ordinal").cast("long").alias("ordinal"))


def bind_parameters(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(site, callee, ordinal, argument, parameter) by position; an empty argument keeps its place.

    ``calls(site, callee, arguments)``, ``functions(callee, params)`` with one parameter list for each callee.
    """
    one = functions.groupBy("callee").agg(F.min("params").alias("params"), F.max("params").alias("other")).where("params = other").drop("other")
    a = calls.select("site", "callee", F.posexplode("arguments").alias("ordinal", "argument")).where("argument <> ''")
    return a.join(one, "callee").where(F.col("ordinal") < F.size("params")).select("site", "callee", "ordinal", "argument", F.get("params", F.col("ordinal")).alias("parameter"))


def verdict(acquire: Column, release: Column, declared: dict[str, tuple[str, ...]]) -> Column:
    """valid, mismatch or unknown for an allocator and a deallocator."""
    known = F.array(*(F.lit(r) for r in sorted({x for v in declared.values() for x in v})))
    out = F.lit("unknown")
    for a, ok in declared.items():
        out = F.when(acquire == a, F.when(release.isin(*ok), "valid").when(F.array_contains(known, release), "mismatch").otherwise("unknown")).otherwise(out)
    return out


def merge_sites(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """External call sites ``sites(site, file, line, root)`` met with calls ``(file, line, raw_name)`` whose name ends in
    the site's: state matched, ambiguous or missing, and how many."""
    met = sites.join(calls, ["file", "line"], "left").withColumn("hit", F.lower("raw_name").endswith(F.lower("root")).cast("long"))
    rows = met.groupBy("site").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("calls"))
    return rows.withColumn("state", F.when(F.col("calls") == 1, "matched").when(F.col("calls") > 1, "ambiguous").otherwise("missing"))


def classpath(entries: DataFrame) -> DataFrame:
    """(entries, fingerprint) of ``entries(position, path)``: normalised, each once at its first place, order counts."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+$", "")
    first = entries.select("position", path.alias("path")).where("path <> ''").groupBy("path").agg(F.min("position").alias("position"))
    ordered = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda s: s["path"]).alias("paths"))
    return ordered.select(F.size("paths").cast("long").alias("entries"), F.concat(F.lit("cp:"), F.sha2(F.array_join("paths", "\n"), 256)).alias("fingerprint"))
