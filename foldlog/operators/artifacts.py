"""Replay artifacts: a content-addressed record an execution, over digests of its parts, and what is wrong with one.

An artifact's parts (fingerprints, references, mappings, snapshots) stay tables of rows, of any size; the record holds, for each, how many rows
there are and a digest that does not depend on their order, so it is bounded however long an execution is. The record's hash is
that of its canonical text without the hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.functions.hashing import fnv1a
from foldlog.functions.json_text import first_unsafe_path

# Versions and names that a valid artifact has.
SCHEMA_VERSION, HASH_ALGORITHM, NORMALIZATION, SERIALIZATION = "v1-alpha.1", "fnv1a-32", 1, 1
RECORD = (
    "artifactId string, createdAt string, eventCount long, executionId string, integrity struct<artifactHash: string, artifactHashAlgorithm: string, deterministicSerializationVersion: int, normalizationVersion: int>, "
    "parts map<string, string>, schemaVersion string"
)
#: Hexadecimal digits of a row's SHA-256 in each of the two sums of a digest.
LANE = 15


def part_digest(rows: DataFrame, by: str, text: Column) -> DataFrame:
    """(by, digest): `n:a:b` of the rows' texts, n their number, a and b sums of parts of their hashes. Row order does not matter, repeats do."""
    lane = lambda k: F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1 + k * LANE, LANE), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(lane(0)).cast("decimal(38,0)").alias("a"), F.sum(lane(1)).cast("decimal(38,0)").alias("b"))
    return sums.select(by, F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "a", "b"))).alias("digest"))


def record(by: str, artifact_hash: Column | None) -> Column:
    """The record as JSON text, keys in order; without a hash the text that is hashed."""
    named = [] if artifact_hash is None else [artifact_hash.alias("artifactHash")]
    integrity = F.struct(*named, *(F.col(f"_{c}").alias(c) for c in ("artifactHashAlgorithm", "deterministicSerializationVersion", "normalizationVersion")))
    return F.to_json(F.struct(F.col("artifactId"), F.col("createdAt"), F.col("eventCount"), F.col(by).cast("string").alias("executionId"), integrity.alias("integrity"), F.col("parts"), F.col("schemaVersion")))


def with_hash(fields: DataFrame, by: str) -> DataFrame:
    return fields.withColumn("artifact_hash", F.concat(F.lit("fnv1a:"), fnv1a(record(by, None))))


def assembled(heads: DataFrame, parts: dict[str, DataFrame], by: str) -> DataFrame:
    """(by, artifact, artifact_hash): heads (by, artifactId, createdAt, eventCount) joined with the digests of all parts.

    parts: {name: (by, text)}. An execution without rows of a part has `0` for it. One aggregation and one join a part.
    """
    joined, names = heads, sorted(parts)
    for name in names:
        joined = joined.join(part_digest(parts[name], by, F.col("text")).withColumnRenamed("digest", f"_part_{name}"), by, "left")
    fields = joined.withColumns({
        "parts": F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(f"_part_{n}", F.lit("0")) for n in names))), "schemaVersion": F.lit(SCHEMA_VERSION),
        "_artifactHashAlgorithm": F.lit(HASH_ALGORITHM), "_deterministicSerializationVersion": F.lit(SERIALIZATION), "_normalizationVersion": F.lit(NORMALIZATION),
    })
    return with_hash(fields, by).select(by, record(by, F.col("artifact_hash")).alias("artifact"), "artifact_hash")


def record_problems(artifacts: DataFrame, by: str) -> DataFrame:
    """(by, problem, detail) of records (by, artifact): versions, missing fields, a hash that does not fit, contents that must not be there."""
    read = artifacts.select(by, "artifact", F.from_json("artifact", RECORD).alias("r"))
    i = lambda c: F.col(f"r.integrity.{c}")
    fields = read.select(by, "artifact", "r", *(F.col(f"r.{c}").alias(c) for c in ("artifactId", "createdAt", "eventCount", "parts", "schemaVersion")), *(i(c).alias(f"_{c}") for c in ("artifactHashAlgorithm", "deterministicSerializationVersion", "normalizationVersion")))
    told = with_hash(fields, by)
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    differs = lambda c, v: ~F.coalesce(c == v, F.lit(False))
    rules = {
        "schemaVersion": differs(F.col("schemaVersion"), SCHEMA_VERSION), "normalizationVersion": differs(i("normalizationVersion"), NORMALIZATION), "deterministicSerializationVersion": differs(i("deterministicSerializationVersion"), SERIALIZATION),
        "artifactHashAlgorithm": differs(i("artifactHashAlgorithm"), HASH_ALGORITHM), "missing artifactId": missing(F.col("artifactId")), "missing executionId": missing(F.col("r.executionId")), "missing createdAt": missing(F.col("createdAt")),
        "missing artifactHash": missing(i("artifactHash")), "artifactHash mismatch": ~missing(i("artifactHash")) & (i("artifactHash") != F.col("artifact_hash")), "missing parts": F.col("parts").isNull(), "raw contents": first_unsafe_path(F.col("artifact")).isNotNull(),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return told.select(by, F.explode(found).alias("problem"), F.lit(None).cast("string").alias("detail"))


def part_problems(artifacts: DataFrame, parts: dict[str, DataFrame], by: str) -> DataFrame:
    """(by, problem, detail): parts whose rows are no longer those that the record names, or that it names while there are none."""
    named = artifacts.select(by, F.explode(F.from_json("artifact", RECORD)["parts"]).alias("part", "digest"))
    now = reduce(DataFrame.unionByName, [part_digest(rows, by, F.col("text")).withColumn("part", F.lit(name)) for name, rows in parts.items()])
    both = named.join(now.withColumnRenamed("digest", "now"), [by, "part"], "left")
    return both.where(F.col("digest") != F.coalesce("now", F.lit("0"))).select(by, F.when(F.col("now").isNull(), "part is empty").otherwise("part differs").alias("problem"), F.col("part").alias("detail"))


def step_problems(steps: DataFrame, mapped: DataFrame, unmapped: DataFrame, by: str, step: str) -> DataFrame:
    """(by, problem, detail): steps mapped or unmapped twice, neither, both, or unknown. One aggregation over all three tables."""
    tagged = lambda df, kind: df.select(by, F.col(step).cast("string").alias("detail"), F.lit(kind).alias("kind"))
    rows = tagged(steps, "s").unionByName(tagged(mapped, "m")).unionByName(tagged(unmapped, "u"))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    n = rows.groupBy(by, "detail").agg(of("s"), of("m"), of("u"))
    rules = {
        "duplicate mapped step": F.col("m") > 1, "duplicate unmapped step": F.col("u") > 1, "step is neither mapped nor unmapped": (F.col("s") > 0) & (F.col("m") + F.col("u") == 0), "step is mapped and unmapped": (F.col("m") > 0) & (F.col("u") > 0),
        "unknown mapped step": (F.col("s") == 0) & (F.col("m") > 0), "unknown unmapped step": (F.col("s") == 0) & (F.col("u") > 0),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return n.select(by, F.explode(found).alias("problem"), "detail")


def artifact_problems(artifacts: DataFrame, parts: dict[str, DataFrame], steps: DataFrame, mapped: DataFrame, unmapped: DataFrame, by: str, step: str) -> DataFrame:
    """All of record_problems(), part_problems() and step_problems(). Artifacts without a problem give no row; what is no JSON misses everything."""
    return record_problems(artifacts, by).unionByName(part_problems(artifacts, parts, by)).unionByName(step_problems(steps, mapped, unmapped, by, step))
