"""Registered queries of the join workbench, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern import operators as op
from kvern.functions import in_unit_column, joined_text, lcg_uniform, partition_of, tuple_text
from kvern.functions.random import MODULUS, MULTIPLIER
from kvern.operators.partition import placed
from kvern.plans.report import REPORT_ID, json_column, sweep_table
from kvern.sources import as_relation, pmf, sequential, weights, zipf, zipf_grid

PARTITIONS, WORKERS = 32, 8
ZIPF_ROWS, ZIPF_KEYS, ZIPF_SKEW = 100_000, 1000, 1.05
LCG_ROWS, LCG_SEED = 5000, 123456789


def _relation(spark: SparkSession, sf_dir: str, table: str, key: str, payload: str | None = None) -> DataFrame:
    return as_relation(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, payload)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, sf_dir, "orders", "o_orderkey")


def _lines(spark: SparkSession, sf_dir: str, payload: str | None = None) -> DataFrame:
    return _relation(spark, sf_dir, "lineitem", "l_orderkey", payload)


def _open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_relation(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'"), "o_orderkey")


def no_partitioning_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.no_partitioning(_orders(spark, sf_dir), _lines(spark, sf_dir)))


def no_partitioning_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.no_partitioning(_open_orders(spark, sf_dir), _lines(spark, sf_dir)))


def radix_count_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.radix(_orders(spark, sf_dir), _lines(spark, sf_dir), partitions=32))


def radix_count_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.radix(_open_orders(spark, sf_dir), _lines(spark, sf_dir), partitions=7))


def radix_count_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.radix(_open_orders(spark, sf_dir), _lines(spark, sf_dir), adaptive=True))


def duplicate_build_semi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.no_partitioning(_lines(spark, sf_dir), _orders(spark, sf_dir)))


def duplicate_build_radix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.radix(_lines(spark, sf_dir), _orders(spark, sf_dir), partitions=PARTITIONS))


def joined_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.joined_tuples(_relation(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), _lines(spark, sf_dir, "l_partkey"))


def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exists(_orders(spark, sf_dir), _lines(spark, sf_dir))


def get_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.get_first(_orders(spark, sf_dir), _lines(spark, sf_dir, "l_partkey"))
    return found.withColumn("payload", F.coalesce("payload", F.lit(-1).cast("long")))


def get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.get_all(_open_orders(spark, sf_dir), _lines(spark, sf_dir, "l_partkey"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders, the dense order key as index."""
    return _relation(spark, sf_dir, "orders", "o_custkey", "o_orderkey")


def partition_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).withColumn("partition", partition_of("id", PARTITIONS))


def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sizes(_orders(spark, sf_dir), PARTITIONS)


def partition_sizes_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More partitions than nations: some are empty."""
    return op.sizes(_relation(spark, sf_dir, "nation", "n_nationkey"), 2 * PARTITIONS)


def radix_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt to partitions: each row with how many rows its physical partition's hash class has."""
    dealt = op.radix_partition(_indexed(spark, sf_dir), PARTITIONS).withColumn("at", F.spark_partition_id())
    # A key is in one partition: rows are all there, and no key is in two.
    return dealt.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("partitions"))


def partition_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.boundaries(op.sizes(_indexed(spark, sf_dir), PARTITIONS))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_indexed(spark, sf_dir), PARTITIONS, WORKERS)


def worker_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(_placed(spark, sf_dir))


def worker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.prefix_sums(op.histogram(_placed(spark, sf_dir)))


def clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cluster(_indexed(spark, sf_dir), PARTITIONS, WORKERS)


def partitionwise_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = op.radix(_open_orders(spark, sf_dir), _lines(spark, sf_dir), partitions=PARTITIONS)
    return op.matches_by_partition(matched, PARTITIONS)


def sequential_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential(spark, 5000)


def zipf_relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frequency_profile(zipf_grid(spark, ZIPF_ROWS, ZIPF_SKEW, ZIPF_KEYS))


def fk_frequency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frequency_profile(_relation(spark, sf_dir, "lineitem", "l_partkey"))


def tuple_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relation(spark, sf_dir, "part", "p_partkey", "p_size").select(tuple_text().alias("line"))


#: Invented durations (ns) of some runs, for the report queries: algorithm, phase, duration.
SAMPLE = [(a, p, 1_000_000 * n + 999) for a, times in (("NoPartitioning", (0, 21, 1300)), ("Radix32", (450, 7, 90)), ("Radix1024", (1005, 3, 62))) for p, n in zip(("Partition", "Build", "Probe"), times, strict=True)]


def _sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, "algorithm string, phase string, duration long")


def phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_table(_sample(spark), ["NoPartitioning", "Radix32", "Radix1024"])


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of the sample's runs."""
    runs = _sample(spark).groupBy("algorithm").pivot("phase", ["Partition", "Build", "Probe"]).agg(F.first(in_unit_column("duration", "ms")))
    named = F.create_map(F.lit("Type"), F.col("algorithm"), F.lit("Skew"), F.lit("1.050000"))
    return json_column(runs.select(F.lit(REPORT_ID).alias("id"), named.alias("parameters"), *(F.col(p.capitalize()).alias(p) for p in ("partition", "build", "probe"))))


def unit_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark).select("algorithm", "phase", *(in_unit_column("duration", u).alias(u) for u in ("ns", "us", "ms", "s")))


def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_tuples(spark, sf_dir).select(joined_text().alias("line"))


def lcg_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcg_uniform(spark, LCG_ROWS, LCG_SEED).select("id", "state")


def zipf_by_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewed keys, looked up in the cumulated distribution by the congruential sequence."""
    return zipf(spark, LCG_ROWS, ZIPF_SKEW, 1, 100, seed=LCG_SEED, uniform="lcg")


def zipf_counts_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 10 000 draws each by either sampler, the keys that come up more often than the key before: none."""
    drawn = [zipf(spark, 10_000, 0.99, 1, 10, seed=123456789, sampler=s).withColumn("sampler", F.lit(s)) for s in ("table", "rejection")]
    return drawn[0].unionByName(drawn[1]).groupBy("sampler").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).crossJoin(
        F.broadcast(op.rising_keys(op.frequency_profile(drawn[0])).unionByName(op.rising_keys(op.frequency_profile(drawn[1]))).agg(F.count(F.lit(1)).alias("rising")))
    )  # one row


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets for a table of each supplier's lines, at both default ratios."""
    lines = _relation(spark, sf_dir, "lineitem", "l_suppkey").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return lines.select("id", op.bucket_count_column("n", 1.25).alias("probing"), op.bucket_count_column("n", 0.25).alias("chaining"))


def salted_radix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matched_count(op.radix(_open_orders(spark, sf_dir), _lines(spark, sf_dir), partitions=PARTITIONS, salt=4))


def counted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.counted_matches(_open_orders(spark, sf_dir), _lines(spark, sf_dir))


def busiest_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workers, with rows and distinct parts as their durations."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spent = lines.groupBy(F.col("l_suppkey").alias("worker")).agg(F.count(F.lit(1)).alias("build"), F.countDistinct("l_partkey").alias("probe"))
    return op.busiest(spent)


_QUERIES = (
    no_partitioning_count, no_partitioning_selective, radix_count_32, radix_count_7, radix_count_adaptive, duplicate_build_semi_count,
    duplicate_build_radix_count, joined_tuples, exists_flag, get_first, get_all, partition_assignment, partition_sizes, partition_boundaries,
    worker_histogram, worker_offsets, clustered_layout, partitionwise_match_counts, sequential_relation, zipf_relation_histogram,
    fk_frequency_profile, tuple_texts, phase_pivot, unit_cast, busiest_worker, partition_sizes_with_empty, radix_partition_rows, report_json,
    joined_texts, lcg_sequence, zipf_by_lcg, zipf_counts_rise, bucket_counts, salted_radix_count, counted_matches,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_ALL = "SELECT count(*) AS matched FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"
_OPEN = "SELECT count(*) AS matched FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
_DUPLICATES = "SELECT count(*) AS matched FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"
#: Workers and batches by the rule of 10 000 rows at least, from the number of orders.
_SPLIT = f"""
r AS (SELECT count(*) AS n FROM orders),
s AS (SELECT CASE WHEN n // {WORKERS} >= 10000 THEN {WORKERS} ELSE (n + 9999) // 10000 END AS w, greatest(n // {WORKERS}, 10000) AS b FROM r),
o AS (SELECT o_custkey AS id, o_orderkey AS payload, CAST(o_custkey % {PARTITIONS} AS INTEGER) AS partition,
             CAST(least(o_orderkey // b, w - 1) AS INTEGER) AS worker FROM orders, s)"""
_HISTOGRAM = "h AS (SELECT partition, worker, count(*) AS n FROM o GROUP BY 1, 2)"


def _zipf_sql() -> str:
    grid = [int(w) for w in (weights(ZIPF_SKEW, ZIPF_KEYS) * 1_000_000)]
    table = ", ".join(f"({k + 1}, {w})" for k, w in enumerate(grid))
    return f"""
WITH g(id, w) AS (VALUES {table}),
c AS (SELECT id, sum(w) OVER (ORDER BY id) - w AS low, sum(w) OVER (ORDER BY id) AS high FROM g),
u AS (SELECT (i * 48271 + 11) % (SELECT sum(w) FROM g) AS x FROM range({ZIPF_ROWS}) t(i))
SELECT CAST(id AS BIGINT) AS id, count(*) AS n FROM u JOIN c ON x >= low AND x < high GROUP BY 1"""


_LCG = f"WITH RECURSIVE r(id, state) AS (SELECT CAST(0 AS BIGINT), CAST({LCG_SEED} AS BIGINT) * {MULTIPLIER} % {MODULUS} UNION ALL SELECT id + 1, state * {MULTIPLIER} % {MODULUS} FROM r WHERE id + 1 < {LCG_ROWS})"


def _zipf_lcg_sql() -> str:
    cumulated = ", ".join(f"({k + 1}, CAST('{float(c)!r}' AS DOUBLE))" for k, c in enumerate(pmf(ZIPF_SKEW, 100).cumsum()))
    return f"{_LCG}, c(k, high) AS (VALUES {cumulated}) SELECT CAST((SELECT coalesce(min(k), 100) FROM c WHERE high > state / CAST({MODULUS} AS DOUBLE)) AS BIGINT) AS id, id AS payload FROM r"


def oracle_sql() -> dict[str, str]:
    sample = ", ".join(f"('{a}', '{p}', {n})" for a, p, n in SAMPLE)
    return {
        "no_partitioning_count": _ALL,
        "no_partitioning_selective": _OPEN,
        "radix_count_32": _ALL,
        "radix_count_7": _OPEN,
        "radix_count_adaptive": _OPEN,
        "duplicate_build_semi_count": _DUPLICATES,
        "duplicate_build_radix_count": _DUPLICATES,
        "joined_tuples": "SELECT o_orderkey AS id, o_custkey AS payload_a, l_partkey AS payload_b FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "exists_flag": "SELECT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders",
        "get_first": "SELECT o_orderkey AS id, coalesce(min(l_partkey), -1) AS payload, count(l_partkey) AS matches FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
        "get_all": "SELECT o_orderkey AS id, l_partkey AS payload FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
        "partition_assignment": f"SELECT o_custkey AS id, o_orderkey AS payload, CAST(o_custkey % {PARTITIONS} AS INTEGER) AS partition FROM orders",
        "partition_sizes": f"SELECT CAST(p AS INTEGER) AS partition, count(o_orderkey) AS n FROM range({PARTITIONS}) t(p) LEFT JOIN orders ON o_orderkey % {PARTITIONS} = p GROUP BY 1",
        "partition_sizes_with_empty": f"SELECT CAST(p AS INTEGER) AS partition, count(n_nationkey) AS n FROM range({2 * PARTITIONS}) t(p) LEFT JOIN nation ON n_nationkey % {2 * PARTITIONS} = p GROUP BY 1",
        "radix_partition_rows": "SELECT o_custkey AS id, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM orders GROUP BY 1",
        "report_json": f"""SELECT '{{"id":"{REPORT_ID}","parameters":{{"Skew":"1.050000","Type":"' || a || '"}},"results":{{"partition":"' || max(d // 1000000) FILTER (p = 'Partition') || '","build":"' || max(d // 1000000) FILTER (p = 'Build') || '","probe":"' || max(d // 1000000) FILTER (p = 'Probe') || '"}}}}' AS json FROM (VALUES {sample}) v(a, p, d) GROUP BY a""",
        "joined_texts": "SELECT concat_ws(', ', o_orderkey, o_custkey, l_partkey) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "lcg_sequence": f"{_LCG} SELECT * FROM r",
        "zipf_by_lcg": _zipf_lcg_sql(),
        "zipf_counts_rise": "SELECT s AS sampler, CAST(10000 AS BIGINT) AS n, CAST(1 AS BIGINT) AS least, CAST(10 AS BIGINT) AS most, CAST(0 AS BIGINT) AS rising FROM (VALUES ('table'), ('rejection')) v(s)",
        "bucket_counts": "SELECT l_suppkey AS id, CAST(ceil(count(*) * 1.25) AS BIGINT) AS probing, CAST(ceil(count(*) * 0.25) AS BIGINT) AS chaining FROM lineitem GROUP BY 1",
        "salted_radix_count": _OPEN,
        "counted_matches": _OPEN,
        "partition_boundaries": f"""WITH z AS (SELECT CAST(p AS INTEGER) AS partition, count(o_custkey) AS n FROM range({PARTITIONS}) t(p) LEFT JOIN orders ON o_custkey % {PARTITIONS} = p GROUP BY 1)
SELECT partition, CAST(sum(n) OVER (ORDER BY partition) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY partition) AS BIGINT) AS "end" FROM z""",
        "worker_histogram": f"WITH {_SPLIT}, {_HISTOGRAM} SELECT * FROM h",
        "worker_offsets": f'WITH {_SPLIT}, {_HISTOGRAM} SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY partition ORDER BY worker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h',
        "clustered_layout": f"WITH {_SPLIT} SELECT *, row_number() OVER (ORDER BY partition, payload) - 1 AS position FROM o",
        "partitionwise_match_counts": f"SELECT CAST(l_orderkey % {PARTITIONS} AS INTEGER) AS partition, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
        "sequential_relation": "SELECT i + 1 AS id, i AS payload FROM range(5000) t(i)",
        "zipf_relation_histogram": _zipf_sql(),
        "fk_frequency_profile": "SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1",
        "tuple_texts": "SELECT concat_ws(', ', p_partkey, p_size) AS line FROM part",
        "phase_pivot": f"""SELECT phase, max(d) FILTER (a = 'NoPartitioning') AS "NoPartitioning", max(d) FILTER (a = 'Radix32') AS "Radix32", max(d) FILTER (a = 'Radix1024') AS "Radix1024"
FROM (SELECT a, phase, CAST(d AS BIGINT) AS d FROM (VALUES {sample}) v(a, phase, d)) GROUP BY 1""",
        "unit_cast": f"SELECT a AS algorithm, phase, CAST(d AS BIGINT) AS ns, CAST(d // 1000 AS BIGINT) AS us, CAST(d // 1000000 AS BIGINT) AS ms, CAST(d // 1000000000 AS BIGINT) AS s FROM (VALUES {sample}) v(a, phase, d)",
        "busiest_worker": "SELECT build, probe FROM (SELECT l_suppkey, count(*) AS build, count(DISTINCT l_partkey) AS probe FROM lineitem GROUP BY 1) ORDER BY build + probe DESC, l_suppkey LIMIT 1",
    }
