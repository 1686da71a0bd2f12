"""The queries of problems 2, 3, 8, 9 and 10 over the test tables, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.canonical import city_ids, status_ids
from millrace.llm.encoding import token_ids
from millrace.llm.stuffing import page_features
from millrace.llm.survivor import FIELDS, STAND_INS, posterior_values, survivors
from millrace.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = city_ids(table(spark, sf_dir, "spark_loader"), table(spark, sf_dir, "ref_city")).toDF("row_id", "ref_id")
    statuses = status_ids(table(spark, sf_dir, "test_duplicate_orders"), table(spark, sf_dir, "ref_status")).toDF("row_id", "ref_id")
    return cities.select(F.lit("spark_loader").alias("src"), "row_id", "ref_id").unionAll(statuses.select(F.lit("test_duplicate_orders").alias("src"), "row_id", "ref_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "orders_validated"), table(spark, sf_dir, "source_trust"))


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of greatest posterior, by estimated accuracies and copying of the sources."""
    return posterior_values(table(spark, sf_dir, "orders_validated"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> mixing.Sizes:
    return mixing.sizes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


#: The entropy that p9_even asks for, as a share of that of equal weights.
EVEN = 0.97


def _even(found: mixing.Sizes) -> mixing.Mixture:
    return mixing.drawn(found, least_entropy=EVEN * math.log(max(1, len(found.available))))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture that has the target shares."""
    return mixing.drawn(_sizes(spark, sf_dir)).documents


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the targets' sources together: the exponent is searched for, and scarce sources are repeated up to their limits."""
    return mixing.drawn(_sizes(spark, sf_dir), passes=1.0).documents


def p9_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture by natural shares raised to the exponent at which their entropy comes near that of equal weights."""
    return _even(_sizes(spark, sf_dir)).documents


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the three mixtures wanted of a source and got, with its exponent and entropies."""
    found = _sizes(spark, sf_dir)
    parts = [mixing.report(m).withColumn("mixture", F.lit(name)) for name, m in (("mix", mixing.drawn(found)), ("whole", mixing.drawn(found, passes=1.0)), ("even", _even(found)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_features(table(spark, sf_dir, "documents")).where("stuffed").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_fused, p8_ids, p9_mix, p9_report, p9_whole, p9_even, p10_found)}
_EDGE = r"[\p{Z}\p{Cc}\p{Cf}]+"


def _trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^{_EDGE}|{_EDGE}$', '', 'g')"


_GIVEN = ", ".join(f"{{'field': '{f}', 'value': {_trimmed(f)}}}" for f in FIELDS)
_STAND_INS = ", ".join(f"'{s}'" for s in STAND_INS)
SQL: dict[str, str] = {
    "p3_found": rf"""
        with records as (
            select record_id,
                   upper(translate({_trimmed('id_order')}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) as k,
                   coalesce(trust, 0) as t,
                   epoch_us(try_cast(updated_at || case when regexp_matches(updated_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then '' else '+00:00' end as timestamptz)) as u,
                   [{_GIVEN}] as fields
            from orders_validated left join source_trust using (source_system)),
        counted as (select *, count(*) over (partition by k) as n from records where k <> ''),
        claims as (select k, t, u, record_id, unnest(fields) as f from counted where n > 1),
        ranked as (
            select k, f.field as field, record_id, row_number() over (partition by k, f.field order by t desc, u desc nulls last, record_id) as place
            from claims where regexp_matches(f.value, '[\p{{L}}\p{{N}}]') and lower(f.value) not in ({_STAND_INS}))
        select k as id_order, field, record_id from ranked where place = 1""",
}
