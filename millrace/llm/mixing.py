"""Problem 9: mixing sources to target weights.

Weights lie between the target shares and the natural shares of the sources, w = target^a * natural^(1-a), or between natural shares and equal
ones, w = natural^a; the exponent is bisected to the largest that respects every source's limit of repetitions and meets a target entropy.
A source's budget is realised in blocks: whole passes over its documents, then the beginning of one more pass in the order of a seeded
permutation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.encoding import VOCABULARY, token_counts
from millrace.session import cut, small, small_rows

#: Blocks of a source's permutation; only the block in which the budget ends is ordered document by document.
BLOCKS = 4096


class Budget(NamedTuple):
    source: str
    target: float
    available: int
    limit: int
    tokens: float  # to be drawn
    exponent: float
    entropy: float  # of the weights, in nats


def entropy(weights: Iterable[float]) -> float:
    return sum((-w * math.log(w) for w in weights if w > 0), 0.0)


def bisect(fits: Callable[[float], bool], rounds: int = 60) -> float:
    """The largest exponent from 0 to 1 that fits; 0 if none does."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def budgets(targets: Sequence[tuple[str, float, int]], available: dict[str, int], total: int | None = None, least_entropy: float | None = None) -> list[Budget]:
    """The tokens to draw from each source: (source, target share, most repetitions) and the tokens that each source has.

    Weights are target^a * natural^(1-a), or natural^a if a least entropy is asked for. The exponent a is the largest from 0 to 1 at which
    the entropy is reached and, with a total, no source is repeated too often; what even exponent 0 cannot reach stays undrawn. Without a
    total, the largest is taken that the weights allow.
    """
    there = [(s, t, limit) for s, t, limit in targets if available.get(s, 0) > 0 and t > 0 and limit > 0]
    everything = sum(available[s] for s, _, _ in there)
    natural = {s: available[s] / everything for s, _, _ in there}

    def weights(a: float) -> dict[str, float]:
        raw = {s: natural[s] ** a if least_entropy is not None else t**a * natural[s] ** (1 - a) for s, t, _ in there}
        return {s: w / sum(raw.values()) for s, w in raw.items()}

    def fits(a: float) -> bool:
        w = weights(a)
        within = total is None or all(w[s] * total <= limit * available[s] * (1 + 1e-12) for s, _, limit in there)
        return within and (least_entropy is None or entropy(w.values()) >= least_entropy)

    drawn: dict[str, float] = {}
    a, w = 0.0, {}
    if there:
        a = bisect(fits)
        w = weights(a)
        size = total if total is not None else min(limit * available[s] / w[s] for s, _, limit in there)
        drawn = {s: min(w[s] * size, limit * available[s]) for s, _, limit in there}
    return [Budget(s, t, available.get(s, 0), limit, drawn.get(s, 0.0), a, entropy(w.values())) for s, t, limit in targets]


class Sizes(NamedTuple):
    """What mixtures are drawn from: documents of the targets' sources in the order of a seeded permutation, materialised."""

    documents: DataFrame  # doc_id, source, n_tokens, order, block
    targets: list[tuple[str, float, int]]
    available: dict[str, int]


def sizes(df: DataFrame, targets: DataFrame, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> Sizes:
    """The sizes in tokens of the targets' documents, counted once for any number of mixtures.

    Documents without a source, of other sources or without tokens (null and empty texts) are left out.
    """
    goals = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in small_rows(targets) if r["source"] is not None]
    names = [s for s, _, _ in goals]
    rows = df.where(F.col(source).isin(*names)) if names else df.limit(0)
    counted = token_counts(rows.select(F.col(doc_id).alias("doc"), F.col(source).alias("_source"), F.col(text).alias("_body")), ("_source",), "doc", "_body", path)
    found = cut(counted.where("n_tokens > 0").toDF("doc_id", "source", "n_tokens").withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("block", F.pmod("order", F.lit(BLOCKS)).cast("int")))
    return Sizes(found, goals, {r["source"]: r["n"] for r in found.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()})  # a row for each source of the targets


class Mixture(NamedTuple):
    documents: DataFrame  # doc_id, source, n_tokens, repeats
    budgets: list[Budget]


def drawn(found: Sizes, total: int | None = None, least_entropy: float | None = None, passes: float | None = None) -> Mixture:
    """Documents with how often each occurs in the mixture (at least once); passes gives the total as a multiple of all tokens there are.

    A budget is whole passes over its source and the beginning of one more, block by block; of the block where it ends, document by
    document, the last one is in if more than half of it fits.
    """
    plan = budgets(found.targets, found.available, total if passes is None else round(passes * sum(found.available.values())), least_entropy)
    rows = []
    for b in plan:
        if b.tokens > 0:
            whole = int((b.tokens + 1e-6) // b.available)
            rows.append((b.source, whole, float(b.tokens - whole * b.available) if whole < b.limit else 0.0))
    session = found.documents.sparkSession
    wanted = session.createDataFrame(rows, "source string, passes int, rest double")  # a row for each source of the targets
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.documents.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ends = blocks.join(F.broadcast(wanted), "source").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    ends = wanted.join(ends.select("source", F.col("block").alias("last"), (F.col("rest") - F.col("before")).alias("left")), "source", "left").select("source", "passes", F.coalesce("last", F.lit(-1)).alias("last"), "left")
    planned = found.documents.join(small(ends), "source")
    full = planned.where("block <> last").withColumn("more", (F.col("block") < F.col("last")).cast("int"))
    # the one block of a source where its budget ends
    running = Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = planned.where("block = last").withColumn("more", (F.sum("n_tokens").over(running) - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    out = full.unionByName(edge).withColumn("repeats", F.col("passes") + F.col("more"))
    return Mixture(out.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), plan)


def mix(df: DataFrame, targets: DataFrame, total: int | None = None, least_entropy: float | None = None, passes: float | None = None, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> Mixture:
    """Documents of the targets' sources with how often each occurs in the mixture (at least once), columns (doc_id, source, n_tokens, repeats).

    The drawing depends on seed and ids alone. Empty tables give an empty mixture. See sizes(), budgets() and drawn().
    """
    found = drawn(sizes(df, targets, seed, doc_id, text, source, path), total, least_entropy, passes)
    return found._replace(documents=found.documents.withColumnsRenamed({"doc_id": doc_id, "source": source}))


def report(mixture: Mixture) -> DataFrame:
    """A row for each source of the targets: what was wanted, what is there, what was drawn and the share reached, with the mixture's exponent, the entropy of its weights and the entropy reached."""
    session = mixture.documents.sparkSession
    goals = session.createDataFrame([(b.source, b.target, b.limit, b.available, b.exponent, b.entropy) for b in mixture.budgets], "source string, target_share double, max_repeats int, tokens_available long, exponent double, planned_entropy double")
    name = mixture.documents.columns[1]
    found = mixture.documents.groupBy(F.col(name).alias("source")).agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    rows = goals.join(found, "source", "left").na.fill(0, ["documents", "tokens", "most_repeats"])
    everything = Window.partitionBy()  # a row for each source of the targets
    rows = rows.withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), F.lit(0.0)))
    return rows.withColumn("reached_entropy", F.sum(F.when(F.col("reached_share") > 0, -F.col("reached_share") * F.log("reached_share")).otherwise(0.0)).over(everything))
