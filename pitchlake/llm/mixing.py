"""Mixing of sources to target weights by hash-threshold histograms.

Each source's budget is its share of the largest total that every source present can fill within its cap of repeats.
A source's documents are all taken as often as whole multiples of its size fit the budget; the rest is a nested set:
the documents whose hash lies below a threshold. The threshold comes from histograms of tokens by source and hash
bucket: the bucket in which the running sum passes the budget is refined by the next bits of the hash until it holds one
hash value or nothing more fits. Only these histograms, of a fixed size a source, reach the driver, and rows are filtered,
never sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the hash, and bits that each histogram resolves.
BITS, STEP = 60, 12


@dataclass
class Budget:
    """What a source gives: its size, budget, whole repeats, and the hash threshold of the documents that come once more."""

    source: str
    share: float
    size: int
    wanted: float
    repeats: int
    threshold: int = 0


def budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, Budget]:
    """Budget of each source with documents and a share; shares are taken among these sources.

    The total is the largest at which no source needs more than ``max_repeats`` of its size.
    """
    present = [(s, share, cap) for s, share, cap in targets if s is not None and sizes.get(s, 0) > 0 and share and share > 0 and cap and cap > 0]
    if not present:
        return {}
    whole = sum(share for _, share, _ in present)
    total = min(sizes[s] * cap * whole / share for s, share, cap in present)
    out = {}
    for s, share, cap in present:
        wanted = min(total * share / whole, sizes[s] * cap)
        repeats = min(int((wanted + 1e-6) // sizes[s]), cap)
        out[s] = Budget(s, share / whole, sizes[s], wanted, repeats)
    return out


def thresholds(sized: DataFrame, found: dict[str, Budget]) -> None:
    """Set each budget's threshold, refining the boundary bucket of each source.

    ``sized`` has source, n_tokens and hash. A document enters whole: the boundary hash value enters if that is nearer.
    """
    state = {b.source: (0, b.wanted - b.repeats * b.size) for b in found.values() if b.wanted - b.repeats * b.size >= 0.5}
    shift = BITS
    while state and shift > 0:
        shift -= STEP
        where = F.lit(False)
        for source, (low, _) in state.items():
            where = where | ((F.col("source") == source) & (F.shiftright("hash", shift + STEP) == F.lit(low >> (shift + STEP))))
        counts = (
            sized.filter(where)
            .groupBy("source", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
            .collect()
        )
        by: dict[str, list] = {}
        for r in counts:
            by.setdefault(r["source"], []).append((r["bucket"], r["tokens"], r["docs"]))
        following = {}
        for source, (low, left) in state.items():
            threshold = low + (1 << (shift + STEP))
            for bucket, tokens, docs in sorted(by.get(source, [])):
                if tokens <= left:
                    left -= tokens
                    continue
                if docs > 1 and shift > 0:
                    following[source] = (bucket << shift, left)
                elif left * 2 >= tokens:
                    threshold = (bucket + 1) << shift
                else:
                    threshold = bucket << shift
                if source not in following or docs == 1 or shift == 0:
                    following.pop(source, None)
                break
            if source not in following:
                found[source].threshold = threshold
        state = following


def mix(sized: DataFrame, targets: list[tuple[str, float, int]], seed: int = 7) -> tuple[DataFrame, list[Budget]]:
    """(documents with copies, budgets). ``sized`` has doc_id, source and n_tokens.

    Rows with a null source, a source without a target and texts without tokens aren't taken. ``copies`` is how often the
    document comes, from 1 to the source's cap. Equal doc_ids hash alike and come or stay together. An empty table, or
    no source with documents, gives no rows. ``targets`` is a small list of (source, share, max_repeats).
    """
    names = sorted({s for s, _, _ in targets if s is not None})
    hashed = sized.filter(F.col("source").isin(names) & (F.col("n_tokens") > 0)).withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - BITS))
    sizes = {r["source"]: r["size"] for r in hashed.groupBy("source").agg(F.sum("n_tokens").alias("size")).collect()}
    found = budgets(sizes, targets)
    thresholds(hashed, found)
    copies = F.lit(0)
    for b in found.values():
        once_more = F.when(F.col("hash") < F.lit(b.threshold), 1).otherwise(0)
        copies = F.when(F.col("source") == b.source, F.lit(b.repeats) + once_more).otherwise(copies)
    return hashed.withColumn("copies", copies.cast("bigint")).filter("copies > 0").drop("hash"), list(found.values())


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs, tokens) of each target, sources without documents with 0."""
    got = mixed.groupBy("source").agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    whole = mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("whole"))
    zero = F.lit(0).cast("bigint")
    return (
        targets.select("source", "target_share")
        .join(F.broadcast(got), "source", "left")
        .join(F.broadcast(whole))
        .select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"))
    )
