"""Operator 8, mixing sources to target weights by the cube method.

Each source has an inclusion rate, target words / words it has. Its whole part is a number of copies that every
document gets; its fraction is the inclusion probability of one more copy. The cube method's flight phase moves
these probabilities along the null space of the balancing constraints (words and documents), three documents at a
time, until each is 0 or 1. It runs in blocks of a source, which are independent tasks of bounded size; the few
documents of a block that stay undecided (some for each doubling of the size) form the blocks of the next round, until
a source has one block, whose last documents the landing phase settles so that the words stay near their target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows are
decided one by one; a source without words has target 0 and takes nothing; an empty table gives no rows; further
columns are ignored. The result depends on the rows, not on their partitioning or order.
"""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.workspace import Workspace

#: Words as the contracts count them.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block of the flight phase.
BLOCK = 1024
#: How many times larger than the next document one may be to go on in the flight.
LATE = 1.5
#: A block leaves 2 documents undecided and those that wait, each LATE times larger than the next one: some 110 with sizes
#: of 64 bits. So blocks of this many or more always leave fewer than half.
LEAST_BLOCK = 256


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take of each source: share of all words, by weight, at most `most` times what the source has."""
    left, open_, out = share * sum(sizes.values()), {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= most * sizes[s]}
        if not full:
            for s in open_:
                out[s] = left * weights[s] / total
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def flight(sizes: list, probs: list, rng: random.Random, land: bool) -> list:
    """Balanced rounding of probs, for sizes from large to small; without land some stay between 0 and 1.

    Three documents at a time move along the one direction that changes neither words nor documents, until one of them is
    settled. One that is much larger than those that come next would hardly move with them; it waits for the landing,
    which settles what is left from large to small, each to the side that leaves the smaller error in words."""
    out, held, late = list(probs), [], []

    def settle(units: list, way: list) -> None:
        up = min(((1 - out[i]) / w if w > 0 else out[i] / -w) for i, w in zip(units, way) if w)
        down = min((out[i] / w if w > 0 else (1 - out[i]) / -w) for i, w in zip(units, way) if w)
        step = up if rng.random() * (up + down) < down else -down
        for i, w in zip(units, way):
            out[i] = min(1.0, max(0.0, out[i] + step * w))
            if out[i] < 1e-9 or out[i] > 1 - 1e-9:
                out[i] = float(round(out[i]))

    for k in range(len(out)):
        if 0 < out[k] < 1:
            late += [i for i in held if sizes[i] > LATE * sizes[k]]
            held = [i for i in held if sizes[i] <= LATE * sizes[k]] + [k]
        while len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            way = [b - c, c - a, a - b] if a != b or b != c else [1, -1, 0]  # orthogonal to the sizes and to (1, 1, 1)
            settle(held, way)
            held = [i for i in held if 0 < out[i] < 1]
    if land:
        error = 0.0
        for i in sorted([*late, *held], key=lambda i: -sizes[i]):
            take, leave = error + (1 - out[i]) * sizes[i], error - out[i] * sizes[i]
            up = rng.random() < out[i] if abs(take) == abs(leave) else abs(take) < abs(leave)
            out[i], error = (1.0, take) if up else (0.0, leave)
    return out


def _decide(seed: int, land: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")  # what stays undecided is small
        key = f"{seed}|{rows['source'].iat[0]!r}|{rows['block'].iat[0]}|{land}"
        rows["p"] = flight(rows["size"].tolist(), rows["p"].tolist(), random.Random(zlib.crc32(key.encode())), land)
        return rows

    return run


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 8, block: int = BLOCK, work: Workspace | None = None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, source, size, source_size, target, copies, and keep columns, of docs (doc_id, text, source, keep). The sources' totals, one row a
    source, are the only thing that the driver gets."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "mix")
    block = max(block, LEAST_BLOCK)
    sized = work.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    words = {r.source: r.words for r in totals}
    share_of = {r.source: weights[i % len(weights)] for i, r in enumerate(totals)}
    target = targets(words, share_of, share, most)
    plan = [(r.source, r.words, float(target[r.source]), target[r.source] / r.words if r.words else 0.0, max(1, -(-r.docs // block))) for r in totals]
    per_source = spark.createDataFrame(plan, "plan_source string, source_size long, target double, rate double, blocks long")
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = (
        sized.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumns({"order": order, "base": F.floor("rate"), "block": F.pmod(order, "blocks")})
        .withColumn("p", F.col("rate") - F.col("base"))
        .select("doc_id", "source", "size", "source_size", "target", "base", "p", "order", "block", *keep)
    )
    done, left = [], max((r.docs for r in totals), default=0)
    while True:
        land = left <= block
        if land:
            rows = rows.withColumn("block", F.lit(0).cast("long"))
        rows = work.save(rows.groupBy("source", "block").applyInPandas(_decide(seed, land), rows.schema), "flight")
        done.append(rows.where("p = 0 OR p = 1"))
        if land:
            break
        rows = rows.where("p > 0 AND p < 1")
        left = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        rows = rows.withColumn("block", F.pmod("order", F.lit(max(1, -(-left // block)))))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    work.drop(sized)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).cast("long").alias("copies"), *keep)


def op8_mix_cube(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
