"""Monotonic alignment of source and target segments by embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP, SPAN_COST, TIE, MOST = 0.45, 0.06, 1e-6, 3
SEGMENTS = 512
RESULT = "unit_id {key}, kind string, source_start int, source_len int, target_start int, target_len int, similarity double"


def _similarities(source: dict, target: dict, n: int, m: int, s: int, t: int) -> np.ndarray:
    """Cosines of all spans of ``s`` source and ``t`` target segments by their starts; zero vectors are like nothing."""
    if n < s or m < t:
        return np.zeros((0, 0))
    a, b = np.stack([source[i, s] for i in range(n - s + 1)]), np.stack([target[j, t] for j in range(m - t + 1)])
    norms = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)


def segment_spans(segments: DataFrame, most: int = MOST) -> DataFrame:
    """(unit_id, side, start, len, embedding) of all runs of 1 to ``most`` neighbouring segments (unit_id, side, position, embedding): the mean of their vectors.

    Positions need not be dense; ends of a unit have fewer runs.
    """
    wide = F.col("embedding").cast("array<double>")
    along = Window.partitionBy("unit_id", "side").orderBy("position")
    rows = segments.withColumn("embedding", wide).withColumn("start", F.row_number().over(along) - 1)
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    total = lambda k: F.aggregate(F.collect_list("embedding").over(along.rowsBetween(0, k - 1)), zero, lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q))
    held = lambda k: F.count(F.lit(1)).over(along.rowsBetween(0, k - 1))
    mean = lambda k: F.transform(total(k), lambda x: x / k)
    spans = [F.struct(F.lit(k).alias("len"), held(k).alias("held"), mean(k).alias("embedding")) for k in range(1, most + 1)]
    out = rows.withColumn("spans", F.array(*spans)).select("unit_id", "side", F.col("start").cast("int").alias("start"), F.explode("spans").alias("s"))
    return out.filter("s.held = s.len").select("unit_id", "side", "start", "s.len", "s.embedding")


def _path(source: dict, target: dict, n: int, m: int, most: int) -> list[tuple]:
    """Cheapest path over matches of up to ``most`` segments a side and gaps; near ties go to the smaller block, matches before gaps."""
    moves = [(1, 0), (0, 1), *[(s, t) for s in range(1, most + 1) for t in range(1, most + 1)]]
    cost = np.full((n + 1, m + 1), np.inf)
    rank = np.full((n + 1, m + 1), 1 << 30)
    back: dict[tuple, tuple] = {}
    cost[0, 0], rank[0, 0] = 0.0, 0
    like = {(s, t): _similarities(source, target, n, m, s, t) for s in range(1, most + 1) for t in range(1, most + 1)}
    for i in range(n + 1):
        for j in range(m + 1):
            if not np.isfinite(cost[i, j]):
                continue
            for s, t in moves:
                a, b = i + s, j + t
                if a > n or b > m:
                    continue
                if s and t:
                    sim = like[s, t][i, j]
                    step, order = 1.0 - max(sim, 0.0) + SPAN_COST * (s + t - 2), s + t - 2
                else:
                    sim, step, order = None, GAP, 10
                total = cost[i, j] + step
                if total < cost[a, b] - TIE or (abs(total - cost[a, b]) <= TIE and order < rank[a, b]):
                    cost[a, b], rank[a, b], back[a, b] = total, order, (s, t, sim)
    out, at = [], (n, m)
    while at != (0, 0):
        s, t, sim = back[at]
        at = (at[0] - s, at[1] - t)
        out.append((at[0], s, at[1], t, sim))
    return out[::-1]


def align(spans: DataFrame, most: int = MOST) -> DataFrame:
    """Blocks (unit_id, kind, source_start, source_len, target_start, target_len, similarity) of each unit in order.

    ``spans``: unit_id, side ('source' or 'target'), start, len, embedding.
    Kinds are matched, omission (source without target) and addition. Units
    are bounded (``SEGMENTS`` a side) and aligned each in one group; larger
    ones must be split before, and fail here.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = {side: {(int(a), int(k)): np.asarray(e, np.float64) for a, k, e in zip(part["start"], part["len"], part["embedding"], strict=True)} for side, part in rows.groupby("side")}
        source, target = sides.get("source", {}), sides.get("target", {})
        size = lambda side: max((a + k for a, k in side), default=0)
        n, m = size(source), size(target)
        if max(n, m) > SEGMENTS:
            raise ValueError(f"unit has {max(n, m)} segments a side, more than {SEGMENTS}")
        path = _path(source, target, n, m, most)
        kinds = ["matched" if s and t else "omission" if s else "addition" for _, s, _, t, _ in path]
        return pd.DataFrame({"unit_id": [rows["unit_id"].iloc[0]] * len(path), "kind": kinds, "source_start": [p[0] for p in path], "source_len": [p[1] for p in path], "target_start": [p[2] for p in path], "target_len": [p[3] for p in path], "similarity": [p[4] for p in path]})

    key = spans.schema["unit_id"].dataType.simpleString()
    return spans.select("unit_id", "side", "start", "len", "embedding").groupBy("unit_id").applyInPandas(run, RESULT.format(key=key))


def span_problems(spans: DataFrame, most: int = MOST) -> DataFrame:
    """(unit_id, side, problem): missing spans, duplicates, unequal widths, values that are not finite, too many segments."""
    sizes = spans.groupBy("unit_id", "side").agg(F.max(F.col("start") + F.col("len")).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count(F.lit(1)).alias("rows"), F.count_distinct("start", "len").alias("distinct"), F.bool_or(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("odd"))
    wanted = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda acc, k: acc + F.greatest(F.col("n") - k + 1, F.lit(0)))
    problems = F.array_compact(F.array(F.when(F.col("n") > SEGMENTS, "too_many_segments"), F.when(F.col("low") != F.col("high"), "unequal_widths"), F.when(F.col("odd"), "not_finite"), F.when(F.col("rows") != F.col("distinct"), "duplicate_span"), F.when(F.col("distinct") != wanted, "missing_span")))
    return sizes.select("unit_id", "side", F.explode(problems).alias("problem"))


def gap_findings(blocks: DataFrame) -> DataFrame:
    """Blocks without a counterpart as warnings."""
    return blocks.filter("kind <> 'matched'").select("unit_id", "kind", F.lit("warning").alias("severity"), "source_start", "source_len", "target_start", "target_len")


def chrf(hypothesis: Column, reference: Column, order: int = 6, words: int = 2, beta: float = 2.0) -> Column:
    """Sentence chrF++ (0 to 100): mean F-score of character and word n-grams."""

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_chrf(a or "", b or "", order, words, beta) for a, b in zip(h, r, strict=True)])

    return score(hypothesis, reference)


def _chrf(h: str, r: str, order: int, words: int, beta: float) -> float:
    from collections import Counter

    pairs = [("".join(h.split()), "".join(r.split()), n) for n in range(1, order + 1)] + [(tuple(h.split()), tuple(r.split()), n) for n in range(1, words + 1)]
    scores = []
    for a, b, n in pairs:
        x, y = (Counter(z[i : i + n] for i in range(len(z) - n + 1)) for z in (a, b))
        if not x or not y:
            continue
        hit = sum((x & y).values())
        p, q = hit / sum(x.values()), hit / sum(y.values())
        scores.append((1 + beta**2) * p * q / (beta**2 * p + q) if hit else 0.0)
    return 100.0 * sum(scores) / len(scores) if scores else 0.0
