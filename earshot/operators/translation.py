"""BLEU and chrF++ from sums of n-gram counts."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.groups import join_groups
from earshot.runtime import spread

ORDERS, CHARS, WORDS, BETA = 4, 6, 2, 2
#: Pairs that are counted together, at most 1,024.
BLOCK = 512
_entities = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
#: The punctuation that the 13a tokenisation sets apart.
_apart = re.compile(r"([{-~\[-` -&(-+:-@/])")
_edge = ".,!?;:\"'()[]{}"


def tokenize(text: str) -> list[str]:
    """13a tokenisation in lower case."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in _entities:
        text = text.replace(a, b)
    text = f" {text} "
    text = _apart.sub(r" \1 ", text)
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    text = re.sub(r"([0-9])(-)", r"\1 \2 ", text)
    return text.lower().split()


def _all_orders(refs: list[list[str]], hyps: list[list[str]], orders: int) -> np.ndarray:
    """For each pair and order: n-grams of the hypothesis, of the reference, and matches; up to 1,024 pairs.

    An n-gram is a hash of 53 bits between the number of its pair and its side, so that one sort of all
    of them brings together what is to be counted.
    """
    names: dict[str, int] = {}
    out = np.zeros((len(refs), orders, 3), dtype=np.int64)
    sides = []
    for side, texts in ((0, refs), (1, hyps)):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        items = np.array([names.setdefault(x, len(names) + 1) for t in texts for x in t], dtype=np.uint64)
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(items))  # items from here to the end of the text
        sides.append((side, sizes, items, row, left))
        for n in range(1, orders + 1):
            out[:, n - 1, 1 - side] = np.maximum(sizes - n + 1, 0)
    grams = [np.zeros(len(items), dtype=np.uint64) for _, _, items, _, _ in sides]
    for n in range(1, orders + 1):
        keys = []
        for k, (side, _, items, row, left) in enumerate(sides):
            last = np.zeros(len(items), dtype=np.uint64)
            last[: max(0, len(items) - n + 1)] = items[n - 1 :]
            grams[k] = (grams[k] + last) * np.uint64(0x9E3779B97F4A7C15)
            grams[k] ^= grams[k] >> np.uint64(29)
            whole = left >= n
            keys.append((row[whole] << np.uint64(54)) | ((grams[k][whole] >> np.uint64(11)) << np.uint64(1)) | np.uint64(side))
        both = np.sort(np.concatenate(keys))
        if not len(both):
            continue
        same = both >> np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        hyp = np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts)
        times = np.diff([*starts, len(both)])
        out[:, n - 1, 2] = np.bincount((both[starts] >> np.uint64(54)).astype(np.int64), np.minimum(hyp, times - hyp), len(refs)).astype(np.int64)
    return out


def bleu_counts(references: list[str], hypotheses: list[str]) -> list[list[int]]:
    """Of each pair the lengths of both sides, then for each order clipped matches and n-grams of the hypothesis."""
    refs, hyps = list(map(tokenize, references)), list(map(tokenize, hypotheses))
    found = _all_orders(refs, hyps, ORDERS)[:, :, [2, 0]].reshape(len(refs), -1)
    return [[len(r), len(h), *row] for r, h, row in zip(refs, hyps, found.tolist(), strict=True)]


def _chrf_words(text: str) -> list[str]:
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in _edge:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in _edge:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def chrf_counts(references: list[str], hypotheses: list[str]) -> list[list[int]]:
    """Of each pair for each order (characters 1 to 6, words 1 and 2) n-grams of the hypothesis, of the reference, and matches."""
    parts = []
    for split, orders in ((lambda t: list("".join(t.split())), CHARS), (_chrf_words, WORDS)):
        parts.append(_all_orders(list(map(split, references)), list(map(split, hypotheses)), orders).reshape(len(references), -1))
    return np.concatenate(parts, axis=1).tolist()


def bleu(counts: list[int]) -> float:
    """BLEU of summed counts, with exponential smoothing of orders without a match."""
    ref_len, hyp_len = counts[:2]
    logs, smooth = 0.0, 1.0
    if not hyp_len or not any(counts[2::2]):
        return 0.0
    for n in range(ORDERS):
        match, total = counts[2 + 2 * n : 4 + 2 * n]
        if not total:
            return 0.0
        if not match:
            smooth *= 2
        logs += math.log(100 * match / total if match else 100 / (smooth * total))
    brevity = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return brevity * math.exp(logs / ORDERS)


def chrf(counts: list[int]) -> float:
    """chrF++ of summed counts: precision and recall averaged over the orders that both sides have."""
    p = r = used = 0.0
    for i in range(0, 3 * (CHARS + WORDS), 3):
        hyp, ref, match = counts[i : i + 3]
        if hyp and ref:
            p, r, used = p + match / hyp, r + match / ref, used + 1
    if not used or not p + r:
        return 0.0
    p, r = p / used, r / used
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)


def _counts(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    r, h = ([x or "" for x in side.to_pylist()] for side in (references, hypotheses))
    rows = []
    for at in range(0, len(r), BLOCK):
        pair = r[at : at + BLOCK], h[at : at + BLOCK]
        rows += [{"bleu": b, "chrf": c} for b, c in zip(bleu_counts(*pair), chrf_counts(*pair), strict=True)]
    return pa.array(rows, pa.struct([("bleu", pa.list_(pa.int64())), ("chrf", pa.list_(pa.int64()))]))


def counts(reference: Column, hypothesis: Column) -> Column:
    """Counts of both metrics for a pair of texts; nulls count as empty."""
    return F.arrow_udf(_counts, "struct<bleu: array<bigint>, chrf: array<bigint>>")(reference, hypothesis)


def _final(name: str) -> Column:
    f = bleu if name == "bleu" else chrf

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in rows.to_pylist()], pa.float64())

    return run(F.col(f"{name}_counts"))


def corpus_scores(predictions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """BLEU and chrF++ of every cell. Only sums of counts are shuffled."""
    rows = spread(predictions.select(*by, "reference", "hypothesis")).select(*by, counts(F.col("reference"), F.col("hypothesis")).alias("c"))
    sums = [F.sum(F.col(f"c.{name}")[i]).alias(f"{name}{i}") for name, k in (("bleu", 2 + 2 * ORDERS), ("chrf", 3 * (CHARS + WORDS))) for i in range(k)]
    out = rows.groupBy(*by).agg(F.count("*").alias("num_samples"), *sums)
    out = out.withColumns({"bleu_counts": F.array(*(F.col(f"bleu{i}") for i in range(2 + 2 * ORDERS))), "chrf_counts": F.array(*(F.col(f"chrf{i}") for i in range(3 * (CHARS + WORDS))))})
    return out.select(*by, "num_samples", _final("bleu").alias("bleu"), _final("chrf").alias("chrf"))


def sentence_scores(predictions: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """BLEU and chrF++ of every row."""
    rows = spread(predictions.select(*keep, "reference", "hypothesis")).select(*keep, counts(F.col("reference"), F.col("hypothesis")).alias("c")).select(*keep, F.col("c.bleu").alias("bleu_counts"), F.col("c.chrf").alias("chrf_counts"))
    return rows.select(*keep, _final("bleu").alias("bleu"), _final("chrf").alias("chrf"))


def cell_records(predictions: DataFrame, by: tuple[str, ...], segment_scores: DataFrame | None = None, key: str = "pred_id") -> DataFrame:
    """One record for each translation cell: BLEU, chrF++, the kind of system, and learned metrics.

    A cell is cascaded if any row has an ``intermediate`` text. ``segment_scores`` (key, spbleu,
    ssa_comet) come from an outside scorer; without one both metrics are null.
    """
    kind = predictions.groupBy(*by).agg(F.when(F.bool_or(F.col("intermediate").isNotNull()), "cascaded").otherwise("end_to_end").alias("model_type"))
    out = join_groups(corpus_scores(predictions, by), kind, by)
    if segment_scores is None:
        return out.withColumns({"spbleu": F.lit(None).cast("double"), "ssa_comet": F.lit(None).cast("double")})
    learned = predictions.select(*by, key).join(segment_scores.select(key, "spbleu", "ssa_comet"), key, "left").groupBy(*by).agg(F.avg("spbleu").alias("spbleu"), F.avg("ssa_comet").alias("ssa_comet"))
    return join_groups(out, learned, by)
