"""Edit distances and alignments.

Distances are expressions: the distinct words of a pair become single characters, and Spark's own
Levenshtein distance counts them. Only alignments, which no expression gives, use an Arrow function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions import text as X


#: Changes up to which the distance of characters is looked for near the diagonal.
NEAR = 16


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Substituted, dropped and added words between two arrays of words.

    Word k of the pair is written as the k-th character from U+20000 on, of which there are more than a
    million; two million comparisons of words are the worst case for a pair of a thousand words each.
    """
    both = F.array_distinct(F.concat(reference, hypothesis))
    byte = lambda v, w: F.char(F.array_position(v, w))
    ideograph = lambda v, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v, w) + 0x1FFFF), 8, "0")), "UTF-32")

    def between(letter: Callable[[Column, Column], Column]) -> Column:
        spelt = lambda v, ws: F.array_join(F.transform(ws, lambda w: letter(v, w)), "")
        # An array of one list binds the list of words, which is else made again for every word.
        return F.transform(F.array(both), lambda v: F.levenshtein(spelt(v, reference), spelt(v, hypothesis)))[0]

    # Equal sides, most rows of good systems, need no letters; the empty ones neither. One byte names up to 255 words.
    few = F.size(reference) + F.size(hypothesis) < 256
    return F.when(reference == hypothesis, 0).when(F.size(hypothesis) == 0, F.size(reference)).when(few, between(byte)).otherwise(between(ideograph))


def char_distance(reference: Column, hypothesis: Column) -> Column:
    """Substituted, dropped and added code points.

    A band around the diagonal is tried first, as most hypotheses are near their reference.
    """
    near = F.levenshtein(reference, hypothesis, NEAR)
    return F.when(reference == hypothesis, 0).otherwise(F.coalesce(F.nullif(near, F.lit(-1)), F.levenshtein(reference, hypothesis)))


def _costs(reference: list[str], hypothesis: list[str]) -> list | np.ndarray:
    """Costs of all pairs of beginnings."""
    n, m = len(reference), len(hypothesis)
    if n * m > 3000:
        names: dict[str, int] = {}
        r, h = (np.array([names.setdefault(w, len(names)) for w in x]) for x in (reference, hypothesis))
        steps = np.arange(m + 1, dtype=np.int32)
        out = np.empty((n + 1, m + 1), dtype=np.int32)
        out[0] = steps
        for i in range(1, n + 1):
            row = np.empty(m + 1, dtype=np.int32)
            row[0] = i
            np.minimum(out[i - 1, :-1] + (h != r[i - 1]), out[i - 1, 1:] + 1, out=row[1:])
            out[i] = np.minimum.accumulate(row - steps) + steps  # added words cost their number
        return out
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        word, above, last = reference[i - 1], cost[-1], i
        row = [i]
        for j in range(1, m + 1):
            c = above[j - 1] + (word != hypothesis[j - 1])
            if above[j] < c:
                c = above[j] + 1
            if last < c:
                c = last + 1
            row.append(c)
            last = c
        cost.append(row)
    return cost


def align(reference: list[str], hypothesis: list[str]) -> list[tuple[str, int, int]]:
    """Operations of one best alignment: kind (equal, substitute, delete, insert) and places in both.

    The best alignment is not unique. Going back from the ends, a step prefers equal or substitute,
    then delete, then insert.
    """
    # The last words that are equal are always aligned.
    last = 0
    while last < min(len(reference), len(hypothesis)) and reference[-1 - last] == hypothesis[-1 - last]:
        last += 1
    tail = [("equal", len(reference) - k, len(hypothesis) - k) for k in range(1, last + 1)]
    n, m = len(reference) - last, len(hypothesis) - last
    cost = _costs(reference[:n], hypothesis[:m])
    out = tail
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if reference[i] == hypothesis[j] else "substitute", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", i, j))
        else:
            j -= 1
            out.append(("insert", i, j))
    return out[::-1]


_OPS = pa.list_(pa.struct([("type", pa.string()), ("ref_span", pa.string()), ("hyp_span", pa.string())]))
_ALIGNED = pa.struct([("hits", pa.int32()), ("substitutions", pa.int32()), ("deletions", pa.int32()), ("insertions", pa.int32()), ("ops", _OPS)])


def _aligned(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    rows = []
    for ref, hyp in zip(references.to_pylist(), hypotheses.to_pylist(), strict=True):
        r, h = ref or [], hyp or []
        steps = align(r, h) if r != h else [("equal", i, i) for i in range(len(r))]
        runs: list[list] = []
        for kind, i, j in steps:
            if kind == "equal":
                runs.append(["equal"])
                continue
            if not runs or runs[-1][0] != kind:
                runs.append([kind, [], []])
            if kind != "insert":
                runs[-1][1].append(r[i])
            if kind != "delete":
                runs[-1][2].append(h[j])
        count = lambda kind, steps=steps: sum(s[0] == kind for s in steps)
        rows.append({"hits": count("equal"), "substitutions": count("substitute"), "deletions": count("delete"), "insertions": count("insert"), "ops": [{"type": x[0], "ref_span": " ".join(x[1]), "hyp_span": " ".join(x[2])} for x in runs if x[0] != "equal"]})
    return pa.array(rows, _ALIGNED)


def alignment(reference: Column, hypothesis: Column) -> Column:
    """Hits, substitutions, deletions, insertions, and the runs of unequal words with their spans."""
    kind = "struct<hits: int, substitutions: int, deletions: int, insertions: int, ops: array<struct<type: string, ref_span: string, hyp_span: string>>>"
    return F.arrow_udf(_aligned, kind)(reference, hypothesis)


def _counted(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    columns: list[list[int]] = [[], [], [], []]
    for ref, hyp in zip(references.to_pylist(), hypotheses.to_pylist(), strict=True):
        r, h = ref or [], hyp or []
        kinds = Counter(x[0] for x in align(r, h)) if r != h else {"equal": len(r)}
        for column, kind in zip(columns, ("equal", "substitute", "delete", "insert"), strict=True):
            column.append(kinds.get(kind, 0))
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["hits", "substitutions", "deletions", "insertions"])


def operation_counts(reference: Column, hypothesis: Column) -> Column:
    """Hits, substitutions, deletions and insertions of the alignment, without its spans."""
    return F.arrow_udf(_counted, "struct<hits: int, substitutions: int, deletions: int, insertions: int>")(reference, hypothesis)


def tokens_of(c: Column) -> Column:
    return X.words(c)
