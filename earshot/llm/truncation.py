"""Values that lost their end, found by hashed logistic regression on artificial cuts.

Intact values of a bounded sample are cut at random places, and finished the way exports finish a cut
(dots, a lone blank, half a character, half an entity): these are the positives. The same values
whole, some with the same finishes, are the negatives. Features are the closing characters and words,
the closing punctuation, and the length against what it could be: the other text of the same
utterance, in which the last words are looked up to see how much follows, and the limit of the field.
A field of a source has a limit where values of many utterances have one length and few have those
beside it, counted over all values. Every value is scored, and the share of cut values, which sets
the threshold, is estimated from all scores.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.llm.canonical import canonical
from earshot.runtime import materialize, spread

#: Rows in the training sample (at most), slots of the hashed weights, passes over the sample.
SAMPLE, SLOTS, PASSES = 12_000, 1 << 18, 10
#: Features that occur less often in training are left out.
LEAST = 8
#: A length is a limit if it has MORE times the values of lengths up to NEAR away, on average, and so many deviations more.
NEAR, MORE, DEVIATIONS = 6, 2.0, 6.0
#: How often artificial cuts and whole values of the training sample stand at a limit.
AT_LIMIT = (0.4, 0.004)
#: Limits, at most, that are broadcast; their number is counted first.
FEW = 100_000
#: Value and other field are compared over so many units before the end.
CONTEXT = 4
_word = re.compile(r"[^\W_]+(?:[^\W_]|[̀-ͯ]|[ऀ-ःऺ-ॏ]|[‌‍'’])*")
_dense = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_finish = re.compile(r"(\s*\[\.\.\.\]|\s*\.{3,}|\s*…|\s*�+|&#?\w{0,6}|\\u?[0-9a-fA-F]{0,4}|%[0-9A-F]?|\s+[-–]|-|\s+)$")
_tag = re.compile(r"\[[^\]]*\]|<[^>]*>|\{[^}]*\}")
#: The finishes that artificial cuts and decorated whole values get.
FINISHES = ("", "", "", "", "", "", "…", "...", " [...]", " ", "�", "&#x", "&am", "&quo", "\\u00", " -", "\xa0")


def parse(text: str | None) -> tuple[str, str, list[str], bool] | None:
    """Kind of finish, closing mark, units before it (words, or characters where words are not spaced), and which they are."""
    if not text or not text.strip():
        return None
    found = _finish.search(text)
    kind = ""
    if found:
        kind = "blank" if not found[0].strip() else "entity" if found[0][0] in "&\\%" else found[0].strip()[0] + ("s" if found[0][0].isspace() else "")
        if kind == "blank" and found[0][-1] != " ":
            kind = "other blank"
        text = text[: found.start()]
    body = _tag.sub(" ", canonical(text)).rstrip()
    mark = body[-1] if body and not body[-1].isalnum() and body[-1] not in "ฯๆ" and not "̀" <= body[-1] <= "ͯ" else ""
    if mark and (0x900 <= ord(mark) < 0x964 or 0xE31 <= ord(mark) <= 0xE4E):
        mark = ""
    words = _word.findall(body.lower())
    dense = len(_dense.findall(body)) * 2 > len(body)
    if dense:
        words = list("".join(words))
    return kind, mark, words, dense


def _follow(own: list[str], other: list[str], dense: bool) -> tuple[str, int]:
    """How the end of ``own`` is met in ``other``, and how many units follow there."""
    n, m = len(own), len(other)
    if not n or not m:
        return "none", 0
    last = own[-1]
    best = (0, 0, 0, -1)  # agreement, exact, nearness to the same distance from the start, place
    for j in range(m):
        word = other[j]
        exact = word == last
        if not exact and (dense or not word.startswith(last)):
            continue
        score = 0
        for k in range(1, CONTEXT + 1):
            if n - 1 - k < 0 or j - k < 0:
                score += n - 1 - k < 0 and j - k < 0
                break
            if own[n - 1 - k] == other[j - k]:
                score += 1
            elif (n - 2 - k >= 0 and own[n - 2 - k] == other[j - k]) or (j - k - 1 >= 0 and own[n - 1 - k] == other[j - k - 1]):
                score += 0.5  # a word dropped or added between
        key = (score, exact, -abs(j - n + 1), j)
        if key > best:
            best = key
    if best[3] < 0:
        return "lost", 0
    return f"{'whole' if best[1] else 'part'}{int(best[0])}", m - 1 - best[3]


def _step(n: int) -> str:
    return str(n) if n < 4 else "4" if n < 8 else "8"


def features(own: tuple, other: tuple | None, limit: bool = False) -> list[str]:
    """What the classifier sees of a parsed value, the other text of the utterance, and whether its length is its field's limit."""
    kind, mark, words, dense = own
    last = words[-1] if words else ""
    d = "d" if dense else "w"
    if dense:
        last = "".join(words[-4:])
    out = ["bias", f"k{kind}", f"m{mark}", f"n{min(len(last), 9)}{d}", f"e1{last[-1:]}", f"e2{last[-2:]}", f"e3{last[-3:]}", f"l{last}", f"s{_step(len(words))}"]
    if not dense and len(words) > 1:
        out.append(f"ll{words[-2]}|{last[-2:]}")
        out.append(f"p{words[-2]}")
    if mark:
        out.append(f"mk{mark}{kind}")
    if limit:
        out += ["limit", f"limit{kind}", f"limit{bool(mark)}"]
    if other is None:
        return [*out, "alone", f"alone{kind}{bool(mark)}", f"alone l{last}"]
    met, after = _follow(words, other[2], dense)
    back, beyond = _follow(other[2], words, dense)
    shared = len(set(words) & set(other[2])) / max(1, min(len(set(words)), len(set(other[2]))))
    near = int(shared * 5)
    ratio = len(words) / max(1, len(other[2]))
    evidence = f"{met}>{_step(after)}"
    out += [f"a{evidence}", f"a{evidence}{d}", f"ak{evidence}{kind}", f"am{evidence}{bool(mark)}", f"b{back}>{_step(beyond)}", f"ab{met}>{_step(after)}{back}>{_step(beyond)}", f"c{near}", f"cr{near}{min(int(ratio * 8), 12)}"]
    if near < 2 or met in ("lost", "none"):
        out += [f"off{kind}{bool(mark)}", f"off l{last}", f"off e{last[-3:]}"]
    return out


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (SLOTS - 1)


def cut(text: str, rng: random.Random) -> str | None:
    """``text`` without its end, finished in one of the usual ways; None where it is too short."""
    words = parse(text)[2] if parse(text) else []
    if len(words) < 4 or len(text) < 8:
        return None
    at = rng.randint(int(len(text) * 0.15) + 1, len(text.rstrip(" .?!…。።।")) - 1)
    if rng.random() < 0.25:
        space = text.rfind(" ", 2, at)
        at = space if space > 2 else at
    short = text[:at]
    if short.endswith(" ") and rng.random() < 0.5:
        short = short.rstrip()
    return short + rng.choice(FINISHES)


class Classifier:
    """Hashed logistic regression with adaptive steps, and the prior of the positives in what it scores."""

    def __init__(self):
        self.weights = np.zeros(SLOTS, dtype=np.float32)
        self.shift = 0.0
        self.known: dict[str, float] = {}

    def fit(self, rows: list[list[str]], labels: np.ndarray, seed: int = 1) -> None:
        # Closings that occur a few times only would let single values vouch for themselves.
        seen = Counter(f for row in rows for f in row)
        rows = [[f for f in row if seen[f] >= LEAST] for row in rows]
        width = max(map(len, rows))
        slots = np.full((len(rows), width), SLOTS, dtype=np.int64)
        for i, row in enumerate(rows):
            slots[i, : len(row)] = [_slot(f) for f in row]
        weights, squares = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-4)
        rng = np.random.default_rng(seed)
        for _ in range(PASSES):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 256):
                part = order[at : at + 256]
                s = slots[part]
                p = 1 / (1 + np.exp(-np.clip(weights[s].sum(axis=1), -30, 30)))
                step = np.zeros(SLOTS + 1)
                np.add.at(step, s.ravel(), np.repeat((p - labels[part]) / 16, width))
                hit = np.unique(s)
                g = step[hit] + 1e-5 * weights[hit]
                squares[hit] += g * g
                weights[hit] -= 0.15 * g / np.sqrt(squares[hit])
                weights[SLOTS] = 0
        self.weights = weights[:SLOTS].astype(np.float32)
        self.known = {}

    def score(self, row: list[str]) -> float:
        known, total = self.known, 0.0
        for f in row:
            w = known.get(f)
            if w is None:
                if len(known) > 300_000:
                    known.clear()
                w = known[f] = float(self.weights[_slot(f)])
            total += w
        return total + self.shift

    def set_prior(self, scores: np.ndarray, times: np.ndarray | None = None) -> None:
        """Moves the threshold from balanced training classes to the share of positives in ``scores``."""
        if not len(scores):
            return
        share = 0.05
        for _ in range(100):
            odds = np.log(share / (1 - share))
            new = float(np.clip(np.average(1 / (1 + np.exp(-np.clip(scores + odds, -30, 30))), weights=times), 1e-4, 0.9))
            if abs(new - share) < 1e-7:
                break
            share = new
        self.shift = float(np.log(share / (1 - share)))


def train(rows: list[tuple], seed: int = 7) -> Classifier:
    """A classifier from ``(hypothesis, reference)`` rows, most of which are whole.

    Which of their lengths are limits may follow in each row. Artificial cuts stand at a limit as often
    as AT_LIMIT says, for real limits depend on the source.
    """
    rng = random.Random(seed)
    natural, negatives, positives = [], [], []
    for pair in rows:
        parsed = [parse(x) for x in pair[:2]]
        limits = pair[2:] or (False, False)
        for i in (0, 1):
            text, other = pair[i], parsed[1 - i]
            if parsed[i] is None:
                continue
            natural.append(features(parsed[i], other, limits[i]))
            if limits[i]:  # most of these are cut already
                continue
            short = cut(text, rng)
            if short is None or parse(short) is None:
                continue
            # Sometimes the other text is taken away, as where decoding failed.
            seen = None if rng.random() < 0.08 else other
            positives.append(features(parse(short), seen, rng.random() < AT_LIMIT[0]))
            finish = rng.choice(FINISHES)
            whole = parsed[i] if not finish or finish[0] in "&\\�" or parsed[i][0] else parse(text + finish)
            negatives.append(features(whole, seen, rng.random() < AT_LIMIT[1]))
    model = Classifier()
    if not positives:
        model.shift = -30.0
        return model
    # Values of the sample that lost their end themselves are no negatives, and their cuts no good positives.
    # The first round finds them by evidence alone, as closing words would only be learnt by heart.
    bare = Classifier()
    bare.fit([[f for f in row if f[0] not in "lpe"] for row in negatives + positives], np.array([0] * len(negatives) + [1] * len(positives), dtype=float))
    sure = [i for i, row in enumerate(negatives) if bare.score([f for f in row if f[0] not in "lpe"]) < 0]
    for again in (False, True):
        if again:
            sure = [i for i in sure if model.score(negatives[i]) < 0]
        model.fit([negatives[i] for i in sure] + [positives[i] for i in sure], np.array([0] * len(sure) + [1] * len(sure), dtype=float))
    model.set_prior(np.array([model.score(f) for f in natural]))
    return model


def limits(df: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", group: str = "dataset") -> DataFrame:
    """``grp``, ``field``, ``size``, ``n`` (different utterances with a value of this length), ``near`` (those beside it, on average) of every limit.

    All values are counted; different utterances, as one that is transcribed over and over is no sign of a limit.
    """
    fields = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.length(F.col(c).cast("string")).alias("size"), F.xxhash64(F.coalesce(F.col(reference), F.col(c)).cast("string")).alias("h")) for i, c in enumerate((hypothesis, reference)))))
    values = df.select(F.col(group).cast("string").alias("grp"), fields.alias("x")).select("grp", "x.*").filter("size > 0")
    counted = values.groupBy("grp", "field", "size").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    beside = W.partitionBy("grp", "field").orderBy("size").rangeBetween(-NEAR, NEAR)
    near = counted.withColumn("near", (F.sum("n").over(beside) - F.col("n")) / (2 * NEAR))
    return near.filter((F.col("n") > MORE * F.col("near")) & (F.col("n") - F.col("near") > DEVIATIONS * F.sqrt(F.col("near") + 1)))


def _with_limits(df: DataFrame, found: DataFrame, hypothesis: str, reference: str, group: str) -> DataFrame:
    """``df`` with ``at_h`` and ``at_r``: whether the value's length is the limit of its field in its source."""
    sizes = found.groupBy("grp").agg(*(F.collect_set(F.when(F.col("field") == i, F.col("size"))).alias(f"sizes_{i}") for i in (0, 1))).withColumnRenamed("grp", "limits_of")
    near = df.join(sizes, F.col("grp").eqNullSafe(F.col("limits_of")), "left")
    at = [F.coalesce(F.array_contains(f"sizes_{i}", F.length(c)), F.lit(False)).alias(n) for i, (c, n) in enumerate((("h", "at_h"), ("r", "at_r")))]
    return near.select(*df.columns, *at)


def _rows(df: DataFrame, found: DataFrame, key: str, hypothesis: str, reference: str, group: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), F.col(hypothesis).cast("string").alias("h"), F.col(reference).cast("string").alias("r"))
    return _with_limits(rows, found, hypothesis, reference, group)


def known_limits(df: DataFrame, **columns: str) -> DataFrame:
    """The limits, worked out once; broadcast when joined if they are few."""
    found = materialize(limits(df, **columns), "limits")
    return F.broadcast(found) if found.count() <= FEW else found


def fit(df: DataFrame, found: DataFrame | None = None, key: str = "pred_id", hypothesis: str = "hypothesis", reference: str = "reference", group: str = "dataset", sample: int = SAMPLE) -> Classifier:
    """Trains on the ``sample`` first rows in the order of a hash of the key. ``found``: the known limits."""
    if group not in df.columns:
        df, group = df.withColumn("__group", F.lit(None).cast("string")), "__group"
    found = limits(df, hypothesis, reference, group) if found is None else found
    # So few hashes are low that hardly more than the sample is put in order.
    share = min(1.0, 4 * (sample + 1000) / max(1, df.count()))
    low = df.select(key, hypothesis, reference, group, F.xxhash64(F.lit(5), F.col(key)).alias("__hash")).filter(F.col("__hash") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    rows = low.orderBy("__hash", hypothesis, reference).limit(sample)
    rows = _rows(rows, found, key, hypothesis, reference, group).select("h", "r", "at_h", "at_r").collect()
    return train(sorted((tuple(r) for r in rows), key=lambda r: (r[0] or "", r[1] or "")))


def scores(df: DataFrame, model: Classifier, found: DataFrame | None = None, key: str = "pred_id", hypothesis: str = "hypothesis", reference: str = "reference", group: str = "dataset") -> DataFrame:
    """``key``, ``field``, ``group``, ``score``, ``cut`` of every value that isn't null, empty or blank.

    ``score`` is the log-odds that the value lost its end; ``cut`` is whether they favour it. The share
    of cut values that both suppose is estimated from the scores of all values, which are written to
    the shared folder first. A value without a counterpart is judged by its closing and its length
    alone. Rows that repeat are scored again.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    found = limits(df, hypothesis, reference, group) if found is None else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        fields = (hypothesis, reference)
        for batch in batches:
            at, names, values = [], [], []
            for i, (h, r, *full) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                parsed = [parse(h), parse(r)]
                for f in (0, 1):
                    if parsed[f] is not None:
                        at.append(i)
                        names.append(fields[f])
                        values.append(model.score(features(parsed[f], parsed[1 - f], full[f])))
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(names, pa.string()), batch.column(1).take(index), pa.array(values, pa.float64())], ["key", "field", "grp", "score"])

    rows = _rows(spread(df.select(*dict.fromkeys((key, group, hypothesis, reference)))), found, key, hypothesis, reference, group)
    raw = materialize(rows.mapInArrow(run, f"key {kind}, field string, grp string, score double"), "scores")
    # Scores in steps of a twentieth, at most some thousands of them.
    steps = raw.groupBy(F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), "score")) * 20).cast("int").alias("step")).count().collect()
    prior = Classifier()
    prior.set_prior(np.array([r["step"] / 20 for r in steps]) - model.shift, np.array([r["count"] for r in steps], dtype=float))
    score = F.col("score") + F.lit(prior.shift - model.shift)
    return raw.withColumn("score", score).withColumn("cut", F.col("score") > 0).withColumnsRenamed({"key": key, "grp": group})


def rates(scored: DataFrame, group: str = "dataset") -> DataFrame:
    """Per group and field: values, values that were cut, and their share."""
    sums = scored.groupBy(group, "field").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"))
    return sums.withColumn("cut_share", F.col("n_cut") / F.col("n"))
