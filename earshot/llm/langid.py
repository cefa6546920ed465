"""Language of texts and of their parts by n-gram filters that answer for all languages at once.

One array of bit masks holds a Bloom filter for every language side by side: bit L of a slot belongs
to language L, so three slots and two ANDs tell all languages that contain an n-gram. What decides
are, for each language and order, the popcounts of the masks over the n-grams of a word: hits and
misses weigh by how often n-grams hit the filter of their own language and those of others, both
measured on samples held out of the filters, which takes hits by false positives and by shared
n-grams back out. Words pass these weights on to a best path through the text, on which a change of
language has a price.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.canonical import canonical
from earshot.runtime import spread

ORDERS = (1, 2, 3, 4, 5)
#: How much a hit of each order counts, whole words last: n-grams of a word overlap, the more the longer they are.
DAMP = (*(0.5 / n for n in ORDERS), 0.5)
#: Weight of a word of a text from its third occurrence on: output that loops says the same thing again.
AGAIN = 0.1
#: Slots of the filter, most samples of a language that are used, folds for the held-out rates.
SLOTS, SAMPLES, FOLDS = 1 << 19, 2000, 5
#: Price of a change of language; least words of a part in a second language; units of a part without spaces that make a word.
SWITCH, RUN = 9.0, 4
#: A label is taken as wrong when its language is less likely than the best by this log-odds, at least.
DOUBT = 4.0
#: Words remembered by a worker, and words that are looked up together.
MEMO, BLOCK = 150_000, 20_000
MOST_LANGUAGES, MOST_NAMES = 62, 10_000
_words = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[̀-ͯ]|[ऀ-ःऺ-ॏ̀-ͯٔัิ-ฺ็-๎゙‌‍'’])*")
_unspaced = re.compile(r"[฀-๿]+|[぀-ヿ㐀-鿿豈-﫿]+")
_tag = re.compile(r"\[[^\]]*\]|<[^>]*>|\{[^}]*\}")


def units(text: str) -> list[tuple[int, int, str]]:
    """Words with their places; runs without spaces are cut into pieces about as long as words."""
    out = []
    for m in _words.finditer(text):
        at = m.start()
        word = m[0]
        run = _unspaced.match(word)
        if not run and len(word) <= 40:
            out.append((at, m.end(), word.lower()))
            continue
        step = 4 if "฀" <= word[0] <= "๿" else 2 if run else 20
        for i in range(0, len(word), step):
            out.append((at + i, min(at + i + step, m.end()), word[i : i + step].lower()))
    return out


def grams(word: str) -> list[list[str]]:
    """The n-grams of each order; those of two characters and more see the word's edges; the word comes last."""
    edged = word if _unspaced.match(word) else f"^{word}$"
    out = [list(word)]
    for n in ORDERS[1:]:
        out.append([edged[i : i + n] for i in range(len(edged) - n + 1)])
    out.append([f"={word}"])
    return out


class Filters:
    """Bit-sliced Bloom filters of several languages and the weights of their hits."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"at most {MOST_LANGUAGES} languages fit in a mask")
        self.languages, self.slots = languages, slots
        self.masks = np.zeros(slots, dtype=np.int64)
        self.hit = np.zeros((len(DAMP), len(languages)))
        self.miss = np.zeros((len(DAMP), len(languages)))

    def places(self, gram: str) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest(gram)
        m = self.slots - 1
        return h & m, (h >> 21) & m, (h >> 42) & m

    def add(self, gram: str, language: int) -> None:
        for at in self.places(gram):
            self.masks[at] |= 1 << language

    def languages_of(self, gram: str) -> int:
        """A mask of all languages that contain the n-gram."""
        a, b, c = self.places(gram)
        return int(self.masks[a] & self.masks[b] & self.masks[c])

    def counts(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Hits for each order and language, and the number of n-grams of each order."""
        n = len(self.languages)
        hits = np.zeros((len(DAMP), n))
        sizes = np.zeros(len(DAMP))
        for k, parts in enumerate(grams(word)):
            sizes[k] = len(parts)
            for gram in parts:
                mask = self.languages_of(gram)
                while mask:
                    low = mask & -mask
                    hits[k, low.bit_length() - 1] += 1
                    mask ^= low
        return hits, sizes

    def score_many(self, words: list[str]) -> np.ndarray:
        """Log-odds of each language for each word: the popcounts of all their n-grams at once."""
        hashes: list[int] = []
        orders: list[int] = []
        edges = []
        digest = xxhash.xxh3_64_intdigest
        for word in words:
            edges.append(len(hashes))
            for k, parts in enumerate(grams(word)):
                hashes += map(digest, parts)
                orders += [k] * len(parts)
        h = np.array(hashes, dtype=np.uint64)
        m = np.uint64(self.slots - 1)
        masks = self.masks[h & m] & self.masks[(h >> np.uint64(21)) & m] & self.masks[(h >> np.uint64(42)) & m]
        bits = (masks[:, None] >> np.arange(len(self.languages))) & 1
        order = np.array(orders)
        return np.add.reduceat(np.where(bits, self.hit[order], self.miss[order]), np.array(edges), axis=0)


def train(samples: list[tuple[str, str]]) -> Filters:
    """Filters of ``(language, text)`` samples; the weights come from folds held out of the filters."""
    by: dict[str, list[str]] = {}
    for language, text in samples:
        if language and text:
            by.setdefault(language, []).append(canonical(text))
    languages = sorted(by)
    filled = Filters(languages)
    n = len(languages)
    own, other = np.zeros((2, len(DAMP), n)), np.zeros((2, len(DAMP), n))  # hits, n-grams
    for fold in range(FOLDS):
        part = Filters(languages)
        for i, language in enumerate(languages):
            for j, text in enumerate(by[language]):
                if j % FOLDS != fold:
                    _fill(part, text, i)
        for i, language in enumerate(languages):
            for text in by[language][fold::FOLDS]:
                for _, _, word in units(text):
                    hits, sizes = part.counts(word)
                    mine = np.arange(n) == i
                    own[0][:, mine] += hits[:, mine]
                    own[1][:, mine] += sizes[:, None]
                    # What other languages hit weighs by language, so that frequent scripts don't drown the rest.
                    other[0][:, ~mine] += hits[:, ~mine]
                    other[1][:, ~mine] += sizes[:, None]
    p = (own[0] + 1) / (own[1] + 2)
    q = (other[0] + 1) / (other[1] + 2)
    damp = np.array(DAMP)[:, None]
    filled.hit = np.log(p / q) * damp
    filled.miss = np.log((1 - p) / (1 - q)) * damp
    for i, language in enumerate(languages):
        for text in by[language]:
            _fill(filled, text, i)
    return filled


def _fill(filters: Filters, text: str, language: int) -> None:
    for _, _, word in units(text):
        for parts in grams(word):
            for gram in parts:
                filters.add(gram, language)


class Reader:
    """Finds the languages of texts; remembers words."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self.known: dict[str, int] = {}
        self.table = np.zeros((MEMO + BLOCK, len(filters.languages)))

    def places(self, words: list[str]) -> list[int]:
        """Rows of the table for the words of a block of texts; new words are scored together."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > len(self.table):
            self.known.clear()
            new = list(dict.fromkeys(words))
            if len(new) > len(self.table):  # one text of very many words
                self.table = np.zeros((len(new), self.table.shape[1]))
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            start = len(self.known)
            self.table[start : start + len(part)] = self.filters.score_many(part)
            self.known.update(zip(part, range(start, start + len(part)), strict=True))
        return [self.known[w] for w in words]

    def read(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int, float]], np.ndarray | None]]:
        """For each text its parts (start, end, language, confidence) and the log-odds of the whole.

        Texts go in blocks. Sums over their words tell the language of a text in one language; only
        where words speak for others by more than a change costs, the best path is looked for.
        """
        out: list = []
        block: list = []
        size = 0
        for text in texts:
            clean = canonical(text) if text else ""
            marked = _tag.sub(lambda m: " " * len(m[0]), clean) if clean and ("[" in clean or "<" in clean or "{" in clean) else clean
            block.append((text, clean, units(marked) if clean else []))
            size += len(block[-1][2])
            if size >= BLOCK // 2:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, block: list) -> list:
        out: list = [([], None)] * len(block)
        full = [i for i, x in enumerate(block) if x[2]]
        if not full:
            return out
        words, weights, starts = [], [], []
        for i in full:
            starts.append(len(words))
            times: dict[str, int] = {}
            for _, _, w in block[i][2]:
                n = times[w] = times.get(w, 0) + 1
                words.append(w)
                weights.append(1.0 if n < 3 else AGAIN)
        scores = self.table[self.places(words)] * np.array(weights)[:, None]
        edges = np.array(starts)
        totals = np.add.reduceat(scores, edges, axis=0)
        best = totals.argmax(axis=1)
        own = np.repeat(best, np.diff([*starts, len(words)]))
        other = np.maximum(scores.max(axis=1) - scores[np.arange(len(own)), own], 0)
        doubt = np.add.reduceat(other, edges)
        sure = 1 / np.exp(np.minimum(totals - totals[np.arange(len(best)), best][:, None], 50)).sum(axis=1)
        for k, i in enumerate(full):
            text, clean, found = block[i]
            if doubt[k] <= SWITCH:
                out[i] = ([(0, len(text), int(best[k]), float(sure[k]))], totals[k])
            else:
                out[i] = (self._parts(text, clean, found, scores[starts[k] : starts[k] + len(found)], int(best[k])), totals[k])
        return out

    def _parts(self, text: str, clean: str, words: list[tuple[int, int, str]], scores: np.ndarray, best: int) -> list[tuple[int, int, int, float]]:
        sums = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        runs = self._path(scores) if self._changes(sums) else [(0, len(words), best)]
        cuts = [0, *(words[a][0] if clean == text else _place(text, words[a][0]) for a, _, _ in runs[1:]), len(text)]
        return [(s, e, language, _confidence(scores[a:b].sum(axis=0), language)) for s, e, (a, b, language) in zip(cuts, cuts[1:], runs, strict=False)]

    @staticmethod
    def _changes(sums: np.ndarray) -> bool:
        """Whether any stretch of words favours another language by more than a change costs."""
        low = np.minimum.accumulate(np.vstack([np.zeros((1, sums.shape[1])), sums[:-1]]), axis=0)
        return bool((sums - low).max() > SWITCH)

    def _path(self, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The best path of languages; parts shorter than RUN words join a neighbour."""
        n, k = scores.shape
        at = scores[0].copy()
        back = np.zeros((n, k), dtype=np.int64)
        stay = np.arange(k)
        for i in range(1, n):
            top = int(at.argmax())
            change = at[top] - SWITCH > at
            back[i] = np.where(change, top, stay)
            at = np.where(change, at[top] - SWITCH, at) + scores[i]
        path = [int(at.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
        runs: list[list[int]] = []
        for i, language in enumerate(path):
            if runs and runs[-1][2] == language:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1, language])
        while len(runs) > 1:
            short = min(range(len(runs)), key=lambda i: runs[i][1] - runs[i][0])
            a, b, _ = runs[short]
            if b - a >= RUN:
                break
            near = [i for i in (short - 1, short + 1) if 0 <= i < len(runs)]
            into = max(near, key=lambda i: scores[a:b, runs[i][2]].sum())
            runs[into][0], runs[into][1] = min(a, runs[into][0]), max(b, runs[into][1])
            del runs[short]
            joined: list[list[int]] = []
            for r in runs:
                if joined and joined[-1][2] == r[2]:
                    joined[-1][1] = r[1]
                else:
                    joined.append(r)
            runs = joined
        return [tuple(r) for r in runs]


def _place(text: str, at: int) -> int:
    """The first place in ``text`` before which the consistent form has ``at`` characters."""
    return bisect_left(range(len(text) + 1), at, key=lambda i: len(canonical(text[:i])))


def _confidence(odds: np.ndarray, language: int) -> float:
    return float(1 / np.exp(np.minimum(odds - odds[language], 50)).sum())


def notations(languages: DataFrame) -> dict[str, str]:
    """Every way to write a language -> its code; a small table, of MOST_NAMES rows or it is an error."""
    out: dict[str, str] = {}
    rows = languages.select("code", "name", "iso639_3", "iso639_1").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} languages")
    for r in rows:
        for x in (r["iso639_1"], r["iso639_3"], r["name"], r["code"]):
            if x and x.strip():
                out[_label(x)] = r["code"]
    return out


def _label(text: str) -> str:
    return re.sub(r"[-_\s]+", "_", text.strip().lower())


def fit(samples: DataFrame, language: str = "language", text: str = "text") -> Filters:
    """Filters from rightly labelled texts, at most SAMPLES of each language, the first in the order of a hash."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(language).orderBy(F.xxhash64(text), text))
    rows = samples.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("l"), F.col(text).alias("t"), rank.alias("r")).filter(F.col("r") <= SAMPLES).orderBy("l", "r").collect()
    return train([(r["l"], r["t"]) for r in rows])


_PARTS = "language string, confidence double, start int, end int"


def languages_of(df: DataFrame, filters: Filters, known: dict[str, str], key: str = "pred_id", text: str = "hypothesis", label: str = "language") -> DataFrame:
    """``key``, ``label`` (code, null if missing or unusable), ``verdict``, ``parts`` of every row.

    ``parts`` is an array of structs: a code, a confidence (probability among the known languages),
    and the place in the text. ``verdict``: 'none' (null, empty, or no letters), 'right', 'missing',
    'wrong' or 'mixed'. A label stays right unless another language is clearly likelier. Texts of any
    length are read whole; a label names a language in any notation of ``known``.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((filters, known))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, known = sent.value
        codes = filters.languages
        reader = Reader(filters)
        part_type = pa.list_(pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            labels, verdicts, found = [], [], []
            for (parts, total), raw in zip(reader.read(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                code = known.get(_label(raw)) if raw else None
                named = {codes[p[2]] for p in parts}
                if not parts:
                    verdict = "none"
                elif len(named) > 1:
                    verdict = "mixed"
                elif code is None:
                    verdict = "missing"
                elif code in named:
                    verdict = "right"
                elif code in codes and total.max() - total[codes.index(code)] < DOUBT:
                    verdict = "right"
                    parts = [(s, e, codes.index(code), _confidence(total, codes.index(code))) for s, e, _, _ in parts]
                else:
                    verdict = "wrong"
                labels.append(code)
                verdicts.append(verdict)
                found.append([{"language": codes[i], "confidence": c, "start": s, "end": e} for s, e, i, c in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(verdicts, pa.string()), pa.array(found, part_type)], ["key", "label", "verdict", "parts"])

    rows = spread(df).select(F.col(key).alias("key"), F.col(text).cast("string"), F.col(label).cast("string"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, label string, verdict string, parts array<struct<{_PARTS.replace(' ', ': ').replace(',: ', ', ')}>>").withColumnRenamed("key", key)


def misfits(found: DataFrame, key: str = "pred_id") -> DataFrame:
    """``key``, ``language``: one row for each language of every text that is mixed or not rightly labelled."""
    cases = found.filter(F.col("verdict").isin("missing", "wrong", "mixed"))
    return cases.select(key, F.explode(F.array_distinct(F.col("parts.language"))).alias("language")).dropDuplicates()


def share_by(found: DataFrame, by: Column, name: str) -> DataFrame:
    return found.groupBy(by.alias(name)).agg(F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("none", "right", "missing", "wrong", "mixed")))
