"""Evaluation records that repeat a training record, exactly or almost.

Transcripts are brought to one form (consistent characters, lower case, no bracketed tags, no
punctuation), and every comparison is a join on hashes of that form or of parts of it:

* the same: one hash of all letters and digits;
* almost the same, spaced scripts: with at most D changed words of n, two texts share all but D of
  their words, so their D + 2 rarest words share two; hashes of pairs of these are joined. Pairs grow
  with the square of D, so texts of more than LONG words use runs of three words: D changes spoil at
  most 4 D of them, and of the first 4 D + 1 in the order of a hash two texts share one;
* almost the same, scripts without spaces: of the training text's pieces of three or four characters
  at most 2 D are spoilt by D changes (an exchange of neighbours can spoil two); the others lie near
  their places in the other text. Hashes of pieces with their places are joined, and met pieces counted.

Every key names the class of sizes a partner may have, so that a key which many texts hold meets texts
of its size only. Joined texts are then compared exactly. Copies of a text are one class, and what
comes out are links between classes, their members, and pairs of members that hold every link.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import canonical
from earshot.runtime import materialize, spread

#: Spellings of the splits.
SPLITS = {"training": "train", "validation": "dev", "valid": "dev", "val": "dev", "eval": "test"}
#: One changed unit in TEN; least words, and characters where words are not spaced; words in a key.
TEN, LEAST_WORDS, LEAST_CHARS, SHARED = 10, 4, 10, 2
#: Words that make up at least this share of all words come last in the order of rarity.
FREQUENT = 1 / 20_000
#: Texts of more words than this are joined by runs of RUN words.
LONG, RUN = 48, 3
#: Rows of candidates or links, at most, that are broadcast; their number is counted first.
FEW = 200_000


def split_name(split: Column) -> Column:
    """train, dev or test; other names in lower case."""
    name = F.lower(F.trim(split))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SPLITS.items() for x in pair))[name], name)


_tag = re.compile(r"\[[^\]]*\]|<[^>]*>|\{[^}]*\}")
_quiet = re.compile("['’ʼ]+")
_gaps, _gaps_marks = re.compile(r"[\W_]+"), regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_format = regex.compile(r"\p{Cf}+")
_marked = re.compile("[\u0300-\U0010ffff]")
_unspaced = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def comparable(text: str) -> str:
    """The words of a consistent text that count, in lower case, between single blanks: no tags, no punctuation."""
    text = _quiet.sub("", _tag.sub(" ", text).lower())
    if _marked.search(text):
        return _gaps_marks.sub(" ", _format.sub("", text)).strip()
    return _gaps.sub(" ", text.replace("\u00ad", "")).strip()


def reach(n: int) -> int:
    """Most changes between a text of ``n`` units and any partner."""
    m = n
    while (m + 1) - n <= (m + 1) // TEN:
        m += 1
    return m // TEN


def distance(a: list, b: list, limit: int) -> int:
    """Changed, added and dropped units and exchanged neighbours; ``limit`` + 1 if there are more.

    For 0, 1, 2 ... changes it is known how far into ``a`` each diagonal can be read, so the work grows
    with the square of the changes, not with the product of the sizes.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    goal, none = m - n, -2
    reached = {}
    for d in range(limit + 1):
        new = {}
        for k in range(-d, d + 1):
            if d:
                one = reached.get(k, none)
                i = max(one + 1, reached.get(k - 1, none), reached.get(k + 1, none) + 1)
                if 0 <= one < n - 1 and 0 <= one + k < m - 1 and a[one] == b[one + k + 1] and a[one + 1] == b[one + k]:
                    i = max(i, one + 2)
            else:
                i = 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            new[k] = i
        if new.get(goal, none) >= n:
            return d
        reached = new
    return limit + 1


def piece(n: int) -> int:
    """Characters in a piece of a text of ``n``; so many that more than 2 D pieces fit."""
    return 3 if n < 40 else 4


def least_met(n: int) -> int:
    """Pieces that D changes leave whole, at least."""
    return n // piece(n) - 2 * reach(n)


def size_class(n: int) -> int:
    """Texts within reach of each other are in the same class or in neighbouring ones."""
    return int(math.log(n) / math.log(1.25))


def partner_classes(n: int) -> range:
    """The size classes of all texts within reach of one of ``n`` units."""
    return range(size_class(max(1, n - reach(n))), size_class(n + reach(n)) + 1)


class WordKeys:
    """Hashes of what a text must share with any partner: pairs of its D + 2 rarest words, or of its runs of
    words the first 4 D + 1 by hash; words and runs that repeat count as several. Both with the sizes that they are for."""

    def __init__(self, order: dict[str, int]):
        self.order, self.known = order, {}

    def __call__(self, words: list[str], side: str) -> list[int]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        ranked = []
        for w in words if len(set(words)) == len(words) else _numbered(words):
            r = known.get(w)
            if r is None:
                r = known[w] = (self.order.get(w.partition("\t")[0], -1), xxhash.xxh64_intdigest(w))
            ranked.append(r)
        n = len(words)
        self.mark = _packed(h & 15 for _, h in ranked)
        out: list[int] = []
        if n <= LONG + reach(LONG):
            few = sorted(h for _, h in sorted(ranked)[: reach(n) + SHARED])
            out = [(a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF for a, b in itertools.combinations(few, 2)]
        if n > LONG:
            runs = _numbered([" ".join(words[i : i + RUN]) for i in range(n - RUN + 1)])
            out += sorted(map(xxhash.xxh64_intdigest, runs))[: (RUN + 1) * reach(n) + 1]
        return [(h + c * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF for c in ((size_class(n),) if side == "train" else partner_classes(n)) for h in out]


def _numbered(words: list[str]) -> Iterator[str]:
    seen: Counter = Counter()
    for w in words:
        seen[w] += 1
        yield f"{w}\t{seen[w]}" if seen[w] > 1 else w


def _packed(classes: Iterable[int]) -> int:
    """Counts of sixteen classes, of four bits each. D changes alter them by 2 D at most."""
    out = 0
    for i, n in Counter(classes).items():
        out |= min(n, 15) << 4 * i
    return out - (1 << 64) if out >> 63 else out


def signature(text: str) -> int:
    """Counts of the characters in sixteen classes."""
    return _packed((ord(ch) * 0x9E3779B1 >> 13) & 15 for ch in text)


def signature_gap(a: Column, b: Column) -> Column:
    """Sum of the differences of two signatures' counts."""
    part = lambda c, i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15))
    return sum((F.abs(part(a, i) - part(b, i)) for i in range(1, 16)), F.abs(part(a, 0) - part(b, 0)))


def train_pieces(text: str) -> Iterator[int]:
    n = len(text)
    k, c = piece(n), size_class(n)
    for i in range(n // k):
        yield xxhash.xxh64_intdigest(f"{c} {k} {i} {text[i * k : i * k + k]}")


def probe_pieces(text: str) -> Iterator[int]:
    """Keys of every piece that a training text within reach may share with ``text``."""
    m = len(text)
    low, high = max(9, m - reach(m)), m + reach(m)
    shapes: dict[tuple[int, int], int] = {}
    for n in range(low, high + 1):
        shapes[(size_class(n), piece(n))] = n
    shift = reach(m)
    for (c, k), n in shapes.items():
        for i in range(n // k):
            for part in {text[at : at + k] for at in range(max(0, i * k - shift), min(m - k, i * k + shift) + 1)}:
                yield xxhash.xxh64_intdigest(f"{c} {k} {i} {part}")


def prepare(index: DataFrame, key: str = "audio_id", text: str = "transcript", split: str = "split", language: str = "language", extra: tuple[str, ...] = ("source",), words: list[tuple[str, int]] | None = None) -> DataFrame:
    """Rows that count, once each: key, split, language, ``extra``, the comparable text and whether it is unspaced.

    Null, blank and tag-only texts, texts of fewer than four words (ten characters where words are
    not spaced), null keys and rows of other splits than train, dev and test are no records here.
    """
    sent = index.sparkSession.sparkContext.broadcast(words)
    name = f"transcripts {sent._jbroadcast.id()}" if words else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = canonical.worker_vocabulary(sent.value, name)
        for batch in batches:
            texts, kinds, classes, keep = [], [], [], []
            for value in batch.column(0).to_pylist():
                text = comparable(canonical.canonical(value, vocabulary))
                letters = text.replace(" ", "")
                unspaced = bool(letters) and not letters.isascii() and 2 * len(_unspaced.findall(letters)) > len(letters)
                keep.append(len(letters) >= LEAST_CHARS if unspaced else text.count(" ") >= LEAST_WORDS - 1)
                texts.append(text)
                kinds.append(unspaced)
                # The letters alone are the class of a text: exact copies may differ in where blanks stand.
                classes.append(xxhash.xxh64_intdigest(letters))
            ids = pa.array(np.array(classes, dtype=np.uint64).view(np.int64))
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(kinds, pa.bool_()), ids], [*names, "text", "unspaced", "class"])
            yield out.filter(pa.array(keep, pa.bool_()))

    names = ["key", "split", "language", *extra]
    rows = spread(index).select(F.col(text).cast("string").alias("value"), F.col(key).cast("string").alias("key"), split_name(F.col(split)).alias("split"), F.col(language).cast("string").alias("language"), *(F.col(x).cast("string").alias(x) for x in extra))
    rows = rows.filter(F.col("value").isNotNull() & F.col("key").isNotNull() & F.col("split").isin("train", "dev", "test"))
    schema = ", ".join(f"{n} string" for n in names) + ", text string, unspaced boolean, class bigint"
    return materialize(rows.mapInArrow(run, schema), "transcripts")


def _texts(rows: DataFrame) -> DataFrame:
    """Each text once, and on which sides it occurs; texts of a class differ in their blanks only."""
    return rows.groupBy("class", "text", "unspaced").agg(F.max(F.expr("split = 'train'")).alias("train"), F.max(F.expr("split <> 'train'")).alias("held"))


def _frequent(texts: DataFrame) -> list[tuple[str, int]]:
    """Words of all spaced texts that make up at least the share FREQUENT; 1 / FREQUENT of them can, at most."""
    counted = texts.filter("not unspaced").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count()
    counted = materialize(counted, "words")
    total = counted.agg(F.sum("count")).first()[0] or 0
    return [(r["word"], r["count"]) for r in counted.filter(F.col("count") >= max(2, total * FREQUENT)).collect()]


def near_classes(texts: DataFrame) -> DataFrame:
    """``train_class``, ``held_class`` of different texts that are almost the same.

    Any order of words finds all pairs; with frequent words last the keys are rare.
    """
    order = texts.sparkSession.sparkContext.broadcast(dict(_frequent(texts)))

    def keys(side: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_words = WordKeys(order.value)
            for batch in batches:
                texts, hashes = [], []
                for c, text, unspaced in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    before = len(hashes)
                    if unspaced:
                        text = text.replace(" ", "")
                        hashes.extend(train_pieces(text) if side == "train" else probe_pieces(text))
                        n, least, mark = len(text), least_met(len(text)), signature(text)
                    else:
                        words = text.split(" ")
                        hashes += of_words(words, side)
                        n, least, mark = len(words), 1, of_words.mark
                    texts.append((c, n * 256 + min(least, 255), mark, len(hashes) - before))
                    if len(hashes) > 200_000:
                        yield _batch(texts, hashes)
                        texts, hashes = [], []
                yield _batch(texts, hashes)

        return run

    # One change needs ten units on one side: shorter texts only match exactly.
    long = texts.filter(F.when(F.col("unspaced"), F.length("text") >= 9).otherwise(F.size(F.split("text", " ")) >= 9)).select("class", "text", "unspaced", "train", "held")
    parts = {side: long.filter(side).select("class", "text", "unspaced").mapInArrow(keys(side), f"{side}_class bigint, key bigint, {side}_size int, {side}_mark bigint") for side in ("train", "held")}
    n = {side: F.shiftright(f"{side}_size", 8) for side in ("train", "held")}
    longer = F.greatest(n["train"], n["held"])
    near = (F.abs(n["train"] - n["held"]) * TEN <= longer) & (F.col("train_class") != F.col("held_class")) & (signature_gap(F.col("train_mark"), F.col("held_mark")) <= 2 * F.floor(longer / TEN))
    joined = parts["train"].join(parts["held"], "key").filter(near)
    pairs = joined.groupBy("train_class", "held_class").agg(F.count("*").alias("met"), F.max(F.col("train_size").bitwiseAND(F.lit(255))).alias("least")).filter("met >= least").select("train_class", "held_class")
    pairs = materialize(pairs, "candidates")
    # Few candidates, by their count, meet the texts by broadcast; else all are shuffled by class.
    hint = F.broadcast if pairs.count() <= FEW else lambda x: x
    texts_of = long.select("class", "text", "unspaced")
    a = texts_of.select(F.col("class").alias("train_class"), F.col("text").alias("a"), "unspaced").join(hint(pairs), "train_class")
    b = texts_of.select(F.col("class").alias("held_class"), F.col("text").alias("b")).join(hint(pairs), "held_class")
    pairs = a.join(b, ["train_class", "held_class"])
    return pairs.mapInArrow(_verify, "train_class bigint, held_class bigint").distinct()


def _batch(texts: list, hashes: list) -> pa.RecordBatch:
    times = np.array([t[3] for t in texts], dtype=np.int64)
    spread = lambda i, kind: pa.array(np.repeat(np.array([t[i] for t in texts], dtype=kind), times))
    return pa.RecordBatch.from_arrays([spread(0, np.int64), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), spread(1, np.int32), spread(2, np.int64)], ["class", "key", "size", "mark"])


def _apart(x: list, y: list, most: int) -> bool:
    """Whether the units alone, in any order, show more than ``most`` changes."""
    a, b = Counter(x), Counter(y)
    return (a - b).total() > most or (b - a).total() > most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.to_pydict()
        keep = []
        for a, b, unspaced in zip(data["a"], data["b"], data["unspaced"], strict=True):
            x, y = (list(a.replace(" ", "")), list(b.replace(" ", ""))) if unspaced else (a.split(" "), b.split(" "))
            most = max(len(x), len(y)) // TEN
            keep.append(not _apart(x, y, most) and distance(x, y, most) <= most)
        yield batch.select(["train_class", "held_class"]).filter(pa.array(keep, pa.bool_()))


def links(rows: DataFrame) -> DataFrame:
    """``train_class``, ``held_class``, ``kind`` ('exact' or 'near') of all classes with an overlap."""
    texts = materialize(_texts(rows), "classes")
    exact = texts.groupBy("class").agg(F.max("train").alias("train"), F.max("held").alias("held")).filter("train and held").select(F.col("class").alias("train_class"), F.col("class").alias("held_class"), F.lit("exact").alias("kind"))
    return exact.unionByName(near_classes(texts).withColumn("kind", F.lit("near")))


def _groups(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of linked classes, and ``found`` by groups of them: the copies of a class in one language on one side.

    Both groups of a link must have the same language; a null language fits any, as texts this close are in one.
    """
    linked = found.select(F.col("train_class").alias("class")).union(found.select("held_class")).distinct()
    linked = F.broadcast(linked) if found.count() <= FEW else linked
    members = rows.join(linked, "class", "left_semi").select("key", "class", "language", "split", F.expr("split = 'train'").alias("train")).distinct()
    members = materialize(members, "members")
    groups = members.groupBy("class", "language", "train").agg(F.count_distinct("key").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    side = lambda name, train: groups.filter(F.col("train") if train else ~F.col("train")).select(*(F.col(c).alias(f"{name}_{c}") for c in groups.columns if c != "train"))
    fits = F.col("train_language").isNull() | F.col("held_language").isNull() | (F.col("train_language") == F.col("held_language"))
    # One record that is on both sides itself is no overlap.
    itself = (F.col("train_n") == 1) & (F.col("held_n") == 1) & (F.col("train_first") == F.col("held_first"))
    return members, found.join(side("train", True), "train_class").join(side("held", False), "held_class").filter(fits & ~itself)


def overlaps(index: DataFrame, words: list[tuple[str, int]] | None = None, **columns: str) -> DataFrame:
    """``audio_id_a``, ``audio_id_b`` (the smaller first), ``kind`` of the overlaps of train with dev or test.

    A link between two groups of copies (the rows of a text and language on one side) is given by its
    rows: each row of either group with the first row of the other one. Every row that overlaps comes
    out, and every link between different texts; where one of the groups is a single row, as most are,
    these are all pairs. The number of rows grows with the groups, not with their product, at any
    size; `classes` has the links with the number of pairs that they stand for, `members` the rows.

    Both rows must have the same language; a null language fits any. A row delivered twice counts
    once. No duplicates; empty tables give no rows.
    """
    rows = prepare(index, words=words, **columns)
    members, pairs = _groups(rows, materialize(links(rows), "links"))

    def star(mine: str, other: str) -> DataFrame:
        of = members.filter("train" if mine == "train" else "not train").select(F.col("key").alias("x"), F.col("class").alias(f"{mine}_class"), F.col("language").alias("own"))
        met = pairs.select(f"{mine}_class", f"{mine}_language", f"{other}_first", f"{other}_last", "kind").join(of, f"{mine}_class").filter(F.col("own").eqNullSafe(F.col(f"{mine}_language")))
        return met.select("x", F.when(F.col("x") == F.col(f"{other}_first"), F.col(f"{other}_last")).otherwise(F.col(f"{other}_first")).alias("y"), "kind")

    out = star("train", "held").unionByName(star("held", "train")).filter("x <> y")
    return out.groupBy(F.least("x", "y").alias("audio_id_a"), F.greatest("x", "y").alias("audio_id_b")).agg(F.min("kind").alias("kind"))


def classes(index: DataFrame, words: list[tuple[str, int]] | None = None, **columns: str) -> DataFrame:
    """One row for each link between groups: both classes and languages, ``kind``, rows on both sides and the pairs they make."""
    _, pairs = _groups(rows := prepare(index, words=words, **columns), materialize(links(rows), "links"))
    return pairs.select("train_class", "train_language", "held_class", "held_language", "kind", F.col("train_n").alias("train_rows"), F.col("held_n").alias("held_rows"), (F.col("train_n") * F.col("held_n")).alias("pairs"))


def members(index: DataFrame, words: list[tuple[str, int]] | None = None, **columns: str) -> DataFrame:
    """``key``, ``class``, ``language``, ``split``, ``links`` of every record of a linked class; links are those to other groups."""
    found, pairs = _groups(rows := prepare(index, words=words, **columns), materialize(links(rows), "links"))
    sides = [pairs.select(F.col(f"{x}_class").alias("class"), F.col(f"{x}_language").alias("language"), F.lit(x == "train").alias("train")) for x in ("train", "held")]
    counted = sides[0].unionByName(sides[1]).groupBy("class", "language", "train").agg(F.count("*").alias("links"))
    return _by_group(found, counted).select("key", "class", "language", "split", "links")


def _by_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group of class, language and side."""
    renamed = groups.withColumnsRenamed({c: f"of_{c}" for c in ("class", "language", "train")})
    on = (F.col("class") == F.col("of_class")) & F.col("language").eqNullSafe(F.col("of_language")) & (F.col("train") == F.col("of_train"))
    return rows.join(renamed, on, how).drop("of_class", "of_language", "of_train")


def overlap_counts(index: DataFrame, words: list[tuple[str, int]] | None = None, **columns: str) -> DataFrame:
    """Per split and source: records, records with the same and with almost the same text on the other side.

    For dev and test the other side is train; for train it is dev and test together. Records are rows;
    languages must fit as in `overlaps`. ``matched`` counts a record once if it has either kind.
    """
    rows = prepare(index, words=words, **columns)
    _, pairs = _groups(rows, materialize(links(rows), "links"))
    sides = [pairs.select(F.col(f"{x}_class").alias("class"), F.col(f"{x}_language").alias("language"), F.lit(x == "train").alias("train"), "kind") for x in ("train", "held")]
    flags = sides[0].unionByName(sides[1]).groupBy("class", "language", "train").agg(F.max(F.expr("kind = 'exact'")).alias("exact"), F.max(F.expr("kind = 'near'")).alias("near"))
    marked = _by_group(rows.withColumn("train", F.expr("split = 'train'")), flags, "left")
    return marked.groupBy("split", "source").agg(F.count("*").alias("records"), F.count_if("exact").alias("exact"), F.count_if("near").alias("near"), F.count_if(F.coalesce("exact", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("matched"))
