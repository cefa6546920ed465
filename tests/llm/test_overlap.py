import itertools
import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import overlap as O
from earshot.llm.canonical import canonical

COLUMNS = "audio_id string, transcript string, language string, split string, source string, speaker_id string"


def plain_distance(a, b):
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cur[j] = min(cur[j], prev2[j - 2] + 1)
        prev2, prev = prev, cur
    return prev[-1]


def brute(rows):
    names = {"training": "train", "valid": "dev", "validation": "dev", "val": "dev", "eval": "test"}
    items = []
    for key, text, lang, split, *_ in rows:
        split = names.get(split.strip().lower(), split.strip().lower())
        if text is None or split not in ("train", "dev", "test"):
            continue
        text = O.comparable(canonical(text))
        letters = text.replace(" ", "")
        dense = 2 * len(O._unspaced.findall(letters)) > len(letters)
        unit = list(letters) if dense else text.split()
        if len(unit) >= (10 if dense else 4):
            items.append((key, lang, split, letters, unit, dense))
    out = set()
    train, held = [x for x in items if x[2] == "train"], [x for x in items if x[2] != "train"]
    for a, b in itertools.product(train, held):
        if a[0] != b[0] and (a[1] is None or b[1] is None or a[1] == b[1]):
            most = max(len(a[4]), len(b[4])) // 10
            if a[3] == b[3] or (a[5] == b[5] and abs(len(a[4]) - len(b[4])) <= most and plain_distance(a[4], b[4]) <= most):
                out.add(tuple(sorted((a[0], b[0]))))
    return out


def found(spark, rows):
    got = O.overlaps(spark.createDataFrame(rows, COLUMNS)).collect()
    pairs = [(r["audio_id_a"], r["audio_id_b"]) for r in got]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    return set(pairs)


def edited(rng, units, vocab, times):
    units = list(units)
    for _ in range(times):
        i = rng.randrange(len(units) - 1)
        kind = rng.randrange(4)
        if kind == 0:
            units[i] = rng.choice(vocab)
        elif kind == 1:
            units.insert(i, rng.choice(vocab))
        elif kind == 2:
            del units[i]
        else:
            units[i], units[i + 1] = units[i + 1], units[i]
    return units


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)] + ["the", "a", "of"] * 8
    dense = [chr(0x4E00 + i) for i in range(40)]
    rows = []
    for i in range(60):
        n = rng.randrange(4, 45)
        text = [rng.choice(vocab) for _ in range(n)]
        rows.append((f"t{i}", " ".join(text), "x", "train", "s", None))
        rows.append((f"h{i}", " ".join(edited(rng, text, vocab, rng.randrange(0, n // 10 + 2))), "x", rng.choice(["dev", "test", "EVAL", " valid"]), "s", None))
        m = rng.randrange(9, 60)
        chars = [rng.choice(dense) for _ in range(m)]
        rows.append((f"u{i}", "".join(chars), None if i % 9 == 0 else "z", "Training", "s", None))
        rows.append((f"v{i}", "".join(edited(rng, chars, dense, rng.randrange(0, m // 10 + 2))), "z", "dev", "s", None))
    want = brute(rows)
    assert len(want) > 60
    assert found(spark, rows) == want


def test_against_brute_force_on_data(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/asr_index_v6_16k.parquet").select("audio_id", "transcript", "language", "split", "source", "speaker_id").collect()]
    assert found(spark, rows) == brute(rows)


def test_forms_that_are_the_same(spark):
    base = "Nobody saw the old farmer near the river"
    variants = ["nobody saw  the OLD farmer near the river.", "[um] nobody saw the old farmer <noise> near the river", "nobody sаw the old farmer near the river", "no​body saw the old farmer near the river!", "nobody saw the old-farmer near the river"]
    rows = [("t", base, "x", "train", "s", None)] + [(f"v{i}", v, "x", "test", "s", None) for i, v in enumerate(variants)]
    assert found(spark, rows) == {("t", f"v{i}") for i in range(len(variants))}


def test_edges(spark):
    rows = [("a", "one two three", "x", "train", "s", None), ("b", "one two three", "x", "dev", "s", None), ("c", None, "x", "dev", "s", None), ("d", "[um]", "x", "train", "s", None), ("e", "  ", None, "test", "s", None), ("f", "same words in here", "x", "train", "s", None), ("f", "same words in here", "x", "dev", "s", None), ("g", "same words in here", "y", "dev", "s", None), ("h", "same words in here", None, "dev", "s", None), ("i", "same words in here", "x", "other", "s", None)]
    assert found(spark, rows) == {("f", "h")}
    assert O.overlaps(spark.createDataFrame(rows, COLUMNS).limit(0)).count() == 0
    assert O.overlaps(spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit(1), "class": F.lit(2), "text": F.lit(3), "train": F.lit(4)})).count() == 1


@pytest.mark.parametrize("n, m", [(1, 3), (2, 2), (30, 20), (31, 20), (101, 100)])
def test_groups_of_copies_grow_by_rows(spark, n, m):
    rows = [(f"t{i:03}", "the very same words again", "x", "train", "s", None) for i in range(n)] + [(f"h{i:03}", "the very same words again", "x", "dev", "s", None) for i in range(m)]
    star = found(spark, rows)
    assert len(star) == n + m - 1 and {x for p in star for x in p} == {r[0] for r in rows}
    df = spark.createDataFrame(rows, COLUMNS)
    assert [(r["train_rows"], r["held_rows"], r["pairs"]) for r in O.classes(df).collect()] == [(n, m, n * m)]
    got = O.members(df).collect()
    assert {r["key"] for r in got} == {r[0] for r in rows} and {r["links"] for r in got} == {1}


def test_long_texts(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["the", "a", "of"] * 60
    rows = []
    for i, n in enumerate([46, 47, 48, 49, 50, 52, 53, 54, 55, 60, 90, 200, 400, 900, 3000]):
        text = [rng.choice(vocab) for _ in range(n)]
        for k, times in enumerate((0, n // 20, n // 10, n // 10 + n // 20)):
            rows.append((f"h{i}-{k}", " ".join(edited(rng, text, vocab, times)), "x", "dev", "s", None))
        rows.append((f"t{i}", " ".join(text), "x", "train", "s", None))
    short = [r for r in rows if len(r[1]) < 3000]
    assert found(spark, short) == brute(short)
    long = found(spark, rows)
    assert {(f"h{i}-{k}", f"t{i}") for i in range(15) for k in (0, 1)} <= long
    keys = O.WordKeys({})
    assert len(keys([f"w{i}" for i in range(10_000)], "train")) < 6_000


def test_counts(spark):
    rows = [("t", "nobody saw the old farmer near the river", "x", "train", "s", None), ("a", "Nobody saw the old farmer near the river", "x", "dev", "s", None), ("b", "quite another sentence stands here", "x", "dev", "q", None)]
    got = {(r["split"], r["source"]): (r["records"], r["exact"], r["near"], r["matched"]) for r in O.overlap_counts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {("train", "s"): (1, 1, 0, 1), ("dev", "s"): (1, 1, 0, 1), ("dev", "q"): (1, 0, 0, 0)}


def test_counts_and_pairs_agree_on_languages(spark):
    rows = [("t", "nobody saw the old farmer near the river", "sw", "train", "s", None), ("a", "Nobody saw the old farmer near the river", "am", "dev", "s", None)]
    assert found(spark, rows) == set()
    assert {r["matched"] for r in O.overlap_counts(spark.createDataFrame(rows, COLUMNS)).collect()} == {0}
    assert O.classes(spark.createDataFrame(rows, COLUMNS)).count() == 0


@pytest.mark.parametrize("n", [9, 10, 18, 19, 27, 90])
def test_reach(n):
    assert O.reach(n) == max(m // 10 for m in range(n, 3 * n) if m - n <= m // 10)


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(500):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = edited(rng, a, [0, 1, 2, 3], 2) if len(a) > 2 else [rng.randrange(4) for _ in range(rng.randrange(4))]
        d = plain_distance(a, b)
        for limit in (1, 2, 4):
            assert O.distance(a, b, limit) == min(d, limit + 1)
