import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import sentences as S


@pytest.fixture(scope="module")
def given(spark, data):
    return [(r["language"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_no").collect()]


@pytest.fixture(scope="module")
def model(spark, data, given):
    sf = data.replace("sf0.001", "sf0.1")
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 4 = 0 and text is not null and length(text) < 20000").select("text").orderBy("doc_id").collect()]
    return S.fit_texts(texts, [t for _, t in given])


def parts(text, model):
    return [text[a:b] for a, b in S.split(text, model)]


def test_joined_sentences_come_apart(given, model):
    rng = random.Random(3)
    want = got = both = 0
    by = {}
    for language, text in given:
        by.setdefault(language, []).append(text)
    for language, texts in sorted(by.items()):
        for _ in range(20):
            chosen = rng.sample(texts, 5)
            joint = "" if language in ("cmn_hans_cn", "ja_jp") else " "
            text = joint.join(chosen)
            places, at = set(), 0
            for t in chosen:
                places.add((at, at + len(t)))
                at += len(t) + len(joint)
            found = set(S.split(text, model))
            want, got, both = want + len(places), got + len(found), both + len(places & found)
    assert both / want >= 0.97 and both / got >= 0.97


@pytest.mark.parametrize(
    "sentences",
    [
        ["With Dr. Renlo we counted 3.5 boxes near p. 7, e.g. the red ones.", "Nobody came back at 7.30 a.m.", "The machine was idle."],
        ["Greasor said: “Nobody opened the garden until the ferry came back. We saw 3 boxes.”", "Every doctor in Starna left."],
        ['Matren said "The farmer and the harvest stayed with Tumu?" and left.', "They cleaned the window because it was too dark."],
        ["Nobody opened the garden until… the ferry came back.", "Stop!", "The set has 25,245 utterances (see p. 4)."],
        ["没有人被墨井完这个松银小的雨米船，用的是v2.6版。", "铁江轮说：「草花笔和窗户来到石丝酒之前被米果水完过。车画轮金为了空荡的钟竹羊。」", "每个云书都会在虫琴田被麦衣开？"],
        ["『サンハーノは銀鐘い水門場のために銀金屋を湖銀した！』とコーランナーミンは叫んだ。", "誰もこの火草い麦果屋を帽雲んだとは言わなかった。"],
    ],
)
def test_hard_cases(sentences, model):
    joint = "" if "。" in sentences[0] or "』" in sentences[0] else " "
    assert parts(joint.join(sentences), model) == sentences


def test_layouts(model):
    lines = ["nobody opened the old garden until the ferry came back", "we saw 30 boxes from the lantern of the river and then they cleaned the window because it was dark", "every doctor in the harbour left"]
    assert parts("\r\n".join(lines) + "\n", model) == lines
    words = "Nobody opened the narrow garden until the quiet ferry came back because every doctor in the harbour cleaned the window near the bridge. They counted what they had left with the farmer so that we saw 44 boxes from the lantern of the river.".split()
    wrapped, line = [], ""
    for w in words:
        if len(line) + 1 + len(w) > 66:
            wrapped.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    text = "\n".join([*wrapped, line])
    assert len(parts(text, model)) == 2
    assert parts("The heading of a text\n\nNobody came back.", model) == ["The heading of a text", "Nobody came back."]


def test_thai_blanks(given, model):
    thai = [t for lang, t in given if lang == "th_th"][:4]
    assert parts(" ".join(thai), model) == thai
    assert len(parts("พวกเราแบกลุมปันแกนในบีแคงจินราว 530 ครั้งต่อวันด้วยกัน", model)) == 1


def test_edges(spark, model):
    for text in (None, "", "  \n\t "):
        assert S.split(text, model) == []
    assert parts(" one ", model) == ["one"] and parts("...", model) == ["..."] and parts('"', model) == ['"']
    long = "Nobody came back until the ferry left. " * 4000
    assert len(S.split(long, model)) == 4000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Nobody came back. They left."), (3, "Nobody came back. They left.")], "doc_id bigint, text string").withColumns({"key": F.lit(1), "sent_start": F.lit(2)})
    got = S.sentences(df, model)
    assert sorted(map(tuple, got.collect())) == [(3, 0, 17), (3, 0, 17), (3, 18, 28), (3, 18, 28)]
    assert S.sentences(df.limit(0), model).count() == 0
    assert S.sentences(df, S.fit(df.limit(0))).count() >= 2


def test_places_cover_the_text(spark, data, model):
    for r in spark.read.parquet(f"{data}/documents.parquet").filter("text is not null").collect():
        text, last = r["text"], 0
        for a, b in S.split(text, model):
            assert a >= last and b > a and not text[last:a].strip() and text[a:b].strip() == text[a:b]
            last = b
        assert not text[last:].strip()


@pytest.mark.parametrize(
    "sentences",
    [
        ["Wao pia walimbea vivevuo hiyo mtimbofu.", "Sisi tuliona uvui 452 katika kijiji."],
        ["Su ma sun ƙoƙarda yauci babba sosai?", "Su ma sun shirya harauya."],
        ["Kila mtu alikuja pamoja na Dkt. Nunjedenja!", "Sisi tuliona taa."],
        ["Write to scores.desk@bench.example, i.e. read https://bench.example/run/14.html for utt_84.flac at 7 a.m. today."],
    ],
)
def test_ends_without_a_blank(sentences, model):
    assert parts("".join(sentences), model) == sentences


def test_case_is_judged_by_the_whole_text():
    assert not S.Text("nobody came back. " * 300 + "They left. Nobody came.").lower
    assert S.Text("nobody came back. " * 300).lower


def _unmarked_model():
    starts, ends = ["we came", "the dog", "nobody", "she sat"], ["home late", "asleep", "spoke today", "down there"]
    import random

    rng = random.Random(3)
    lines = [f"{rng.choice(starts)} {rng.choice(['was', 'is', 'went'])} {rng.choice(ends)}" for _ in range(400)]
    texts = ["\n\n".join(x.capitalize() + "." for x in lines[i : i + 4]) for i in range(0, 400, 4)]
    han = [f"{rng.choice(['我们', '孩子', '老师'])}{rng.choice(['昨天', '今天'])}{rng.choice(['回家了', '睡着了', '说话了'])}" for _ in range(400)]
    texts += ["。".join(han[i : i + 4]) + "。" for i in range(0, 400, 4)]
    thai = [f"{rng.choice(['พวกเรา', 'เด็กๆ', 'คุณครู'])}{rng.choice(['เมื่อวาน', 'วันนี้'])}{rng.choice(['กลับบ้าน', 'หลับไป', 'พูดคุย'])}" for _ in range(400)]
    texts += [" ".join(thai[i : i + 4]) for i in range(0, 400, 4)]
    return S.fit_texts(texts, [])


@pytest.fixture(scope="module")
def unmarked():
    return _unmarked_model()


@pytest.mark.parametrize(
    "text, parts",
    [
        ("we came was home late the dog is asleep nobody went spoke today", ["we came was home late", "the dog is asleep", "nobody went spoke today"]),
        ("我们昨天回家了孩子今天睡着了老师昨天说话了", ["我们昨天回家了", "孩子今天睡着了", "老师昨天说话了"]),
        ("พวกเราเมื่อวานกลับบ้านเด็กๆวันนี้หลับไปคุณครูวันนี้พูดคุย", ["พวกเราเมื่อวานกลับบ้าน", "เด็กๆวันนี้หลับไป", "คุณครูวันนี้พูดคุย"]),
    ],
)
def test_texts_without_marks_split_where_boundaries_are_expected(unmarked, text, parts):
    assert [text[a:b] for a, b in S.split(text, unmarked, unmarked=0.2)] == parts
    assert len(S.split(text, unmarked)) == 1  # a line without marks is one sentence where nothing says otherwise


def test_every_gap_has_a_posterior(unmarked):
    doc = S.Text("we came was home late, the dog is asleep")
    p = unmarked.between[doc.table].score(doc)
    assert len(p) == len(doc.text.split()) - 1 and (p >= 0).all() and (p <= 1).all()


def test_counts_cover_all_documents(spark):
    texts = ["We came home. The dog was asleep."] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    first = S.fit_texts(texts[:3], [], 3)
    counts = {(r["name"], r["key"]): r["a"] + r["b"] for r in S.counted(df, first).collect()}
    assert counts["all", ""] == pytest.approx(30)  # one place in each document
    model = S.fit(df, None, sample=3)
    assert [(a, b) for a, b in S.split(texts[0], model)] == [(0, 13), (14, 33)]


def test_words_and_guesses_come_from_all_documents(spark):
    names = [f"Zo{chr(97 + i)}rb" for i in range(12)]
    texts = [f"We saw box {i}. {names[i % 12] if i < 48 else 'They'} left." for i in range(6000)]  # each name in four documents
    texts += [f"They saw Dq. Nulo{i} again." for i in range(3)]
    model = S.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert set(names) <= model.known
    counts = [sum(sum(n) for c, n in model.events.items() if c == (word, "dot")) for word in ("5999", "dq")]
    assert counts == [2, 6]  # in both cases


def test_given_sentences_are_all_counted(spark):
    df = spark.createDataFrame([(1, "We came. They left.")], "doc_id bigint, text string")
    given = spark.createDataFrame([("Zorb saw a box.",)] * 5, "text string")
    assert "Zorb" in S.fit(df, given).known and "~zorb" in S.fit(df, given).known
