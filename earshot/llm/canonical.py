"""One consistent form for text that looks the same.

The consistent form of a value is canonically composed (NFC) and has ordinary letters, digits,
hyphens and blanks, nothing invisible, and in every token only letters of the token's script. A token
with a character that could be coded otherwise (invisible, of another width or style, of another
script than its neighbours or its text) is first looked up in a vocabulary. A weighted edit automaton
walks the vocabulary's trie; reading a look-alike, or another form of a letter, or skipping an
ignorable, costs nothing. Of the words reached at no cost the most frequent one is the spelling.
Tokens that reach none, blanks and marks follow the table, character by character.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.runtime import materialize

# Pairs of letters that look alike, foreign letter first, Latin letter second.
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҺH ԚQ ԜW"
GREEK = "αa οo ρp νv ιi υu κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
# Small forms of capitals that look alike, met where a text was put in lower case afterwards.
LOWERED = "вb кk мm нh тt βb εe ζz ηh μm νn τt χx"
#: Prepended marks of category Cf that are visible.
VISIBLE_FORMATS = frozenset("؀؁؂؃؄؅۝܏࣢𑂽𑃍")
#: Letters of Persian and Urdu, which need the zero-width non-joiner inside words.
JOINER_LETTERS = re.compile("[پچژگکی]")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")

#: A value of these characters alone can't change: plain Latin, or one unmixed script beside neutral characters.
_NEUTRAL = r" !-@\[-`{-~\t\n\r¡-¬®-´¶-¿–—‘-”…。、「」『』，？！：；（）·"
SAFE = "|".join(f"[{_NEUTRAL}{letters}]*" for letters in ("A-Za-zÀ-ɏ", "Ѐ-ѿ", "ሀ-፼", "؟،؛ء-ي٠-٩ٮ-ە", "ก-ะาำเ-ๆ", "ぁ-ゖァ-ヺー一-鿋"))
_safe = re.compile(SAFE).fullmatch


#: What `ignorable` and `plain` may change, as classes that are searched for first; supersets are harmless.
_any_ignorable = regex.compile("[\\p{Cf}\\p{Cc}\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5\u180b-\u180e\ufe00-\ufe0f\U000e0100-\U000e01ef]").search
_any_plain = re.compile("[\u00a0\u1680\u2000-\u200a\u2010\u2011\u202f\u205f\u2212\u2100-\u214f\u2f00-\u2fdf\u3000\u3130-\u318f\ufb00-\ufeff\uff00-\uffef\U0001d400-\U0001eeff\U0001fbf0-\U0001fbf9]").search
_latin, _other = re.compile("[A-Za-z\u00c0-\u024f\u0250-\u02af\u1e00-\u1eff\u2c60-\u2c7f\ua720-\ua7ff]").search, re.compile("[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]").search

_greek = re.compile("[\u0370-\u03ff\u1f00-\u1fff]").search


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """The script of a letter by its name; '' for other characters."""
    if not ch.isalpha():
        return ""
    return U.name(ch, "").split(" ")[0]


def _alike() -> tuple[dict, dict]:
    """Letter -> script -> the letters of that script that it may stand for; the first is the table's."""
    forward: dict = {}
    for name, pairs in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("", LOWERED)):
        for foreign, latin in pairs.split():
            own = name or script(foreign)
            forward.setdefault(foreign, {}).setdefault("LATIN", []).append(latin)
            if name:
                forward.setdefault(latin, {}).setdefault(own, []).append(foreign)
    for pairs in (CYRILLIC.split(), GREEK.split()):
        for foreign, latin in pairs:
            for other in ("CYRILLIC", "GREEK"):
                if other != script(foreign):
                    for ch in forward.get(latin, {}).get(other, ()):
                        forward[foreign].setdefault(other, []).append(ch)
    return forward, {ch: set(x) for ch, x in forward.items()}


ALIKE, ALIKE_SCRIPTS = _alike()


@lru_cache(maxsize=1 << 16)
def ignorable(ch: str) -> bool:
    """Characters that show nothing and join or direct nothing that a reader would miss."""
    o = ord(ch)
    if U.category(ch) == "Cf":
        return ch not in VISIBLE_FORMATS
    return o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5) or 0x180B <= o <= 0x180E or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or (U.category(ch) == "Cc" and ch not in "\t\n\r\x0b\x0c\x85")


@lru_cache(maxsize=1 << 16)
def plain(ch: str) -> str:
    """The ordinary form of one character: letters, digits, hyphens and blanks by rule."""
    o = ord(ch)
    if o < 0x80:
        return ch
    kind = U.category(ch)
    if kind == "Zs":
        return " "
    if o in (0x2010, 0x2011, 0x2212, 0xFE63, 0xFF0D):
        return "-"
    form = U.decomposition(ch)
    if form.startswith("<"):
        tag = form[1 : form.index(">")]
        folded = U.normalize("NFKC", ch)
        if tag in ("wide", "narrow", "font", "isolated", "initial", "medial", "final") and (kind[0] in "LMN" or tag == "font"):
            return folded
        if tag == "compat" and (0xFB00 <= o <= 0xFB17 or 0x2F00 <= o <= 0x2FDF):
            return folded
    return ch


def _needed(text: str, at: int) -> bool:
    """Whether the joiner at ``at`` is one that the script needs."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if not before or not after:
        return False
    if U.combining(before) == 9:  # after a virama
        return after.isalpha()
    if script(before) == "ARABIC" and script(after) == "ARABIC":
        return text[at] == "‌" and bool(JOINER_LETTERS.search(text))
    return text[at] == "‍" and U.category(before) in ("So", "Sk", "Mn") and U.category(after) == "So" and ord(after) > 0x2000


class Vocabulary:
    """A trie of ordinary spellings, walked by an automaton in which look-alikes are free."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, count in words.items():
            if any(plain(ch) != ch or ignorable(ch) for ch in word):
                continue
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = max(count, node.get("", 0))

    def lookup(self, token: str, budget: int = 0) -> tuple[str, int] | None:
        """The spelling of least cost up to ``budget``, then of highest count, then first by text.

        Costs: 0 for the same character, a look-alike, an ordinary form, or a skipped ignorable; 1 for
        any other exchange, a dropped or an added character. Spellings are chosen at no cost only: a
        misspelt word is another word.
        """
        states = self._added({"": (self.root, 0)}, budget)
        for ch in token:
            nxt: dict = {}

            def put(word: str, node: dict, cost: int, nxt: dict = nxt) -> None:
                if cost <= budget and nxt.get(word, (None, budget + 1))[1] > cost:
                    nxt[word] = (node, cost)

            similar = {ch, plain(ch), *(x for options in ALIKE.get(ch, {}).values() for x in options)}
            for word, (node, cost) in states.items():
                put(word, node, cost + (not ignorable(ch)))
                for x in similar:
                    to = node
                    for part in x:  # some forms stand for several letters
                        to = to.get(part)
                        if to is None:
                            break
                    else:
                        put(word + x, to, cost)
                if cost < budget:
                    for x, child in node.items():
                        if x and x not in similar:
                            put(word + x, child, cost + 1)
            states = self._added(nxt, budget)
            if not states:
                return None
        found = [(cost, -node[""], word) for word, (node, cost) in states.items() if "" in node]
        return (min(found)[2], -min(found)[1]) if found else None

    @staticmethod
    def _added(states: dict, budget: int) -> dict:
        """The states with those reached by characters that the token lacks."""
        todo = [x for x in states.items() if x[1][1] < budget]
        while todo:
            word, (node, cost) = todo.pop()
            for x, child in node.items():
                if x and states.get(word + x, (None, budget + 1))[1] > cost + 1:
                    states[word + x] = (child, cost + 1)
                    if cost + 1 < budget:
                        todo.append((word + x, states[word + x]))
        return states


_tokens = re.compile(r"[^\W\d_]+(?:[^\W_]|['’-]|[̀-ͯ])*")


def _possible(token: str, target: str) -> bool:
    return all(script(c) in ("", target) or target in ALIKE_SCRIPTS.get(c, ()) for c in token)


def _table(token: str, target: str) -> str:
    return "".join(c if script(c) in ("", target) else ALIKE[c][target][0] for c in token)


def _letters(text: str, vocabulary: Vocabulary | None) -> str:
    """``text`` with the letters of every Latin, Cyrillic or Greek token brought to one script."""
    spans = []
    sure: Counter = Counter()
    for m in _tokens.finditer(text):
        have = Counter(s for s in map(script, m[0]) if s in SCRIPTS)
        if have:
            firm = {s for s in have if any(script(c) == s and c not in ALIKE for c in m[0])}
            spans.append((m.start(), m.end(), m[0], have, firm))
            for c in m[0]:
                if c not in ALIKE and script(c) in SCRIPTS:
                    sure[script(c)] += 1
    if not spans:
        return text
    if len({s for x in spans for s in x[3]}) == 1:
        return text
    main = max(SCRIPTS, key=lambda s: (sure[s], sum(x[3][s] for x in spans), s == "LATIN"))
    out, at = [], 0
    for k, (start, end, token, have, firm) in enumerate(spans):
        new = token
        if len(have) > 1:
            new = _mixed(token, have, firm, main, vocabulary)
        elif main not in have and not firm and _possible(token, main):
            own = next(iter(have))
            near = [x for x in (spans[k - 1] if k else None, spans[k + 1] if k + 1 < len(spans) else None) if x]
            if not any(own in x[4] for x in near):
                new = _spelling(token, main, vocabulary)
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


def _spelling(token: str, target: str, vocabulary: Vocabulary | None) -> str:
    found = vocabulary.lookup(token.lower()) if vocabulary else None
    if found and all(script(c) in ("", target) for c in found[0]) and len(found[0]) == len(token):
        return "".join(x.upper() if t.isupper() and len(x.upper()) == 1 else x for t, x in zip(token, found[0], strict=True))
    return _table(token, target)


def _mixed(token: str, have: Counter, firm: set, main: str, vocabulary: Vocabulary | None) -> str:
    """A token of several scripts: the script of its unmistakable letters, else of the text, else of most letters."""
    fits = [s for s in SCRIPTS if _possible(token, s)]
    if not fits:
        if len(firm) > 1 and "-" in token:  # compounds of two scripts: by part
            return "-".join(_letters(p, vocabulary) for p in token.split("-"))
        return token
    target = next((s for s in fits if s in firm), None) or (main if main in fits else max(fits, key=lambda s: have[s]))
    return _spelling(token, target, vocabulary)


_words = regex.compile("[\\p{L}\\p{M}\\p{Cf}\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5\u180b-\u180e\ufe00-\ufe0f\U000e0100-\U000e01ef]+")


def _spelt(text: str, vocabulary: Vocabulary) -> str:
    """``text`` with the tokens that hold invisible or unusual forms of letters spelt as in the vocabulary, where it has them."""

    def spell(m) -> str:
        token = m[0]
        if not _any_ignorable(token) and not _any_plain(token):
            return token
        if any(c in "\u200c\u200d" and _needed(token, i) for i, c in enumerate(token)):
            return token
        found = vocabulary.lookup(token.lower())
        ordinary = "".join(plain(c) for c in token if not ignorable(c))
        if not found or len(found[0]) != len(ordinary):
            return token
        return "".join(x.upper() if t.isupper() and len(x.upper()) == 1 else x for t, x in zip(ordinary, found[0], strict=True))

    return _words.sub(spell, text)


def canonical(text: str | None, vocabulary: Vocabulary | None = None) -> str | None:
    """The consistent form; null stays null. Applying it again changes nothing."""
    if text is None or _safe(text):
        return text
    new = U.normalize("NFC", text)
    if vocabulary is not None and (_any_ignorable(new) or _any_plain(new)):
        new = U.normalize("NFC", _spelt(new, vocabulary))
    if _any_ignorable(new):
        new = "".join(c for i, c in enumerate(new) if not ignorable(c) or (c in "\u200c\u200d" and _needed(new, i)))
        new = U.normalize("NFC", new)
    if _any_plain(new):
        new = U.normalize("NFC", "".join(map(plain, new)))
    # Only Latin, Cyrillic and Greek letters look alike; a text of one of them has nothing to decide.
    if _other(new) and (_latin(new) or _greek(new)):
        new = U.normalize("NFC", _letters(new, vocabulary))
    return new


# --- Spark ---------------------------------------------------------------------------------------

_worker: dict = {}


def worker_vocabulary(words: Iterable[tuple[str, int]] | None, name: str) -> Vocabulary | None:
    if words is None:
        return None
    if _worker.get("name") != name:
        _worker.update(name=name, vocabulary=Vocabulary(dict(words)))
    return _worker["vocabulary"]


def vocabulary_words(texts: DataFrame, text: str, share: float = 1 / 20_000) -> list[tuple[str, int]]:
    """The words, in lower case and without apostrophes, that make up at least ``share`` of all words of ``text``.

    At most 1 / ``share`` words can do so, which bounds what is sent to the driver and back. All rows
    are counted. Words that mix scripts with look-alikes are no spellings and are left out.
    """
    word = F.explode(F.split(F.translate(F.lower(F.col(text)), "'’ʼ", ""), r"[^\p{L}\p{M}\p{N}]+")).alias("word")
    counted = materialize(texts.select(word).filter("word <> ''").groupBy("word").count(), "words")
    total = counted.agg(F.sum("count")).first()[0] or 0
    least = max(2, int(total * share))
    one_script = F.col("word").rlike(r"^(?:[\p{IsLatin}\p{M}'’-]+|[\p{IsCyrillic}\p{M}-]+|[\p{IsGreek}\p{M}-]+|[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+)$")
    return [(r["word"], r["count"]) for r in counted.filter((F.col("count") >= least) & one_script).collect()]


def is_safe(text: Column) -> Column:
    """Whether the value is certain to be in the consistent form already, judged in the JVM."""
    return text.rlike(f"^(?:{SAFE})$")


def canonical_column(text: Column, words: list[tuple[str, int]] | None = None) -> Column:
    """The consistent form of a column. Values that can't change never leave the JVM."""
    sent = None if words is None else _broadcast(words)
    name = "" if sent is None else f"column {sent._jbroadcast.id()}"

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = worker_vocabulary(None if sent is None else sent.value, name)
        for texts in batches:
            yield pa.array([canonical(t, vocabulary) for t in texts.to_pylist()], pa.string())

    return F.when(is_safe(text), text).otherwise(convert(F.when(~is_safe(text), text)))


def _broadcast(words: list[tuple[str, int]]):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(words)


def changed_values(tables: dict[str, tuple[DataFrame, str, list[str]]], words: list[tuple[str, int]] | None = None) -> DataFrame:
    """``table_name``, ``row_key``, ``field``, ``consistent`` of every value that the consistent form changes.

    ``tables``: name -> table, key column, text columns. Nulls and empty values never change. A key
    that occurs in several rows is reported once for each field and form.
    """
    parts = []
    for name, (df, key, fields) in tables.items():
        values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")
        parts.append(df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), values).filter(F.col("x.value").isNotNull() & ~is_safe(F.col("x.value"))).select("table_name", "row_key", "x.field", "x.value"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sent = None if words is None else _broadcast(words)
    label = "" if sent is None else f"values {sent._jbroadcast.id()}"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_vocabulary(None if sent is None else sent.value, label)
        seen: dict[str, str] = {}
        for batch in batches:
            forms = []
            for value in batch.column(3).to_pylist():
                form = seen.get(value)
                if form is None:
                    if len(seen) > 50_000:
                        seen.clear()
                    form = seen[value] = canonical(value, vocabulary)
                forms.append(form)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(forms, pa.string())], ["table_name", "row_key", "field", "consistent"])
            yield out.filter(pa.array([f != v for f, v in zip(forms, batch.column(3).to_pylist(), strict=True)], pa.bool_()))

    found = rows.mapInArrow(convert, "table_name string, row_key string, field string, consistent string")
    return found.dropDuplicates(["table_name", "row_key", "field", "consistent"])
