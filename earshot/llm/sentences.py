"""Sentence boundaries by a hidden-event n-gram language model.

The model sees a text as tokens between which a boundary token may stand: between any two words, or
characters where words are not spaced. It knows how likely the boundary follows a word and its mark,
and how likely a token follows with and without one. These n-gram counts are soft. They come from
expectation maximisation over all documents, in which nothing is labelled, and from single rightly
given sentences: words and first guesses are counted first, then every round counts every document, also in
lower case, with the model so far.

Gaps without any mark are scored in whole arrays, by bigrams: the words that end and begin sentences
against the pairs that stand within them. Gaps with something to tell (a mark, a line break, a blank
in a script that sets blanks between sentences, the inside of a quotation) have events of their kind;
forward-backward over them gives the posteriors. A blank line always parts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.runtime import materialize, spread

#: Rounds; least count of a known token.
ROUNDS, KNOWN = 4, 4
#: Weight of the general counts of tokens against those of a family of places.
PRIOR = 20.0
#: Contexts and tokens that make up at least this share of the corpus' events are kept, so at most 1 / SHARE of them.
SHARE = 1 / 200_000
#: Least share of all tokens that begin texts, paragraphs and lines that makes a token a usual start.
START = 1 / 10_000
#: Words of a table of gaps, at most; slots of the hashed counts of pairs; weight of single words against pairs.
WORDS, SLOTS, PAIR = 8000, 1 << 16, 8.0
#: Contexts and words that a task holds before it hands on its counts; log-odds that it remembers.
HELD, MEMO = 300_000, 200_000
#: Texts whose gaps are scored together.
BLOCK = 500
#: First guess of the share of gaps without a mark that end a sentence.
UNMARKED = 1e-4
#: Kinds of places that don't depend on their neighbours: inside a quotation, at a break by width.
ALONE = ("in", "linew")
#: Widest line of a text that is broken at a width.
WIDTH = 100
#: Ends of sentences; two Ethiopic word separators are one, too.
_marks = "….!?؟።፧।॥。！？｡፡"
_closers = "”\"»’'」』》)]"
_quotes = "”\"»」』》"
_openers = "“\"«‘'「『《(["
_thai = "ก-๛຀-໿ក-៿က-႟"
_dense = "぀-ヿ㐀-鿿"
#: Blanks, ends of sentences in scripts without blanks, and marks right before a letter or an opening mark.
_place = re.compile(
    rf"(?<=[{re.escape(_marks + _closers)}])\s+|[^\S\r\n\v\f\x85\u2028\u2029]*[\r\n\v\f\x85\u2028\u2029]\s*|(?<=[{_thai}0-9])\s+(?=[{_thai}])"
    rf"|(?<=[。！？｡])(?:[”」』》)]*)(?=[^\s。！？｡”」』》)…])|(?<=[。！？｡])[”」』》)]+(?=\S)"
    rf"|(?:[….!?؟።፧।॥]|፡፡)(?P<glued>[{re.escape(_closers)}]*)(?=[^\W\d_]|[{re.escape(_openers)}])"
)
_pairs = re.compile(r"[“”«»„「」『』《》()\[\]\"]|\n[^\S\n]*\n")
_match = {"“": "”", "„": "”", "«": "»", "「": "」", "『": "』", "《": "》", "(": ")", "[": "]"}
_left = re.compile(r"[^\s“\"«「『《(\[]*$")
_right = re.compile(rf"[{re.escape(_openers)}\s]*(?:([{_thai}]{{1,5}})|([\u3041-\u3096])|([{_dense}]{{1,2}})|(\w(?:[\w'’.-]|[̀-ًͯ-ٕऀ-ॣ‌‍])*)|(\S))")


def _held(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets that close, as outermost intervals; a blank line closes nothing."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _pairs.finditer(text):
        c, at = m[0], m.start()
        if c[0] == "\n":
            stack = []
        elif c == '"':
            if stack and stack[-1][0] == '"':
                out.append((stack.pop()[1], at))
            elif at + 1 < len(text) and not text[at + 1].isspace():
                stack.append((c, at))
        elif c in _match:
            stack.append((c, at))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if _match.get(stack[i][0]) == c:
                    out.append((stack[i][1], at))
                    del stack[i:]
                    break
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if not merged or a > merged[-1][1]:
            merged.append((a, b))
    return merged


def _shape(word: str) -> str:
    """Class of a word that the model doesn't know."""
    if not word:
        return "-"
    c = word[0]
    if c.isdigit():
        return "9"
    if not c.isalpha():
        return "."
    kind = "A" if c.isupper() else "a" if c.islower() else "o"
    return kind + ("1" if len(word) == 1 else "" if len(word) < 5 else "+") + ("." if "." in word else "")


class Text:
    """A document as its possible boundaries: for each the end of the left part, the start of the
    right one, the word before, its mark, the token after, and about how many words lie since the last."""

    __slots__ = ("text", "places", "lower", "dense", "table", "_codes")

    def __init__(self, text: str):
        self.text = text
        self.dense = not text.isascii() and 2 * len(_joined.findall(text)) > len(text) - text.count(" ")
        self._codes: tuple | None = None
        self.lower = text == text.lower() != text.upper()
        self.table = 2 if self.dense else int(self.lower)
        held = _held(text)
        starts = [a for a, _ in held]
        opened = set(starts)
        self.places: list[tuple] = []
        breaks = _breaks(text)
        last = 0
        for m in _place.finditer(text):
            a, b = m.start(), m.end()
            gap = m[0]
            glued = m["glued"] is not None
            if glued:  # a straight quote may open what follows
                b = next((x for x in range(m.start("glued"), b) if x in opened), b)
                a, gap = b, ""
            if gap and not gap[0].isspace():
                a = b  # closers belong to the left part
                gap = ""
            if b >= len(text) or a == 0 or not text[:a].strip():
                continue
            after = text[b]
            lines = gap.count("\n") or gap.count("\r") or sum(gap.count(c) for c in "\u2028\u2029\x0b\x0c\x85")
            since = (b - last) // 7
            if lines > 1:
                self.places.append((a, b, "", "para", "", since))
                last = b
                continue
            i = bisect_right(starts, b - 1) - 1
            inside = i >= 0 and held[i][0] < b <= held[i][1]
            if after in _closers and after not in _openers:
                continue
            if after in "?!…:;؟।。、，,." and not lines and not re.match(r"\.\w", text[b : b + 2]):
                continue
            end = a
            closed = ""
            while end and text[end - 1] in _closers:
                closed = closed or ("c" if text[end - 1] in _quotes else "")
                end -= 1
            while closed and end and text[end - 1].isspace():  # French closers stand after a blank
                end -= 1
            stop = end
            while stop and text[stop - 1] in _marks:
                stop -= 1
            mark = text[stop:end]
            if mark == "፡":  # alone it only separates words
                mark, stop = "", end
            if mark and text[stop - 1 : stop].isspace():
                stop -= 1
            if mark:
                kind = "q" if any(c in "!?؟፧！？" for c in mark) else "ell" if "…" in mark or ".." in mark else "dot" if "." in mark else "stop"
            elif lines:
                kind = "line" + breaks.get(a, "u")
            elif re.match(rf"[{_thai}]", after) and end and re.match(rf"[{_thai}0-9]", text[end - 1]):
                kind = "blank"
            elif closed and re.match(rf"[{_thai}]", after):
                kind = "blank"
            else:
                continue
            if kind == "ell" and b + 1 < len(text) and text[b].isupper():
                kind = "ellU"
            if mark and lines and "w" not in breaks.values():
                kind += "n"
            if glued:
                kind += "g"
            if inside:  # a quotation belongs to the sentence that carries it
                kind, closed = "in", ""
            elif kind in ("linew", "linel"):
                closed = ""
            word = _left.search(text, max(0, stop - 40), stop)[0]
            if kind == "blank" or glued and re.search(f"[{_thai}]", word):
                word = word[-4:]
            elif re.search(f"[{_dense}]", word):
                word = word[-2:]
            r = _right.match(text, b)
            token = next((x for x in r.groups() if x), "") if r else ""
            self.places.append((a, b, word, kind + closed, token, since))
            if kind not in ALONE:
                last = b


    def caseless(self) -> bool:
        return not self.lower and self.text == self.text.lower()

    def lowered(self) -> Text | None:
        """The same document in lower case, as many are written; itself where there is no case, so that each counts
        twice; None where it is in lower case or that would change places."""
        if self.lower:
            return None
        if self.caseless():
            return self
        low = self.text.lower()
        if len(low) != len(self.text):
            return None
        new = Text.__new__(Text)
        new.text, new.dense, new.lower, new._codes = low, self.dense, True, None
        new.table = 2 if self.dense else 1
        new.places = [(a, b, word.lower(), kind.replace("U", ""), token.lower(), since) for a, b, word, kind, token, since in self.places]
        return new

    def units(self) -> Iterator[tuple[str, ...]]:
        """What stands on both sides of every gap: words, or pairs of characters where words are not spaced."""
        if not self.dense:
            yield from ((w,) for x in _unit(self.text) if (w := x.strip(_around)))
            return
        t = self.text
        yield from (tuple(x for x in (t[i : i + 2], t[i]) if x.strip(_around) == x and not x.isspace() and len(x.split()) == 1) for i in range(len(t)))

    def coded(self, table: Between) -> tuple[np.ndarray, np.ndarray]:
        if self._codes is None or self._codes[0] is not table.ids:
            if self.dense:
                t = self.text
                at = range(1, len(t))
                get = table.ids.get
                u = [get(t[max(0, i - 2) : i]) or get(t[i - 1]) or (BREAK if t[i - 1].isspace() else 12 + _last_class.get(t[i - 1], 0)) for i in at]
                v = [get(t[i : i + 2]) or get(t[i]) or (BREAK if t[i].isspace() else _unit_class(t[i])) for i in at]
                self._codes = (table.ids, np.array(u, dtype=np.int64), np.array(v, dtype=np.int64))
            else:
                before, after = table.codes(_unit(self.text))
                self._codes = (table.ids, before[:-1], after[1:])
        return self._codes[1:]

    def bare(self, plain: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Gaps in lines in which no mark of an end stands."""
        line = np.cumsum(u == BREAK)
        marks = np.bincount(line, (~plain & (u != BREAK)).astype(float))
        return marks[line] == 0

    def spots(self, which: np.ndarray) -> list[tuple[int, int]]:
        """End of the left and start of the right side of some gaps."""
        if self.dense:
            return [(int(i) + 1, int(i) + 1) for i in which if self.text[int(i) + 1].isalnum() and self.text[int(i)].isalnum()]
        want, out, last = set(map(int, which)), [], 0
        for k, m in enumerate(_unit_at(self.text)):
            if k - 1 in want:
                out.append((last, m.start()))
            last = m.end()
        return out


_block = re.compile(r"(?:(?!\r?\n[^\S\n]*\r?\n).)+", re.S)


def _breaks(text: str) -> dict:
    """Place of a line break without a mark before it -> 'w' (broken at a width), 'l' (a list of lines) or 'u' (unsure).

    This is told by paragraph. Running text ends with a mark; lines that stand for themselves don't, and
    no single width explains where they are broken.
    """
    out: dict = {}
    if "\n" not in text:
        return out
    for block in _block.finditer(text):
        body = block[0].rstrip()
        if "\n" not in body:
            continue
        lines = [(m.start(), m[0].rstrip()) for m in re.finditer(r"[^\r\n]+", body) if m[0].strip()]
        open_ = [(start, line, line.rsplit(None, 1)[-1], after.split(None, 1)[0]) for (start, line), (_, after) in zip(lines, lines[1:], strict=False) if line[-1] not in _marks + _closers]
        if not open_:
            continue
        # Lines are broken before the word that no longer fits, or after the word that reached the width:
        # either way one width must explain all of them.
        sizes = [len(line) for _, line, _, _ in open_]
        before = max(sizes) < min(len(line) + 1 + len(first) for _, line, _, first in open_)
        after = max(len(line) - len(last) - 1 for _, line, last, _ in open_) < min(sizes)
        even = max(sizes) <= WIDTH and (before or after)
        runs = body.rstrip(_closers + " ")[-1:] in tuple(_marks)
        kind = "w" if even and (runs or len(open_) > 2) else "u" if runs else "l"
        out |= {block.start() + start + len(line): kind for start, line, _, _ in open_}
    return out


#: Classes of words that a table doesn't know: by the first character, then by the last one.
SHAPES, BREAK = 22, 20
_last_class = {c: 1 for c in ",;:،፣፤、，：；-–—"} | {c: 2 for c in _marks + "."} | {c: 3 for c in _closers}


def _unit_class(word: str) -> int:
    if word == "\n":
        return BREAK
    c = word[0]
    first = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isalpha() else 4
    return first * 4 + _last_class.get(word[-1], 0)


_unit = re.compile(r"[^\s]+|[\r\n\v\f\x85\u2028\u2029]+").findall
_unit_at = re.compile(r"[^\s]+|[\r\n\v\f\x85\u2028\u2029]+").finditer
_around = _openers + _closers + _marks + ".,;:،፣፤、，：；"
_joined = re.compile(rf"[{_thai}{_dense}]")


class Between:
    """Bigrams of neighbouring words, and words at the edges of sentences, for all gaps of a text at once."""

    def __init__(self, ids: dict[str, int], odds: float = math.log(UNMARKED)):
        self.ids, self.odds = ids, odds
        n = SHAPES + len(ids)
        self.ends, self.begins, self.left, self.right = (np.zeros(n) for _ in range(4))  # at boundaries; anywhere
        self.pairs = np.zeros(SLOTS)
        self.events = np.zeros(2)  # gaps without and with a boundary
        self.held: tuple[list, ...] = ([], [], [], [], [])
        self.size = 0

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words as they stand before gaps, where marks count, and after gaps, where they don't."""
        get = self.ids.get
        before = [get(w) or _unit_class(w) for w in words]
        after = [c if c >= BREAK or not c & 3 else get(w.strip(_around)) or c for c, w in zip(before, words, strict=True)]
        return np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)

    @staticmethod
    def slots(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return ((u * 0x9E3779B1 + v * 0x85EBCA77) >> 7) & (SLOTS - 1)

    def observe(self, doc: Text, before: list[str], after: list[str], weights: list[float], by: Between) -> None:
        words, tokens, theirs, left, right = self.held
        if doc.dense:
            known = self.ids
            before = [w[-2:] if w[-2:] in known else w[-1:] for w in before]
            after = [w[:2] if w[:2] in known else w[:1] for w in after]
        words += before
        tokens += after
        theirs += weights
        u, v = doc.coded(self)
        left.append(u)
        right.append(v)
        self.by = by
        self.size += len(u) + len(before)
        if self.size > 100_000:
            self.add()

    def add(self) -> None:
        """Adds what was observed to the counts."""
        words, tokens, theirs, left, right = self.held
        if words:
            w = np.array(theirs)
            self.ends += np.bincount(self.codes([x or "." for x in words])[0], w, len(self.ends))
            self.begins += np.bincount(self.codes([x or "." for x in tokens])[1], w, len(self.begins))
        if left:
            u, v = np.concatenate(left), np.concatenate(right)
            plain = self.plain(u, v)
            u, v = u[plain], v[plain]
            p = self.by.posteriors(u, v)
            self.left += np.bincount(u, 1 - p, len(self.left))
            self.right += np.bincount(v, 1 - p, len(self.right))
            self.ends += np.bincount(u, p, len(self.ends))
            self.begins += np.bincount(v, p, len(self.begins))
            self.pairs += np.bincount(self.slots(u, v), 1 - p, SLOTS)
            self.events += (len(p) - p.sum(), p.sum())
        for x in self.held:
            x.clear()
        self.size = 0

    def settle(self) -> None:
        self.add()
        share = lambda x: (x + 0.05) / (x.sum() + 0.05 * len(x))
        self.at_end = np.log(share(self.ends)) - np.log(share(self.left))
        self.at_start = np.log(share(self.begins))
        self.inner = share(self.right)
        if self.events.sum():
            self.odds = math.log((self.events[1] + UNMARKED) / (self.events[0] + 1))

    def posteriors(self, u: np.ndarray, v: np.ndarray, odds: np.ndarray | float | None = None) -> np.ndarray:
        """Probability of a boundary at each of many gaps, of which texts doesn't matter."""
        if not hasattr(self, "inner"):
            return np.full(len(u), UNMARKED)
        whole = np.log((self.pairs[self.slots(u, v)] + PAIR * self.inner[v]) / (self.left[u] + PAIR))
        return 1 / (1 + np.exp(-np.clip((self.odds if odds is None else odds) + self.at_end[u] + self.at_start[v] - whole, -30, 30)))

    def score(self, doc: Text, unmarked: float | None = None) -> np.ndarray:
        """The boundary's posterior at every gap of a text; 0 where a mark or a break has an event of its own."""
        u, v = doc.coded(self)
        plain = self.plain(u, v)
        odds = np.full(len(u), self.odds)
        if unmarked is not None:
            odds[doc.bare(plain, u)] = math.log(unmarked / (1 - unmarked))
        return np.where(plain, self.posteriors(u, v, odds), 0.0)

    @staticmethod
    def plain(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Gaps at which nothing stands: neither a break nor the mark of an event of its own."""
        shape = u < BREAK
        return (u != BREAK) & (v != BREAK) & ~(shape & (u % 4 >= 2))


_glue = "\x1f"
_arrays = ("ends", "begins", "left", "right", "pairs")


class _Rows:
    """Rows of name, key and two numbers."""

    def __init__(self):
        self.columns: tuple[list, ...] = ([], [], [], [])

    def __call__(self, name: str, items: list[tuple[str, float, float]]) -> None:
        self.columns[0].extend([name] * len(items))
        for column, values in zip(self.columns[1:], zip(*items, strict=True), strict=True) if items else ():
            column.extend(values)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(self.columns, kinds, strict=True)], ["name", "key", "a", "b"])


class Model:
    """Soft n-gram counts of boundary events and of the tokens beside them."""

    def __init__(self):
        self.events: dict = defaultdict(_none)  # context -> not, boundary
        #: (boundary or not, family of the place) -> counts of the token after it, and their sums.
        self.tokens: dict = defaultdict(Counter)
        self.sums: dict = defaultdict(float)
        self.gaps: dict = defaultdict(_even)
        self.known: set[str] = set()
        self.memo: dict = {}
        #: Words within ordinary and lower-case texts, not yet counted as tokens.
        self.words = (Counter(), Counter())
        #: Bigrams of words between which nothing stands: of ordinary, lower-case and unspaced texts.
        self.between: list[Between] = [Between({}) for _ in range(3)]

    @staticmethod
    def _word(word: str, lower: bool) -> tuple[str, str]:
        low = word.lower()
        return low, ("~" if lower else "") + _shape(word if not lower else low)

    def token(self, token: str, lower: bool) -> str:
        t = ("~" if lower else "") + token
        return t if t in self.known else ("~" if lower else "") + _shape(token)

    @staticmethod
    def families(kind: str) -> tuple[str, str]:
        """Whose counts tell the token after a place, and what they back off to: sentences in lines may
        start in lower case, others don't, and what follows a mark depends on the mark."""
        for base in ("linel", "linew", "line", "blank", "in"):
            if kind.startswith(base):
                return base, base
        return kind.rstrip("cn") + ("c" if kind.endswith("c") else ""), "mark"

    @staticmethod
    def gap(place: tuple) -> tuple[int, str]:
        return min(place[5], 6), place[3][:1]

    def count(self, event: int, family: str, token: str, weight: float) -> None:
        self.tokens[event, family][token] += weight
        self.sums[event, family] += weight

    def empty(self) -> Model:
        """A model of the same words without counts."""
        new = Model()
        new.known = self.known
        new.between = [Between(x.ids, x.odds) for x in self.between]
        return new

    def observe(self, doc: Text, posteriors: list[float], by: Model, weight: int = 1) -> None:
        """Adds the soft counts of a document; gaps without a mark are judged by the model ``by``."""
        self.count(1, "", self.token(_first(doc.text), doc.lower), weight)
        self.words[doc.lower].update(doc.text.split()[1:])
        last = 1.0
        before, after, weights = [], [], []
        for (_, _, word, kind, token, since), p in zip(doc.places, posteriors, strict=True):
            t = self.token(token, doc.lower)
            if kind == "para":
                self.count(1, "", t, weight)
                self.count(1, "mark", t, weight)
            else:
                yes, no = weight * p, weight * (1 - p)
                if kind == "linel":
                    self.count(1, "", t, yes)
                    self.count(1, "mark", t, yes)
                for context in self._contexts(word, kind, doc.lower):
                    e = self.events[context]
                    e[0] += no
                    e[1] += yes
                for family in set(self.families(kind)):
                    self.count(0, family, t, no)
                    self.count(1, family, t, yes)
                before.append(word)
                after.append(token)
                weights.append(p)
            if kind in ALONE:
                continue
            for gap in () if _glued(kind) or kind == "linel" else (self.gaps[min(since, 6), kind[:1]], self.gaps[-1, kind[:1]]):
                gap[0] += weight * last * (1 - p)
                gap[1] += weight * last * p
            last = p
        self.between[doc.table].observe(doc, before, after, weights, by.between[doc.table])

    def given(self, texts: list[str]) -> None:
        """Adds single rightly given sentences, as they are and in lower case."""
        for lower in (False, True):
            for s in texts:
                s = s.lower() if lower else s
                self.count(1, "", self.token(_first(s), lower), 1)
                self.words[lower].update(s.split()[1:])

    def add(self) -> None:
        """Adds the words of texts, most of which don't begin a sentence, to the counts."""
        for lower, words in enumerate(self.words):
            for word, n in words.items():
                self.count(0, "", self.token(word.strip(_edges), bool(lower)), n)
            words.clear()
        for table in self.between:
            table.add()

    def rows(self, copies: bool = False) -> pa.RecordBatch:
        """All counts as rows of name, key and two numbers; events of lower-case ``copies`` don't add to the sum of all."""
        self.add()
        put = _Rows()
        put("event", [(_glue.join(c), *n) for c, n in self.events.items()])
        put("token", [(f"{e}{_glue}{family}{_glue}{t}", n, 0.0) for (e, family), counts in self.tokens.items() for t, n in counts.items()])
        put("sum", [(f"{e}{_glue}{family}", n, 0.0) for (e, family), n in self.sums.items()])
        put("gap", [(f"{i}{_glue}{kind}", *n) for (i, kind), n in self.gaps.items()])
        if not copies:
            put("all", [("", float(sum(n[0] + n[1] for c, n in self.events.items() if len(c) == 1)), 0.0)])
        for i, table in enumerate(self.between):
            put(f"odds {i}", [("", *map(float, table.events))])
            for part in _arrays:
                counts = getattr(table, part)
                put(f"{part} {i}", [(str(k), float(counts[k]), 0.0) for k in np.flatnonzero(counts)])
        return put.batch()

    def merged(self, rows: Iterable[tuple]) -> Model:
        """A model of the words of this one that holds the counts in ``rows``."""
        new = self.empty()
        for name, key, a, b in rows:
            parts = key.split(_glue)
            kind, _, i = name.partition(" ")
            if kind == "event":
                e = new.events[tuple(parts)]
                e[0] += a
                e[1] += b
            elif kind == "token":
                new.tokens[int(parts[0]), parts[1]][parts[2]] += a
            elif kind == "sum":
                new.sums[int(parts[0]), parts[1]] += a
            elif kind == "gap":
                g = new.gaps[int(parts[0]), parts[1]]
                g[0] += a
                g[1] += b
            elif kind == "odds":
                new.between[int(i)].events += (a, b)
            elif kind in _arrays:
                getattr(new.between[int(i)], kind)[int(key)] += a
        return new.settled()

    def settled(self) -> Model:
        """This model, with what counts imply worked out."""
        self.add()
        self.memo = {}
        for table in self.between:
            table.settle()
        return self

    def _contexts(self, word: str, kind: str, lower: bool) -> tuple:
        low, shape = self._word(word, lower)
        return (low, kind), (shape, kind), (kind,)

    def event(self, word: str, kind: str, lower: bool) -> float:
        """Probability of the boundary after a word and its mark, from the mark up to the word itself."""
        p = 0.5
        for context, k in zip(reversed(self._contexts(word, kind, lower)), (2.0, 4.0, 3.0), strict=True):
            if context in self.events:
                a, b = self.events[context]
                p = (b + k * p) / (a + b + k)
        if _glued(kind):  # what is an abbreviation before a blank is one without it
            low = (word.lower(), kind.replace("g", "", 1))
            if low in self.events:
                a, b = self.events[low]
                p = min(p, (b + 3.0) / (a + b + 3.0))
        return min(max(p, 1e-5), 1 - 1e-5)

    def odds(self, place: tuple, lower: bool) -> float:
        _, _, word, kind, token, _ = place
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        left = memo.get((word, kind, lower))
        if left is None:
            p = self.event(word, kind, lower)
            left = memo[word, kind, lower] = math.log(p / (1 - p))
        t = self.token(token, lower)
        right = memo.get((t, kind))
        if right is None:
            size = len(self.known) + 20
            with_, without = (self._next(e, t, kind, size) for e in (1, 0))
            right = memo[t, kind] = math.log(with_) - math.log(without)
        return left + right

    def _next(self, event: int, t: str, kind: str, size: int) -> float:
        """Probability of a token after a place, from general counts down to those of the mark."""
        if kind in _rules:  # both events back off to what follows such places at all
            base = self.families(kind)[0]
            n = sum(self.tokens[e, base].get(t, 0.0) for e in (0, 1))
            p = (n + 0.5) / (self.sums[0, base] + self.sums[1, base] + 0.5 * size)
            return (self.tokens[event, base].get(t, 0.0) + PRIOR * p) / (self.sums[event, base] + PRIOR)
        p = (self.tokens[event, ""].get(t, 0.0) + 0.5) / (self.sums[event, ""] + 0.5 * size)
        for family in reversed(self.families(kind)):
            p = (self.tokens[event, family].get(t, 0.0) + PRIOR * p) / (self.sums[event, family] + PRIOR)
        return p

    def posteriors(self, doc: Text) -> list[float]:
        """Forward-backward over the events; neighbours are tied by how many words lie between them."""
        alone = {}
        local, chain = [], []
        for i, place in enumerate(doc.places):
            if place[3] == "para":
                local.append((0.0, 1.0))
                chain.append(i)
                continue
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.odds(place, doc.lower)))))
            if place[3] in ALONE:
                alone[i] = p
            else:
                local.append((1 - p, p))
                chain.append(i)
        n = len(chain)
        if not n:
            return [alone[i] for i in range(len(alone))]
        ties = []
        for i in chain[1:]:
            place = doc.places[i]
            if _glued(place[3]) or place[3] == "linel":  # abbreviations, file names and listed lines stand at any distance
                ties.append(((1.0, 1.0), (1.0, 1.0)))
                continue
            # How much more or less likely a boundary is at this distance from the last than at any.
            (a, b), (c, d) = self.gaps[self.gap(place)], self.gaps[-1, place[3][:1]]
            ties.append(((1.0, 1.0), (a / (a + b) * (c + d) / c, b / (a + b) * (c + d) / d)))
        forward = [local[0]]
        for i in range(1, n):
            f = [local[i][y] * sum(forward[-1][x] * ties[i - 1][x][y] for x in (0, 1)) for y in (0, 1)]
            s = sum(f) or 1.0
            forward.append((f[0] / s, f[1] / s))
        back = (1.0, 1.0)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            x0, x1 = forward[i][0] * back[0], forward[i][1] * back[1]
            out[i] = x1 / ((x0 + x1) or 1.0)
            if i:
                b = [sum(ties[i - 1][x][y] * local[i][y] * back[y] for y in (0, 1)) for x in (0, 1)]
                s = sum(b) or 1.0
                back = (b[0] / s, b[1] / s)
        if alone:
            at = dict(zip(chain, out, strict=True)) | alone
            return [at[i] for i in range(len(at))]
        return out


#: First guesses for the inside of quotations, breaks by width, and lines that stand for themselves.
_rules = {"in": 0.01, "linew": 0.01, "linel": 0.98}


def _glued(kind: str) -> bool:
    """Whether no blank follows the mark."""
    return kind.endswith(("g", "gc"))


def _start(place: tuple, doc: Text, ends: dict, inside: set[str], starts: set[str]) -> float:
    """First guess of a boundary, before anything is counted. ``ends``: how words with a full stop go
    on; ``inside``: tokens that follow quotations but don't begin texts; ``starts``: usual starts."""
    _, _, word, kind, token, _ = place
    small = token[:1].islower() and not doc.lower
    if kind in _rules:
        return _rules[kind]
    if kind.startswith("line"):
        return 0.1 if small else 0.5
    if kind.startswith("blank"):
        return 0.03 if word[-1:].isdigit() else 0.9
    if small:
        return 0.02
    if _glued(kind) and not token[:1].isupper() and token.lower() not in starts:
        return 0.05 if kind.startswith(("dot", "ell")) else 0.5
    if _glued(kind) and kind.startswith("dot") and len(word) < 2:
        return 0.05
    if kind.startswith("ell"):
        return 0.9 if token[:1].isupper() else 0.15
    if kind.startswith("dot"):
        return ends.get((word.lower(), _glued(kind)), 0.3 if token[:1].isdigit() or len(word) < 3 else 0.9)
    return 0.1 if kind.endswith("c") and token.lower() in inside else 0.95


class Seen:
    """What texts hold before anything is known of boundaries."""

    def __init__(self):
        #: Tokens at places and at the beginning of texts; tokens that begin texts, and that follow quotations; words by table.
        self.tokens, self.firsts, self.after = Counter(), Counter(), Counter()
        self.words = (Counter(), Counter(), Counter())

    def add(self, doc: Text, times: int = 1) -> None:
        flag = "~" if doc.lower else ""
        firsts = [_first(doc.text), *(p[4] for p in doc.places if p[3] in ("para", "linel"))]  # texts and paragraphs begin with sentences, too
        words = [w for pair in doc.units() for w in pair]
        for _ in range(times):
            self.tokens.update(flag + p[4] for p in doc.places)
            self.tokens.update(flag + t for t in firsts)
            self.firsts.update(t.lower() for t in firsts)
            self.after.update(p[4].lower() for p in doc.places if p[3].endswith("c"))
            self.words[doc.table].update(words)

    def given(self, text: str) -> None:
        """Adds a single rightly given sentence, as it is and in lower case."""
        for flag, token in (("", _first(text)), ("~", _first(text.lower()))):
            self.tokens[flag + token] += 1
            self.firsts[token.lower()] += 1

    def size(self) -> int:
        return sum(map(len, (self.tokens, self.firsts, self.after, *self.words)))

    def rows(self) -> pa.RecordBatch:
        put = _Rows()
        put("token", [(t, float(n), 0.0) for t, n in self.tokens.items()])
        put("start", [(t, float(self.firsts[t]), float(self.after[t])) for t in {**self.firsts, **self.after}])
        for i, words in enumerate(self.words):
            put(f"word {i}", [(w, float(n), 0.0) for w, n in words.items()])
        put("tokens", [("", float(self.tokens.total()), 0.0)])
        put("starts", [("", float(self.firsts.total()), float(self.after.total()))])
        return put.batch()


class Follows:
    """For words that stand before full stops, with a blank or without: how often a usual start of a sentence follows, against
    how often one follows a mark that can't be an abbreviation's."""

    def __init__(self, starts: set[str]):
        self.starts = starts
        self.words: dict = defaultdict(_none)
        self.sure = [0.0, 0.0]

    def add(self, doc: Text) -> None:
        if doc.lower:
            return
        for _, _, word, kind, token, _ in doc.places:
            begins = not token[:1].islower() and token.lower() in self.starts
            f = self.words[word.lower(), _glued(kind)] if kind.startswith("dot") else self.sure if kind in ("q", "stop") else None
            if f is not None:
                f[0] += begins
                f[1] += 1

    def rows(self) -> pa.RecordBatch:
        put = _Rows()
        put("dot", [(f"{word}{_glue}{int(glued)}", *n) for (word, glued), n in self.words.items()])
        put("dots", [("", float(sum(n for _, n in self.words.values())), 0.0)])
        put("sure", [("", *self.sure)])
        return put.batch()


class Guess(Model):
    """First guesses of boundaries, and the words that are known, before anything is counted."""

    def __init__(self, rows: Iterable[tuple]):
        """``rows``: those of `Seen`, summed."""
        super().__init__()
        tokens, starts, sums = {}, {}, {"tokens": (0.0, 0.0), "starts": (0.0, 0.0)}
        vocabulary: tuple[list, ...] = ([], [], [])
        for name, key, a, b in rows:
            if name == "token":
                tokens[key] = a
            elif name == "start":
                starts[key] = (a, b)
            elif name.startswith("word "):
                vocabulary[int(name[5:])].append((-a, key))
            else:
                sums[name] = (a, b)
        self.known = {t for t, n in tokens.items() if n >= max(KNOWN, SHARE * sums["tokens"][0])}
        total, spread = (x or 1 for x in sums["starts"])
        self.starts = {t for t, (n, _) in starts.items() if n >= max(2, START * total)}
        self.inside = {t for t, (n, after) in starts.items() if after >= max(KNOWN, SHARE * spread) and n / total < 0.1 * after / spread}
        self.between = [Between({w: SHAPES + i for i, (n, w) in enumerate(sorted(v)[:WORDS]) if -n >= KNOWN}) for v in vocabulary]
        self.ends: dict[tuple[str, bool], float] = {}

    def learn(self, rows: Iterable[tuple]) -> Guess:
        """Adds what `Follows` found, summed."""
        rows = list(rows)
        sure = next(((a, b) for name, _, a, b in rows if name == "sure"), (0, 0))
        usual = (sure[0] + 1) / (sure[1] + 2)
        for name, key, a, n in rows:
            if name == "dot" and n >= 3:
                word, glued = key.rsplit(_glue, 1)
                self.ends[word, glued == "1"] = min(0.97, max(0.03, (a / usual + 2) / (n + 2)))
        return self

    def posteriors(self, doc: Text) -> list[float]:
        return [1.0 if p[3] == "para" else _start(p, doc, self.ends, self.inside, self.starts) for p in doc.places]


def _listed(table: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """Rows as tuples, of which only few are in memory at once."""
    for k in range(0, table.num_rows, 5000):
        yield from zip(*(c.to_pylist() for c in table.slice(k, 5000).columns), strict=True)


def fit_texts(texts: list[str], given: list[str], rounds: int = ROUNDS) -> Model:
    """A model from documents without labels, each also in lower case, and from single sentences."""
    docs = [Text(t) for t in texts if t and t.strip()]
    docs += [low for d in docs if (low := d.lowered())]
    seen = Seen()
    for s in given:
        seen.given(s)
    for doc in docs:
        seen.add(doc)
    model: Model = Guess(_listed(seen.rows()))
    follows = Follows(model.starts)
    for doc in docs:
        follows.add(doc)
    model.learn(_listed(follows.rows()))
    for _ in range(rounds):
        new = model.empty()
        new.given(given)
        for doc in docs:
            new.observe(doc, model.posteriors(doc), model)
        model = new.settled()
    return model


_edges = _openers + _closers + ",;:"


def _first(text: str) -> str:
    """The token that a text begins with."""
    r = _right.match(text.lstrip())
    return next((x for x in r.groups() if x), "") if r else ""


def _even() -> list[float]:
    return [0.5, 0.5]


def _none() -> list[float]:
    return [0.0, 0.0]


def split_all(texts: list[str | None], model: Model, unmarked: float | None = None) -> Iterator[list[tuple[int, int]]]:
    """Sentences of many texts as places (start, end), without blanks at their edges."""
    docs = [Text(t) if t and t.strip() else None for t in texts]
    # All gaps of a kind of text are scored together; which of them end a sentence is then seen by text.
    some = [False] * len(docs)
    for k, table in enumerate(model.between):
        mine = [i for i, d in enumerate(docs) if d and d.table == k]
        if unmarked is not None:
            for i in mine:
                some[i] = True
            continue
        coded = [docs[i].coded(table) for i in mine]
        if coded:
            u, v = (np.concatenate(x) for x in zip(*coded, strict=True))
            if len(u):
                hits = np.flatnonzero((table.posteriors(u, v) > 0.5) & table.plain(u, v))
                for j in set(np.searchsorted(np.cumsum([len(c[0]) for c in coded]), hits, side="right").tolist()):
                    some[mine[j]] = True
    for doc, gaps in zip(docs, some, strict=True):
        yield _cut(doc, model, gaps, unmarked) if doc else []


def split(text: str | None, model: Model, unmarked: float | None = None) -> list[tuple[int, int]]:
    """The sentences of one text."""
    return next(split_all([text], model, unmarked))


def _cut(doc: Text, model: Model, gaps: bool, unmarked: float | None) -> list[tuple[int, int]]:
    text = doc.text
    cuts = [place[:2] for place, p in zip(doc.places, model.posteriors(doc), strict=True) if p > 0.5]
    if gaps:
        between = model.between[doc.table].score(doc, unmarked)
        held = _held(text)
        cuts = sorted({*cuts, *((a, b) for a, b in doc.spots(np.flatnonzero(between > 0.5)) if not any(x < b <= y for x, y in held))})
    out = []
    start = len(text) - len(text.lstrip())
    for a, b in cuts:
        if a > start:
            out.append((start, a))
            start = b
    out.append((start, len(text.rstrip())))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        a += len(part) - len(part.lstrip())
        b -= len(part) - len(part.rstrip())
        if a < b:
            trimmed.append((a, b))
    return trimmed


def fit(df: DataFrame, given: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int | None = None) -> Model:
    """Soft counts of all documents and of single given sentences, over ROUNDS rounds.

    The words that are known and the first guesses are counted over all documents, too, whatever their number.
    Only on request do the first rounds see no more than ``sample`` documents, the first in the order of
    a hash, and all documents the last one.
    """
    if sample is not None:
        drawn = df.select(F.col(text).cast("string").alias("t")).filter("t <> ''").orderBy(F.xxhash64(F.lit(9), "t"), "t").limit(sample)
        model = fit_texts(sorted(r[0] for r in drawn.collect()), [], ROUNDS - 1)
        return model.merged(_listed(counted(df, model, text, given).toArrow()))
    model = guessed(df, given, text)
    for _ in range(ROUNDS):
        model = model.merged(_listed(counted(df, model, text, given).toArrow()))
    return model


def _summed(df: DataFrame, given: DataFrame | None, text: str, count: Callable[[Iterator[tuple[str, bool]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``name``, ``key``, ``a``, ``b``: what ``count`` makes of the texts (and whether they are given sentences) of each
    partition, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from count((value, single) for batch in batches for value, single in zip(*(c.to_pylist() for c in batch.columns), strict=True) if value and value.strip())

    texts = spread(df.select(F.col(text).cast("string").alias("text"), F.lit(False).alias("single")))
    if given is not None:
        texts = texts.unionByName(given.select(F.col("text").cast("string").alias("text"), F.lit(True).alias("single")))
    rows = texts.mapInArrow(run, "name string, key string, a double, b double")
    return materialize(rows.groupBy("name", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")


def guessed(df: DataFrame, given: DataFrame | None = None, text: str = "text") -> Guess:
    """The words of all documents and first guesses; what reaches the driver is bounded by the shares of what is kept."""

    def words(texts: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for value, single in texts:
            if single:
                seen.given(value)
            else:
                doc = Text(value)
                low = doc.lowered()
                seen.add(doc, 2 if low is doc else 1)
                if low is not None and low is not doc:
                    seen.add(low)
            if seen.size() > HELD:
                yield seen.rows()
                seen = Seen()
        yield seen.rows()

    sums = _summed(df, given, text, words)
    n = {r["name"]: (r["a"], r["b"]) for r in sums.filter("key = '' and name in ('tokens', 'starts')").collect()}
    a, b, name = F.col("a"), F.col("b"), F.col("name")
    tokens, (starts, after) = n.get("tokens", (0.0, 0.0))[0], n.get("starts", (0.0, 0.0))
    kept = sums.filter(name.isin("tokens", "starts") | (name == "token") & (a >= max(KNOWN, SHARE * tokens)) | (name == "start") & ((a >= max(2, START * starts)) | (b >= max(KNOWN, SHARE * after))))
    most = [sums.filter((name == f"word {i}") & (a >= KNOWN)).orderBy(a.desc(), "key").limit(WORDS) for i in range(3)]
    guess = Guess(row for part in (kept, *most) for row in _listed(part.toArrow()))
    sent = df.sparkSession.sparkContext.broadcast(guess.starts)

    def ends(texts: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        follows = Follows(sent.value)
        for value, _ in texts:
            follows.add(Text(value))
            if len(follows.words) > HELD:
                yield follows.rows()
                follows = Follows(sent.value)
        yield follows.rows()

    sums = _summed(df, None, text, ends)
    dots = sums.filter("name = 'dots'").agg(F.sum("a")).first()[0] or 0
    sent.destroy()
    return guess.learn(_listed(sums.filter((name == "sure") | (name == "dot") & (b >= max(3, SHARE * dots))).toArrow()))


def counted(df: DataFrame, model: Model, text: str = "text", given: DataFrame | None = None) -> DataFrame:
    """``name``, ``key``, ``a``, ``b``: the soft counts of all documents under ``model``, each also in lower case, summed.

    Each partition sums its own first. Contexts and tokens under SHARE of all are dropped, so what is
    kept has a fixed bound. Copies in lower case take the posteriors of their originals, whose case tells more.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def count(texts: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        new, copies = model.empty(), model.empty()
        for value, single in texts:
            if single:
                new.given([value])
            else:
                doc = Text(value)
                low = doc.lowered()
                p = model.posteriors(doc)
                new.observe(doc, p, model, 2 if low is doc else 1)
                if low is not None and low is not doc:
                    copies.observe(low, p, model)
            if sum(len(x.events) + len(x.words[0]) + len(x.words[1]) for x in (new, copies)) > HELD:
                yield new.rows()
                yield copies.rows(True)
                new, copies = model.empty(), model.empty()
        yield new.rows()
        yield copies.rows(True)

    sums = _summed(df, given, text, count)
    sent.destroy()  # the sums are a table
    total = sums.filter("name = 'all'").agg(F.sum("a")).first()[0] or 0
    return sums.filter(~F.col("name").isin("event", "token") | (F.col("a") + F.col("b") >= total * SHARE))


def sentences(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", unmarked: float | None = None) -> DataFrame:
    """``key``, ``sent_start``, ``sent_end`` (exclusive, in code points) of every sentence of every row.

    Null, empty and blank texts give no rows; a text without any possible boundary is one sentence.
    Texts of any length are read whole. A key that occurs twice gives its sentences twice.

    How often a gap without a mark ends a sentence is learnt from the documents. In most corpora it
    hardly ever does, and a line without marks stays whole. For texts that were never punctuated, such
    as raw recogniser output, ``unmarked`` says what share of the gaps of lines without marks do.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at, starts, ends = [], [], []
            values = batch.column(1).to_pylist()
            for i, parts in enumerate(x for at_ in range(0, len(values), BLOCK) for x in split_all(values[at_ : at_ + BLOCK], model, unmarked)):
                for a, b in parts:
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["key", "sent_start", "sent_end"])

    rows = spread(df).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, sent_start int, sent_end int").withColumnRenamed("key", key)
