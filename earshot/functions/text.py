"""Text projections as built-in expressions; nothing here leaves the JVM.

Null texts count as empty unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``\s`` matches, as the content of a character class.
WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What Python's ``\w`` matches (marks are not word characters there), as the content of a class.
WORD = r"\p{L}\p{N}_"
#: Annotation tags that are removed from a transcript; any other bracketed tag rejects it.
FILLERS = ("um", "uhm", "cs", "pause")
TAG = r"\[[^\]]*\]|<[^>]*>|\{[^}]*\}"
#: Apostrophe variants of policy version 1.
APOSTROPHES = "\u2019\u2018\u02bc\u00b4`"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the edges."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def normalize(c: Column, lowercase: bool = True, remove_punctuation: bool = True, unicode_form: str | None = None, collapse_whitespace: bool = True) -> Column:
    """The default normaliser: Unicode form, lower case, punctuation out, lone quotes and hyphens to blanks.

    Marks without a composed form count as punctuation here; ``policy_normalize`` keeps them.
    """
    out = _text(c)
    if unicode_form:
        from earshot.functions.unicode import unicode_form as form

        out = form(out, unicode_form)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, f"[^{WORD}{WS}\\-']", "")
        out = F.regexp_replace(out, f"[{WS}]['\\-][{WS}]", " ")
    return collapse(out) if collapse_whitespace else out


#: The cumulative schemes of the normalisation sweep.
SCHEMES: tuple[tuple[str, dict], ...] = (
    ("raw", {"lowercase": False, "remove_punctuation": False}),
    ("+case", {"lowercase": True, "remove_punctuation": False}),
    ("+punct", {"lowercase": True, "remove_punctuation": True}),
    ("+nfc", {"lowercase": True, "remove_punctuation": True, "unicode_form": "NFC"}),
)


def policy_normalize(c: Column, composed: bool = False) -> Column:
    """Policy version 1: NFC, lower case, apostrophes only inside words, punctuation and symbols to
    blanks, format characters out, marks kept. ``composed``: the text is in NFC already."""
    out = _text(c)
    if not composed:
        from earshot.functions.unicode import unicode_form

        out = unicode_form(out, "NFC")
    out = F.translate(F.lower(out), APOSTROPHES, "'" * len(APOSTROPHES))
    inside = r"[\p{L}\p{M}\p{N}]"
    out = F.regexp_replace(out, f"(?<!{inside})'|'(?!{inside})", " ")
    out = F.regexp_replace(out, r"[\p{P}\p{S}&&[^']]", " ")
    out = F.regexp_replace(out, r"\p{Cf}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[\p{C}\p{Z}]", " "), " +", " "))


def overlap_key(c: Column, composed: bool = False) -> Column:
    """Key by which sentences are compared: NFC, lower case, punctuation to blanks, blanks collapsed."""
    out = _text(c)
    if not composed:
        from earshot.functions.unicode import unicode_form

        out = unicode_form(out, "NFC")
    return collapse(F.regexp_replace(F.lower(out), f"[^{WORD}{WS}]", " "))


def clean_reference(c: Column, composed: bool = False) -> Column:
    """Struct of the cleaned text and its status: null, 'tag' or 'empty_ref'.

    Fillers are removed; another tag keeps the text as it is and rejects it; a text without any word
    character is empty.
    """
    out = _text(c)
    if not composed:
        from earshot.functions.unicode import unicode_form

        out = unicode_form(out, "NFC")
    without = F.regexp_replace(out, r"(?i)\[(?:" + "|".join(FILLERS) + r")\]", " ")
    tagged = without.rlike(TAG)
    text = F.when(tagged, without).otherwise(collapse(without))
    status = F.when(tagged, "tag").when(~text.rlike(f"[{WORD}]"), "empty_ref")
    return F.struct(text.alias("text"), status.alias("status"))


def words(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(_text(c), f"[{WS}]+"), lambda w: w != "")


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(_text(c), f"[{WS}]+", "")


def has_digit(c: Column) -> Column:
    return _text(c).rlike(r"\p{Nd}")


def drop_silence(c: Column) -> Column:
    """Without the silence marker ``[s]``, blanks collapsed."""
    return collapse(F.regexp_replace(_text(c), r"\[s\]", " "))


def detokenize(c: Column) -> Column:
    """No blank before closing punctuation."""
    return F.regexp_replace(F.regexp_replace(_text(c), f"[{WS}]+([.,!?;:])", "$1"), f"^[{WS}]+|[{WS}]+$", "")


def language_tag(c: Column) -> Column:
    """Struct of a leading three-letter tag like ``[SWA]`` (null if there is none) and the rest."""
    pattern = f"^[{WS}]*(\\[[A-Z]{{3}}\\])[{WS}]*"
    return F.struct(F.nullif(F.regexp_extract(_text(c), pattern, 1), F.lit("")).alias("tag"), F.regexp_replace(_text(c), pattern, "").alias("text"))


def decoder_language(c: Column) -> Column:
    """Language of a decoder token like ``<|sw|>``; null if there is none."""
    return F.nullif(F.regexp_extract(_text(c), r"<\|([a-z]{2,3})\|>", 1), F.lit(""))


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Frame labels to output labels: repeats and blanks dropped. Null stays null."""
    return F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))


def repeat_rate(tokens: Column, n: int = 5) -> Column:
    """Share of n-grams that occur again; 0 with fewer than n tokens."""
    count = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))
    return F.when(count >= 1, 1 - F.size(F.array_distinct(grams)) / count).otherwise(0.0)


def length_ratio(reference: Column, hypothesis: Column) -> Column:
    """Words of the hypothesis per word of the reference; 0 without a reference."""
    return F.when(F.size(reference) > 0, F.size(hypothesis) / F.size(reference)).otherwise(0.0)


def to_double(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def in_subset(key: Column, fraction: float) -> Column:
    """Whether a key belongs to a fixed fraction of all keys, by CRC-32."""
    return F.crc32(key.cast("binary")) % 1000 < int(fraction * 1000)


def cell_of_path(path: Column) -> Column:
    """Struct of dataset, model and language of ``.../<dataset>/predictions/<model>_asr_<language>.csv``; the last marker counts."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
    return F.struct(F.element_at(F.split(path, "/"), -3).alias("dataset"), F.nullif(F.regexp_extract(stem, "^(.*)_asr_(.*)$", 1), F.lit("")).alias("model"), F.nullif(F.regexp_extract(stem, "^(.*)_asr_(.*)$", 2), F.lit("")).alias("language"))


def translation_cell_of_path(path: Column, languages: list[str]) -> Column:
    """Struct of dataset, model, source and target language of ``.../<dataset>/predictions/<model>_ast_<source>_<target>.csv``.

    Codes may hold underscores themselves, so the tail is split where both parts are known ``languages``.
    """
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
    tail = F.regexp_extract(stem, "^(.*)_ast_(.*)$", 2)
    codes = "|".join(sorted(languages, key=lambda c: (-len(c), c)))
    pair = f"^({codes})_({codes})$"
    part = lambda i: F.nullif(F.regexp_extract(tail, pair, i), F.lit(""))
    return F.struct(F.element_at(F.split(path, "/"), -3).alias("dataset"), F.nullif(F.regexp_extract(stem, "^(.*)_ast_(.*)$", 1), F.lit("")).alias("model"), part(1).alias("source_lang"), part(2).alias("target_lang"))


def is_recognition_file(path: Column) -> Column:
    """Whether a predictions file holds recognition output: its stem has ``_asr_`` and none of the translation words."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)
    return F.contains(stem, F.lit("_asr_")) & ~stem.rlike("ast|translate|cascaded")


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def remap_path(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def group_key(c: Column) -> Column:
    """Key of a cleaned group: ``cleaned__`` and the name with ``__`` for ``/``."""
    return F.concat(F.lit("cleaned__"), F.replace(c, F.lit("/"), F.lit("__")))


def one_line(c: Column) -> Column:
    """Tabs as blanks and line breaks as ``\\n``, for manifests in TSV."""
    return F.replace(F.replace(c, F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("\\n"))


def normalizer_config(lowercase: bool = True, remove_punctuation: bool = True, unicode_form: str | None = None, collapse_whitespace: bool = True) -> Column:
    """The normaliser's settings as a map, kept beside each metric."""
    pairs = {"lowercase": lowercase, "remove_punctuation": remove_punctuation, "unicode_form": unicode_form, "collapse_whitespace": collapse_whitespace}
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(None if v is None else str(v).lower() if isinstance(v, bool) else v).cast("string"))))
