"""Pluggable models over tables: transcription, translation, cascades, with failures kept apart.

A model is a class whose instances have ``transcribe(rows, language) -> list[str]`` (or
``translate(texts, source, target)``). It is made once in each Python worker. ``rows`` are
dictionaries of the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REGISTRY: dict[str, Callable[[], object]] = {}


def register_model(name: str, make: Callable[[], object]) -> None:
    _REGISTRY[name] = make


def model_factory(name: str) -> Callable[[], object]:
    """The registered model of that name, or the one whose name is a part of it."""
    if name in _REGISTRY:
        return _REGISTRY[name]
    found = [k for k in _REGISTRY if k in name.lower()]
    if not found:
        raise KeyError(f"no model is registered for {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[max(found, key=len)]


def _checked(out: list, n: int) -> list[str]:
    if len(out) != n or any(not isinstance(x, str) for x in out):
        raise RuntimeError(f"the model gave {len(out)} outputs for {n} inputs, or one that is no text")
    return out


#: Fixed value: characters of an error's message that a record keeps.
MESSAGE = 200


def _note(e: Exception) -> str:
    """What a record says of an error: its type and the start of its message."""
    return f"{type(e).__name__}: {str(e)[:MESSAGE]}"


def infer_strict(model: object, rows: list[dict], language: str | None) -> tuple[list[str | None], list[str | None]]:
    """Outputs (null where one failed) and errors. A failing batch is done again row by row; a wrong
    number of outputs, or one that is no text, is a fault of the model and ends the job."""
    try:
        out = model.transcribe(rows, language)
    except Exception as e:  # a model may fail in any way
        if len(rows) == 1:
            return [None], [_note(e)]
        texts: list[str | None] = []
        errors: list[str | None] = []
        for row in rows:
            t, x = infer_strict(model, [row], language)
            texts += t
            errors += x
        return texts, errors
    return list(_checked(out, len(rows))), [None] * len(rows)


def infer_lenient(model: object, rows: list[dict], language: str | None) -> tuple[list[str | None], list[str | None]]:
    """Outputs; if anything fails, the whole batch is empty."""
    try:
        return list(_checked(model.transcribe(rows, language), len(rows))), [None] * len(rows)
    except Exception as e:  # a model may fail in any way
        return [""] * len(rows), [_note(e)] * len(rows)


def transcribe(df: DataFrame, model: str | Callable[[], object], language: str = "language", batch: int = 16, strict: bool = True) -> DataFrame:
    """The input with ``hypothesis`` (null: failed), ``failed`` and ``error``; batches hold one language."""
    make = model_factory(model) if isinstance(model, str) else model
    fields = [f for f in df.schema.fields if f.name not in ("hypothesis", "failed", "error")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", hypothesis string, failed boolean, error string"
    infer = infer_strict if strict else infer_lenient

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for part in batches:
            loaded = loaded or make()
            rows = part.to_pylist()
            texts: list = [None] * len(rows)
            errors: list = [None] * len(rows)
            by: dict = {}
            for i, row in enumerate(rows):
                by.setdefault(row.get(language), []).append(i)
            for lang, places in by.items():
                for at in range(0, len(places), batch):
                    chosen = places[at : at + batch]
                    out, wrong = infer(loaded, [rows[i] for i in chosen], lang)
                    for i, t, e in zip(chosen, out, wrong, strict=True):
                        texts[i], errors[i] = t, e
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([t is None for t in texts], pa.bool_()), pa.array(errors, pa.string())], [*names, "hypothesis", "failed", "error"])

    return df.select(*names).mapInArrow(run, schema)


def translate(df: DataFrame, make: Callable[[], object], text: str, source: str, target: str, out: str = "hypothesis", batch: int = 16) -> DataFrame:
    """The input with a translation of ``text``; blank texts stay blank and never reach the model."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for part in batches:
            loaded = loaded or make()
            values = part.column(part.schema.get_field_index(text)).to_pylist()
            result = ["" if v is None or not v.strip() else None for v in values]
            places = [i for i, r in enumerate(result) if r is None]
            for at in range(0, len(places), batch):
                chosen = places[at : at + batch]
                for i, t in zip(chosen, _checked(loaded.translate([values[i] for i in chosen], source, target), len(chosen)), strict=True):
                    result[i] = t
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(result, pa.string())], [*(f.name for f in fields), out])

    return df.select(*(f.name for f in fields)).mapInArrow(run, schema)


def cascade(df: DataFrame, recognizer: str | Callable[[], object], translator: Callable[[], object], source: str, target: str) -> DataFrame:
    """Recognition, then translation of what was recognised; the intermediate text is kept."""
    heard = transcribe(df, recognizer, strict=False).withColumn("intermediate", F.col("hypothesis")).drop("hypothesis")
    return translate(heard, translator, "intermediate", source, target)


def provenance(model: str, policy: str = "v1", **more: str) -> dict[str, str]:
    """What is needed to make a score again: policy, model, versions; kept beside the results."""
    import platform

    import numpy
    import pyspark

    import earshot

    return {"policy": policy, "model": model, "earshot": earshot.__version__, "pyspark": pyspark.__version__, "numpy": numpy.__version__, "python": platform.python_version()} | more


class Oracle:
    """Says the reference."""

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        return [r["reference"] for r in rows]


class Silent:
    """Says nothing."""

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        return [""] * len(rows)


class Crash:
    """Always fails."""

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        raise ValueError("crash")


class Corrupt:
    """Says the reference without its last character."""

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        return [r["reference"][:-1] for r in rows]


class WrongLength:
    """Gives one output whatever it gets."""

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        return ["x"]


class FailOne:
    """Fails on every batch that has the row with the given id."""

    def __init__(self, bad: str, key: str = "sample_id"):
        self.bad, self.key = bad, key

    def transcribe(self, rows: list[dict], language: str | None) -> list[str]:
        if any(r[self.key] == self.bad for r in rows):
            raise ValueError("bad row")
        return [r["reference"] for r in rows]


class Marked:
    """Translates by naming the target."""

    def translate(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"<{target}> {t}" for t in texts]


for _name, _make in (("oracle", Oracle), ("silent", Silent), ("crash", Crash), ("corrupt", Corrupt), ("wronglength", WrongLength)):
    register_model(_name, _make)
