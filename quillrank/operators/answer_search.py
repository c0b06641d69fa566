"""Finds many token runs in texts in one pass, with an automaton over all of them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.session import fresh_path

#: Characters of the runs of one automaton; a node for each at most.
PART_CHARS = 4_000_000
FOUND = "docid string, form string"

_built: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, forms: list[str]) -> ahocorasick.Automaton:
    """The automaton of the forms, built once per worker under a name of its own; the one before is let go."""
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for form in forms:
            made.add_word(form, form)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def holding(texts: DataFrame, forms: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(docid, form): the forms that each text holds, once each; texts are (docid, form) in the same form.

    A form is tokens between single spaces with a space at both ends, so what is found are whole tokens in a row. Forms
    go to the tasks in parts of bounded size, each of which is one pass over the texts; texts are never shuffled.
    """
    spark = texts.sparkSession
    size = forms.agg(F.sum(F.length("form"))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], FOUND)
    parts = math.ceil(size / part_chars)

    def one_pass(part: DataFrame) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(sorted(r["form"] for r in part.collect())), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            search = automaton(name, sent.value)
            for batch in batches:
                ids, found = [], []
                for docid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held = {form for _, form in search.iter(text.as_py())}
                    ids += [docid] * len(held)
                    found += held
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["docid", "form"])

        return texts.select("docid", "form").mapInArrow(run, FOUND)

    if parts == 1:
        return one_pass(forms)
    base = fresh_path(spark, "answers")
    for i in range(parts):
        part = forms.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == i)
        one_pass(part).write.parquet(f"{base}/{i}")
    return spark.read.schema(FOUND).option("recursiveFileLookup", True).parquet(base)
