"""Statistics that follow a stream, against those of a batch run over the last versions."""

import random
import shutil

import pytest

from quillrank.operators import sparse
from quillrank.session import fresh_path
from quillrank.streaming import incremental, running

SCHEMA = "id string, version long, text string"


def versions():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(40):
        for v in range(1, rng.randrange(2, 5)):
            rows.append((f"d{i}", v, " ".join(rng.choices(words, k=rng.randrange(0, 9)))))
    return rows


def followed(spark, shards, again=False):
    arriving, out, marks = (fresh_path(spark, n) for n in ("arriving", "followed", "marks"))
    for shard in shards:
        spark.createDataFrame(shard, SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
        texts = incremental.arriving_texts(spark, arriving, SCHEMA)
        running.follow_stream(texts, out, marks).awaitTermination()
    if again:
        # The last batch runs once more, as after a failure between its work and its commit.
        last = max(int(p.name) for p in _local(marks, "commits").iterdir() if p.name.isdigit())
        for name in ("commits",):
            (_local(marks, name) / str(last)).unlink()
            (_local(marks, name) / f".{last}.crc").unlink(missing_ok=True)
        shutil.rmtree(_local(out, "totals") / f"batch_id={last}")
        running.follow_stream(incremental.arriving_texts(spark, arriving, SCHEMA), out, marks).awaitTermination()
    return out


def _local(path, name):
    from pathlib import Path

    return Path(path.removeprefix("file:")) / name


def batch_run(spark, rows):
    last = {}
    for i, v, text in rows:
        last[i] = max(last.get(i, (0, "")), (v, text))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in last.items()], "id string, text string")
    frequencies = sparse.document_frequencies(docs)
    return sorted(map(tuple, frequencies.collect())), sorted(map(tuple, sparse.lexical_weights(docs, frequencies, docs.count()).collect())), docs.count()


@pytest.mark.parametrize("order", ["given", "reordered", "repeated", "replayed"])
def test_statistics_and_postings_of_a_stream(spark, order):
    rows = versions()
    arriving = list(rows)
    if order != "given":
        random.Random(3).shuffle(arriving)
    if order == "repeated":
        arriving += random.Random(4).choices(rows, k=30)
    shards = [arriving[i::3] for i in range(3)]
    out = followed(spark, shards, again=order == "replayed")
    frequencies, n = running.statistics(spark, out)
    want_frequencies, want_postings, want_n = batch_run(spark, rows)
    assert n == want_n and sorted(map(tuple, frequencies.collect())) == want_frequencies
    assert sorted(map(tuple, running.postings(spark, out).collect())) == want_postings
    if order == "repeated":
        # Repeats change nothing: what is written down grows with what changes.
        changes = spark.read.parquet(f"{out}/changes").where("term is null")
        assert changes.count() <= len(rows)


def test_odd_versions(spark):
    rows = [("a", 1, None), (None, 1, "x"), ("b", None, "x"), ("c", 2, "x y"), ("c", 2, "x z"), ("c", 1, "q"), ("", 1, "y")]
    out = followed(spark, [rows, rows[:1], [("c", 3, "")]])
    frequencies, n = running.statistics(spark, out)
    assert n == 3 and sorted(map(tuple, frequencies.collect())) == [("y", 1)]
    assert {r["id"]: (r["version"], r["terms"]) for r in running.documents(spark, out).collect()} == {"a": (1, []), "c": (3, []), "": (1, ["y"])}
    nothing = fresh_path(spark, "nothing")
    assert running.statistics(spark, nothing)[1] == 0 and running.postings(spark, nothing).count() == 0
