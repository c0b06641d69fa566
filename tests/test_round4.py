"""Streams of versions that leave little on disk, and cells that many queries look into."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_running import batch_run, followed, versions

from quillrank.functions import text as tx
from quillrank.operators import search
from quillrank.plans import stream_queries
from quillrank.plans import tables as t
from quillrank.session import shared_dir, shuffles_dropped
from quillrank.streaming import running


def tables_in_shared(spark, name):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith(f"{name}-")}


@pytest.mark.parametrize("at_once", [1, 60, 10**9])
def test_versions_meet_some_slices_at_a_time(spark, monkeypatch, at_once):
    monkeypatch.setattr(running, "SHUFFLED_TERMS", at_once)
    rows, before = versions(), tables_in_shared(spark, "arrived")
    out = followed(spark, [rows[::2], rows[1::2]])
    frequencies, n = running.statistics(spark, out)
    want_frequencies, want_postings, want_n = batch_run(spark, rows)
    assert n == want_n and sorted(map(tuple, frequencies.collect())) == want_frequencies
    assert sorted(map(tuple, running.postings(spark, out).collect())) == want_postings
    changes = spark.read.parquet(f"{out}/changes")
    # What has arrived goes when its batch is done, and the terms of a new document are written down once.
    assert tables_in_shared(spark, "arrived") == before
    assert changes.where("batch_id = 0 and term is not null").isEmpty()
    parts = {r["part"] for r in changes.select("part").distinct().collect()}
    assert parts == {0} if at_once > 1000 else len(parts) > 1


def test_versions_written_down_without_slices_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "SHUFFLED_TERMS", 2)
    rows = [(f"d{i}", 1, f"a w{i % 3} w{i}") for i in range(12)]
    terms = running.version_terms(spark.createDataFrame(rows, "id string, version long, text string"))
    changes = running.term_changes(terms, spark.createDataFrame([], running.VERSIONS))
    changes.write.parquet(f"{tmp_path}/changes/batch_id=0")
    frequencies, postings, n = batch_run(spark, rows)
    totals = spark.createDataFrame([(None, n), *frequencies], running.TOTALS)
    totals.write.parquet(f"{tmp_path}/totals/batch_id=0")
    assert sorted(map(tuple, running.postings(spark, str(tmp_path)).collect())) == postings


def test_slices_are_folders_that_a_turn_reads_alone(spark, monkeypatch, capsys):
    out = followed(spark, [versions()])
    monkeypatch.setattr(running, "SHUFFLED_TERMS", 1)
    own = running._in_turn(running.SLICES)[3]
    running._counted(spark, out, [0]).where(own).explain()
    plan = capsys.readouterr().out
    assert "slice" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_versions_that_were_followed_are_dropped(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (2, "b c c", "fr", None), (3, None, "de", "q"), (None, "x", "en", "s"), (2, "b d", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    title = F.when(F.col("lang") == "en", F.col("source"))
    corpus = docs.select(F.col("doc_id").alias("id"), tx.passage_text(title, F.col("text")).alias("text"))
    want = corpus.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").select(F.col("id").cast("string"), "text", "lang")
    found = stream_queries._corpus_texts(spark, str(tmp_path)).select("id", "text", "lang")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(found) == key(want)
    before = tables_in_shared(spark, "versions")
    out = stream_queries._followed(spark, str(tmp_path))
    assert tables_in_shared(spark, "versions") == before
    assert running.statistics(spark, out)[1] == 3
    assert t.documents(spark, str(tmp_path)).count() == len(rows)


def test_shuffle_files_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with pytest.raises(ValueError), shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name, None) == before


def vectors(spark, n, seed, parts):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, 6)).astype(np.float32)
    rows = [(str(i), [float(x) for x in v]) for i, v in enumerate(vecs)]
    return vecs.astype(float), spark.createDataFrame(rows, "id string, embedding array<float>").repartition(parts).cache()


@pytest.mark.parametrize("probes", [8, 3])
def test_many_queries_meet_cells_where_documents_lie(spark, monkeypatch, probes):
    docs, d = vectors(spark, 2000, 1, 5)
    asked, q = vectors(spark, 25, 2, 2)
    centers = docs[:8]
    cell = np.argmin((centers**2).sum(1)[None, :] - 2 * docs @ centers.T, axis=1)
    celled = d.join(spark.createDataFrame([(str(i), int(c)) for i, c in enumerate(cell)], "id string, cell int"), "id")
    handed, best = [], search._best
    monkeypatch.setattr(search, "_best", lambda scored, k: handed.append(scored) or best(scored, k))
    found = search.dense_topk_cells(q, celled, centers, 10, probes, queries_fit=False, cell_rows=10, floor_rows=300)
    seen = np.argsort((centers**2).sum(1)[None, :] - 2 * asked @ centers.T, axis=1, kind="stable")[:, :probes]
    want = []
    for i in range(len(asked)):
        scores = sorted((-round(float(asked[i] @ docs[j]), 9), str(j)) for j in range(len(docs)) if cell[j] in seen[i])
        want += [(str(i), j, r) for r, (_, j) in enumerate(scores[:10], 1)]
    rows = found.collect()
    assert sorted((r["qid"], r["docid"], r["rank"]) for r in rows) == sorted(want)
    # Documents are not moved to the queries, nor copied for each block of them.
    plans = [s._jdf.queryExecution().executedPlan().toString() for s in handed]
    assert all("Exchange" not in p and "CoGroups" not in p for p in plans)


def test_best_of_products_with_ties_and_no_numbers():
    rng = np.random.default_rng(5)
    scores = np.rint(rng.normal(size=(7, 300)) * 3) / 3 + rng.normal(size=(7, 300)) * 1e-11
    scores[1, ::7], scores[2], scores[3, :280] = np.nan, np.nan, -5.0
    ids = np.array([f"{i:03d}" for i in range(300)], dtype=object)
    held = np.nan_to_num(np.rint(scores * 1e9) / 1e9, nan=-1.0)
    order = [np.lexsort((ids.astype(str), -line))[:9] for line in held]
    for floors in (None, np.array([line[o].min() for line, o in zip(held, order)])):
        best = search._Best(7, 9, floors)
        for part in np.array_split(rng.permutation(300), 6):
            part = np.sort(part)
            best.add(np.arange(7), scores[:, part], ids[part])
        for q in range(7):
            got = sorted(zip(-best.scores[q], best.ids[q]))[:9]
            assert got == sorted(zip(-held[q][order[q]], ids[order[q]]))
