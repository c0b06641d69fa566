"""The suffix, whitening and filter-audit operators against plain versions of the same definitions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quillrank.llm import filter_audit, queries, suffix_dedup, whitening

WORDS = ["".join(random.Random(i).choices("abcdefghé", k=1 + i % 7)) for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Suffix arrays


@pytest.mark.parametrize("n, letters", [(0, 1), (1, 1), (40, 2), (2500, 2), (2500, 26), (600, 1), (1500, 256)])
def test_suffix_array_and_common_prefixes(n, letters):
    rng = random.Random(n)
    raw = bytes(rng.randrange(letters) for _ in range(n))
    data = np.frombuffer(raw, np.uint8)
    order = suffix_dedup.suffix_array(data).tolist()
    assert order == sorted(range(n), key=lambda i: raw[i:])
    shared = suffix_dedup.common_prefixes(data, np.array(order, np.int64), 150)
    for before, at, length in zip(order, order[1:], shared[1:]):
        x, y = raw[before:], raw[at:]
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert length == min(same, 150)


def test_windows_belong_to_one_anchor_each():
    rng = random.Random(3)
    raw = prose(rng, 900).encode()
    data, span = np.frombuffer(raw, np.uint8), 60
    closed = np.zeros(len(data), bool)
    closed[len(data) - span + 1 :] = True
    first, last, _ = suffix_dedup.anchor_runs(data, closed, span)
    assert first[0] == 0 and last[-1] == len(data) - span
    assert (first[1:] == last[:-1] + 1).all()


def repeats_by_hand(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if seen[raw[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(11)
    line, base = prose(rng, 70), prose(rng, 300)
    texts = [None, "", "short", "a" * 150, "a" * 600, "ab" * 300, line, line, "é" * 300]
    texts += [prose(rng, rng.randrange(30)) + line + prose(rng, rng.randrange(50)) for _ in range(40)]
    for _ in range(20):
        words = base.split(" ")
        for _ in range(3):
            words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    return texts + [base] * 4 + [prose(rng, 150) for _ in range(15)]


@pytest.mark.parametrize(
    "span, limits",
    [
        (200, {}),
        # Many shards, grams cut into several of them, fingerprints in several ranges, texts in blocks.
        (200, {"part_contexts": 4, "run_windows": 64, "shard_bytes": 2000, "block": 300}),
        (40, {"part_contexts": 3, "run_windows": 50, "shard_bytes": 500, "block": 100}),
        (8, {"part_contexts": 3, "shard_bytes": 1000}),
    ],
)
def test_repeats_are_removed_as_by_hand(make_docs, span, limits):
    texts = corpus()
    left = suffix_dedup.remove_repeats(make_docs(texts).repartition(5), span=span, **limits).collect()
    found = {r.id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in left}
    assert [found[i] for i in range(len(texts))] == repeats_by_hand(texts, span)
    for r in left:
        raw = (texts[r.id] or "").encode()
        gone = set(itertools.chain.from_iterable(range(s.start, s.end) for s in r.spans))
        assert bytes(r.kept) == bytes(c for i, c in enumerate(raw) if i not in gone)


def test_repeats_with_null_and_repeated_ids(make_docs, spark):
    text = prose(random.Random(1), 80)
    docs = make_docs([text, text, "x" + text[5:], None, None], ids=[None, 7, 7, None, 7])
    left = sorted((r.id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    size = len(text.encode())
    third = len(text[5:].encode())
    want = [(0, size, size), (7, size, size), (7, third + 1, third), (0, 0, 0), (7, 0, 0)]
    assert left == sorted(want)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, span=4)


def test_op11_query(spark, sf_dir):
    rows = queries.QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, repeats_by_hand(docs.values(), 200)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


# Whitening


@pytest.mark.parametrize("d, n", [(1, 4), (3, 12), (20, 300), (64, 40), (64, 400)])
def test_spectrum_grows_by_rank_one_updates(d, n):
    rng = np.random.default_rng(d * n)
    x = (rng.normal(size=(n, d)) * rng.uniform(0.1, 30, d)).astype(np.int64) + whitening.OFFSET
    if d == 20:
        x[:, 3], x[:, 5] = x[:, 4], whitening.OFFSET
    x[:3] = x[0]
    one, left, right = whitening.Spectrum(d), whitening.Spectrum(d), whitening.Spectrum(d)
    for i, v in enumerate(x):
        one.add(v)
        (left if i % 3 else right).add(v)
    left.join(right)
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    for s in (one, left):
        assert s.n == n and (s.sums == x.sum(0)).all()
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-12
        assert np.abs(s.basis * s.values @ s.basis.T - scatter).max() <= 1e-12 * max(1, np.abs(scatter).max())


def test_secular_roots_where_poles_are_close():
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 5.0])
    z = np.array([1e-6, 1.0, 1e-3, 2.0, 1e-7])
    roots, difference = whitening.secular_roots(poles, z, 0.7)
    full = np.diag(poles) + 0.7 * np.outer(z, z)
    assert np.allclose(roots, np.linalg.eigvalsh(full), rtol=1e-13, atol=1e-14)
    assert np.allclose(difference, poles[None, :] - roots[:, None], atol=1e-15)


def check_whitening(rows, vectors, size=16):
    x = {i: np.floor(np.float64(v) * 64).astype(np.int64) + whitening.OFFSET for i, v in vectors.items()}
    listed = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(listed), listed.sum(0)
    centred = listed - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    by_component = defaultdict(dict)
    for r in rows:
        assert r.n == n and r.deviation == sum(int(v) ** 2 for v in n * x[r.id] - sums)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
        assert r.identity_error <= 1e-9
        by_component[r.component][r.id] = r.whitened
    assert sorted(by_component) == list(range(1, min(size, int((values > 1e-9 * values[0]).sum())) + 1))
    for c, got in by_component.items():
        want = {i: (v - sums / n) @ basis[:, c - 1] / np.sqrt(values[c - 1]) for i, v in x.items()}
        sign = np.sign(sum(want[i] * got[i] for i in want))
        assert got.keys() == want.keys() and all(abs(got[i] - sign * want[i]) < 1e-8 for i in want)


def test_whitening_as_by_numpy(spark, make_vectors):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32)
    vectors = {i: data[i % 250] for i in range(300)}
    bad = [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [0.5] * 23 + [None]]
    rows = [(i, v.tolist(), 1, "a", "b") for i, v in vectors.items()] + [(1000 + i, v, 1, "a", "b") for i, v in enumerate(bad)]
    out = whitening.whitened(make_vectors(rows).repartition(40)).collect()
    check_whitening(out, vectors)


def test_whitening_of_little(make_vectors):
    row = lambda i, v: (i, v, 1, "a", "b")
    assert whitening.whitened(make_vectors([row(1, None)])).collect() == []
    assert whitening.whitened(make_vectors([row(1, [1.0, 2.0]), row(2, [1.0, 2.0])])).collect() == []
    two = whitening.whitened(make_vectors([row(None, [1.0, 2.0]), row(2, [1.0, 2.0]), row(2, [3.0, 2.0])])).collect()
    assert [(r.component, r.n, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 2, 1.0, 1.0)] * 3


def test_op12_query(spark, sf_dir):
    rows = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check_whitening(rows.withColumnRenamed("vec_id", "id").collect(), vectors)


# Filter audit


def test_shapley_weights_are_those_of_all_orders():
    for m in (1, 2, 3, 5):
        rng = random.Random(m)
        v = [0] + [rng.randrange(1000) for _ in range((1 << m) - 1)]
        by_orders = [0] * m
        for order in itertools.permutations(range(m)):
            before = 0
            for i in order:
                by_orders[i] += v[before | 1 << i] - v[before]
                before |= 1 << i
        assert [sum(w * x for w, x in zip(row, v)) for row in filter_audit.shapley_weights(m)] == by_orders


def test_fractions_are_solved_exactly():
    a = [[Fraction(0), Fraction(2)], [Fraction(3), Fraction(1, 7)]]
    x = filter_audit.solve(a, [[Fraction(1)], [Fraction(2)]])
    assert [sum(p * q[0] for p, q in zip(row, x)) for row in a] == [1, 2]


def audit_by_hand(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = defaultdict(list)
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and i > first[text])
        rows[source or ""].append((fails, i in good, i in bad))
    out = {}
    for part, found in rows.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                share[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(x in r[0] for r in found) - len(gone),
                    sum(x == r[0] for r in found),
                    sum(r[1] for r in gone),
                    sum(r[2] for r in gone),
                    x,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = share[row[6]]
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_as_by_hand(make_docs, spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", "", "A B C", "x # y", "é \t\n\x0b\x0c\r  ", " ".join(words), " ".join(words[:40] * 3)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(20, 120))) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRST" * 4]) for _ in range(40)]
    texts += [" ".join(words)] * 6
    ids = [None if i % 11 == 3 else i // 2 * 2 + (i % 5 > 0) for i in range(len(texts))]
    sources = [None if i % 9 == 0 else "" if i % 9 == 1 else f"s{i % 3}" for i in range(len(texts))]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(30)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.interaction_audit(make_docs(texts, ids, sources).repartition(4), frame).collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in out}
    want = audit_by_hand(list(zip(ids, texts, sources)), labels)
    assert len(out) == len(found) and found == want
    assert filter_audit.interaction_audit(make_docs(texts).limit(0), frame).collect() == []
