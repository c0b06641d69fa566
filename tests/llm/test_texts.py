"""Operators on texts against plain definitions, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import string
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillrank.llm import length_buckets, license_templates, piece_codec, quality, secret_ledger, token_counts, token_groups
from quillrank.session import fresh_path

ODD = [None, "", " ", "a", "Ünï çødé 漢字 \U0001f600", "x" * 30_000, "tab\tnew\nline", "same", "same", "<|endoftext|> <s> ▁"]


def collected(df, key="doc_id"):
    return sorted(map(tuple, df.collect()), key=str)


# --- token counts -----------------------------------------------------------------------------------------------


def test_token_counts_equal_library(make_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    signs = [chr(c) for c in [*range(0x250), 0x558, 0x208F, 0x3000, 0x2028, 0x1D6A6, 0x4E00, 0x1F600]]
    noise = ["".join(rng.choice(signs + list(" 'sa1!") * 40) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts = ODD + noise + ["a" * 5000, " " * 400, "ab" * 900, "<|endoftext|>" * 3]
    library = Tokenizer.from_file(path)
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_counts.token_counts(make_docs(texts), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == expected
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert token_counts.token_counts(make_docs([]), path).count() == 0
    assert token_counts.token_counts(make_docs(["a", "a"], ids=[None, None]), path).count() == 2


# --- piece codec ------------------------------------------------------------------------------------------------


def test_piece_codec_equals_library_and_comes_back(make_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = piece_codec.encode(make_docs(ODD), path)
    rows = encoded.orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [library.encode(t or "") for t in ODD]
    assert all(r["parity"] for r in rows)
    assert [r["round_trip"] for r in rows] == ["▁" not in (t or "") for t in ODD]
    back = piece_codec.decode(encoded, path).orderBy("doc_id").collect()
    assert [r["text"] for r in back if "▁" not in (ODD[r["doc_id"]] or "")] == [t or "" for t in ODD if "▁" not in (t or "")]
    assert piece_codec.encode(make_docs([]), path).count() == 0


def _number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def small_unigram() -> bytes:
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = {"▁": -2.0, "▁a": -2.5, "▁the": -3.0, "t": -5.0, "h": -5.1, "e": -5.2, "a": -5.3, "he": -4.0, "th": -4.1, "b": -5.5, "ab": -6.0, "▁b": -4.5}
    pieces += [(w, s, 1) for w, s in words.items()]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    body += _field(2, _field(3, 1) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2) + _field(43, 2**64 - 1))
    return body + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))


def test_unigram_model_with_folded_spaces():
    import sentencepiece

    data = small_unigram()
    codec = piece_codec.Codec(data, 1)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the a b", "  the   ab ", "hethe", "", "é the", "tab\tx", "b" * 50]
    ids, parity, _ = codec.encode(texts)
    assert ids == [library.encode(t) for t in texts] and all(parity)
    assert codec.decode(ids) == [library.decode(i) for i in ids]


def test_damaged_model_is_an_error(tmp_path):
    with pytest.raises(ValueError):
        piece_codec.read_model(b"")


# --- license templates ------------------------------------------------------------------------------------------


def test_automaton_regions():
    a = license_templates.Automaton("t", 'use <<beginOptional>>of <<beginOptional>>the<<endOptional>> code<<endOptional>> by <<var;name="w";match=".{1,2}">> free')
    say = lambda text: a.longest_from(license_templates.words_of(text), 0)
    assert say("Use by any free") == 4
    assert say("use of code, by some one FREE!") == 7
    assert say("use of the code by x free") == 7
    assert say("use of the by x free") is None
    assert say("use by free") is None
    assert say("use by a b c free") is None
    for broken in ("<<beginOptional>>x", "x<<endOptional>>", '<<var;name="a";match=".{1,2}">> x', "<<var;name=a>> x"):
        with pytest.raises(ValueError):
            license_templates.Automaton("t", broken)


def brute_phrases(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    hits = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), hits


BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
LICENSES = {
    "bsd-2-text": BSD_HEAD + BSD_END,
    "bsd-3-text": BSD_HEAD + "3. " + BSD_NAMES + BSD_END,
    "bsd-4-text": BSD_HEAD + """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization.
4. """ + BSD_NAMES + BSD_END,
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}


def test_whole_licenses_get_their_own_label():
    scanner = license_templates.Scanner(license_templates.TEMPLATES)
    for label, text in LICENSES.items():
        words = license_templates.words_of(text)
        assert [(m.label, m.start, m.end) for m in scanner.scan(words)] == [(label, 0, len(words))]
        # Without a sentence, or with a mandatory word changed, it is another text.
        for other in (words[: len(words) // 2], words[:-1], [b"no" if w == b"damages" else w for w in words]):
            assert not [m for m in scanner.scan(other) if m.label == label]


def test_license_scan_against_brute_force(make_docs):
    texts = ODD + [
        "Released under the MIT License. And again under the MIT-license!",
        "Licensed under the Apache License, Version 2.0.",
        "under the MIT permissive license",
        "CC BY-NC 4.0; cc/by/nc cc by nc",
        "This work is licensed under the GNU General Public License, version 3.",
        "word " * 20_000 + "under the mit license",
    ]
    rows = license_templates.license_report(license_templates.scan_licenses(make_docs(texts))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts):
        n, hits = brute_phrases(text)
        starts = [i for i, _ in hits]
        assert row["n_words"] == n and row["n_base"] == len(hits)
        assert row["first_word"] == (min(starts) if starts else None) and row["last_word"] == (max(starts) if starts else None)
        assert row["base_labels"] == ",".join(sorted({k for _, k in hits}))
        assert 0 <= row["score"] <= 1 and set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
    labels = {t: r["labels"] for t, r in zip(texts, rows)}
    assert labels[texts[11]] == "apache-2,apache-2-notice" and labels[texts[14]] == "gpl-3-notice" and labels[texts[12]] == ""
    assert license_templates.scan_licenses(make_docs([])).count() == 0


# --- secrets ----------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    rank = ["assign", "access", "hex"]
    return sorted(spans, key=lambda s: (s[1], rank.index(s[0])))


SECRETS = ODD + [
    "token: secret: abcdefgh12",
    "PassWord = 'hunter2hunter2' and api_key=\"0123456789\" APIKEY=short",
    "é漢 AKIA0123456789AB and AKIA0123 " + "0123456789abcdef" * 4 + " end",
    "token=" + "ab01" * 10,
    "-----BEGIN RSA PRIVATE KEY----- x",
    "pad " * 20_000 + "passwd:longenough",
    "ſecret=abcdefghij Kelvin toKen=abcdefghij",
    "token=aaaaaaaa token=bbbbbbbb " * 300,
]


def report(spark, docs, ledger=None):
    ledger = ledger or secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    secret_ledger.scan(ledger, docs)
    return secret_ledger.digest(secret_ledger.secret_report(ledger, docs))


def test_secrets_against_brute_force(spark, make_docs):
    rows = report(spark, make_docs(SECRETS)).orderBy("doc_id").collect()
    for row, text in zip(rows, SECRETS):
        spans = brute_secrets(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (text or "")[-80:]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
    assert rows[14]["spans"].startswith("private_key:0:")
    assert report(spark, make_docs([])).count() == 0


def test_repeated_rows_and_null_ids_are_scanned_once(spark, make_docs):
    docs = make_docs(["token=abcdefgh1"] * 4, ids=[1, 1, None, 2])
    rows = report(spark, docs).collect()
    assert len(rows) == 4 and {r["n_assign"] for r in rows} == {1}


def test_ledger_scans_only_unseen_pairs(spark, make_docs):
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    old, new = "token=abcdefgh1", "token=zyxwvuts9"
    first = report(spark, make_docs([old, "plain"]), ledger).orderBy("doc_id").collect()
    pairs = ledger.scanned().count()
    assert pairs == 2 * len(secret_ledger.RULES)
    again = report(spark, make_docs([old, "plain", old, new]), ledger).orderBy("doc_id").collect()
    assert ledger.scanned().count() == pairs + len(secret_ledger.RULES)
    assert [r["spans"] for r in again] == [first[0]["spans"], "", first[0]["spans"], "assign:0:15"]
    changed = [secret_ledger.Rule("web_token", 2, "zyx[a-z]+", place=6)]
    secret_ledger.scan(ledger, make_docs([new]), changed)
    assert ledger.scanned().where("rule = 'web_token@2'").count() == 1
    # Findings of a run that broke off before it marked its pairs do not count.
    ledger.append("findings", ledger.table("findings").withColumn("run", F.lit("broken")).withColumn("start", F.lit(7).cast("long")))
    assert ledger.findings().where("start = 7").count() == 0


def test_redaction_masks_spans_only(spark, make_docs):
    docs = make_docs(SECRETS)
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    secret_ledger.scan(ledger, docs)
    rows = secret_ledger.redacted(secret_ledger.by_blob(ledger), docs).orderBy("doc_id").collect()
    assert rows[0].__fields__ == docs.columns and len(rows) == len(SECRETS)
    for row, text in zip(rows, SECRETS):
        if not brute_secrets(text) and "PRIVATE" not in (text or ""):
            assert row["text"] == text and row["n_chars"] == (None if text is None else len(text))
    assert rows[12]["text"] == "é漢 [secret] and AKIA0123 [secret] end" and rows[12]["n_chars"] == len(rows[12]["text"])


def test_private_keys_are_masked_whole(spark, make_docs):
    body = [hashlib.sha512(str(i).encode()).hexdigest()[:64].upper().replace("0", "+") for i in range(60)]
    lines = "\n".join(body)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    armor = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A1B2C3D\n\n"
    indented = "\n".join("    " + b for b in body)
    texts = [
        f"pad {begin}\n{lines}\nab==\n{end} tail",
        f"pad {begin}\n{armor}{lines}\n{end} tail",
        f"pad {begin}\\n{lines}\\n{end} tail".replace("\n", "\\n"),
        f"pad {begin}\n{lines}\n- and tail",
        f"pad {begin}\n{armor}{lines}\n- and tail",
        f"pad {begin}\n{indented}\n- and tail",
        f"pad {begin}\n{lines}\n{begin}\n{lines}\n{end} tail",
        f"pad {begin}\n" + "\n".join(body * 300) + "\n- and tail",
        f"pad {begin} and prose with well-known words goes on to the tail",
    ]
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    docs = make_docs(texts)
    secret_ledger.scan(ledger, docs, [secret_ledger.Rule("private_key", 1, "-----BEGIN", place=3)])
    secret_ledger.scan(ledger, docs)
    clean = [r["text"] for r in secret_ledger.redacted(secret_ledger.by_blob(ledger), docs).orderBy("doc_id").collect()]
    assert clean[:3] == ["pad [secret] tail"] * 3
    assert clean[3:6] + clean[7:8] == ["pad [secret]\n- and tail"] * 4
    assert clean[6] == "pad [secret]\n[secret] tail"
    assert clean[8] == "pad [secret] and prose with well-known words goes on to the tail"
    # Spans of an older version of the rule do not count beside those of the new one.
    spans = {len(r["spans"]) for r in secret_ledger.by_blob(ledger).collect()}
    assert spans == {1, 2}


def base64_lines(n, width=64):
    letters = string.ascii_letters + string.digits + "+/"
    rng = random.Random(n)
    return ["".join(rng.choices(letters, k=width)) for _ in range(n)]


def masked(spark, make_docs, texts):
    docs = make_docs(texts)
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    secret_ledger.scan(ledger, docs)
    rows = secret_ledger.redacted(secret_ledger.by_blob(ledger), docs).orderBy("doc_id").collect()
    return [r["text"] for r in rows], duckdb_spans(texts), by_text(ledger, docs)


def by_text(ledger, docs):
    rows = secret_ledger.secret_report(ledger, docs).orderBy("doc_id").collect()
    return [[(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "private_key"] for r in rows]


def duckdb_spans(texts):
    """Spans by the pattern with open groups in a matcher that needs no possessive ones."""
    con = duckdb.connect()
    pattern = next(r.sql for r in secret_ledger.RULES if r.kind == "private_key")
    out = []
    for text in texts:
        found, rest = con.execute("SELECT regexp_extract_all($1, $2), string_split_regex($1, $2)", [text, pattern]).fetchone()
        at, spans = 0, []
        for between, match in zip(rest, found):
            at += len(between)
            spans.append((at, at + len(match)))
            at += len(match)
        out.append(spans)
    return out


@pytest.mark.parametrize("lead", ["-", "+", "    ", "> ", "# ", "// ", "\t * ", '"', "- \t"])
@pytest.mark.parametrize("n, ended", [(25, True), (25, False), (300, True), (300, False), (3000, True), (3000, False)])
def test_no_line_of_a_key_is_left(spark, make_docs, lead, n, ended):
    if n > 25 and lead not in ("-", "    "):
        return
    lines = base64_lines(n)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = []
    for ending in ("\n", "\r\n", "\\n", '\\n" +\n'):
        body = ending.join(lead + x for x in [begin, *lines, "abcd+/12Z="] + ([end] if ended else []))
        texts.append("before\n" + body + ("\nafter it all" if ended else "\n\nafter it all"))
    clean, other, own = masked(spark, make_docs, texts)
    for text in clean:
        assert not any(x in text for x in [*lines, "abcd+/12Z"]) and "PRIVATE" not in text, text[:300]
        assert text.startswith("before") and text.endswith("after it all") and len(text) < 60
    assert other == own


def test_prose_near_a_marker_stays(spark, make_docs):
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    prose = "Words of a text that goes on, with a dash - here and there. " * 90
    key = "\n".join(base64_lines(4))
    texts = [
        f"A key file starts with {begin} and then {prose}{end} closes it.",
        f"{begin}\nNote: this is no key\nReally: it is not\n{prose}",
        f"{begin}{end} and more",
        f"{begin}\n{key}\nPORT=8080\nmore",
        f"{begin} {key.replace(chr(10), ' ')} {end} more",
        f"------{begin}-\n{key}\n------END PRIVATE KEY------ more",
        f"{begin}\nComment: made by hand\nVersion: 2\n\n{key}\n=AbCd\n{end}\nmore",
        f"{begin}" + " " * 200_000 + "more",
        f"{begin}" + "\n-" * 100_000 + "more",
        "-----BEGIN " + "A " * 100_000 + "more",
    ]
    clean, other, own = masked(spark, make_docs, texts)
    assert clean[0] == f"A key file starts with [secret] and then {prose}{end} closes it."
    assert clean[1] == f"[secret]\nNote: this is no key\nReally: it is not\n{prose}"
    assert clean[2] == "[secret] and more"
    assert clean[3] == "[secret]\nPORT=8080\nmore"
    assert clean[4] == "[secret] more"
    assert clean[5] == "------[secret]- more"
    assert clean[6] == "[secret]\nmore"
    assert clean[7] == "[secret]" + " " * 200_000 + "more"
    assert clean[8] == "[secret]" + "\n-" * 100_000 + "more"
    assert clean[9] == texts[9]
    assert other == own


def test_findings_go_back_to_paths_of_earlier_runs(spark, make_docs):
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    first = secret_ledger.scan(ledger, make_docs(["token=abcdefgh1", "plain"], ids=[5, 6]))
    second = secret_ledger.scan(ledger, make_docs(["token=abcdefgh1", "token=abcdefgh1"], ids=[5, 9]))
    rows = {(r["path"], r["run"], r["kind"], r["start"], r["stop"]) for r in secret_ledger.history(ledger).collect()}
    assert rows == {(p, run, "assign", 0, 15) for p, run in [("5", first), ("5", second), ("9", second)]}


# --- packing ----------------------------------------------------------------------------------------------------


def brute_padding(lengths, buckets):
    sizes = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(sizes)) + 1):
        for cut in itertools.combinations(sizes[:-1], k - 1):
            bounds = [*cut, sizes[-1]]
            cost = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(0, 9), rng.randint(0, 40)]) for _ in range(30)]
    histogram = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
    for buckets in (1, 2, 3, 4):
        bounds = length_buckets.best_bounds(histogram, buckets)
        assert len(bounds) <= buckets and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == brute_padding(lengths, buckets)


def test_batches_fill_the_budget(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 5, 50, 700])) for i in range(3000)] + [(None, 4), (7, None), (8, -3), (9, 90_000), (1, 3), (1, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    packed = length_buckets.pack(df, budget=1000, buckets=4, shard_rows=100).collect()
    assert len(packed) == len(rows)
    groups = {}
    for r in packed:
        assert r["padding"] == r["bound"] - r["n_tokens"] >= 0
        groups.setdefault(r["bucket"], {}).setdefault(r["batch"], []).append(r)
    for batches in groups.values():
        size = max(1, 1000 // max(1, next(iter(batches.values()))[0]["bound"]))
        assert sorted(batches) == list(range(len(batches)))
        for number, batch in batches.items():
            assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
            assert len(batch) == size or number == max(batches)
    again = length_buckets.pack(df.repartition(3), budget=1000, buckets=4, shard_rows=100).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, packed), key=str)
    assert length_buckets.pack(df.limit(0)).count() == 0


def test_coarse_bins_hold_their_lengths(spark):
    rows = spark.range(0, 200_000, 7).select(F.col("id").alias("n"), length_buckets.bin_of(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["n"] and r["n"] - r["b"] <= max(0, r["n"] / 512) for r in rows)
    assert length_buckets.word_count("t") is not None


# --- quality ----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.score(docs, labels.where("doc_id % 2 = 0")).select("row.doc_id", "kept", "p_good")
    met = kept.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((met["quality"] == 1) == met["kept"]).mean() > 0.95
    assert met["p_good"].between(0, 1).all()


def test_sparse_sites_lean_on_their_host(spark, make_docs):
    good, bad = "Plain words in a calm line of text, as they should be. " * 3, "BUY!! NOW!! $$$ ### !!! " * 8
    texts = [good] * 60 + [bad] * 60 + ["Some MIXED! words here."] * 2
    sources = ["g.org"] * 60 + ["b.org"] * 60 + ["g.org", "b.org"]
    docs = make_docs(texts, sources=sources)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 3)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.score(docs, labels).select("row.doc_id", "p_good", "p_path", "kept", "p_text").collect()}
    assert all(rows[i]["kept"] == (i < 60) for i in range(120))
    assert rows[120]["p_text"] == rows[121]["p_text"] and rows[120]["p_good"] > rows[121]["p_good"]
    assert rows[120]["p_path"] > 0.5 > rows[121]["p_path"]


def test_quality_of_odd_inputs(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(make_docs([]), none).count() == 0
    docs = make_docs(ODD, sources=[None] * 5 + ["a"] * 5)
    rows = quality.score(docs, none).select("row.*", "p_good", "kept").collect()
    assert len(rows) == len(ODD) and len({round(r["p_good"], 9) for r in rows}) == 1
    one_class = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (4, 7)], "doc_id long, quality int")
    assert quality.score(docs, one_class).count() == len(ODD)


def test_a_text_is_not_judged_by_its_own_label(spark, make_docs):
    texts = [f"{i} Plain words of text number {i % 7}, and more." * (1 + i % 3) for i in range(400)] + ["the one text of its host"]
    docs = make_docs(texts, sources=[f"h{i % 4}" for i in range(400)] + ["alone"])
    others = [(i, i % 2) for i in range(399)]
    for table, known in ((docs, others), (docs.where("doc_id = 400"), [])):
        seen = []
        for own in (0, 1):
            labels = spark.createDataFrame(known + [(400, own)], "doc_id long, quality int")
            row = quality.score(table, labels).where("row.doc_id = 400").first()
            seen.append((row["p_host"], row["p_path"]))
        # The label is one of 400 that the classifier learns from; beyond that it does not count.
        assert all(abs(a - b) < 0.01 for a, b in zip(*seen))
    assert seen[0] == seen[1] == (0.5, 0.5)


def quality_by_hand(rows, threshold):
    """Posteriors from (p_text, label, host, path) of all rows."""
    own = [r["p_text"] if r["label"] is None else float(r["label"]) for r in rows]
    n, total = len(rows), sum(own)
    centre = (total + 1) / (n + 2)
    groups = lambda key, keep: {k: [o for r, o in zip(rows, own) if key(r) == k] for k in {key(r) for r in rows if keep(r)}}
    with_host = lambda r: r["host"] is not None
    hosts, paths = groups(lambda r: r["host"], with_host), groups(lambda r: (r["host"], r["path"]), with_host)

    def strength(parts):
        """Parts are (distance of the rate from its centre, size)."""
        if len(parts) < 2:
            return quality.STRONGEST
        weight, squares = sum(m for _, m in parts), sum(m * m for _, m in parts)
        spread = sum(m * d * d for d, m in parts)
        even = weight - squares / weight
        between = (spread - (len(parts) - 1) * centre * (1 - centre)) / even if even > 0 else 0
        if between <= 0:
            return quality.STRONGEST
        return min(quality.STRONGEST, max(quality.WEAKEST, centre * (1 - centre) / between - 1))

    rate = lambda v: sum(v) / len(v)
    k_host = strength([(rate(v) - centre, len(v)) for v in hosts.values()])
    k_path = strength([(rate(v) - rate(hosts[k[0]]), len(v)) for k, v in paths.items()])
    out = []
    for r, o in zip(rows, own):
        c = (total - o + 1) / (n + 1)
        if r["host"] is None:
            out.append((c, c))
            continue
        host, path = hosts[r["host"]], paths[r["host"], r["path"]]
        p_host = (sum(host) - o + k_host * c) / (len(host) - 1 + k_host)
        out.append((p_host, (sum(path) - o + k_path * p_host) / (len(path) - 1 + k_path)))
    return out


def test_quality_posteriors_as_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 != 4, F.col("source")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, labels).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("host"), F.struct("row.source", "row.lang").alias("path"),
        "p_text", "p_host", "p_path", "p_good", "kept",
    )
    rows = scored.join(labels.selectExpr("doc_id", "quality as label"), "doc_id", "left").collect()
    base = (labels.where("quality = 1").count() + 1) / (labels.count() + 2)
    odds = lambda p: p / (1 - p)
    for r, (p_host, p_path) in zip(rows, quality_by_hand(rows, 0.5)):
        assert abs(r["p_host"] - p_host) < 1e-5 and abs(r["p_path"] - p_path) < 1e-5
        good = odds(r["p_text"]) / odds(base) * odds(r["p_path"])
        assert abs(r["p_good"] - good / (1 + good)) < 1e-9 and r["kept"] == (r["p_good"] >= 0.5)


def test_drawn_rows_do_not_grow_with_partitions(spark):
    from quillrank.llm.common import drawn

    frame = lambda parts: spark.range(0, 20_000, 1, parts)
    few, many = ({r["id"] for r in drawn(frame(p), 500, "id").collect()} for p in (2, 64))
    assert few == many and len(few) == 500
    assert drawn(frame(3), 19_990, "id").count() == 19_990
    assert drawn(frame(3).limit(5), 500, "id").count() == 5 and drawn(frame(3).limit(0), 5, "id").count() == 0


# --- n-gram Jaccard join ----------------------------------------------------------------------------------------


def brute_jaccard(docs):
    """Sets of tuples of words, all pairs, union-find."""
    sets = {}
    for key, text in docs:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets[key] = grams
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def family_texts(seed):
    """Near copies of several texts at all distances, chains, copies, a shared passage and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(18):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own if rng.random() < 0.7 else own + [word()]))
            base = own if rng.random() < 0.3 else base
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(12)]
    texts += ["Short one", "short ONE", "short", "", None, " \t", "a b c d e", "a b c d e f"] + texts[:3]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_against_brute_force(make_docs, seed):
    texts = family_texts(seed)
    rows = token_groups.similar_documents(make_docs(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_jaccard(enumerate(texts))


def test_jaccard_join_of_a_family_about_the_threshold(make_docs):
    """Variants of one text, most pairs of which stay just below the threshold: they are opened as a group."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 3, 4])):
            words[at] = f"c{i}x{at}"
        texts.append(" ".join(words))
    rows = token_groups.similar_documents(make_docs(texts)).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found == brute_jaccard(enumerate(texts))
    assert 1 < len({c for _, c in found.values()}) < 120


def test_jaccard_join_of_odd_rows(make_docs):
    text = "one two three four five six seven"
    docs = make_docs([text, text, text, None, "x " * 50_000], ids=[5, 5, None, 3, 4])
    rows = sorted((tuple(r) for r in token_groups.similar_documents(docs).collect()), key=str)
    assert rows == sorted([(5, 3, 5), (5, 3, 5), (None, 3, None), (3, 0, 3), (4, 1, 4)], key=str)
    assert token_groups.similar_documents(make_docs([])).count() == 0


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = rng.permutation(10_000)[:n]
        b = np.append(a[: int(n * rng.uniform(0.7, 1))], rng.integers(20_000, 30_000, int(rng.integers(0, 30))))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < 80 * union:
            continue
        length = lambda s: min(len(s), len(s) - token_groups.needed(len(s), 80, 100) + token_groups.depth(len(s)))
        first = lambda s: np.sort(np.unique(s))[: length(np.unique(s))]
        smallest = token_groups.needed(max(len(np.unique(a)), len(np.unique(b))), 80, 100)
        assert len(np.intersect1d(first(a), first(b))) >= token_groups.depth(smallest)
