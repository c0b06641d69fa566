"""Secret scans with a ledger of blobs: each text is scanned once per version of each rule, wherever it turns up.

A version of a file is a row (path, text). Its blob is named by the SHA-256 of its text. The ledger keeps, below one
folder, `versions` (path, blob, run), `findings` (blob, rule, span) and `scanned` (blob, rule version, run). A run writes
its findings first and its scanned pairs last, and only findings of pairs that are marked as scanned count: a run that
breaks off leaves nothing that is read, and its pairs are scanned again by the next one. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` is shorter than `least`
    characters are dropped after matching. A changed pattern needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    place: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    @property
    def sql(self) -> str:
        """The pattern without possessive groups."""
        return self.pattern.replace(")*+", ")*").replace(")++", ")+")


def either_case(words: Sequence[str]) -> str:
    """An alternative of words, ASCII letters in either case."""
    fold = lambda w: "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in w)
    return "|".join(map(fold, words))


#: What may stand between the runs of base64 of a key: line ends, also written as escapes, indents, quotes, comment and diff marks.
_BETWEEN = r"""[\x20\t\r\n\\>#*"',|;:+/-]*"""
_BREAK = rf"{_BETWEEN}(?:\\r{_BETWEEN})?(?:\\n{_BETWEEN})?"
_NAME = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_HEADER = rf"{_BREAK}[A-Z][A-Za-z]{{1,14}}(?:-[A-Za-z]{{1,14}}){{0,3}}:\x20[^\r\n\\]*[\r\n\\]"
_RUN = rf"{_BREAK}[A-Za-z0-9+/=]{{16,}}"
_END = rf"(?:{_BREAK}[A-Za-z0-9+/=]{{1,15}}){{0,2}}{_BETWEEN}-----END {_NAME}"
_REST = rf"""{_BREAK}[A-Za-z0-9+/]{{0,15}}={{1,2}}(?:[\r\n\\"']|\z)"""
#: A private key from its BEGIN line on: headers, then runs of 16 base64 characters and more, any number of them, then the
#: END line or a padded last run. Without a run behind it, the BEGIN line alone. A word of prose is shorter, and ends it.
#: Possessive groups, as Java's matcher goes one call deeper for each turn of an open one; nothing behind them makes them
#: give back a turn, so open groups match the same (`sql` has those, for matchers that need no possessive ones).
PRIVATE_KEY = f"-----BEGIN {_NAME}(?:(?:{_HEADER})*+(?:{_RUN})++(?:{_END}|{_REST})?|{_BETWEEN}-----END {_NAME})?"

#: Order matters: spans that start together are listed in this order.
BASE_RULES = (
    Rule(
        "assign",
        1,
        "(" + either_case(["password", "passwd", "secret", "token", "api_?key"]) + ")"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        place=0,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", least=16, place=1),
    Rule("hex", 1, "[0-9a-f]{32,}", least=32, place=2),
)
MORE_RULES = (
    Rule("private_key", 3, PRIVATE_KEY, place=3),
    Rule("repository_token", 1, "gh[opsur]_[A-Za-z0-9]{36,}", place=4),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", place=5),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", place=6),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<kind:string,place:int,nth:int,gap:int,width:int,ok:boolean>"


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _matches(rule: Rule, text: str) -> Column:
    """The matches of a rule, each with the number of characters since the match before. Texts without one cost a
    single search."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.arrays_zip(F.transform(found, F.length).alias("width"), F.transform(tested, F.length).alias("size"), between.alias("gap"))
    listed = F.transform(
        F.filter(zipped, lambda z: z["width"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.place).alias("place"),
            i.alias("nth"),
            z["gap"].alias("gap"),
            z["width"].alias("width"),
            (z["size"] >= rule.least).alias("ok"),
        ),
    )
    wanted = F.array_contains("pending", rule.key) & F.col(text).rlike(rule.pattern)
    return F.when(wanted, listed).otherwise(F.array().cast(f"array<{SPAN}>"))


class Ledger:
    """The three tables below `path`, which is in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    _SCHEMAS = {
        "versions": "path string, path_key long, blob binary, run string",
        "findings": "blob binary, rule string, kind string, place int, start long, stop long, run string",
        "scanned": "blob binary, rule string, run string",
    }

    def table(self, name: str) -> DataFrame:
        """A table as far as it has been written; empty before the first run."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self.table("scanned")

    def findings(self, rules: Sequence[Rule] | None = None) -> DataFrame:
        """Spans of pairs that are marked as scanned, each once; with `rules`, of these versions only. (blob, kind, place, start, stop)"""
        marked = self.scanned().select("blob", "rule", "run").distinct()
        if rules is not None:
            marked = marked.where(F.col("rule").isin([r.key for r in rules]))
        spans = self.table("findings").join(marked, ["blob", "rule", "run"], "left_semi")
        return spans.select("blob", "kind", "place", "start", "stop").distinct()


def scan(
    ledger: Ledger, versions: DataFrame, rules: Sequence[Rule] = RULES, path_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Scans what the ledger has not seen of the versions' texts, and returns the name of the run.

    Texts are shuffled only as far as a blob has a rule left to scan, one copy of each blob: which copy is decided
    from narrow rows, by path and blob together, so a blob with very many copies is not gathered in one place. A null
    text is an empty one; a null path is a path like any other; rows that repeat are one version.
    """
    run = uuid.uuid4().hex
    rows = versions.select(
        F.col(path_col).cast("string").alias("path"), F.xxhash64(path_col).alias("path_key"), blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ledger.append("versions", rows.select("path", "path_key", "blob", F.lit(run).alias("run")))
    here = ledger.table("versions").where(F.col("run") == run)
    copies = here.groupBy("blob").agg(F.min("path_key").alias("path_key"))
    seen = ledger.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    pending = F.array_except(keys, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    todo = copies.join(seen, "blob", "left").select("blob", "path_key", pending.alias("pending")).where(F.size("pending") > 0)
    # Two exact repeats of a row would both be chosen; their matches are the same and are folded below.
    texts = rows.join(todo.hint("shuffle_hash"), ["blob", "path_key"])
    listed = texts.select("blob", F.explode(F.concat(*[_matches(r, "text") for r in rules])).alias("m")).select("blob", "m.*")
    listed = listed.dropDuplicates(["blob", "kind", "nth"])
    until = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.col("width")).over(until)
    spans = listed.withColumn("stop", stop).where("ok")
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.key))])
    spans = spans.select(
        "blob", version[F.col("kind")].alias("rule"), "kind", "place", (F.col("stop") - F.col("width")).alias("start"), "stop", F.lit(run).alias("run")
    )
    ledger.append("findings", spans)
    ledger.append("scanned", todo.select("blob", F.explode("pending").alias("rule"), F.lit(run).alias("run")))
    return run


def by_blob(ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans): the blob's spans by the given rules in their versions, by start and then by kind."""
    span = F.struct("start", "place", "stop", "kind")
    return ledger.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def history(ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(path, run, blob, kind, start, stop): every finding with each path and run that had its text, from the ledger alone."""
    paths = ledger.table("versions").select("path", "run", "blob").distinct()
    return paths.join(ledger.findings(rules).hint("shuffle_hash"), "blob").select("path", "run", "blob", "kind", "start", "stop")


def secret_report(
    ledger: Ledger, versions: DataFrame, rules: Sequence[Rule] = RULES, path_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(path, blob, spans as an array) of every version: the findings of its blob, joined back."""
    rows = versions.select(F.col(path_col).alias("path"), blob_of(text_col).alias("blob"))
    found = rows.join(by_blob(ledger, rules), "blob", "left")
    none = F.array().cast("array<struct<start:bigint,place:int,stop:bigint,kind:string>>")
    return found.select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))


def digest(report: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans and the text of all spans."""
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return report.select(
        path_col, *[count(k) for k in base], F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


MASK = "[secret]"


def redacted(report: DataFrame, docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span, or run of overlapping spans, replaced by a mark; the length column follows.

    `report` gives the spans of each blob. Rows without findings come through as they are, other columns too.
    """
    spans = report.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    held = docs.select(F.struct("*").alias("row"), blob_of(text_col).alias("blob")).join(spans.hint("shuffle_hash"), "blob", "left")
    text = F.col(f"row.{text_col}")

    def step(seen: Column, s: Column) -> Column:
        free = s["start"] >= seen["at"]
        between = F.substring(text, (seen["at"] + 1).cast("int"), (s["start"] - seen["at"]).cast("int"))
        out = F.when(free, F.concat(seen["out"], between, F.lit(MASK))).otherwise(seen["out"])
        return F.struct(out.alias("out"), F.greatest(seen["at"], s["stop"]).alias("at"))

    masked = F.aggregate(
        "spans", start, step,
        lambda seen: F.concat(seen["out"], F.substring(text, (seen["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    clean = F.when(F.col("spans").isNull(), text).otherwise(masked)
    done = held.withColumn("clean", clean)
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.col("clean").alias(name))
        elif name == length_col:
            size = F.length("clean").cast(docs.schema[name].dataType)
            columns.append(F.when(F.col("spans").isNull(), F.col(f"row.{name}")).otherwise(size).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return done.select(*columns)
