"""License scans by templates with markup, compiled into automata over words.

A template is plain wording with regions in double angle brackets:

    <<beginOptional>> ... <<endOptional>>      words that may be missing; regions may be nested
    <<var;name="x";match=".{1,20}">>           any 1 to 20 words
    <<var;name="x";match="work|the program">>  one of the given wordings

A text is accepted where its words run through the automaton: mandatory words must be there, exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import id_and_text, text_groups

#: Words are runs of digits, letters and everything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")
_MATCH = re.compile(r'match="([^"]*)"')
_SPAN = re.compile(r"\.\{(\d+),(\d+)\}")

# The phrases every scan looks for, with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)



def _bsd_number(n: str) -> str:
    return f"<<beginOptional>>{n}<<endOptional>> "


_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met " + _bsd_number("1") + "redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer " + _bsd_number("2") + "redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution "
)
_BSD_NAMES = (
    '<<var;name="names";match="neither the name|neither the names|the name">> <<var;name="holder";match=".{1,30}">> '
    '<<var;name="may";match="may be used|may not be used">> to endorse or promote products derived from this software without '
    "specific prior written permission "
)
_BSD_END = (
    'this software is provided by <<var;name="holder";match=".{1,20}">> as is and any express or implied warranties including but '
    "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
    'event shall <<var;name="holder";match=".{1,20}">> be liable for any direct indirect incidental special exemplary or '
    "consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract strict liability "
    "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)

TEMPLATES = (
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of "
        '<<var;name="what";match="this software and associated documentation files|.{1,12}">> the software to deal in '
        "the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and "
        '<<var;name="rights";match="noninfringement|non infringement">> in no event shall <<var;name="holder";match=".{1,20}">> be liable for any '
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ),
    (
        "mit-notice",
        '<<beginOptional>><<var;name="act";match="released|licensed|distributed|available">><<endOptional>> under '
        'the <<beginOptional>>terms of the<<endOptional>> mit <<var;name="kind";match="license|licence">>',
    ),
    (
        "apache-2-notice",
        "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
    ),
    (
        "gpl-3-notice",
        '<<beginOptional>><<var;name="what";match="this work|this program|this software|it">> is<<endOptional>> '
        "licensed under the gnu <<beginOptional>>lesser<<endOptional>> general public license "
        "<<beginOptional>>as published by the free software foundation either<<endOptional>> version 3 "
        "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    ),
    (
        "cc-by-nc-notice",
        'licensed under <<beginOptional>>a<<endOptional>> <<var;name="name";match="cc|creative commons">> '
        '<<var;name="by";match="by|attribution">> <<var;name="nc";match="nc|noncommercial">> '
        '<<beginOptional>><<var;name="version";match="1 0|2 0|2 5|3 0|4 0">><<endOptional>>',
    ),
    ("bsd-2-text", _BSD_HEAD + _BSD_END),
    ("bsd-3-text", _BSD_HEAD + _bsd_number("3") + _BSD_NAMES + _BSD_END),
    (
        "bsd-4-text",
        _BSD_HEAD + _bsd_number("3") + "all advertising materials mentioning features or use of this software must display the "
        'following <<var;name="word";match="acknowledgement|acknowledgment">> this product includes software developed by '
        '<<var;name="holder";match=".{1,30}">> ' + _bsd_number("4") + _BSD_NAMES + _BSD_END,
    ),
    (
        "isc-text",
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose "
        "with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        'appear in all copies the software is provided as is and <<var;name="holder";match=".{1,20}">> disclaims all warranties with regard '
        "to this software including all implied warranties of merchantability and fitness in no event shall "
        '<<var;name="holder";match=".{1,20}">> be liable for any special direct indirect or consequential damages or any damages whatsoever '
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class _Node:
    __slots__ = ("word", "skip")

    def __init__(self) -> None:
        self.word: list[tuple[bytes | None, int]] = []
        self.skip: list[int] = []


class Automaton:
    """States with edges on a word, on any word, and on nothing."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.nodes = [_Node()]
        self.mandatory: list[bytes] = []
        end, open_regions, last = 0, [], 0
        for mark in [*_MARKUP.finditer(markup), None]:
            plain = markup[last : mark.start() if mark else len(markup)]
            for word in words_of(plain):
                end = self._edge(end, word)
                if not open_regions:
                    self.mandatory.append(word)
            if mark is None:
                break
            last = mark.end()
            kind = mark.group(1)
            if kind == "beginOptional":
                open_regions.append(end)
            elif kind == "endOptional":
                if not open_regions:
                    raise ValueError(f"{label}: a region ends that did not begin")
                begun = open_regions.pop()
                join = self._node()
                self.nodes[end].skip.append(join)
                self.nodes[begun].skip.append(join)
                end = join
            else:
                end = self._replaceable(end, mark.group(2))
        if open_regions or not self.mandatory:
            raise ValueError(f"{label}: a region does not end, or no word is mandatory")
        self.final = end
        self.closed = [self._closure(i) for i in range(len(self.nodes))]
        first = [e for s in self.closed[0] for e in self.nodes[s].word]
        if any(w is None for w, _ in first) or self.final in self.closed[0]:
            raise ValueError(f"{label}: a template starts with a known word")
        self.starts = frozenset(w for w, _ in first)

    def _node(self) -> int:
        self.nodes.append(_Node())
        return len(self.nodes) - 1

    def _edge(self, at: int, word: bytes | None) -> int:
        to = self._node()
        self.nodes[at].word.append((word, to))
        return to

    def _replaceable(self, at: int, options: str) -> int:
        match = _MATCH.search(options)
        if not match:
            raise ValueError(f"{self.label}: a replaceable region says what it matches")
        join = self._node()
        for choice in match.group(1).split("|"):
            end = at
            if span := _SPAN.fullmatch(choice):
                least, most = map(int, span.groups())
                for k in range(most):
                    if k >= least:
                        self.nodes[end].skip.append(join)
                    end = self._edge(end, None)
            else:
                for word in words_of(choice):
                    end = self._edge(end, word)
            self.nodes[end].skip.append(join)
        return join

    def _closure(self, at: int) -> tuple[int, ...]:
        seen, todo = {at}, [at]
        while todo:
            for n in self.nodes[todo.pop()].skip:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return tuple(seen)

    def longest_from(self, words: Sequence[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from a start."""
        states, end = set(self.closed[0]), None
        for at in range(start, len(words)):
            word = words[at]
            states = {
                c for s in states for w, to in self.nodes[s].word if w is None or w == word for c in self.closed[to]
            }
            if not states:
                break
            if self.final in states:
                end = at + 1
        return end


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int


class Scanner:
    """All templates at once. A template is tried only in texts that hold all its mandatory words."""

    def __init__(self, templates: Iterable[tuple[str, str]]):
        self.automata = [Automaton(label, markup) for label, markup in templates]
        self.keys = [max(a.mandatory, key=len) for a in self.automata]

    def scan(self, words: list[bytes], overlapping: bool = False) -> list[Match]:
        """Leftmost longest places of each template; with `overlapping`, the place from every start."""
        found = []
        present = None
        for automaton, key in zip(self.automata, self.keys):
            present = set(words) if present is None else present
            if key not in present or not present.issuperset(automaton.mandatory):
                continue
            free = 0
            for at in [i for i, w in enumerate(words) if w in automaton.starts]:
                if at < free:
                    continue
                end = automaton.longest_from(words, at)
                if end is not None:
                    found.append(Match(automaton.label, at, end))
                    free = at + 1 if overlapping else end
        return found


MATCHES = "array<struct<label:string,start:bigint,stop:bigint>>"


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, phrases, templates): the places of plain phrases and the accepted places of templates, in words.

    Phrases are found at every start, templates leftmost longest. A null or empty text has no words and no places.
    Each row stands by itself: repeated rows give equal rows, null ids stay, an empty table gives an empty one. Only
    the two named columns are read. A text is read whole; a task holds a few megabytes of text at a time, or one text.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    templates, phrases = list(templates), list(phrases)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, marked = Scanner(phrases), Scanner(templates)
        keys = {k for s in (plain, marked) for k in s.keys}
        for ids, texts in text_groups(batches):
            sizes, base, more = [], [], []
            for text in texts:
                raw = text.encode().translate(_FOLD)
                words = raw.split()
                sizes.append(len(words))
                if any(k in raw for k in keys):
                    base.append([(m.label, m.start, m.end) for m in plain.scan(words, overlapping=True)])
                    more.append([(m.label, m.start, m.end) for m in marked.scan(words)])
                else:
                    base.append([])
                    more.append([])
            as_place = lambda rows: pa.array([[dict(zip(("label", "start", "stop"), m)) for m in r] for r in rows], place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(sizes, pa.int64()), as_place(base), as_place(more)],
                names=["id", "n_words", "phrases", "templates"],
            )

    found = rows.mapInArrow(scan, f"id {id_type}, n_words long, phrases {MATCHES}, templates {MATCHES}")
    return found.select(F.col("id").alias(id_col), "n_words", "phrases", "templates")


def covered(places: str):
    """Words in at least one place of an array of places."""
    spans = F.array_sort(F.transform(places, lambda m: F.struct(m["start"], m["stop"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        spans,
        start,
        lambda seen, m: F.struct(
            (seen["n"] + F.greatest(F.lit(0), m["stop"] - F.greatest(seen["reach"], m["start"]))).alias("n"),
            F.greatest(seen["reach"], m["stop"]).alias("reach"),
        ),
        lambda seen: seen["n"],
    )


def license_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned text: counts, first and last place of a phrase, labels, and the share of words covered."""
    starts = F.transform("phrases", lambda m: m["start"])
    labels = lambda *places: F.array_join(
        F.array_sort(F.array_distinct(F.transform(F.concat(*places), lambda m: m["label"]))), ","
    )
    share = covered(F.concat("phrases", "templates")) / F.col("n_words")
    return found.select(
        id_col,
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("phrases").alias("base_labels"),
        labels("phrases", "templates").alias("labels"),
        F.when(F.col("n_words") > 0, share).otherwise(F.lit(0.0)).alias("score"),
    )
