"""Column functions over texts, token arrays and passages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token patterns, prefixes, separator, instruction prompts, chat markers.
WORD_PATTERN = r"[\p{L}\p{N}]+"
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
ANSWER_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
DOCUMENT_PREFIX = "document: "
INSTRUCTION_SEPARATOR = "!@#$%^&*()"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes a value once and gives it to `body`.

    A plain expression inside a lambda would be computed again for every element of the array it runs over.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, in order: the text cut at all else, which costs less than to take each run out."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")


def lexical_tokens(text: Column) -> Column:
    """Lower-cased word tokens, the vocabulary of the lexical encoder."""
    return word_tokens(F.lower(text))


def answer_tokens(text: Column) -> Column:
    """Uncased words and single marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ANSWER_PATTERN), F.lit(0))


def answer_form(text: Column) -> Column:
    """Uncased tokens between single spaces, so that containment means a contiguous token run."""
    return F.concat(F.lit(" "), F.array_join(answer_tokens(text), " "), F.lit(" "))


def has_answer(text: Column, answers: Column, regex: bool = False) -> Column:
    """True if the text holds one of the answers as a token run, or matches one as a pattern."""
    if regex:
        return F.exists(answers, lambda a: F.rlike(text, F.concat(F.lit("(?ium)"), a)))
    forms = F.filter(F.transform(answers, answer_form), lambda a: F.length(a) > 2)
    return let(answer_form(text), lambda whole: F.exists(forms, lambda a: F.contains(whole, a)))


class WordTokenizer:
    """Default tokeniser; stays in the JVM for single texts and for arrays of texts."""

    def one(self, text: Column) -> Column:
        return word_tokens(text)

    def many(self, texts: Column) -> Column:
        return F.transform(texts, word_tokens)


class LexicalTokenizer(WordTokenizer):
    def one(self, text: Column) -> Column:
        return lexical_tokens(text)

    def many(self, texts: Column) -> Column:
        return F.transform(texts, lexical_tokens)


#: Characters that a tokeniser gets at once: what it gives back is many times as large, until it is packed as Arrow.
TOKENIZED_CHARS = 500_000


def _packed(batches: Iterable[list[list[str]]]) -> pa.Array:
    """Token lists as one array; those of a batch go before the next ones are made."""
    strings = pa.list_(pa.string())
    parts = [pa.array(b, strings) for b in batches]
    return pa.concat_arrays(parts) if parts else pa.array([], strings)


class PluginTokenizer:
    """Tokeniser supplied by the user: a function from a list of texts to a list of token lists.

    It runs on Arrow batches, a piece of bounded size per call.
    """

    def __init__(self, encode_batch: Callable[[Sequence[str]], list[list[str]]]):
        strings = T.ArrayType(T.StringType())

        def encoded(texts: pa.Array) -> pa.Array:
            def batches() -> Iterator[list[list[str]]]:
                held, chars = [], 0
                for text in texts:
                    held.append(text.as_py() or "")
                    chars += len(held[-1])
                    if chars >= TOKENIZED_CHARS:
                        yield encode_batch(held)
                        held, chars = [], 0
                if held:
                    yield encode_batch(held)

            return _packed(batches())

        @F.arrow_udf(strings)
        def one(texts: pa.Array) -> pa.Array:
            return encoded(texts)

        @F.arrow_udf(T.ArrayType(strings))
        def many(lists: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return pa.ListArray.from_arrays(ends, encoded(pc.list_flatten(lists)))

        self._one, self._many = one, many

    def one(self, text: Column) -> Column:
        return self._one(text)

    def many(self, texts: Column) -> Column:
        return self._many(texts)


WORDS = WordTokenizer()
LEXICAL = LexicalTokenizer()


def passage_text(
    title: Column | None, text: Column, sep: str = " ", prefix: str | Column = "", lowercase: bool = False
) -> Column:
    """Title, separator and text, or the text alone where there is no title; the prefix keeps its case."""
    body = text if title is None else F.when(title.isNotNull(), F.concat(title, F.lit(sep), text)).otherwise(text)
    if lowercase:
        body = F.lower(body)
    lead = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(lead, body)


def trimmed_passage(title: Column | None, text: Column) -> Column:
    """Title and text joined by a blank and trimmed."""
    body = text if title is None else F.when(title.isNotNull(), F.concat(title, F.lit(" "), text)).otherwise(text)
    return strip(body)


def truncate(tokens: Column, max_len: int | None, eos: str | None = None) -> Column:
    """First `max_len` tokens; with an end token, one slot is kept for it."""
    if eos is None:
        return tokens if max_len is None else F.slice(tokens, 1, max_len)
    kept = tokens if max_len is None else F.slice(tokens, 1, max(max_len - 1, 0))
    return F.concat(kept, F.array(F.lit(eos)))


def corpus_prefix(name: Column) -> Column:
    """Symmetric collections use the query prefix for their passages too."""
    symmetric = (name == "quora") | name.contains("cqadupstack")
    return F.when(symmetric, F.lit(QUERY_PREFIX)).otherwise(F.lit(PASSAGE_PREFIX))


def normalise_instruction(instruction: Column) -> Column:
    """Ends every non-empty instruction with a colon in place of full stops."""
    bare = F.regexp_replace(instruction, r"^\.+|\.+$", "")
    done = (F.length(instruction) == 0) | instruction.endswith(":")
    return F.when(done, instruction).otherwise(F.concat(bare, F.lit(":")))


def with_instruction(instruction: Column, text: Column) -> Column:
    """Instruction, separator and text; the separator alone where there is no instruction."""
    marked = F.concat(F.lit(INSTRUCTION_SEPARATOR), text)
    lead = strip(instruction)
    empty = instruction.isNull() | (F.length(instruction) == 0)
    return F.when(empty, marked).otherwise(F.concat(lead, F.lit(" "), marked))


# Markers around a text by model family, and the end marker for end-token pooling.
CHAT_MARKERS = {
    "llama3-instruct": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"),
    "mistral-instruct": ("[INST] ", " [/INST]"),
    "llama2-chat": ("[INST] ", " [/INST]"),
    "gemma2-it": ("<bos><start_of_turn>user\n", "<end_of_turn>"),
    "qwen2-instruct": ("<|im_start|>user\n", "<|im_end|>"),
}
END_MARKERS = {
    "llama3": "<|end_of_text|>",
    "llama2": " </s>",
    "llama2-chat": " </s>",
    "mistral": " </s>",
    "mistral-instruct": " </s>",
    "gemma": "<eos>",
    "qwen2": "<|endoftext|>",
    "qwen2-instruct": "<|endoftext|>",
}


def chat_text(family: Column, text: Column, eos_pooling: bool = False) -> Column:
    """Wraps a text in the markers of its model family; unknown families keep the text as it is.

    Families whose template closes the turn by itself get no end marker.
    """
    bare = strip(text)
    wrapped = text
    for name, (before, after) in CHAT_MARKERS.items():
        wrapped = F.when(family == name, F.concat(F.lit(before), bare, F.lit(after))).otherwise(wrapped)
    if not eos_pooling:
        return wrapped
    ended = wrapped
    for name, end in END_MARKERS.items():
        closed = F.concat(strip(wrapped), F.lit(end))
        ended = F.when(family == name, closed).otherwise(ended)
    return ended


def bio_spans(tags: Column) -> Column:
    """Entity spans (start, end, kind) of a tag array such as B-x, I-x, O; positions from 1.

    Starts and ends are listed in order, and spans do not overlap, so the n-th start belongs to the n-th end.
    """
    return let(tags, _spans)


def _spans(tags: Column) -> Column:
    """A tag goes on with the span before it if it is I- and the tag before has its kind."""
    goes_on = lambda tag, last: tag.startswith("I") & ((last == tag) | (last == F.concat(F.lit("B"), F.substr(tag, F.lit(2)))))
    outside = F.array(F.lit("O"))
    before = F.slice(F.concat(outside, tags), F.lit(1), F.size(tags))
    after = F.slice(F.concat(tags, outside), F.lit(2), F.size(tags))
    starts = F.zip_with(tags, before, lambda tag, last: (tag != "O") & ~goes_on(tag, last))
    ends = F.zip_with(tags, after, lambda tag, following: (tag != "O") & ~goes_on(following, tag))
    places = lambda flags: F.array_compact(F.transform(flags, lambda flag, i: F.when(flag, i + 1)))
    kinds = F.filter(F.zip_with(tags, starts, lambda tag, start: F.when(start, F.substr(tag, F.lit(3)))), lambda k: k.isNotNull())
    span = lambda z: F.struct(z["s"].alias("start"), z["e"].alias("end"), z["k"].alias("kind"))
    return F.transform(F.arrays_zip(places(starts).alias("s"), places(ends).alias("e"), kinds.alias("k")), span)
