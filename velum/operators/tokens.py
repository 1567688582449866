"""Token/BIO texts read a batch at a time: all lines of a batch are cut, counted and
labelled together with Arrow, not one token after the other.

The results are those of the expressions in ``annotations`` (``sentences``, ``body_tokens``,
``labelled``, ``bio_runs``), which read one text inside a larger expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.labels import BIO_LABEL

TOKENS = "array<array<struct<pos:int,word:string,tag:string,start:int,end:int>>>"
RECORDS = "array<struct<text:string,labels:array<struct<start:int,end:int,tag:string>>>>"
CORPUS = (
    "struct<text:string,gold:array<struct<start:int,end:int,rank:int,seq:int,"
    "bio_label:string,entity_type:string>>>"
)

# Bytes of text whose tokens are held at once.
PART = 1 << 20


@dataclass
class Tokens:
    """The tokens of some sentences, of which ``ends`` tells where each ends."""

    ends: np.ndarray
    word: pa.Array
    tag: pa.Array
    start: np.ndarray
    end: np.ndarray


def _runs(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, "i8"), np.cumsum(counts)))


def _lists(ends: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
    mask = None if missing is None else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), values, mask=mask)


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where each text's lines end, the lines, and which of them are empty."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    values = lines.flatten()
    empty = pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return _runs(pc.list_value_length(lines).to_numpy(zero_copy_only=False)), values, empty


def _field(lines: pa.Array, sep: str) -> tuple[pa.Array, pa.Array]:
    """The first two fields of each line; null where it has only one."""
    fields = pc.split_pattern(lines, sep, max_splits=2)
    at = _runs(pc.list_value_length(fields).to_numpy(zero_copy_only=False))
    values = fields.flatten()
    second = pa.array(at[:-1] + 1, mask=at[1:] - at[:-1] < 2)
    return values.take(pa.array(at[:-1])), values.take(second)


def _tokens(lines: pa.Array, ends: np.ndarray, sep: str) -> Tokens:
    """Tokens of the sentences made of these lines."""
    word, tag = _field(lines, sep)
    length = pc.utf8_length(word).to_numpy(zero_copy_only=False).astype("i8")
    at = _runs(length + 1)
    start = at[:-1] - np.repeat(at[ends[:-1]], np.diff(ends))
    return Tokens(ends, word, tag, start, start + length)


def _sentences(texts: pa.Array, sep: str) -> tuple[np.ndarray, Tokens]:
    """Where each text's sentences end, and their tokens."""
    ends, lines, empty = _lines(texts)
    # The last line of a text has no end, so it closes no sentence.
    closes = empty.copy()
    closes[ends[1:] - 1] = False
    before = _runs(closes)
    of_text = before[ends]
    # Tokens behind the last sentence of a text are in none.
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    inside = ~empty & (before[:-1] < of_text[1:][text])
    kept = np.flatnonzero(inside)
    n = np.bincount(before[:-1][kept], minlength=int(before[-1]))
    return of_text, _tokens(lines.take(pa.array(kept)), _runs(n), sep)


def _bodies(texts: pa.Array, sep: str) -> tuple[np.ndarray, Tokens]:
    """Which texts have no body, and the tokens of each body as one sentence."""
    ends, lines, empty = _lines(texts)
    n, text = len(texts), np.repeat(np.arange(len(texts)), np.diff(ends))
    at = np.arange(len(lines))
    # Blank lines: empty ones between two line ends.
    blank = empty & (at > ends[:-1][text]) & (at < ends[1:][text] - 1)
    first, last = np.full(n, len(lines)), np.full(n, -1)
    blanks = np.flatnonzero(blank)
    last[text[blanks]] = blanks
    first[text[blanks[::-1]]] = blanks[::-1]
    missing = last < first + 2
    inside = ~empty & (at > first[text]) & (at < last[text]) & ~missing[text]
    kept = np.flatnonzero(inside)
    counts = np.bincount(text[kept], minlength=n)
    return missing, _tokens(lines.take(pa.array(kept)), _runs(counts), sep)


def _labelled(tokens: Tokens) -> np.ndarray:
    outside = pc.fill_null(pc.equal(tokens.tag, "O"), False)
    return np.flatnonzero(~outside.to_numpy(zero_copy_only=False))


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype("i4"))


def _structs(**columns) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _sentence_texts(tokens: Tokens) -> pa.Array:
    return pc.binary_join(_lists(tokens.ends, tokens.word), " ")


def _token_lists(texts: pa.Array, sep: str) -> pa.Array:
    of_text, t = _sentences(texts, sep)
    pos = np.arange(len(t.start)) - np.repeat(t.ends[:-1], np.diff(t.ends))
    rows = _structs(pos=_ints(pos), word=t.word, tag=t.tag, start=_ints(t.start), end=_ints(t.end))
    return _lists(of_text, _lists(t.ends, rows), _missing(texts))


def _record_lists(texts: pa.Array, sep: str) -> pa.Array:
    of_text, t = _sentences(texts, sep)
    kept = _labelled(t)
    labels = _structs(
        start=_ints(t.start[kept]), end=_ints(t.end[kept]), tag=t.tag.take(pa.array(kept))
    )
    rows = _structs(text=_sentence_texts(t), labels=_lists(np.searchsorted(kept, t.ends), labels))
    return _lists(of_text, rows, _missing(texts))


def _missing(texts: pa.Array) -> np.ndarray:
    return pc.is_null(texts).to_numpy(zero_copy_only=False)


def _gold(tokens: Tokens, keep: tuple[str, ...]) -> tuple[np.ndarray, pa.Array]:
    """Runs of labelled tokens: a kept token that does not go on from the one before it
    ends what came before, and those that begin with a labelled one are spans."""
    codes = pc.dictionary_encode(tokens.tag)
    names = codes.dictionary.to_pylist()
    code = pc.fill_null(codes.indices, len(names)).to_numpy(zero_copy_only=False)
    wanted = np.array([x in keep and x != "O" for x in names] + [False])
    label = np.array([x in BIO_LABEL for x in names] + [False])
    # Tags of one kind have one number; those without a kind have none.
    parts = [x.split("-") for x in names]
    kinds = {p[1]: i for i, p in enumerate(parts) if len(p) > 1}
    kind = np.array([kinds[p[1]] if len(p) > 1 else -1 for p in parts] + [-1])
    kept = np.flatnonzero(wanted[code])
    code, start, end = code[kept], tokens.start[kept], tokens.end[kept]
    ends = np.searchsorted(kept, tokens.ends)
    sentence = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    goes_on = np.zeros(len(kept), bool)
    goes_on[1:] = (
        (sentence[1:] == sentence[:-1])
        & ~label[code[1:]]
        & (start[1:] == end[:-1] + 1)
        & (kind[code[1:]] == kind[code[:-1]])
        & (kind[code[1:]] >= 0)
    )
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(kept))[: len(first)] - 1
    spans = label[code[first]]
    first, last = first[spans], last[spans]
    tag = pa.array(names, pa.string())
    entity = pa.array([BIO_LABEL.get(x) for x in names], pa.string())
    none = _ints(np.zeros(len(first)))
    at = pa.array(code[first].astype("i8"))
    rows = _structs(
        start=_ints(start[first]), end=_ints(end[last]), rank=none, seq=none,
        bio_label=tag.take(at), entity_type=entity.take(at),
    )
    return np.searchsorted(first, ends), rows


def _corpus(texts: pa.Array, sep: str, keep: tuple[str, ...]) -> pa.Array:
    missing, t = _bodies(texts, sep)
    at = pa.array(np.arange(len(missing)), mask=missing)
    ends, spans = _gold(t, keep)
    return _structs(text=_sentence_texts(t).take(at), gold=_lists(ends, spans))


def _in_parts(read, texts: pa.Array, *args) -> pa.Array:
    """``read`` over a few texts at a time, so that little more than the result is held."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")
    cuts = np.flatnonzero(np.diff(size // PART)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    return pa.concat_arrays([read(texts.slice(a, b - a), *args) for a, b in zip(edges, edges[1:])])


def token_lists(text: str, sep: str) -> Column:
    """The sentences of a text, each an array of its tokens."""

    @F.arrow_udf(TOKENS)
    def read(texts: pa.Array) -> pa.Array:
        return _in_parts(_token_lists, texts, sep)

    return read(F.col(text))


def record_lists(text: str, sep: str) -> Column:
    """The sentences of a text, each with its own text and its labelled tokens."""

    @F.arrow_udf(RECORDS)
    def read(texts: pa.Array) -> pa.Array:
        return _in_parts(_record_lists, texts, sep)

    return read(F.col(text))


def corpus_bodies(text: str, sep: str, keep: tuple[str, ...]) -> Column:
    """The words of a text's body joined by blanks, and its gold spans."""

    @F.arrow_udf(CORPUS)
    def read(texts: pa.Array) -> pa.Array:
        return _in_parts(_corpus, texts, sep, keep)

    return read(F.col(text))
