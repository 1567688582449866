"""Gold annotations from inline-tagged texts and from token/BIO texts.

Everything happens inside the row that holds a document, so nothing is shuffled and
documents of any number spread freely. Ends are exclusive; the file formats with
other conventions are converted where files are read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from velum.functions.arrays import empty, let, literal, literal_map, rows, running
from velum.functions.finders import find_all
from velum.functions.mask import mask
from velum.functions.patterns import INLINE_TAG
from velum.functions.resolve import resolve
from velum.labels import BIO_KEEP, BIO_LABEL, CORPUS_FOOTER, CORPUS_HEADER, CORPUS_MARKER
from velum.operators.tokens import record_lists, token_lists

TAGGED = "struct<start:int,end:int,entity_type:string>"
TOKEN = "struct<pos:int,word:string,tag:string,start:int,end:int>"
GOLD = "struct<start:int,end:int,rank:int,seq:int,bio_label:string,entity_type:string>"

# Separators a token line may use.
SEPARATORS = (" ", "\t")

# Documents of a raw corpus up to this length are dropped unless told otherwise.
MIN_CHUNK = 45

# A <YEAR> tag is this much longer than the year it stands for.
YEAR_EXCESS = 2


def inline_spans(text: str) -> str:
    """Gold spans of a text in which each sensitive passage was replaced by
    ``<TYPE>`` and ``#`` up to its length, as positions in the original text."""

    def kind(item):
        return f"regexp_extract({item}.text, '^<([^<>]*)>', 1)"

    def years_after(years, item):
        return f"{years} + CASE WHEN {kind(item)} = 'YEAR' THEN 1 ELSE 0 END"

    return running(
        find_all(text, INLINE_TAG),
        "0",
        years_after,
        lambda years, item, _: f"named_struct("
        f"'start', {item}.start - {YEAR_EXCESS} * {years}, "
        f"'end', {item}.`end` - {YEAR_EXCESS} * ({years_after(years, item)}), "
        f"'entity_type', {kind(item)})",
        TAGGED,
    )


def gold_from_inline_tags(tagged: DataFrame) -> DataFrame:
    return tagged.selectExpr("doc_id", rows(inline_spans("text")))


def split_corpus(
    corpus: DataFrame, marker: str = CORPUS_MARKER, min_length: int = MIN_CHUNK
) -> DataFrame:
    """Raw corpus texts cut into documents at ``marker``, numbered within each corpus
    and put between the dummy first and last sentence."""
    return corpus.selectExpr(
        "corpus_id", f"posexplode({chunks('text', marker, min_length)}) AS (doc_index, chunk)"
    ).selectExpr("corpus_id", "doc_index", f"{wrapped('chunk')} AS text")


def chunks(text: str, marker: str, min_length: int, behind_marker: bool = False) -> str:
    """What stands between the markers of a text once its blank lines are collapsed, without
    what is too short. With ``behind_marker`` the text follows a marker, the last line end of
    which takes part in collapsing."""
    collapsed = rf"replace({text}, '\n\n', '\n')"
    if behind_marker:
        collapsed = rf"substring(replace(concat('\n', {text}), '\n\n', '\n'), 2)"
    parts = f"split({collapsed}, {literal(f'\\Q{marker}\\E')}, -1)"
    return f"filter({parts}, c -> length(c) > {min_length})"


def wrapped(chunk: str) -> str:
    """A chunk between the dummy first and last sentence."""
    return f"concat({literal(CORPUS_HEADER)}, {chunk}, {literal(CORPUS_FOOTER)})"


def _checked(sep: str) -> str:
    if sep not in SEPARATORS:
        raise ValueError(f"token separator must be one of {SEPARATORS}, not {sep!r}")
    return sep


def sentences(text: str, sep: str = " ") -> str:
    """Sentences of a token/BIO text, each an array of tokens with offsets in the
    sentence text, which is its words joined by blanks.

    A blank line ends a sentence; what follows the last one is not a sentence."""
    _checked(sep)
    segments = rf"split({text}, r'(?<![^\n])\n', -1)"
    complete = f"transform(array({segments}), s -> slice(s, 1, size(s) - 1))[0]"
    return f"transform({complete}, segment -> {_tokens('segment', sep)})"


def body_tokens(text: str, sep: str = " ") -> str:
    """Tokens of what stands between the first and the last blank line of a text, all as
    one sentence; NULL if there is no such part."""
    _checked(sep)
    body = rf"regexp_extract({text}, r'(?s)^.*?\n\n(.*)\n\n', 1)"
    lines = rf"regexp_replace(regexp_replace({body}, r'\n{{2,}}', '\n'), r'\A\n', '')"
    tokens = let("body", lines, _tokens("body", sep))
    return rf"CASE WHEN {text} RLIKE r'(?s)\n\n.*\n\n' THEN {tokens} END"


def _tokens(segment: str, sep: str) -> str:
    lines = rf"split(regexp_replace({segment}, r'\n\z', ''), r'\n', -1)"
    placed = running(
        f"transform({lines}, line -> split(line, '{sep}', -1))",
        "0",
        lambda at, t: f"{at} + length(get({t}, 0)) + 1",
        lambda at, t, i: f"named_struct('pos', {i}, 'word', get({t}, 0), 'tag', get({t}, 1), "
        f"'start', {at}, 'end', {at} + length(get({t}, 0)))",
        TOKEN,
    )
    return f"CASE WHEN {segment} = '' THEN {empty(TOKEN)} ELSE {placed} END"


def sentence_text(tokens: str) -> str:
    return f"array_join({tokens}.word, ' ')"


def labelled(tokens: str) -> str:
    """Tokens that are not outside of every entity."""
    return f"filter({tokens}, t -> NOT (t.tag <=> 'O'))"


def token_rows(documents: DataFrame, sep: str = " ") -> DataFrame:
    """One row per token: ``doc_id, sent_id, pos, word, tag, start, end``."""
    return documents.select("doc_id", token_lists("text", _checked(sep)).alias("sents")).selectExpr(
        "doc_id", "posexplode(array_compact(sents)) AS (sent_id, tokens)"
    ).selectExpr("doc_id", "sent_id", rows("tokens"))


def sentence_records(documents: DataFrame, sep: str = " ") -> DataFrame:
    """One row per document with its records: sentence text and labelled tokens."""
    return documents.select("doc_id", record_lists("text", _checked(sep)).alias("records"))


def bio_runs(labels: str, keep: tuple[str, ...] = BIO_KEEP) -> str:
    """Gold spans of labelled tokens: a ``B-`` token and the ``I-`` tokens of its type
    that follow it without a gap. ``I-`` tokens without a ``B-`` vanish.

    Each token that does not go on from the one before it ends what came before; a run
    is a ``B-`` token and what comes ahead of the next such place."""

    def label(t):
        return f"try_element_at({literal_map(BIO_LABEL)}, {t}.tag)"

    def kind(t):
        return f"get(split({t}.tag, '-'), 1)"

    kept = f"filter({labels}, t -> t.tag IN ({', '.join(map(literal, keep))}))"
    token, before = "get(kept, j)", "get(kept, j - 1)"
    goes_on = (
        f"j > 0 AND {label(token)} IS NULL AND {token}.start = {before}.`end` + 1 "
        f"AND {kind(token)} = {kind(before)}"
    )
    first = f"filter(sequence(0, size(kept) - 1), j -> NOT coalesce({goes_on}, false))"
    end = "get(kept, coalesce(get(firsts, k + 1), size(kept)) - 1).`end`"
    span = (
        f"named_struct('start', {token}.start, 'end', {end}, 'rank', 0, 'seq', 0, "
        f"'bio_label', {token}.tag, 'entity_type', {label(token)})"
    )
    runs = let("firsts", first, f"transform(firsts, (j, k) -> {span})")
    spans = f"filter({runs}, g -> g.entity_type IS NOT NULL)"
    return let(
        "kept", kept, f"CASE WHEN size(kept) > 0 THEN sort_array({spans}) ELSE {empty(GOLD)} END"
    )


def annotation_mask(text: str, gold: str) -> str:
    """Text with each gold span as its tag, filled with stars to the span's length.
    All offsets are those of the unmasked text."""
    return mask(text, resolve(gold, touching="keep", element=GOLD), "tag_l", "*")
