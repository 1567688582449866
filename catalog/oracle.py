"""The catalogue's queries once more, as SQL for DuckDB.

Only the definition of the inputs and the plain patterns are shared with the engine;
offsets, dates, resolution, masking, annotations and scores are computed another way
(regex splits, unnested positions, windows, pairwise joins)."""

from __future__ import annotations

import sys

from catalog import inputs as I
from velum import labels as L
from velum.functions import patterns as P


def _blank() -> str:
    codes = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    return "".join(f"\\x{{{c:x}}}" for c in codes)


BLANK = _blank()
PATTERNS = {
    "telephone": P.telephone(BLANK),
    "zipcode": P.ZIP_CODE,
    "email": P.email(BLANK),
    "fiscal_code": P.FISCAL_CODE,
    "date": P.DATE,
    "age": P.age(BLANK),
    "capitals": "[A-Z]{2,}",
}


def _case(column: str, values: dict[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


# ---- inputs -------------------------------------------------------------------

_STRUCTS = ", ".join(
    f"{{'label': {label}, 'value': {value}, 'cut': {cut}}}"
    for label, value, cut in I.LETTER_PIECES
)
LETTERS = f"""
letter AS (
  SELECT 'l' || o_orderkey AS doc_id, o_orderkey, [{_STRUCTS}] AS pieces
  FROM orders JOIN customer ON o_custkey = c_custkey),
letters AS (
  SELECT doc_id, array_to_string(list_transform(pieces, lambda p: p.value), '') AS text FROM letter),
piece AS (
  SELECT doc_id, o_orderkey, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM letter),
placed AS (
  SELECT doc_id, o_orderkey, i, p.label AS label, p.value AS value, p.cut AS cut,
    CAST(coalesce(sum(length(p.value)) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM piece),
gold AS (
  SELECT doc_id, s, s + length(value) - cut AS e, label AS entity_type FROM placed WHERE label <> '')"""

CORPUS = f"""{LETTERS},
corpus AS (
  SELECT 'd' || doc_id AS doc_id, text FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'b' || item_id, text FROM benchmark
  UNION ALL SELECT doc_id, text FROM letters)"""

_TOKEN_LABEL = I.TOKEN_LABEL.replace("i %", "(i - 1) %")


WORDS = r"""
words AS (
  SELECT 'd' || doc_id AS doc_id,
    list_filter(string_split(regexp_replace(text, '[ \n\r\t]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws
  FROM documents),
word AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words)"""


# The sentences of the token texts, by the rule that builds them: a dummy word, then
# runs of equal length. A body whose last run is full leaves an empty sentence, and a
# document without words has only blank lines.
TOKENS = f"""{WORDS},
tokens AS (
  SELECT doc_id, 0 AS sent_id, 0 AS pos, 'TEST_NLP' AS word, 'test' AS tag FROM words
  UNION ALL
  SELECT doc_id, CAST(1 + (i - 1) // {I.SENTENCE_WORDS} AS INTEGER),
    CAST((i - 1) % {I.SENTENCE_WORDS} AS INTEGER), w, {_TOKEN_LABEL} FROM word),
token AS (
  SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, sent_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM tokens)"""

# ---- finders ------------------------------------------------------------------


def _hits(name: str, entity: str, source: str = "corpus") -> str:
    """Positions of a pattern: lengths of the gaps and matches before each match."""
    text = "lower(text)" if entity in ("date", "age") else "text"
    pattern = PATTERNS[entity]
    s = (
        "list_sum(list_transform(g[1:i], lambda x: length(x))) + "
        "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    )
    start, end, found = "s", "s + length(m[i])", "m[i]"
    if entity == "zipcode":
        start, end, found = "s + 1", "s + length(m[i]) - 1", "substring(m[i], 2, 5)"
    return f"""
{name}_m AS (
  SELECT doc_id, string_split_regex({text}, '{pattern}') AS g,
    regexp_extract_all({text}, '{pattern}') AS m
  FROM {source}),
{name}_i AS (
  SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name}_s AS (SELECT doc_id, m, i, CAST({s} AS BIGINT) AS s FROM {name}_i),
{name} AS (
  SELECT doc_id, {start} AS s, {end} AS e, {found} AS text, i - 1 AS seq FROM {name}_s)"""


def _months(text: str) -> str:
    for month, number in L.MONTHS:
        text = f"replace({text}, '{month}', '{number}')"
    return text


_REF = I.REFERENCE_DATE


def _dates(name: str, source: str) -> str:
    """Read the candidates in ``source``; the numbers of each are laid out as up to
    three values with a flag for those that must be a year."""
    number = "TRY_CAST({} AS INTEGER)".format
    digits = lambda x: f"{{'v': {number(x)}, 'big': length({x}) > 2}}"
    quantity = lambda x: f"{{'v': {number(x)}, 'big': {number(x)} > 100}}"
    decimal = lambda x, y: (
        f"{{'v': {number(x)}, 'big': {number(x)} > 100 OR ({number(x)} = 100 AND {number(y)} > 0)}}"
    )
    fits = lambda x, y: f"length({x}) + length({y}) + 1 NOT IN (6, 8)"
    century = _REF.year // 100 * 100
    return f"""
{name}_n AS (
  SELECT *, {_months(f"translate(text, '{P.OTHER_DIGITS}', '{P.ASCII_DIGITS}')")} AS norm FROM {source}),
{name}_p AS (
  SELECT *, string_split_regex(norm, '{P.DATE_SEPARATOR}') AS t, regexp_replace(norm, '[0-9]', '', 'g') AS q
  FROM {name}_n),
{name}_v AS (
  SELECT *, CASE
    WHEN q IN ('-', '/') THEN [{digits('t[1]')}, {digits('t[2]')}]
    WHEN q IN ('--', '//', '..') THEN [{digits('t[1]')}, {digits('t[2]')}, {digits('t[3]')}]
    WHEN q = ' ' THEN [{quantity('t[1]')}, {quantity('t[2]')}]
    WHEN q = '  ' THEN [{quantity('t[1]')}, {quantity('t[2]')}, {quantity('t[3]')}]
    WHEN q = '.' AND {fits('t[1]', 't[2]')} THEN [{decimal('t[1]', 't[2]')}]
    WHEN q IN ('-/', '/-', '- ', '/ ') THEN [{digits('t[1]')}, {digits('t[2]')}, {quantity('t[3]')}]
    WHEN q IN (' -', ' /') THEN [{quantity('t[1]')}, {digits('t[2]')}, {digits('t[3]')}]
    WHEN q = '. ' AND {fits('t[1]', 't[2]')} THEN [{decimal('t[1]', 't[2]')}, {quantity('t[3]')}]
    WHEN q = ' .' AND {fits('t[2]', 't[3]')} THEN [{quantity('t[1]')}, {decimal('t[2]', 't[3]')}]
  END AS v FROM {name}_p),
{name}_b AS (
  SELECT *, len(list_filter(v, lambda x: x.big)) AS n_big, len(v) AS n, v[1].big AS big1,
    v[1].v AS a, v[2].v AS b, v[3].v AS c
  FROM {name}_v WHERE v IS NOT NULL),
{name}_f AS (
  SELECT *, CASE
      WHEN n = 1 THEN CASE WHEN a > 31 THEN [a, NULL, NULL] ELSE [NULL, NULL, a] END
      WHEN n = 2 AND a > 31 THEN [a, b, NULL]
      WHEN n = 2 AND b > 31 THEN [b, a, NULL]
      WHEN n = 2 AND b <= 12 THEN [NULL, b, a]
      WHEN n = 2 THEN [NULL, a, b]
      WHEN a > 31 OR big1 THEN CASE WHEN c <= 12 THEN [a, c, b] ELSE [a, b, c] END
      WHEN a > 12 OR b <= 12 THEN [c, b, a]
      ELSE [c, a, b] END AS f
  FROM {name}_b WHERE n_big <= 1),
{name}_y AS (
  SELECT *, CASE
      WHEN f[1] IS NULL THEN {_REF.year}
      WHEN f[1] >= 100 OR n_big > 0 THEN f[1]
      WHEN f[1] + {century} >= {_REF.year + 50} THEN f[1] + {century - 100}
      WHEN f[1] + {century} < {_REF.year - 50} THEN f[1] + {century + 100}
      ELSE f[1] + {century} END AS dy,
    coalesce(f[2], {_REF.month}) AS dm
  FROM {name}_f),
{name}_d AS (
  SELECT *, day(last_day(make_date(dy, dm, 1))) AS dim
  FROM {name}_y WHERE dy BETWEEN 1 AND 9999 AND dm BETWEEN 1 AND 12),
{name} AS (
  SELECT *, coalesce(f[3], least({_REF.day}, dim)) AS dd
  FROM {name}_d WHERE f[3] IS NULL OR f[3] BETWEEN 1 AND dim)"""


# ---- spans, resolution and masks ------------------------------------------------

_FLAT = "doc_id, s AS span_start, e AS span_end"


def _pattern_spans(entities: list[str], source: str = "corpus") -> str:
    """All spans of the given entities in ``spans``."""
    ctes, parts = [], []
    for e in entities:
        ctes.append(_hits(f"hit_{e}", e, source))
        found = f"hit_{e}"
        if e == "date":
            ctes.append(_dates("hit_day", "hit_date"))
            found = "hit_day"
        parts.append(
            f"SELECT doc_id, s, e, {L.PATTERN_RANK[e]} AS rank, seq, "
            f"'{L.OUTPUT_LABEL[e]}' AS entity_type, text, 'regex' AS model FROM {found}"
        )
    return ",".join([*ctes, f"\nspans AS ({' UNION ALL '.join(parts)})"])


_REGEX = ["telephone", "zipcode", "email", "fiscal_code", "date", "age"]


def _resolved(source: str) -> str:
    """Greedy walk over each document's ordered spans, in ``kept``."""
    return f"""
walk AS (
  SELECT doc_id, list_reduce(
      list({{'s': s, 'e': e, 'entity_type': entity_type, 'text': text, 'model': model}}
        ORDER BY s, e, rank, seq, entity_type, text).list_transform(lambda z: [z]),
      lambda a, x: CASE WHEN x[1].s > a[-1].e THEN a || x ELSE a END) AS ks
  FROM {source} GROUP BY doc_id),
kept AS (
  SELECT doc_id, k.s AS s, k.e AS e, k.entity_type AS entity_type, k.text AS text, k.model AS model, i
  FROM (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM walk))"""


def _mask(kept: str, source: str, mode: str, sc: str = "*", shown: str = "NULL") -> str:
    """Pieces between kept spans and what replaces each span, joined again."""
    width = "(e - s)"
    tag = "'<' || entity_type || '>'"
    token = {
        "anon": f"CASE WHEN {width} > 0 THEN repeat('{sc}', 3) ELSE '' END",
        "anon_l": f"repeat('{sc}', {width})",
        "tag": tag,
        "tag_l": f"{tag} || repeat('{sc}', greatest({width} - length({tag}), 0))",
    }[mode]
    return f"""
around AS (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM {kept}),
pieces AS (
  SELECT doc_id, i, e, substring(t.text, before + 1, s - before) || coalesce({shown}, {token}) AS piece
  FROM around AS a JOIN {source} AS t USING (doc_id)),
joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY i) AS head, max(e) AS last_end FROM pieces GROUP BY doc_id),
masked AS (
  SELECT doc_id, CASE WHEN head IS NULL THEN t.text
      ELSE head || substring(t.text, last_end + 1) END AS masked_text
  FROM {source} AS t LEFT JOIN joined USING (doc_id))"""


_DATE_ROWS = _dates("shown_day", "(SELECT doc_id, s AS ds, text FROM kept WHERE entity_type = 'DATA')")


def _masked_dates(level: str, mode: str) -> str:
    form = "CAST(dy AS VARCHAR)" if level == "year" else "dm || '-' || dy"
    shown = f"(SELECT {form} FROM shown_day AS d WHERE d.doc_id = a.doc_id AND d.ds = a.s AND a.entity_type = 'DATA')"
    return (
        f"WITH {CORPUS},{_pattern_spans(_REGEX)},{_resolved('spans')},{_DATE_ROWS},"
        f"{_mask('kept', 'corpus', mode, '*', shown)} SELECT doc_id, masked_text FROM masked"
    )


def _masked(mode: str, sc: str = "*") -> str:
    return (
        f"WITH {CORPUS},{_pattern_spans(_REGEX)},{_resolved('spans')},"
        f"{_mask('kept', 'corpus', mode, sc)} SELECT doc_id, masked_text FROM masked"
    )


# ---- models ---------------------------------------------------------------------

_REPORTS = ", ".join(f"('{g}', '{m}', '{x}')" for g, m, x in I.MODEL_REPORTS)


def _model_spans(values: dict) -> str:
    """Spans that the models report on the letters and the configuration routes."""
    routes = ", ".join(
        f"('{model}', '{raw}', '{L.OUTPUT_LABEL[entity]}', {L.MODEL_RANK[model]})"
        for model, raws in L.MODEL_LABELS.items()
        for raw, entity in raws.items()
        if values["models"].get(entity) == model
    )
    return f"""
report(gold, model, label) AS (VALUES {_REPORTS}),
route(model, label, entity_type, rank) AS (VALUES {routes}),
model_spans AS (
  SELECT doc_id, s, s + length(value) AS e, rank, 0 AS seq, entity_type, value AS text, route.model AS model
  FROM placed JOIN report ON placed.label = report.gold
    JOIN route ON route.model = report.model AND route.label = report.label,
    range(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END))"""



def _letter_spans(values: dict, name: str) -> str:
    """All spans found on the letters under a configuration."""
    entities = [e for e in _REGEX if values["models"].get(e) == "regex"]
    ctes = _pattern_spans(entities, "letters").replace("hit_", f"{name}_hit_")
    head, _, tail = ctes.rpartition("\nspans AS (")
    if any(m in L.MODEL_LABELS for m in values["models"].values()):
        more = f"{_model_spans(values)},"
        return f"{head}{more}\n{name} AS ({tail[:-1]} UNION ALL SELECT * FROM model_spans)"
    return f"{head}\n{name} AS ({tail}"


# ---- scores -----------------------------------------------------------------------


_PARTIAL_GOLD = """
partial_gold AS (
  SELECT CASE WHEN CAST(substring(doc_id, 2) AS BIGINT) % 30 = 0 THEN 'g' || doc_id ELSE doc_id END AS doc_id,
    s, e, entity_type
  FROM gold WHERE CAST(substring(doc_id, 2) AS BIGINT) % 3 = 0)"""


def _confusion(spans: str, name: str, gold: str = "gold") -> str:
    """Strict counts by matching keys, lenient counts by comparing all pairs."""
    to_gold = _case("entity_type", L.OUTPUT_TO_GOLD, "entity_type")
    return f"""
{name}_p AS (SELECT doc_id, {to_gold} AS entity, s, e FROM {spans}),
{name}_g AS (
  SELECT doc_id, {_case("entity_type", L.GOLD_FOLD, "entity_type")} AS entity, s, e,
    row_number() OVER () AS id FROM {gold}),
{name}_n AS (SELECT doc_id, entity, count(*) AS n_gold FROM {name}_g GROUP BY ALL),
{name}_m AS (SELECT doc_id, entity, count(*) AS n_pred FROM {name}_p GROUP BY ALL),
{name}_sp AS (SELECT doc_id, entity, s, e, count(*) AS n FROM {name}_p GROUP BY ALL),
{name}_sg AS (SELECT doc_id, entity, s, e, count(*) AS n FROM {name}_g GROUP BY ALL),
{name}_st AS (
  SELECT doc_id, entity, sum(least({name}_sp.n, {name}_sg.n)) AS tp
  FROM {name}_sp JOIN {name}_sg USING (doc_id, entity, s, e) GROUP BY ALL),
{name}_lt AS (
  SELECT g.doc_id, g.entity, count(DISTINCT g.id) AS tp
  FROM {name}_g AS g JOIN {name}_p AS p ON g.doc_id = p.doc_id AND g.entity = p.entity
    AND greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) <> 0
  GROUP BY ALL),
{name} AS (
  SELECT doc_id, entity, score_type, CAST(tp AS BIGINT) AS tp,
    CAST(greatest(n_pred - tp, 0) AS BIGINT) AS fp, CAST(n_gold - tp AS BIGINT) AS fn
  FROM (
    SELECT doc_id, entity, kind.score_type, n_gold, coalesce(n_pred, 0) AS n_pred,
      coalesce(CASE kind.score_type WHEN 'strict' THEN {name}_st.tp ELSE {name}_lt.tp END, 0) AS tp
    FROM {name}_n LEFT JOIN {name}_m USING (doc_id, entity)
      LEFT JOIN {name}_st USING (doc_id, entity) LEFT JOIN {name}_lt USING (doc_id, entity),
      (VALUES ('strict'), ('lenient')) AS kind(score_type)))"""


def _rates(source: str, name: str) -> str:
    return f"""
{name}_pr AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
  FROM {source}),
{name} AS (
  SELECT *, CASE WHEN precision + recall > 0
      THEN 2 * (precision * recall) / (precision + recall) ELSE 0 END AS f1
  FROM {name}_pr)"""


def _macro(source: str, name: str, config: str) -> str:
    return f"""
{name} AS (
  SELECT entity, score_type, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
    '{config}' AS config_name
  FROM {source} GROUP BY entity, score_type)"""


_METRICS = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _evaluated(values: dict, name: str, resolved: bool = False) -> str:
    spans = f"{name}_all"
    ctes = [_letter_spans(values, spans)]
    if resolved:
        ctes.append(_resolved(spans))
        spans = "kept"
    ctes += [
        _confusion(spans, f"{name}_c"),
        _rates(f"{name}_c", f"{name}_r"),
        _macro(f"{name}_r", name, values["name"]),
    ]
    return ",".join(ctes)


_REGEX_COUNTS = (
    f"WITH {LETTERS},{_letter_spans(I.REGEX_CONFIG, 'found')},{_confusion('found', 'counts')}"
)
_ALL_CONFIGS = (
    f"WITH {LETTERS},{_evaluated(I.REGEX_CONFIG, 'r')},{_evaluated(I.DATES_CONFIG, 'd')},"
    f"{_evaluated(I.MIXED_CONFIG, 'm')},\n"
    "every AS (SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM m)"
)

# ---- annotations ------------------------------------------------------------------

TAGGED = f"""{LETTERS},
tagged AS (
  SELECT doc_id, i, label, CASE WHEN label = '' THEN value ELSE '<' || label || '>' ||
      repeat('#', greatest(length(value) - length(label) - 2, 0)) END AS piece
  FROM placed),
tag_placed AS (
  SELECT *, CAST(coalesce(sum(length(piece)) OVER w, 0) AS BIGINT) AS raw,
    2 * CAST(coalesce(sum(CASE WHEN label = 'YEAR' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS shift
  FROM tagged
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tag_gold AS (
  SELECT doc_id, raw - shift AS s,
    raw + length(piece) - shift - CASE WHEN label = 'YEAR' THEN 2 ELSE 0 END AS e, label AS entity_type
  FROM tag_placed WHERE label <> '')"""

SPLIT = f"""{WORDS},
numbered AS (
  SELECT doc_id, (i - 1) // {I.CHUNK_WORDS} AS part, i, w, {_TOKEN_LABEL} AS tag,
    w || ' ' || {_TOKEN_LABEL} AS line
  FROM word),
chunk AS (
  SELECT doc_id, part, string_agg(line || chr(10), '' ORDER BY i) AS body FROM numbered GROUP BY ALL),
long_chunk AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS doc_index
  FROM chunk WHERE length(body) > 45)"""

# Runs as islands: a token opens a run when it is a B- token, and continues the one
# before it when that is kept, next to it and of the same type.
RUNS = f"""{SPLIT},
token AS (
  SELECT n.doc_id || '-' || c.doc_index AS doc_id, i AS pos, w AS word, tag,
    CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY n.doc_id, part ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM numbered n JOIN long_chunk c USING (doc_id, part)),
body AS (
  SELECT *, s + length(word) AS e FROM token WHERE tag IN ({", ".join(f"'{t}'" for t in L.BIO_KEEP)})),
linked AS (
  SELECT *, string_split(tag, '-')[2] AS kind, CASE
      WHEN tag LIKE 'I%' AND lag(e) OVER w + 1 = s
        AND lag(string_split(tag, '-')[2]) OVER w = string_split(tag, '-')[2] THEN 0 ELSE 1 END AS breaks
  FROM body WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
island AS (
  SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM linked),
runs AS (
  SELECT doc_id, min(s) AS s, max(e) AS e, arg_min(tag, pos) AS bio_label,
    {_case("arg_min(tag, pos)", L.BIO_LABEL)} AS entity_type
  FROM island GROUP BY doc_id, run),
gold_runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i
  FROM runs WHERE bio_label LIKE 'B%')"""

# Sentences that exist: the dummy one, all full or begun runs of words, an empty one
# after a body that ends with a full run or has no words.
SENTENCES = f"""{TOKENS},
sentence AS (
  SELECT doc_id, sent_id, string_agg(word, ' ' ORDER BY pos) AS text,
    count(*) FILTER (WHERE tag <> 'O') AS n_labels,
    coalesce(string_agg('[' || s || ', ' || (s + length(word) + 1) || ', "' || tag || '"]', ', ' ORDER BY pos)
      FILTER (WHERE tag <> 'O'), '') AS labels
  FROM token GROUP BY ALL
  UNION ALL
  SELECT doc_id, CAST(1 + len(ws) // {I.SENTENCE_WORDS} AS INTEGER), '', 0, '' FROM words
  WHERE len(ws) % {I.SENTENCE_WORDS} = 0)"""


def _find(entity: str) -> str:
    return f"WITH {CORPUS},{_hits('hit', entity)} SELECT {_FLAT}, text FROM hit"


_READ = f"WITH {CORPUS},{_hits('hit', 'date')},{_dates('day', 'hit')}"

ORACLE: dict[str, str] = {
    "find_telephone": _find("telephone"),
    "find_zipcode": _find("zipcode"),
    "find_email": _find("email"),
    "find_fiscal_code": _find("fiscal_code"),
    "find_age": _find("age"),
    "find_date_candidates": _find("date"),
    "find_date_valid": f"{_READ} SELECT {_FLAT}, text FROM day",
    "months_normalised": f"WITH {LETTERS} SELECT doc_id, {_months('lower(text)')} AS text FROM letters",
    "date_generalise_year": f"{_READ} SELECT {_FLAT}, text, CAST(dy AS VARCHAR) AS shown FROM day",
    "date_generalise_month": f"{_READ} SELECT {_FLAT}, text, dm || '-' || dy AS shown FROM day",
    "all_spans": f"WITH {CORPUS},{_pattern_spans(_REGEX)} "
    f"SELECT {_FLAT}, entity_type, text, model FROM spans",
    "resolved_spans": f"WITH {CORPUS},{_pattern_spans(_REGEX)},{_resolved('spans')} "
    f"SELECT {_FLAT}, entity_type, text, model FROM kept",
    "mask_tag": _masked("tag"),
    "mask_tag_l": _masked("tag_l"),
    "mask_anon": _masked("anon", "x"),
    "mask_anon_l": _masked("anon_l"),
    "mask_date_year": _masked_dates("year", "anon_l"),
    "mask_date_month": _masked_dates("month", "tag"),
    "remask_stored_spans": _masked("tag_l", "-"),
    "deidentify": f"WITH {CORPUS},{_pattern_spans(_REGEX)},{_resolved('spans')},"
    f"{_mask('kept', 'corpus', 'anon_l')},\nn AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY ALL) "
    "SELECT doc_id, masked_text, CAST(coalesce(n, 0) AS BIGINT) AS n_spans "
    "FROM masked LEFT JOIN n USING (doc_id)",
    "gold_from_inline_tags": f"WITH {TAGGED} SELECT {_FLAT}, entity_type FROM tag_gold",
    "letter_gold_lines": f"WITH {TAGGED} "
    "SELECT doc_id, s || ';' || (e - 1) || ';' || entity_type AS line FROM tag_gold",
    "span_text": f"WITH {LETTERS} SELECT {_FLAT}, entity_type, "
    "substring(text, s + 1, e - s) AS text FROM gold JOIN letters USING (doc_id)",
    "corpus_split": f"""WITH {SPLIT}
SELECT doc_id AS corpus_id,
  CAST(doc_index AS INTEGER) AS doc_index,
  'TEST_NLP test' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'TEST_NLP test' AS text
FROM long_chunk""",
    "conll_tokens": f"WITH {TOKENS} SELECT doc_id, s AS span_start, s + length(word) AS span_end, "
    "sent_id, pos, word, tag FROM token",
    "token_offsets": f"WITH {TOKENS} SELECT doc_id, s AS span_start, s + length(word) AS span_end, "
    "sent_id, word, tag FROM token WHERE tag <> 'O'",
    "sentence_records": f"WITH {SENTENCES} SELECT doc_id, sent_id, text, n_labels FROM sentence",
    "sentence_json": f"""WITH {SENTENCES} SELECT doc_id, sent_id,
  '{{"text": ' || CAST(to_json(text) AS VARCHAR) || ', "labels": [' || labels || ']}}' AS record
FROM sentence""",
    "bio_runs": f"WITH {RUNS} SELECT {_FLAT}, bio_label, entity_type FROM gold_runs",
    "annotation_mask": f"""WITH {RUNS},
body_text AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM token GROUP BY doc_id),
{_mask('gold_runs', 'body_text', 'tag_l')}
SELECT doc_id, text, masked_text FROM body_text JOIN masked USING (doc_id)""",
    "document_order": "SELECT 'd' || doc_id AS doc_id, doc_id AS doc_number FROM documents",
    "model_span_intake": f"WITH {LETTERS},{_model_spans(I.MIXED_CONFIG)} "
    f"SELECT {_FLAT}, entity_type, text, model FROM model_spans",
    "annotate_models": f"""WITH {CORPUS},{_pattern_spans(['date'])},{_hits('org', 'capitals')}
SELECT {_FLAT}, entity_type, text, model FROM spans
UNION ALL
SELECT {_FLAT}, '{L.OUTPUT_LABEL["organization"]}', text, 'stanza' FROM org""",
    "deidentify_with_models": f"WITH {LETTERS},{_letter_spans(I.MIXED_CONFIG, 'found')},"
    f"{_resolved('found')},{_mask('kept', 'letters', 'tag')} SELECT doc_id, masked_text FROM masked",
    "gold_labels": f"""WITH {LETTERS},{_letter_spans(I.REGEX_CONFIG, 'found')}
SELECT {_FLAT}, {_case('entity_type', L.OUTPUT_TO_GOLD)} AS entity_type, 'predicted' AS side FROM found
UNION ALL
SELECT {_FLAT}, {_case('entity_type', L.GOLD_FOLD, 'entity_type')}, 'gold' FROM gold""",
    "confusion_strict": f"{_REGEX_COUNTS} SELECT doc_id, entity, tp, fp, fn FROM counts "
    "WHERE score_type = 'strict'",
    "confusion_lenient": f"{_REGEX_COUNTS} SELECT doc_id, entity, tp, fp, fn FROM counts "
    "WHERE score_type = 'lenient'",
    "scores_document": f"{_REGEX_COUNTS},{_rates('counts', 'rates')} "
    f"SELECT doc_id, entity, score_type, {_METRICS} FROM rates",
    "scores_one_document": f"WITH {LETTERS},{_letter_spans(I.REGEX_CONFIG, 'found')},"
    f"one_found AS (SELECT * FROM found WHERE doc_id = '{I.ONE_LETTER}'),"
    f"one_gold AS (SELECT * FROM gold WHERE doc_id = '{I.ONE_LETTER}'),"
    f"{_confusion('one_found', 'c', 'one_gold')},{_rates('c', 'r')},{_macro('r', 'm', 'regex')} "
    f"SELECT entity, score_type, {_METRICS}, config_name FROM m",
    "scores_macro": f"WITH {LETTERS},{_evaluated(I.REGEX_CONFIG, 'r')} "
    f"SELECT entity, score_type, {_METRICS}, config_name FROM r",
    "scores_macro_resolved": f"WITH {LETTERS},{_evaluated(I.REGEX_CONFIG, 'r', True)} "
    f"SELECT entity, score_type, {_METRICS}, config_name FROM r",
    "scores_all_configs": f"{_ALL_CONFIGS} SELECT entity, score_type, {_METRICS}, config_name "
    "FROM every WHERE score_type = 'lenient'",
    "scores_compare": _ALL_CONFIGS
    + " SELECT entity, "
    + ", ".join(
        f"round(max(CASE WHEN config_name = '{c}' THEN f1 END), 6) AS {c}"
        for c in ("dates", "mixed", "regex")
    )
    + " FROM every WHERE score_type = 'lenient' GROUP BY entity",
    "score_matrix": f"WITH {LETTERS},{_evaluated(I.MIXED_CONFIG, 'm')} "
    f"SELECT entity, {_METRICS} FROM m WHERE score_type = 'strict'",
    "unpaired_documents": f"""WITH {CORPUS},{_PARTIAL_GOLD}
SELECT doc_id, 'gold' AS missing FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM partial_gold)
UNION ALL
SELECT DISTINCT doc_id, 'document' FROM partial_gold WHERE doc_id NOT IN (SELECT doc_id FROM corpus)""",
    "scores_partial_gold": f"WITH {LETTERS},{_PARTIAL_GOLD},{_letter_spans(I.REGEX_CONFIG, 'found')},"
    "both_found AS (SELECT * FROM found WHERE doc_id IN (SELECT doc_id FROM partial_gold)),"
    "both_gold AS (SELECT * FROM partial_gold WHERE doc_id IN (SELECT doc_id FROM letters)),"
    f"{_confusion('both_found', 'c', 'both_gold')},{_rates('c', 'r')},{_macro('r', 'm', 'regex')} "
    f"SELECT entity, score_type, {_METRICS}, config_name FROM m",
    "deidentify_with_models_all": f"WITH {LETTERS},{_letter_spans(I.MIXED_CONFIG, 'found')},"
    f"{_resolved('found')},{_mask('kept', 'letters', 'tag')}, n AS (SELECT doc_id, count(*) AS n "
    "FROM (SELECT DISTINCT doc_id, s, e, entity_type, text, model FROM found) GROUP BY doc_id) "
    "SELECT doc_id, masked_text, coalesce(n, 0) AS n_spans FROM masked LEFT JOIN n USING (doc_id)",
}
ORACLE["resolved_stored_spans"] = ORACLE["resolved_spans"]
# What is written and read again is what was written.
ORACLE["letter_gold_parsed"] = ORACLE["gold_from_inline_tags"]
ORACLE["case_gold_parsed"] = ORACLE["bio_runs"]
ORACLE["records_parsed_json"] = ORACLE["records_parsed_jsonl"] = ORACLE["sentence_records"]
ORACLE["score_lines_parsed"] = ORACLE["scores_macro"]
