"""Shared pieces of the DuckDB oracle SQL. Written for DuckDB, not generated from the Spark plans."""

from __future__ import annotations


def values(rows, columns: str) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return str(x)
        return "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


TRIM = r"regexp_replace({}, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')"


def trim(expr: str) -> str:
    return TRIM.format(expr)


def sentence_list(expr: str, blank: str = r"[ \n]+") -> str:
    marked = f"regexp_replace({expr}, '([.!?]){blank}', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"


def numbered(list_expr: str, source: str, ids: str, no: str, item: str) -> str:
    """Explode a list column with a 1-based position."""
    return (
        f"SELECT {ids}, unnest(range(1, len(_l) + 1))::INTEGER AS {no}, unnest(_l) AS {item} "
        f"FROM (SELECT {ids}, {list_expr} AS _l FROM {source})"
    )


def sentences_cte(source: str = "documents", ids: str = "doc_id", text: str = "text") -> str:
    return f"sentences AS ({numbered(sentence_list(text), source, ids, 'sent_no', 'text')})"


BLANK_NUMBERS = r"regexp_replace({}, '\b\d+\b', ' ', 'g')"


def freq_sentences_cte(source: str = "documents", ids: str = "doc_id") -> str:
    blank = BLANK_NUMBERS.format("text")
    return f"fsent AS ({numbered(sentence_list(blank, chr(92) + 's+'), source, ids, 'sent_no', 'text')})"


def freq_words(expr: str) -> str:
    quotes = f"regexp_replace({expr}, '[«»\"“”'']+', ' ', 'g')"
    raw = f"list_filter(regexp_split_to_array({BLANK_NUMBERS.format(quotes)}, '\\s+'), lambda w: length(w) > 1)"
    return (
        f"list_filter(list_transform({raw}, lambda w: trim(lower(w), '.,;:!?() ' || chr(9))), "
        f"lambda w: NOT regexp_full_match(w, '\\d+'))"
    )


STOPS = '.,!?;:()"“”«»–—'
TOKEN_RX = f"(<<|>>|--|[{STOPS}]|‘|[''’]*[^ \\t\\n\\r{STOPS}''’]+)"

MARK_CASE = """CASE WHEN _raw = ',' THEN 'COMMA' WHEN _raw = '.' THEN 'PERIOD' WHEN _raw = '?' THEN 'QUESTION'
 WHEN _raw = '!' THEN 'EXCLAIM' WHEN _raw = ';' THEN 'SEMICOLON' WHEN _raw = ':' THEN 'COLON'
 WHEN _raw = '(' THEN 'PAREN_OPEN' WHEN _raw = ')' THEN 'PAREN_CLOSE' WHEN _raw = '"' THEN 'QUOTE'
 WHEN _raw IN ('“', '‘', '«', '<<') THEN 'QUOTE_OPEN' WHEN _raw IN ('”', '»', '>>', '') THEN 'QUOTE_CLOSE'
 WHEN _raw IN ('–', '—', '--') THEN 'DASH' END"""


def raw_tokens_cte(source: str = "sentences", ids: str = "doc_id, sent_no", text: str = "text") -> str:
    spaced = f"regexp_replace({text}, '(<<|>>|--)', ' \\1 ', 'g')"
    quoted = f"regexp_replace({spaced}, '(^|[ \\t\\n\\r{STOPS}‘])’', '\\1  ', 'g')"
    tight = f"regexp_replace({quoted}, '([''’])[ \\t\\n\\r]+', '\\1', 'g')"
    lst = f"regexp_extract_all({tight}, '{TOKEN_RX}', 1)"
    return f"""rawtok AS ({numbered(lst, source, ids, 'tok_no', '_raw')}),
basetok AS (SELECT {ids}, tok_no,
  CASE WHEN _raw = '' THEN '’' ELSE regexp_replace(_raw, '^[''’]+(.)', '\\1') END AS surface,
  {MARK_CASE} AS kind0,
  regexp_matches(_raw, '^[''’]+.') AS preceded_by_apostrophe FROM rawtok),
basetok2 AS (SELECT *, translate(lower(surface), 'āēīōū', 'aeiou') AS lower FROM basetok)"""


def tokens_cte(source: str = "documents", ids: str = "doc_id", text: str = "text") -> str:
    """Typed tokens: quotes directed by replaying the marks one by one, then boundary and name flags."""
    key = f"{ids}, sent_no"
    w = f"(PARTITION BY {key} ORDER BY tok_no)"
    before = f"(PARTITION BY {key} ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto = f"(PARTITION BY {key} ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{sentences_cte(source, ids, text)},
{raw_tokens_cte('sentences', key)},
q1 AS (SELECT *, sum(CASE WHEN kind0 IN ('QUOTE_OPEN', 'QUOTE_CLOSE') THEN 1 ELSE 0 END) OVER {w} AS _g FROM basetok2),
q2 AS (SELECT *, max(CASE WHEN kind0 = 'QUOTE_OPEN' THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, _g) AS _open,
  sum(CASE WHEN kind0 = 'QUOTE' THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, _g ORDER BY tok_no) AS _nth FROM q1),
q3 AS (SELECT {key}, tok_no, surface, lower, preceded_by_apostrophe,
  CASE WHEN kind0 = 'QUOTE' THEN CASE WHEN (_nth - 1 + _open) % 2 = 1 THEN 'QUOTE_CLOSE' ELSE 'QUOTE_OPEN' END
  ELSE kind0 END AS punct_type FROM q2),
q4 AS (SELECT *, coalesce(punct_type, 'WORD') AS _k FROM q3),
q5 AS (SELECT *, lag(_k) OVER {w} AS _p,
  last_value(CASE WHEN _k <> 'QUOTE_CLOSE' THEN _k END IGNORE NULLS) OVER {before} AS _lb,
  last_value(CASE WHEN _k <> 'QUOTE_CLOSE' THEN _k END IGNORE NULLS) OVER {upto} AS _lu FROM q4),
q6 AS (SELECT *, (_p IS NULL OR _p = 'QUOTE_OPEN' OR coalesce(_lb IN ('PERIOD','QUESTION','EXCLAIM'), FALSE)) AS is_initial,
  (_k IN ('PERIOD','QUESTION','EXCLAIM') OR (_k = 'QUOTE_CLOSE' AND coalesce(_lu IN ('PERIOD','QUESTION','EXCLAIM'), FALSE))) AS is_sent_boundary,
  _k IN ('COMMA', 'SEMICOLON') AS is_clause_boundary, _k = 'QUOTE_OPEN' AS is_quote_open, _k = 'QUOTE_CLOSE' AS is_quote_close FROM q5),
tokens AS (SELECT {key}, tok_no, surface, lower, punct_type, preceded_by_apostrophe, is_initial, is_sent_boundary,
  is_clause_boundary, is_quote_open, is_quote_close,
  (punct_type IS NULL AND regexp_matches(surface, '^[A-Z]') AND (NOT is_initial OR contains(lower, 'l'))) AS is_proper_noun FROM q6)"""
