"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

Everything is a Spark SQL expression over the text column: one pass over each row, no shuffle, no Python.

The rules for a line, each by its words (runs of characters other than white space):

* punctuation: symbols of ``[#*$%&|<>]`` are a twelfth of its characters or more, or half of its words end in ``!!``, or
  it ends in an ellipsis, or it has twelve words or more and no sentence mark at all;
* navigation: two words or more, and a quarter of all, are a bare separator, or it consists of words of menus alone;
* boilerplate: it has five words or more without a lower-case letter but with upper-case ones, or ten words or more of
  which at most a third differ, or it begins as a licence or copyright line does, or it has at most twenty words and a
  phrase of cookie notices, subscriptions, terms, sharing and the like.

Cases: a null text counts as an empty one; an empty text has no words, so its base rule fails; a line without words
never fails and loses nothing; equal rows get equal results, one for each row; a very long text is judged whole, within its row; an empty table gives an empty table;
columns of the input named like a result are shadowed only in ``assess``'s struct column, which ``out`` names.
Windows of eight words are compared by a 64-bit hash of their words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What ends or parts a sentence, and words that part the entries of a menu.
MARKS = "[.!?:;,…。！？、।؟۔]"
SEPARATORS = ("|", "»", "›", "·", "•", ">", "/")
_ENTRY = (
    "(?:home|about|about us|contact|contact us|log ?in|log ?out|sign in|sign up|register|account|search|menu|site ?map|privacy"
    "|terms|help|faq|news|blog|shop|cart|next|previous|back|top|share|print|rss|skip to (?:main )?content)"
)
#: Of lines in lower case: menus; how licence and copyright lines begin; phrases of notices. In both dialects of patterns.
MENU = rf"^[^a-z]*{_ENTRY}(?:[^a-z]+{_ENTRY})*[^a-z]*\z"
BOILERPLATE = r"^[^a-z©(]*(?:this work is licensed|licensed under|released under|distributed under|copyright |\(c\) |© |all rights reserved|spdx-license)"
NOTICE = (
    "all rights reserved|terms of (?:service|use)|privacy policy|cookie policy|uses? cookies|accept (?:all )?cookies|subscribe to our"
    "|sign up for our|enable javascript|javascript is (?:disabled|required)|click here|read more|powered by|follow us on|share this"
    "|add to cart|leave a comment|skip to (?:main )?content|page [0-9]+ of [0-9]+"
)
_SPACE = r"[\\x20\\x09-\\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """body with ``name`` bound to ``value``, which is then worked out once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _count(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


def _sql(pattern: str) -> str:
    """A pattern as a string of Spark SQL."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _line() -> str:
    words = f"array_remove(split(l, '{_SPACE}'), '')"
    parts = f"size(filter(w, x -> x IN ({', '.join(map(_sql, SEPARATORS))})))"
    fails = (
        f"size(w) > 0 AND ({_count('l', SYMBOLS)} * 12 >= length(l)"
        " OR size(filter(w, x -> endswith(x, '!!'))) * 2 >= size(w)"
        " OR endswith(get(w, size(w) - 1), '...') OR endswith(get(w, size(w) - 1), '…')"
        f" OR (size(w) >= 12 AND NOT l RLIKE {_sql(MARKS)})"
        f" OR ({parts} >= 2 AND {parts} * 4 >= size(w))"
        " OR (size(w) >= 5 AND upper(l) = l AND lower(l) <> l)"
        " OR (size(w) >= 10 AND size(array_distinct(w)) * 3 <= size(w))"
        f" OR lower(l) RLIKE {_sql(BOILERPLATE)}"
        f" OR (size(w) <= 20 AND (lower(l) RLIKE {_sql(MENU)} OR lower(l) RLIKE {_sql(NOTICE)})))"
    )
    return _let(words, "w", f"named_struct('line', l, 'words', w, 'fails', {fails})")


def _repeat_words(words: str, k: int) -> str:
    """The words that lie in a window of k words found twice or more."""
    covered = f"aggregate(transform(p, (x, i) -> least({k}, coalesce(get(p, i + 1), x + {k}) - x)), 0L, (a, x) -> a + x)"
    twice = "filter(transform(s, (e, i) -> if(get(s, i - 1).h = e.h OR get(s, i + 1).h = e.h, e.i, -1)), x -> x >= 0)"
    places = _let(f"sort_array({twice})", "p", covered)
    sorts = _let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "s", places)
    hashes = f"transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))"
    some = _let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0L, {sorts})")
    return f"if(size({words}) <= {k}, 0L, {some})"


def assess(text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> Column:
    """A struct for each text: the counts, base_failed, the lines' verdict, kept, and the cleaned text."""
    with_word = "transform(filter(v, x -> size(x.words) > 0), x -> x.line)"
    dups = _let(with_word, "u", "size(u) - size(array_distinct(u))")
    lost = "aggregate(v, 0L, (a, x) -> a + if(x.fails, size(x.words), 0))"
    cleaned = "array_join(transform(filter(v, x -> NOT x.fails), x -> x.line), '\\n')"
    base = f"(f.n_words < {MIN_WORDS} OR 100 * f.n_repeat_words > {MAX_REPEAT_PERCENT} * f.n_words)"
    facts = (
        "named_struct('n_words', cast(size(w) AS bigint),"
        f" 'word_chars', cast(length(regexp_replace(t, '{_SPACE}', '')) AS bigint),"
        f" 'n_symbols', cast({_count('t', SYMBOLS)} AS bigint),"
        f" 'n_dup_lines', cast({dups} AS bigint),"
        f" 'n_repeat_words', {_repeat_words('w', WINDOW)},"
        f" 'lost_words', {lost}, 'n_failed_lines', cast(size(filter(v, x -> x.fails)) AS bigint))"
    )
    verdict = (
        "named_struct('n_words', f.n_words, 'word_chars', f.word_chars, 'n_symbols', f.n_symbols,"
        " 'n_dup_lines', f.n_dup_lines, 'n_repeat_words', f.n_repeat_words, 'lost_words', f.lost_words,"
        f" 'n_failed_lines', f.n_failed_lines, 'base_failed', {base},"
        f" 'kept', NOT {base} AND 100 * f.lost_words <= {max_lost_percent} * f.n_words, 'cleaned', {cleaned})"
    )
    judged = _let(facts, "f", verdict)
    lines = _let(f"transform(split(t, '\\n'), l -> {_line()})", "v", _let("flatten(transform(v, x -> x.words))", "w", judged))
    return F.expr(_let(f"coalesce(`{text}`, '')", "t", lines))


def rules(docs: DataFrame, out: str = "rules", text: str = "text") -> DataFrame:
    """docs with one more column, the struct of ``assess``; a column of that name is replaced."""
    return docs.withColumn(out, assess(text))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules(docs).select("doc_id", *[F.col(f"rules.{x}").alias(x) for x in names])


_WS = r"[\x20\x09-\x0D]+"
_SEPARATORS = ", ".join(f"'{x}'" for x in SEPARATORS)
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS words FROM docs),
pos AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS s FROM w WHERE len(words) >= 8),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM pos),
dup AS (SELECT rid, i, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 8) - i) AS n FROM win WHERE c > 1),
rep AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM dup GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs),
lw AS (SELECT rid, l, list_filter(regexp_split_to_array(l, '{_WS}'), lambda x: x <> '') AS ws FROM line),
judged AS (SELECT rid, l, ws, len(ws) > 0 AND (
    (length(l) - length(translate(l, '#*$%&|<>', ''))) * 12 >= length(l)
    OR len(list_filter(ws, lambda x: ends_with(x, '!!'))) * 2 >= len(ws)
    OR ends_with(ws[-1], '...') OR ends_with(ws[-1], '…')
    OR (len(ws) >= 12 AND NOT regexp_matches(l, '{MARKS}'))
    OR (len(list_filter(ws, lambda x: x IN ({_SEPARATORS}))) >= 2 AND len(list_filter(ws, lambda x: x IN ({_SEPARATORS}))) * 4 >= len(ws))
    OR (len(ws) >= 5 AND upper(l) = l AND lower(l) <> l)
    OR (len(ws) >= 10 AND len(list_distinct(ws)) * 3 <= len(ws))
    OR regexp_matches(lower(l), '{BOILERPLATE}')
    OR (len(ws) <= 20 AND (regexp_matches(lower(l), '{MENU}') OR regexp_matches(lower(l), '{NOTICE}')))
  ) AS fails FROM lw),
by_line AS (SELECT rid, sum(CASE WHEN fails THEN len(ws) ELSE 0 END) AS lost,
    count(*) FILTER (len(ws) > 0) - count(DISTINCT l) FILTER (len(ws) > 0) AS n_dup_lines FROM judged GROUP BY rid),
facts AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN by_line USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM facts
"""
