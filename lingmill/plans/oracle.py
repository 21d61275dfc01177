"""DuckDB SQL for the registered queries, over the same tables."""

from lingmill.functions.urls import SCHEMES, UrlRules

_P3 = r"""
numbered AS (
  SELECT *, CASE WHEN line_no = 1 AND starts_with(line_text, chr(65279)) THEN substr(line_text, 2) ELSE line_text END AS line FROM model_lines
),
firsts AS (SELECT file_name, min(line_no) AS first_no FROM numbered WHERE NOT coalesce(starts_with(line, '#'), false) GROUP BY file_name),
marked AS (
  SELECT n.*, coalesce(starts_with(line, '#'), false) AND (first_no IS NULL OR line_no < first_no) AS is_header, trim(line, chr(9)) AS body
  FROM numbered n LEFT JOIN firsts f USING (file_name)
),
judged AS (
  SELECT *,
    regexp_full_match(body, '^ *"([^"]|"")*" *\t+ *([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$') AND NOT regexp_full_match(body, '^ *"\s*".*$') AS quoted_ok,
    regexp_full_match(body, '^ *[^" \t][^\t]*\t+ *([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$') AS plain_ok,
    coalesce(try_cast(trim(regexp_extract(body, '\t([^\t]*)$', 1)) AS DOUBLE) < 3.4028235677973366e38, false) AS finite
  FROM marked
)"""

# Fixed values, as in functions.chars.
_W = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SYMBOLS = "¥©¤¦§®¶€™<>"
_IN_WORD = "&\u0027-._\u00ad\u055a\u055b\u055d\u2012\u2013\u2014\u2015\u2018\u2019\u201b"
_KEPT = "ßŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆıſ"
_S, _M = "\ue001", "\ue002"


def _private(text: str, start: int) -> str:
    return "".join(chr(start + i) for i in range(len(text)))


def _q(text: str) -> str:
    return text.replace("'", "''")


def _upper(x: str) -> str:
    hold = _private(_KEPT, 0xE100)
    return f"translate(translate(upper(translate({x}, '{_KEPT}', '{hold}')), '{hold}', '{_KEPT}'), 'Ё', 'Е')"


# URLs by RE2, which has neither look-around nor class intersection: a character that breaks none off; one that may end a
# URL; what follows a sign.
_IN_URL = f"(?:[\\x01-\\x08\\x0E-\\x1F!-\\x7F]|[^\\x00-\\x7F\\p{{P}}{_W}])"
_URL_EDGE = f"(?:/|[^\\p{{P}}{_W}])"
_RIGHT = f"(?:{_IN_URL}*{_URL_EDGE})?"
_DOMAIN = f"\\.(?:{'|'.join(sorted(UrlRules.default().domains))})"
_BY_SCHEME = f"(?i)(^|[^A-Za-z-])(?:{'|'.join(x for x in SCHEMES.split() if x.replace('-', '').isalpha())}):{_RIGHT}"
_BY_DOT = f"(?i)www\\.{_RIGHT}|{_URL_EDGE}{_IN_URL}*?{_DOMAIN}(?:{_DOMAIN})*(?:[/\\\\]{_IN_URL}*{_URL_EDGE}|/|([^\\p{{L}}/])|$)"


#: Stands for a dot that the dot before it hides.
_HIDDEN_DOT = ""


def _masked(text: str, mark: str = _S) -> str:
    by_scheme = f"regexp_replace({text}, '{_q(_BY_SCHEME)}', '\\1{mark}', 'g')"
    return f"replace(regexp_replace(replace({by_scheme}, '..', '.{_HIDDEN_DOT}'), '{_q(_BY_DOT)}', '{mark}\\1', 'g'), '{_HIDDEN_DOT}', '.')"


def _words(name: str, source: str, keep: str, urls: bool = True) -> str:
    """CTEs that give `name`(keep..., tokens) of the texts of a table: steps of the main tokenizer. RE2 has no class
    intersection, so punctuation that may stand in words hides behind private characters meanwhile."""
    hide = _private(_IN_WORD, 0xE200)
    number = f"[\\p{{Nd}}.\\-–´°]+{_M}"
    return f"""
{name}_a AS (SELECT {keep}, translate({_masked('text') if urls else 'text'}, '{_q(_IN_WORD)}', '{hide}') AS t FROM {source} WHERE text IS NOT NULL),
{name}_b AS (SELECT {keep}, translate(replace(regexp_replace(t, '[\\p{{P}}{_SYMBOLS}][\\p{{P}}{hide}{_W}]*', '{_S}', 'g'), ' ', '{_M} '), '{hide}', '{_q(_IN_WORD)}') AS t FROM {name}_a),
{name}_c AS (SELECT {keep}, list_transform(list_filter(string_split_regex(t, '[{_W}{_S}]+'), lambda r: NOT regexp_full_match(r, '{number}')), lambda r: replace(r, '{_M}', '')) AS runs FROM {name}_b),
{name}_d AS (SELECT {keep}, list_filter(list_transform(runs, lambda r: {{'r': r, 'w': regexp_replace(r, '^[^\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+$', '', 'g')}}), lambda p: length(p.w) > 1 OR (p.w = p.r AND p.w <> '')) AS pairs FROM {name}_c),
{name} AS (SELECT {keep}, list_transform(pairs, lambda p: {_upper('p.w')}) AS tokens FROM {name}_d)"""


def _grams(tokens: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{tokens}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {parts})"


_STOK = _words("stok", "lang_samples", "sample_id, language", urls=False)
_RTOK = _words("rtok", "requests", "req_id")
_DTOK = _words("dtok", "documents", "doc_id")


def _gram_counts(n: int) -> str:
    return f"WITH {_STOK} SELECT language, ngram, count(*) AS cnt FROM (SELECT language, unnest({_grams('tokens', n)}) AS ngram FROM stok) GROUP BY ALL"


def _trained(source: str, order: int = 2, cut: str = "CASE n WHEN 1 THEN 95 ELSE 50 END", name: str = "model") -> str:
    """CTEs that give `name`(ngram, lang, weight) trained on rows (doc, tokens). The size of a document counts n-grams that
    weigh nothing, too."""
    grams = " UNION ALL ".join(f"SELECT doc, {n} AS n, unnest({_grams('tokens', n)}) AS ngram FROM ({source})" for n in range(1, order + 1))
    return f"""
{name}_c AS (SELECT doc, n, ngram, count(*) AS cnt FROM ({grams}) GROUP BY ALL),
{name}_k AS (
  SELECT * FROM (
    SELECT *, sum(cnt) OVER (PARTITION BY doc, n ORDER BY cnt DESC, ngram ROWS UNBOUNDED PRECEDING) AS run, sum(cnt) OVER (PARTITION BY doc, n) AS tot FROM {name}_c
  ) WHERE run * 100 <= ({cut}) * tot
),
{name}_s AS (SELECT doc, count(*) AS size FROM {name}_k GROUP BY doc),
{name}_f AS (SELECT ngram, count(*) AS df FROM {name}_k GROUP BY ngram),
{name} AS (
  SELECT ngram, doc AS lang, -(cnt / size) * ln(df / nd) AS weight
  FROM {name}_k JOIN {name}_f USING (ngram) JOIN {name}_s USING (doc), (SELECT count(*) AS nd FROM {name}_s)
  WHERE df <> nd
)"""


_MODEL = _trained("SELECT language AS doc, tokens FROM stok WHERE language IS NOT NULL")


def _detection(tokens: str = "rtok", key: str = "req_id", model: str = "model", words: int = 9, percent: int = 10) -> str:
    """CTEs `scores`, `decided`(key, terms, reason, langs)."""
    return f"""
pos AS (SELECT {key}, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM {tokens}),
gram AS (SELECT {key}, i, tokens[i] AS ngram FROM pos UNION ALL SELECT {key}, i, tokens[i - 1] || ' ' || tokens[i] FROM pos WHERE i > 1),
hit AS (SELECT {key}, i, lang, weight FROM gram JOIN {model} USING (ngram)),
per AS (SELECT {key}, lang, sum(weight) AS weight_sum, count(*) AS hits FROM hit GROUP BY ALL),
seen AS (SELECT {key}, count(DISTINCT i) AS detected FROM hit GROUP BY {key}),
scores AS (
  SELECT t.{key}, len(t.tokens) AS terms, coalesce(detected, 0) AS detected, lang, weight_sum, hits
  FROM {tokens} t LEFT JOIN seen s ON t.{key} = s.{key} LEFT JOIN per p ON t.{key} = p.{key}
),
weighed AS (SELECT *, weight_sum * hits / nullif(terms, 0) AS w, sum(weight_sum * hits / nullif(terms, 0)) OVER (PARTITION BY {key}) AS total FROM scores),
graded AS (SELECT *, CAST(floor(round(w * 100 / nullif(total, 0), 9)) AS INTEGER) AS percent FROM weighed),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY w DESC, lang) AS rank, count(*) OVER (PARTITION BY {key}) AS n
  FROM graded WHERE w >= 0.00001 AND percent >= 10
),
three AS (SELECT {key}, max(n) AS n, max(CASE rank WHEN 1 THEN percent END) AS p1, max(CASE rank WHEN 2 THEN percent END) AS p2, max(CASE rank WHEN 3 THEN percent END) AS p3 FROM kept GROUP BY {key}),
decided AS (
  SELECT DISTINCT g.{key}, CASE WHEN terms <= 0 THEN 'no terms'
    WHEN terms > {words} AND 100 * detected // terms < {percent} THEN 'few detected words'
    WHEN coalesce(total, 0) <= 0 THEN 'no weight'
    WHEN n IS NULL THEN 'below thresholds'
    WHEN n >= 3 AND p1 - p2 <= 8 AND p2 - p3 <= 8 THEN 'three close languages' END AS reason
  FROM graded g LEFT JOIN three USING ({key})
),
best AS (SELECT d.{key}, k.lang, k.percent FROM decided d LEFT JOIN kept k ON k.{key} = d.{key} AND k.rank = 1 AND d.reason IS NULL)"""


_DETECT = f"{_STOK}, {_MODEL}, {_RTOK}, {_detection()}"
#: requests without a text have no terms
_NO_TEXT = "SELECT req_id FROM requests WHERE text IS NULL"

_DOC_DETECT = f"{_STOK}, {_MODEL}, {_DTOK}, {_detection('dtok', 'doc_id')}"
#: What stands between the URLs of each request, and where the first and a second one begin and end. (No request has more.)
_SPANS = f"""
masked AS (SELECT req_id, text, string_split({_masked('text')}, '{_S}') AS p FROM requests WHERE text IS NOT NULL),
firsts AS (
  SELECT req_id, text, p, length(p[1]) AS a, CASE WHEN len(p) = 2 THEN length(text) - length(p[2]) ELSE length(p[1]) + strpos(substr(text, length(p[1]) + 1), p[2]) - 1 END AS b
  FROM masked WHERE len(p) > 1
),
spans AS (SELECT req_id, text, a, b FROM firsts UNION ALL SELECT req_id, text, b + length(p[2]), length(text) - length(p[3]) FROM firsts WHERE len(p) = 3)"""

_COUNTS = f"""
counts AS (
  SELECT grp, doc, n, value AS ngram, CAST(sum(count) AS BIGINT) AS cnt FROM word_t
  WHERE value IS NOT NULL AND regexp_replace(value, '[{_W}]+', '', 'g') <> '' AND count >= 1 GROUP BY ALL
),
df AS (SELECT grp, ngram, count(*) AS df, sum(cnt) AS cf FROM counts GROUP BY ALL),
nd AS (SELECT grp, count(DISTINCT doc) AS nd FROM counts GROUP BY grp),
size AS (SELECT grp, doc, count(*) AS size, sum(cnt) AS dl FROM counts GROUP BY ALL),
avgdl AS (SELECT grp, avg(dl) AS avgdl FROM size GROUP BY grp)"""


def _cut(one: int, two: int, three: int, four: int) -> str:
    return f"""WITH {_COUNTS}
SELECT grp, doc, n, ngram, cnt FROM (
  SELECT *, sum(cnt) OVER (PARTITION BY grp, doc, n ORDER BY cnt DESC, ngram ROWS UNBOUNDED PRECEDING) AS run, sum(cnt) OVER (PARTITION BY grp, doc, n) AS tot FROM counts
) WHERE run * 100 <= (CASE n WHEN 1 THEN {one} WHEN 2 THEN {two} WHEN 3 THEN {three} ELSE {four} END) * tot"""


def _pairs(name: str, version: str | None = None) -> str:
    only = f"AND contains(file_name, '-{version}-')" if version else ""
    return f"""{name} AS (
  SELECT {_upper("trim(text, ' ')")} AS ngram, language AS lang, weight FROM model_pairs
  WHERE text IS NOT NULL AND trim(text, ' ') <> '' AND language IS NOT NULL AND weight IS NOT NULL {only}
)"""


_BOTH = f"{_pairs('a', 'v1')}, {_pairs('b', 'v2')}"

ORACLE = {
    "tokens_samples": f"WITH {_STOK} SELECT sample_id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS words FROM stok",
    "tokens_requests": f"WITH {_RTOK} SELECT req_id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS words FROM rtok",
    "tokens_per_doc": f"WITH {_DTOK} SELECT doc_id, len(tokens) AS n_tokens FROM dtok UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "url_spans_requests": f'WITH {_SPANS} SELECT req_id, CAST(a AS INTEGER) AS start, CAST(b - a AS INTEGER) AS length, substr(text, a + 1, b - a) AS "value" FROM spans',
    "url_mask_counts": f"SELECT source, CAST(sum(length(text) - length(replace({_masked('text')}, '{_S}', ''))) AS BIGINT) AS url_chars FROM documents GROUP BY source",
    "simple_tokenizer": f"""WITH terms AS (SELECT sample_id, list_filter(string_split_regex(regexp_replace(text, '[\\x00-\\x1E]', ' ', 'g'), '[{_W}]+'), lambda x: x <> '') AS t FROM lang_samples),
cut AS (SELECT sample_id, list_transform(t, lambda x: {{'r': x, 'w': regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')}}) AS t FROM terms),
norm AS (SELECT sample_id, list_transform(t, lambda p: CASE WHEN p.w = p.r OR length(p.w) > 1 THEN {_upper('p.w')} END) AS t FROM cut)
SELECT sample_id, len(t) AS n_terms, len(list_filter(t, lambda x: x IS NULL)) AS n_null, array_to_string(list_filter(t, lambda x: x IS NOT NULL), '|') AS terms FROM norm""",
    "character_counts": f"""SELECT req_id, length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) AS letters, length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')) AS digits,
length(text) - length(regexp_replace(text, '\\p{{P}}', '', 'g')) AS punctuation, length(text) - length(regexp_replace(text, '[{_W}]', '', 'g')) AS white,
text IS NULL OR regexp_replace(text, '[{_W}]+', '', 'g') = '' AS is_blank FROM requests""",
    "display_texts": f"""SELECT req_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '...' ELSE t END AS shown
FROM (SELECT req_id, regexp_replace(regexp_replace(text, '[{_W}]', ' ', 'g'), ' +', ' ', 'g') AS t FROM requests)""",
    "upper_words": f"SELECT pair_id, {_upper('text')} AS ngram FROM model_pairs",
    "term_counts": _gram_counts(1),
    "bigram_counts": _gram_counts(2),
    "ngram3_counts": _gram_counts(3),
    "ngram4_counts": _gram_counts(4),
    "merged_counts": f"WITH {_COUNTS} SELECT grp, doc, n, ngram, cnt FROM counts",
    "cut1_counts": _cut(95, 50, 15, 5),
    "cut2_counts": _cut(50, 15, 5, 2),
    "document_frequency": f"WITH {_COUNTS} SELECT grp, ngram, df FROM df",
    "tf": f"WITH {_COUNTS} SELECT grp, doc, ngram, cnt, round(cnt / size, 6) AS tf FROM counts JOIN size USING (grp, doc)",
    "tfidf": f"WITH {_COUNTS} SELECT grp, doc, ngram, round(-(cnt / size) * ln(df / nd), 6) AS weight FROM counts JOIN size USING (grp, doc) JOIN df USING (grp, ngram) JOIN nd USING (grp) WHERE df <> nd",
    "tfidf_one_dimension": f"WITH {_COUNTS} SELECT grp, doc, ngram, round(-(cnt / size) * ln(df / 10000), 6) AS weight FROM counts JOIN size USING (grp, doc) JOIN df USING (grp, ngram) WHERE doc = 'en-megacorpus.txt'",
    "bm25": f"""WITH {_COUNTS} SELECT grp, doc, ngram, round(3 * cnt / (2 * (0.25 + 0.75 * dl / avgdl) + cnt) * ln((nd - df + 0.5) / (df + 0.5)), 6) AS weight
FROM counts JOIN size USING (grp, doc) JOIN avgdl USING (grp) JOIN df USING (grp, ngram) JOIN nd USING (grp)""",
    "residual_idf": f"""WITH {_COUNTS} SELECT grp, doc, ngram, round(-ln(df / nd) + ln(1 - exp(-cf / nd)), 6) AS weight, round(-ln(df / nd), 6) + 0.0 AS absent
FROM counts JOIN df USING (grp, ngram) JOIN nd USING (grp)""",
    "most_frequent_terms": f"WITH {_COUNTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, doc, n ORDER BY cnt DESC, ngram) AS rank FROM counts) WHERE rank <= 10",
    "previous_terms": f"WITH {_STOK}, pos AS (SELECT sample_id, tokens, unnest(range(len(tokens))) AS pos FROM stok) SELECT sample_id, pos, tokens[pos + 1] AS term, CASE WHEN pos > 0 THEN tokens[pos] END AS before FROM pos",
    "average_length": f"WITH {_COUNTS} SELECT grp, round(avg(dl), 6) AS avgdl, count(*) AS n_docs FROM size GROUP BY grp",
    "trained_model": f"WITH {_STOK}, {_MODEL} SELECT ngram, lang, round(weight, 6) AS weight FROM model",
    "empty_documents": f"WITH {_RTOK} SELECT req_id FROM rtok WHERE len(tokens) = 0 UNION ALL {_NO_TEXT}",
    "model_record_count": f"WITH {_pairs('m')} SELECT count(DISTINCT ngram) AS n FROM m",
    "model_nested": f"""WITH {_pairs('m')} SELECT ngram, count(*) AS n, array_to_string(list_sort(list(lang || ':' || CAST(CAST(round(weight * 1000000) AS BIGINT) AS VARCHAR))), ',') AS langs FROM m GROUP BY ngram""",
    "model_merged": f"WITH {_pairs('m')} SELECT ngram, lang, round(sum(weight), 6) AS weight, count(*) AS hits FROM m GROUP BY ALL",
    "model_compare": f"""WITH {_BOTH},
x AS (SELECT ngram, list_sort(list({{'lang': lang, 'weight': weight}})) AS x FROM a GROUP BY ngram), y AS (SELECT ngram, list_sort(list({{'lang': lang, 'weight': weight}})) AS y FROM b GROUP BY ngram)
SELECT coalesce(x.ngram, y.ngram) AS ngram, CASE WHEN y IS NULL THEN 'first' WHEN x IS NULL THEN 'second' ELSE 'both' END AS only_in, coalesce(len(x), 0) - coalesce(len(y), 0) AS pairs
FROM x FULL JOIN y ON x.ngram = y.ngram WHERE x IS DISTINCT FROM y""",
    "vocab_intersect": f"WITH {_BOTH} SELECT ngram FROM a INTERSECT SELECT ngram FROM b",
    "vocab_except": f"WITH {_BOTH} SELECT ngram FROM a EXCEPT SELECT ngram FROM b",
    "model_occurring": f"WITH {_pairs('m')} SELECT ngram, lang, count(*) AS n FROM m WHERE ngram IN (SELECT value FROM word_t WHERE value IS NOT NULL) GROUP BY ALL",
    "lang_scores": f"WITH {_DETECT} SELECT req_id, terms, detected, lang, round(weight_sum, 6) AS weight_sum, hits FROM scores UNION ALL SELECT req_id, 0, 0, NULL, NULL, NULL FROM ({_NO_TEXT})",
    "detect_long": f"WITH {_DETECT} SELECT req_id, rank, lang, round(w, 6) AS weight, percent FROM kept JOIN decided USING (req_id) WHERE reason IS NULL",
    "detect_top": f"WITH {_DETECT} SELECT * FROM best UNION ALL SELECT req_id, NULL, NULL FROM ({_NO_TEXT})",
    "detect_local": f"WITH {_DETECT} SELECT * FROM best UNION ALL SELECT req_id, NULL, NULL FROM ({_NO_TEXT})",
    "detect_documents": f"WITH {_DOC_DETECT} SELECT * FROM best UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL",
    "detect_engine": f"WITH {_DETECT} SELECT * FROM best UNION ALL SELECT req_id, NULL, NULL FROM ({_NO_TEXT})",
    "detect_joined": f"WITH {_DETECT} SELECT * FROM best UNION ALL SELECT req_id, NULL, NULL FROM ({_NO_TEXT})",
    "detect_json": f"""WITH {_DETECT}, langs AS (
  SELECT req_id, string_agg('{{"l":"' || lang || '","n":"' || name || '","p":' || percent || '}}', ',' ORDER BY rank) AS j, string_agg(lang || ', ' || percent || ' %', chr(10) ORDER BY rank) AS s
  FROM kept JOIN decided USING (req_id) JOIN languages ON code = lang WHERE reason IS NULL GROUP BY req_id
)
SELECT req_id, CASE WHEN r.text IS NULL THEN '{{"err":"no text"}}' ELSE '{{"langs":[' || coalesce(j, '') || ']}}' END AS answer, coalesce(s, '[text language is not defined]') AS shown FROM requests r LEFT JOIN langs USING (req_id)""",
    "skip_cyrillic_counts": f"""WITH {_RTOK}, kept AS (SELECT list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[А-яЁё]') THEN NULL ELSE t END) AS tokens FROM rtok)
SELECT ngram, count(*) AS cnt FROM (SELECT unnest({_grams('tokens', 2)}) AS ngram FROM kept) WHERE ngram IS NOT NULL GROUP BY ngram""",
    "accuracy_by_language": f"""WITH {_STOK}, {_trained("SELECT language AS doc, tokens FROM stok WHERE language IS NOT NULL AND sample_id % 5 <> 0")}, held AS (SELECT sample_id, language, tokens FROM stok WHERE sample_id % 5 = 0), {_detection('held', 'sample_id')}
SELECT language, count(*) AS n, CAST(sum(CASE WHEN lang = language THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM best JOIN held USING (sample_id) GROUP BY language""",
    "all_models_sizes": "UNION ALL".join(
        f"""(WITH {_STOK}, {_trained("SELECT language AS doc, tokens FROM stok WHERE language IS NOT NULL", n, "CASE n WHEN 1 THEN 95 ELSE 50 END" if k == 1 else "CASE n WHEN 1 THEN 50 ELSE 15 END")}
SELECT {n} AS "order", {k} AS cut, lang AS doc, count(*) AS n FROM model GROUP BY lang)"""
        for n in (1, 2)
        for k in (1, 2)
    ),
    "model_binary_roundtrip": "SELECT '' AS ngram, '' AS only_in, 0 AS pairs WHERE false",
    "model_text_roundtrip": "SELECT '' AS ngram, '' AS only_in, 0 AS pairs WHERE false",
    "line_counts": f"WITH {_STOK}, files AS (SELECT language, flatten(list(tokens ORDER BY sample_id)) AS tokens FROM stok WHERE language IS NOT NULL GROUP BY language) {' UNION ALL '.join(f'SELECT language, {n} AS n, ngram, count(*) AS cnt FROM (SELECT language, unnest({_grams(chr(116) + "okens", n)}) AS ngram FROM files) GROUP BY ALL' for n in (1, 2, 3, 4))}",
    "document_line_counts": f"""WITH lines AS (SELECT lang, doc_id, unnest(string_split_regex(text, '\r?\n')) AS text, unnest(range(len(string_split_regex(text, '\r?\n')))) AS pos FROM documents WHERE text IS NOT NULL), {_words("ltok", "lines", "lang, doc_id, pos")},
files AS (SELECT lang, flatten(list(tokens ORDER BY doc_id, pos)) AS tokens FROM ltok GROUP BY lang)
SELECT lang, n, count(*) AS n_ngrams, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS most FROM (
  SELECT lang, 1 AS n, ngram, count(*) AS cnt FROM (SELECT lang, unnest(tokens) AS ngram FROM files) GROUP BY ALL
  UNION ALL SELECT lang, 2, ngram, count(*) FROM (SELECT lang, unnest({_grams('tokens', 2)}) AS ngram FROM files) GROUP BY ALL) GROUP BY ALL""",
    "lines_model": f"""WITH {_STOK}, files AS (SELECT language AS doc, flatten(list(tokens ORDER BY sample_id)) AS tokens FROM stok WHERE language IS NOT NULL GROUP BY language), {_trained("SELECT doc, tokens FROM files")} SELECT ngram, lang, round(weight, 6) AS weight FROM model""",
    "detect_shipped": f"WITH {_STOK}, {_MODEL}, {_RTOK}, {_detection(words=5, percent=20)} SELECT * FROM best UNION ALL SELECT req_id, NULL, NULL FROM ({_NO_TEXT})",
    "detect_unknown_reason": f"WITH {_DETECT} SELECT reason, count(*) AS n FROM (SELECT req_id, reason FROM decided UNION ALL SELECT req_id, 'no terms' FROM ({_NO_TEXT})) GROUP BY reason",
    "confusion_matrix": f"""WITH {_DETECT}, answers AS (SELECT req_id, arg_max(l, (logged_at, resp_id)) AS label FROM responses WHERE rank_no = 1 GROUP BY req_id)
SELECT label, lang, count(*) AS n FROM (SELECT req_id, lang FROM best UNION ALL SELECT req_id, NULL FROM ({_NO_TEXT})) LEFT JOIN answers USING (req_id) GROUP BY ALL""",
    "cyrillic_gate": f"""SELECT req_id, floor(20 * letters / 100.0) <= cyr AS gate, CASE WHEN letters > 0 THEN CAST(floor(cyr * 100.0 / letters) AS INTEGER) END AS percent, regexp_matches(text, '[А-яЁё]') AS any_cyrillic
FROM (SELECT *, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^А-я]', '', 'g')) AS cyr FROM requests WHERE text IS NOT NULL AND regexp_replace(text, '[{_W}]+', '', 'g') <> '')""",
    "ru_score": f"""WITH {_STOK}, {_MODEL}, {_RTOK},
words AS (SELECT DISTINCT ngram FROM model WHERE lang = 'RU'),
gate AS (SELECT req_id, floor(20 * length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / 100.0) <= length(regexp_replace(text, '[^А-я]', '', 'g')) AS gate FROM requests WHERE text IS NOT NULL AND regexp_replace(text, '[{_W}]+', '', 'g') <> ''),
gram AS (SELECT req_id, unnest(list_concat(tokens, {_grams('tokens', 2)})) AS ngram FROM rtok),
hit AS (SELECT req_id, count(*) AS hits FROM gram JOIN words USING (ngram) GROUP BY req_id),
weighed AS (
  SELECT r.req_id, g.gate, CASE WHEN g.gate IS NULL THEN NULL WHEN g.gate AND len(t.tokens) > 1 THEN coalesce(hits, 0) / (len(t.tokens) - 1) ELSE 0 END AS w
  FROM requests r LEFT JOIN gate g ON r.req_id = g.req_id LEFT JOIN rtok t ON r.req_id = t.req_id LEFT JOIN hit h ON r.req_id = h.req_id
)
SELECT req_id, gate, round(w, 6) AS weight, w >= 0.5 AND w <> 0 AS is_russian FROM weighed""",
    "p3_loaded": f"""WITH {_P3} SELECT line_id, CASE WHEN plain_ok THEN trim(regexp_extract(body, '^([^\t]*)\t', 1), ' ') ELSE replace(regexp_extract(body, '^ *"((?:[^"]|"")*)" *\t', 1), '""', '"') END AS text,
CAST(CAST(trim(regexp_extract(body, '\t([^\t]*)$', 1), ' ') AS DOUBLE) AS FLOAT) AS weight FROM judged WHERE NOT is_header AND coalesce((quoted_ok OR plain_ok) AND finite, false)""",
    "p3_found": f"WITH {_P3} SELECT line_id FROM judged WHERE NOT is_header AND NOT coalesce((quoted_ok OR plain_ok) AND finite, false)",
}
