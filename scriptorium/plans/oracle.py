"""The same results as DuckDB SQL over the tables as views."""

from __future__ import annotations

from scriptorium.functions import rules as R
from scriptorium.operators.reports import INSTRUCTIONS
from scriptorium.plans import seeds


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, R.STRIP)


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def measured(x: str) -> str:
    return sub(sub(sub(sub(x, R.CITATION_PLAIN), R.NOTE_ANY), r"\*\*|`"), R.PUNCT)


def uncited(x: str) -> str:
    return sub(x, f"{R.CITATION_PLAIN}|{R.NOTE_ANY}")


def literal(x: str, w: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {q(w)}, ''))) / {len(w)} AS INTEGER)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def num(x: str) -> str:
    return f"TRY_CAST({x} AS BIGINT)"


H = q(R.REFS_HEADING)
BODY = f"CASE WHEN instr(text, {H}) = 0 THEN text ELSE left(text, instr(text, {H}) - 1) END"
REFS = f"substring(text, instr(text, {H}))"


def lines(text: str = "text", where: str = "text IS NOT NULL") -> str:
    return f"SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM (SELECT doc_id, string_split({text}, chr(10)) AS a FROM documents WHERE {where})"


PROSE = f"SELECT doc_id, line_no, s FROM (SELECT *, {strip('line')} AS s FROM ({lines(BODY)})) WHERE s <> '' AND NOT {has('s', R.NOISE)} AND NOT {has('line', R.NOTE_LINE)}"
_PARTS = f"list_filter(list_transform(regexp_extract_all(s, '[^。！？；]*[。！？；]|[^。！？；]+\\z'), lambda x: {strip('x')}), lambda x: x <> '')"
SENTENCES = f"SELECT doc_id, line_no, unnest(p) AS sentence, generate_subscripts(p, 1) AS sent_no FROM (SELECT doc_id, line_no, {_PARTS} AS p FROM ({PROSE}))"
MEASURED = f"SELECT *, length(norm) AS chars FROM (SELECT *, {measured('sentence')} AS norm FROM ({SENTENCES}))"
_PIPES = "length(line) - length(replace(line, '|', '')) < 2"
PARAGRAPHS = f"SELECT doc_id, line_no, s AS text FROM (SELECT *, {strip('line')} AS s FROM ({lines()})) WHERE s <> '' AND NOT {has('s', R.HEADING_LINE)} AND NOT {has('s', R.NOISE_NO_HEADING)} AND NOT {has('line', R.NOTE_LINE)} AND {_PIPES}"
DOC_STATS = f"SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(c, 0)::BIGINT AS n_chars, coalesce(c, 0) / greatest(1, coalesce(n, 0))::DOUBLE AS avg_chars FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(chars) AS c FROM ({MEASURED}) GROUP BY 1) s USING (doc_id) WHERE d.text IS NOT NULL"
BLOATED = f"SELECT doc_id, line_no, length({measured('s')}) AS chars FROM ({PROSE}) WHERE length({measured('s')}) > 500"
_KEPT = f"array_to_string(list_filter(string_split({BODY}, chr(10)), lambda x: NOT {has('x', R.NOTE_LINE)}), chr(10))"
FILLER = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {q(label)} AS label, {count('b', p)} AS hits FROM b" for i, (p, label) in enumerate(R.FILLER_PATTERNS))
FILLER = f"WITH b AS (SELECT doc_id, {_KEPT} AS b FROM documents WHERE text IS NOT NULL) SELECT * FROM ({FILLER})"

GROUPS = f"SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS occ FROM (SELECT doc_id, regexp_extract_all({BODY}, {q(R.CITATION)}, 1) AS a FROM documents WHERE instr(text, {H}) > 0)"
_PART = f"SELECT doc_id, occ, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, occ, list_filter(list_transform(string_split(replace(raw, '，', ','), ','), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM ({GROUPS}))"
_ENDS = f"SELECT *, {num(strip('string_split(d, chr(1))[1]'))} AS a, {num(strip('string_split(d, chr(1))[2]'))} AS b FROM (SELECT doc_id, occ, i, regexp_replace(part, '[-–—]', chr(1)) AS d FROM ({_PART}))"
_NUMS = f"SELECT doc_id, occ, i, unnest(CASE WHEN a IS NULL THEN [] WHEN a <= b AND b - a < 200 THEN range(a, b + 1) ELSE [a] END) AS num, generate_subscripts(CASE WHEN a IS NULL THEN [] WHEN a <= b AND b - a < 200 THEN range(a, b + 1) ELSE [a] END, 1) AS j FROM ({_ENDS})"
CITES = f"SELECT doc_id, occ, row_number() OVER (PARTITION BY doc_id, occ ORDER BY i, j) AS pos, num FROM ({_NUMS})"
_NO = num("nullif(regexp_extract(line, '^\\[([0-9]+)\\]', 1), '')")
_E1 = f"SELECT *, {_NO} AS num FROM ({lines(REFS, f'instr(text, {H}) > 0')})"
_E2 = f"SELECT *, sum((num IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ({_E1})"
_ETEXT = "string_agg(regexp_replace(line, '^\\[([0-9]+)\\]', ''), chr(10) ORDER BY line_no)"
ENTRIES = f"SELECT * FROM (SELECT doc_id, max(num) AS num, n::INTEGER AS ord, {strip(sub(_ETEXT, f'[{R.WS}]+', ' '))} AS entry FROM ({_E2}) WHERE n > 0 GROUP BY doc_id, n) WHERE entry <> ''"
CANON = f"SELECT doc_id, num, min(num) OVER (PARTITION BY doc_id, key) AS canonical, entry FROM (SELECT doc_id, num, entry, lower({sub('entry', R.ENTRY_ASIDE)}) AS key FROM (SELECT doc_id, num, arg_min(entry, ord) AS entry FROM ({ENTRIES}) GROUP BY 1, 2))"
FIRST = f"SELECT doc_id, num, row_number() OVER (PARTITION BY doc_id ORDER BY pl) AS place FROM (SELECT doc_id, num, min((occ, pos)) AS pl FROM ({CITES}) GROUP BY 1, 2)"
RENUMBER = f"""SELECT doc_id, old, row_number() OVER (PARTITION BY doc_id ORDER BY pl IS NULL, pl, old) AS new, listed FROM (
 SELECT coalesce(c.doc_id, e.doc_id) AS doc_id, coalesce(c.num, e.num) AS old, c.pl, e.num IS NOT NULL AS listed
 FROM (SELECT x.doc_id, coalesce(k.canonical, x.num) AS num, min((occ, pos)) AS pl FROM ({CITES}) x LEFT JOIN ({CANON}) k ON x.doc_id = k.doc_id AND x.num = k.num GROUP BY 1, 2) c
 FULL JOIN (SELECT DISTINCT doc_id, canonical AS num FROM ({CANON})) e ON c.doc_id = e.doc_id AND c.num = e.num)"""
_NOTES = f"SELECT doc_id, line, regexp_extract(line, {q(R.NOTE_HEAD)}, 1) AS d, regexp_extract_all({sub('line', R.NOTE_HEAD)}, {q(R.NOTE_MARK)}, 1) AS r, line_no FROM ({lines()})"
NOTES = f"SELECT doc_id, num, sum(r)::BIGINT AS refs, sum(d)::BIGINT AS defs FROM (SELECT doc_id, {num('d')} AS num, 0 AS r, 1 AS d FROM ({_NOTES}) WHERE d <> '' UNION ALL SELECT doc_id, {num('x')}, 1, 0 FROM (SELECT doc_id, unnest(r) AS x FROM ({_NOTES}))) WHERE num IS NOT NULL GROUP BY 1, 2"

_V = lambda c: strip(f"coalesce({c}, '')")
TYPE = "CASE WHEN regexp_matches(lower(coalesce(type, '')), 'dissertation|thesis|学位') THEN 'D' WHEN regexp_matches(lower(coalesce(type, '')), 'newspaper|报纸') THEN 'N' WHEN regexp_matches(lower(coalesce(type, '')), 'conference|会议|proceedings') THEN 'C' WHEN regexp_matches(lower(coalesce(type, '')), 'book|专著|monograph') THEN 'M' ELSE 'J' END"
PAGES = f"translate({sub(q('') + ' || coalesce(pages, ' + q('') + ')', f'[{R.WS}]+')}, '－—–', '---')"
_NAMES = f"list_filter(list_transform(string_split(replace(coalesce(authors, ''), '；', ';'), ';'), lambda x: {strip('x')}), lambda x: x <> '')"
FORMAT = f"SELECT id, {TYPE} AS code, {_NAMES} AS names, {sub(_V('title'), r'[.。]+' + chr(92) + 'z')} AS t, {_V('journal')} AS j, {_V('year')} AS y, {_V('volume')} AS v, {_V('issue')} AS i, {PAGES} AS p FROM bib"
GBT = f"""SELECT id, CASE WHEN len(names) <= 3 THEN array_to_string(names, ', ') ELSE array_to_string(names[1:3], ', ') || ', 等' END || '. ' || t || '[' || code || '].' ||
 CASE WHEN code = 'J' THEN ' ' || j || ', ' || y || CASE WHEN v <> '' THEN ', ' || v ELSE '' END || CASE WHEN i <> '' THEN '(' || i || ')' ELSE '' END || CASE WHEN p <> '' THEN ': ' || p ELSE '' END
 WHEN code IN ('D', 'C') THEN ' ' || y ELSE ' ' || j || ', ' || y END || '.' AS entry FROM ({FORMAT})"""
LAW = f"""SELECT id, CASE WHEN len(names) > 0 THEN array_to_string(names, '、') || '：' ELSE '' END || '《' || t || '》' ||
 CASE WHEN code = 'J' THEN '《' || j || '》' || y || '年' || CASE WHEN i <> '' THEN '第' || i || '期' ELSE '' END || CASE WHEN p <> '' THEN '、第' || replace(p, '-', '—') || '页' ELSE '' END
 WHEN code = 'D' THEN '，' || y || '年学位论文' WHEN code = 'N' THEN '，《' || j || '》' || y || '年' ELSE '，' || j || y || '年版' END || '。' AS entry FROM ({FORMAT})"""

_NL = lambda c: f"(length({c}) - length(replace({c}, chr(10), '')))"
_AHEAD = q("(?m)^" + R.ABSTRACT_HEAD + "$")
_SC1 = f"SELECT doc_id, string_split_regex(text, {q('(?m)^' + R.REFS_HEAD + '$')})[1] AS text FROM documents WHERE text IS NOT NULL"
_SC2 = f"SELECT *, string_split_regex(text, {_AHEAD})[1] AS before, CASE WHEN regexp_matches(text, {_AHEAD}) THEN substring(text, length(string_split_regex(text, {_AHEAD})[1]) + length(regexp_extract(text, {_AHEAD})) + 1) ELSE '' END AS r FROM ({_SC1})"
_TAIL = q(rf"\A((?s:.*?))(\n#{{1,6}}[{R.WS}](?s:.*))?\z")
_SC3 = f"SELECT doc_id, text, before, regexp_extract(r, {_TAIL}, 1) || CASE WHEN regexp_extract(r, {_TAIL}, 2) <> '' THEN chr(10) ELSE '' END AS abstract, substring(regexp_extract(r, {_TAIL}, 2), 2) AS after FROM ({_SC2})"
SCAN = f"SELECT doc_id, text, abstract, before || after AS rest, abstract || chr(10) || before || after AS whole, {_NL('before')} AS u, CASE WHEN after <> '' THEN {_NL('text')} - {_NL('after')} - {_NL('before')} ELSE 0 END AS s FROM ({_SC3})"
ABSTRACT = f"SELECT doc_id, {strip('abstract')} AS abstract, rest FROM ({SCAN})"
_TL = f"SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n, u, sh FROM (SELECT doc_id, string_split(rest, chr(10)) AS a, u, s AS sh FROM ({SCAN}))"
TPARAS = f"""SELECT doc_id, CASE WHEN n > u THEN n + sh ELSE n END AS line_no, s AS text FROM (SELECT *, {strip('line')} AS s FROM ({_TL})) WHERE s <> '' AND NOT {has('s', R.HEADING_LINE)} AND NOT {has('s', R.NOISE_NO_HEADING)} AND NOT {has('line', R.NOTE_LINE)} AND {_PIPES}
 UNION ALL SELECT doc_id, 0, {strip(sub('abstract', f'[{R.WS}]+', ' '))} FROM ({SCAN}) WHERE {strip('abstract')} <> ''"""
CLEAN = f"SELECT doc_id, {uncited('whole')} AS text FROM ({SCAN})"
_VAGUE = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {q(w)} AS w, {literal('text', w)} AS n FROM cl" for i, w in enumerate(R.VAGUE))
# A phrase is left out if one taken before it contains it; containing phrases of the lexicon are never left out first.
VAGUE = f"WITH cl AS MATERIALIZED ({CLEAN}), x AS MATERIALIZED ({_VAGUE}) SELECT doc_id, w AS phrase, n AS hits FROM x WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.n > 0 AND y.w <> x.w AND contains(y.w, x.w) AND (y.n > x.n OR (y.n = x.n AND y.i < x.i)))"
_INFL = " UNION ALL ".join(f"SELECT doc_id, {q(c)} AS category, unnest(regexp_extract_all(text, {q(p)})) AS phrase FROM cl" for c, ps in R.INFLATION.items() for p in ps)
INFLATION = f"WITH cl AS MATERIALIZED ({CLEAN}) SELECT doc_id, category, phrase, count(*) AS hits FROM ({_INFL}) GROUP BY 1, 2, 3"
SELF = f"SELECT doc_id, {literal('abstract', '本文')} AS in_abstract, {literal(uncited('rest'), '本文')} AS in_rest, {count('abstract || rest', R.FIRST_PERSON)} AS first_person FROM ({SCAN})"
HEADS = f"SELECT *, (arabic_1 + arabic_2 > 0) AND (chinese_1 + chinese_2 > 0) AS mixed FROM (SELECT doc_id, {', '.join(f'{count("text", "(?m)" + p)} AS {n}' for n, p in R.HEADINGS.items())} FROM ({SCAN}))"


def between(mark: str) -> str:
    """Marks between two wide characters: what a run of such pairs loses when its second wide character is left over."""
    text, gone = "text", sub(sub("text", f"([{R.CJK}]){mark}([{R.CJK}])", r"\1\2"), f"([{R.CJK}]){mark}([{R.CJK}])", r"\1\2")
    return f"length({text}) - length({gone})"


PUNCT = f"SELECT doc_id, {literal(uncited('text'), '——')} AS dashes, {literal(uncited('text'), '……')} AS ellipses, length({uncited('text')}) AS chars, {literal('text', chr(34))} AS straight_quotes, {between(',')} AS half_commas, {between(chr(92) + '.')} AS half_stops, {count('text', chr(92) + '.{3,}')} AS dots FROM (SELECT doc_id, whole AS text FROM ({SCAN}))"
DENSITY = f"SELECT * FROM (SELECT doc_id, line_no, {' + '.join(literal('t', w) for w in R.AI_WORDS)} AS total, length(t) AS chars FROM (SELECT doc_id, line_no, {uncited('text')} AS t FROM ({TPARAS})))"
UNIFORM = f"SELECT doc_id, count(*) AS paragraphs, avg(n) AS mean, stddev_pop(n) AS sd, stddev_pop(n) / avg(n) AS cv FROM (SELECT doc_id, length({uncited('text')}) AS n FROM ({TPARAS})) WHERE n >= 30 GROUP BY 1 HAVING count(*) >= 5"


def _times(words: list[str]) -> str:
    return "(" + " + ".join(literal("c.text", w) for w in words) + ")"


_MARKS = f"""SELECT c.doc_id, s.in_abstract AS abstract_self, s.first_person, coalesce(n.k, 0) AS dense, p.straight_quotes, coalesce(v.k, 0) AS vague, coalesce(i.k, 0) AS inflation, {_times(R.FORMULAIC)} AS formulaic, {_times(R.FILLER)} AS filler,
 CASE WHEN s.in_rest > 3 THEN s.in_rest ELSE 0 END AS rest_self, CASE WHEN p.dashes / greatest(1.0::DOUBLE, p.chars / 1000::DOUBLE) > 8 THEN p.dashes ELSE 0 END AS dashes, p.half_commas + p.half_stops + p.dots AS half_width, h.arabic_1 + h.arabic_2 AS arabic_heads, coalesce(u.cv < 0.35, false)::INT AS even
 FROM ({CLEAN}) c JOIN ({SELF}) s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM ({DENSITY}) WHERE total >= 3 GROUP BY 1) n USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hits) AS k FROM ({VAGUE}) GROUP BY 1) v USING (doc_id)
 LEFT JOIN (SELECT doc_id, sum(hits) AS k FROM ({INFLATION}) GROUP BY 1) i USING (doc_id) JOIN ({PUNCT}) p USING (doc_id) JOIN ({HEADS}) h USING (doc_id) LEFT JOIN ({UNIFORM}) u USING (doc_id)"""
_SEVERE = ("abstract_self", "first_person", "dense", "straight_quotes")
_WARN = ("vague", "inflation", "formulaic", "filler", "rest_self", "dashes", "half_width", "arabic_heads", "even")
_SHOWN = lambda ns: " + ".join(f"({n} > 0)::INT" for n in ns)
_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}:' || {n}::BIGINT END" for n in (*_SEVERE, *_WARN)) + ")"
VERDICT = f"SELECT doc_id, {_SHOWN(_SEVERE)} AS severe, {_SHOWN(_WARN)} AS warnings, {_LIST} AS findings, ({_SHOWN((*_SEVERE, *_WARN))} > 0)::INT AS status FROM ({_MARKS})"


def no_doi(x: str) -> str:
    x = sub(x, rf"(?i)[{R.WS}]*DOI[{R.WS}]*[:：][{R.WS}]*[^{R.WS}]+")
    x = sub(x, rf"(?i)[{R.WS}]*https?://(?:dx\.)?doi\.org/[^{R.WS}]+")
    return strip(sub(x, f"[{R.WS}]+", " "))


def fixed(expr: str) -> str:
    return f"SELECT doc_id, length(f) AS chars, md5(f) AS digest FROM (SELECT doc_id, text, {expr} AS f FROM documents WHERE text IS NOT NULL) WHERE f <> text"


def _wide_marks(x: str) -> str:
    for mark, wide in ((",", "，"), (r"\.", "。"), (";", "；"), (":", "："), (r"\?", "？"), ("!", "！")):
        for _ in range(2):  # RE2 has no look-around: neighbours that share a character need a second pass
            x = sub(x, f"([{R.CJK_KANA}]){mark}([{R.CJK_KANA}])", rf"\1{wide}\2")
    return x


_DQ_LINE = "array_to_string(list_transform(string_split(l, chr(34)), lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '“' || p ELSE '”' || p END), '')"
DOUBLE = f"array_to_string(list_transform(string_split(text, chr(10)), lambda l: {_DQ_LINE}), chr(10))"
_HEAD = "CASE WHEN instr(fragment, '大') > 0 THEN left(fragment, instr(fragment, '大') - 1) WHEN instr(fragment, '学') > 0 THEN left(fragment, instr(fragment, '学') - 1) ELSE left(fragment, length(fragment) - 1) END"
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, {q(w)})" for w in ws) + ")"
INSTITUTIONS = f"SELECT doc_id, line_no, fragment FROM (SELECT *, {_HEAD} AS head FROM (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, {q(R.INSTITUTION)})) AS fragment FROM ({lines()}))) WHERE head <> '' AND NOT {has('fragment', R.REDACTED)} AND NOT {_ANY('head', R.NO_INSTITUTION)} AND NOT ({_ANY('line', R.CITATION_SIGNS)} AND NOT contains(line, '作者') AND NOT contains(line, '单位'))"
TERMS = " UNION ALL ".join(f"SELECT doc_id, line_no, {q(t)} AS term, {literal('line', t)} AS hits FROM l" for t in ("平台请求权", "duty of care", "终稿"))
PATHS = "SELECT source_file AS path FROM export_file UNION ALL SELECT 'd' || doc_id || (['.pdf', '.docx', '.md', '.CAJ'])[doc_id % 4 + 1] FROM documents"
CLASSES = f"SELECT doc_id, norm, min((line_no, sent_no)) AS pl, count(*) AS copies, list_distinct(string_split(norm, '')) AS letters FROM ({MEASURED}) WHERE chars >= 20 GROUP BY 1, 2"
NEAR = f"""WITH c AS MATERIALIZED ({CLASSES}), p AS (SELECT a.doc_id, a.pl AS a, b.pl AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pl < b.pl AND len(a.letters) >= 0.65 * len(b.letters) - 1e-9 AND len(b.letters) >= 0.65 * len(a.letters) - 1e-9
 WHERE len(list_intersect(a.letters, b.letters))::DOUBLE / (len(a.letters) + len(b.letters) - len(list_intersect(a.letters, b.letters))) >= 0.65),
 e AS (SELECT doc_id, pl, count(*) AS links FROM (SELECT doc_id, a AS pl FROM p UNION ALL SELECT doc_id, b FROM p) GROUP BY 1, 2)
 SELECT c.doc_id, c.pl[1] AS line_no, c.pl[2] AS sent_no, copies, coalesce(links, 0) AS links FROM c LEFT JOIN e ON c.doc_id = e.doc_id AND c.pl = e.pl"""
NGRAMS = f"""WITH g AS (SELECT doc_id, substring(norm, k, 10) AS gram, (line_no, sent_no, k) AS pl FROM (SELECT *, unnest(range(1, chars - 8)) AS k FROM ({MEASURED}) WHERE chars >= 10)),
 h AS (SELECT doc_id, gram, count(*) AS hits, min(pl) AS pl FROM g GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT doc_id, rank, gram, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pl) AS rank FROM h) WHERE rank <= 10"""
QUANT = f"SELECT doc_id, l[least(n - 1, floor(n * 0.5)::INT) + 1] AS q50, l[least(n - 1, floor(n * 0.75)::INT) + 1] AS q75, l[least(n - 1, floor(n * 0.9)::INT) + 1] AS q90, l[n] AS longest, len(list_filter(l, lambda x: x > 100)) AS over_100, len(list_filter(l, lambda x: x > 100)) / n::DOUBLE AS share_100 FROM (SELECT doc_id, list(chars ORDER BY chars) AS l, count(*)::INT AS n FROM ({MEASURED}) GROUP BY 1)"
_SEC = f"SELECT *, s LIKE '## %' AS head, NOT (s LIKE '## %') AND s <> '' AND NOT {has('s', R.NOISE)} AND NOT {has('line', R.NOTE_LINE)} AS txt FROM (SELECT *, {strip('line')} AS s FROM ({lines(BODY)}))"
SECTIONS = f"SELECT doc_id, section, title, chars, repeat('█', greatest(1, round_even(chars / 200.0, 0)::INT)) AS bar FROM (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN {strip('substring(s, 4)')} END), '（前言）') AS title, sum(CASE WHEN txt THEN length({measured('s')}) END)::BIGINT AS chars FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS section FROM ({_SEC}) WHERE head OR txt) GROUP BY 1, 2) WHERE chars IS NOT NULL"
CURVE = f"""SELECT project, version, doc_id, n_chars, round(change, 6) AS change, coalesce(change <= -40, false) AS collapsed FROM (SELECT *, (n_chars - p) / greatest(1, p)::DOUBLE * 100 AS change FROM
 (SELECT d.project, d.version, doc_id, s.n_chars, lag(s.n_chars) OVER (PARTITION BY d.project ORDER BY d.version, d.saved_at, doc_id) AS p FROM documents d JOIN ({DOC_STATS}) s USING (doc_id) WHERE d.project IS NOT NULL))"""
LEXICON = " UNION ALL ".join(f"SELECT doc_id, {q(w)} AS phrase, {literal('text', w)} AS hits FROM cl WHERE contains(text, {q(w)})" for w in [*R.AI_WORDS, *R.FILLER, *R.FORMULAIC])
DEDUPE = f"SELECT min(id) AS id, count(*) AS copies FROM bib GROUP BY lower({sub('coalesce(title, ' + q('') + ')', R.TITLE_ASIDE)}), coalesce({strip('string_split(coalesce(authors, ' + q('') + '), ' + q(';') + ')[1]')}, '')"

_ISLANDS = f"SELECT doc_id, occ, min(num) AS a, max(num) AS b FROM (SELECT *, num - row_number() OVER (PARTITION BY doc_id, occ ORDER BY num) AS k FROM (SELECT DISTINCT doc_id, occ, num FROM ({CITES}))) GROUP BY doc_id, occ, k"
_SHOWN = "string_agg(CASE WHEN b - a >= 2 THEN a || '-' || b WHEN a = b THEN a::VARCHAR ELSE a || ', ' || b END, ', ' ORDER BY a)"
COMPRESSED = f"SELECT g.doc_id, g.occ, coalesce(shown, '') AS shown FROM ({GROUPS}) g LEFT JOIN (SELECT doc_id, occ, {_SHOWN} AS shown FROM ({_ISLANDS}) GROUP BY 1, 2) s ON g.doc_id = s.doc_id AND g.occ = s.occ"
_PAGE = "SELECT doc_id, n, '===== PAGE ' || n || ' =====' || chr(10) || substring(text, (n - 1) * 2000 + 1, 2000) AS t FROM (SELECT doc_id, text, unnest(range(1, 1 + greatest(1, ceil(length(text) / 2000.0)::INT))) AS n FROM documents WHERE text IS NOT NULL)"
SCANS = f"SELECT doc_id, count(*) AS pages, sum(length({strip('t')}))::BIGINT AS chars, sum(length({strip('t')})) / count(*)::DOUBLE < 80 AS scanned FROM ({_PAGE}) GROUP BY 1"

_TAGS = {"refworks": [("RT", "type"), ("A1", "authors"), ("T1", "title"), ("JF", "journal"), ("YR", "year"), ("vo", "volume"), ("IS", "issue"), ("OP", "pages"), ("K1", "keywords"), ("DO", "doi"), ("AB", "abstract")]}
_TAGS["endnote"] = [(t, f) for t, (_, f) in zip(("%0", "%A", "%T", "%J", "%D", "%V", "%N", "%P", "%K", "%R", "%X"), _TAGS["refworks"], strict=True)]


def _written(code: str, f: str) -> str:
    if f == "authors":
        return f"array_to_string(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: {q(code + ' ')} || a), chr(10))"
    if f == "type":
        return f"{q(code + ' ')} || CASE WHEN {strip(_C('type'))} = '' THEN 'Generic' ELSE type END"
    return f"{q(code + ' ')} || {_C(f)}"


def _C(f: str) -> str:
    return f"coalesce({f}, '')"


def _field_lines(fmt: str) -> str:
    text = " || chr(10) || ".join(_written(c, f) for c, f in _TAGS[fmt])
    ends = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    exports = f"SELECT (id - 1) // 20 AS export_id, string_agg({text}, chr(10) ORDER BY id) AS t FROM bib GROUP BY 1"
    rows = f"SELECT export_id, line_no, {strip('l')} AS line FROM (SELECT export_id, unnest(a) AS l, generate_subscripts(a, 1) AS line_no FROM (SELECT export_id, string_split_regex(t, {q(ends)}) AS a FROM ({exports})))"
    if fmt == "refworks":
        known = ", ".join(q(c) for c in [*R.REFWORKS, *R.REFWORKS_OTHER])
        lower = ", ".join(q(c) for c in R.REFWORKS_OTHER)
        word = f"regexp_extract(line, '^([A-Za-z][A-Za-z0-9]?)(?:[{R.WS}]|\\z)', 1)"
        code = f"CASE WHEN {word} IN ({known}) OR lower({word}) IN ({lower}) THEN {word} END"
        start, value = "starts_with(line, 'RT ')", f"regexp_replace(line, '^[A-Za-z][A-Za-z0-9]?(?:[{R.WS}]+|\\z)', '')"
    else:
        code, start, value = "nullif(regexp_extract(line, '^(%[A-Z0-9@!?+*$&])', 1), '')", "starts_with(line, '%0')", f"regexp_replace(line, '^%[A-Z0-9@!?+*$&][{R.WS}]*', '')"
    a = f"SELECT *, {code} AS code, {start} AS st FROM ({rows}) WHERE line <> ''"
    b = f"SELECT *, sum(st::INT) OVER (PARTITION BY export_id ORDER BY line_no) AS rec, CASE WHEN code IS NULL THEN line ELSE {value} END AS v FROM ({a})"
    c = f"SELECT *, sum((code IS NOT NULL)::INT) OVER (PARTITION BY export_id ORDER BY line_no) AS f FROM ({b}) WHERE rec > 0"
    return f"SELECT export_id, rec::BIGINT AS rec, min(line_no) AS line_no, max(code) AS code, {strip('string_agg(v, chr(32) ORDER BY line_no)')} AS value FROM ({c}) WHERE f > 0 GROUP BY export_id, rec, f"


def _records(fmt: str) -> str:
    named = [f"WHEN code = {q(c)} OR code = {q(c.lower())} THEN {q(f)}" for c, f in _TAGS[fmt]]
    rows = f"SELECT *, CASE {' '.join(named)} END AS field FROM ({_field_lines(fmt)})"
    pick = []
    for _, f in _TAGS[fmt]:
        if f in ("authors", "abstract"):
            sep = "; " if f == "authors" else " "
            x = f"coalesce(string_agg(value, {q(sep)} ORDER BY line_no) FILTER (WHERE field = {q(f)} AND value <> ''), '')"
            x = strip(sub(x, f"[{R.WS}]+", " ")) if f == "abstract" else x
        else:
            x = f"coalesce(arg_min(value, line_no) FILTER (WHERE field = {q(f)}), '')"
        pick.append(f"{x} AS {f}")
    return f"SELECT *, 'export-' || export_id || '.txt' AS source_file FROM (SELECT export_id, rec, {', '.join(pick)} FROM ({rows}) GROUP BY 1, 2) WHERE title <> ''"


_INNER = "(length(p[i]) > 0 AND " + has("right(p[i], 1)", f"[{R.CJK_KANA}]") + ") OR (length(p[i + 1]) > 0 AND " + has("left(p[i + 1], 1)", f"[{R.CJK_KANA}]") + ")"
_TURNS = f"list_transform(range(1, len(p)), lambda i: (CASE WHEN {_INNER} THEN 1 ELSE 0 END))"


def single(text: str) -> str:
    """Single quotes beside a wide character made curly, by turns within each line: quote i stands between parts i and i + 1."""
    lines_ = f"SELECT doc_id, generate_subscripts(a, 1) AS n, string_split(unnest(a), '''') AS p FROM (SELECT doc_id, string_split({text}, chr(10)) AS a FROM t)"
    turned = f"SELECT doc_id, n, p, {_TURNS} AS k FROM ({lines_})"
    mark = "CASE WHEN k[i] = 0 THEN '''' WHEN list_sum(k[1:i]) % 2 = 1 THEN '‘' ELSE '’' END"
    fixed_line = f"SELECT doc_id, n, p[1] || array_to_string(list_transform(range(1, len(p)), lambda i: {mark} || p[i + 1]), '') AS l FROM ({turned})"
    return f"SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS f FROM ({fixed_line}) GROUP BY 1"


SINGLE = f"WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT s.doc_id, length(f) AS chars, md5(f) AS digest FROM ({single('text')}) s JOIN t USING (doc_id) WHERE f <> text"
_REST = sub(_wide_marks(sub("f", r"\.{3,}|。{2,}", "……")), rf"([0-9]{{4}})[{R.WS}]*[—–][{R.WS}]*([0-9]{{4}})", r"\1-\2")
NORMALIZED = f"WITH t AS (SELECT doc_id, text AS raw, {DOUBLE} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(g) AS chars, md5(g) AS digest FROM (SELECT s.doc_id, raw, {_REST} AS g FROM ({single('text')}) s JOIN t USING (doc_id)) WHERE g <> raw"

# A body is cut at its marks, and put together again with the new ones between.
_NEWS = f"SELECT x.doc_id, x.occ, list_sort(list_distinct(list(r.new))) AS news FROM ({CITES}) x LEFT JOIN ({CANON}) k ON x.doc_id = k.doc_id AND x.num = k.num JOIN ({RENUMBER}) r ON r.doc_id = x.doc_id AND r.old = coalesce(k.canonical, x.num) GROUP BY 1, 2"
_PIECES = f"SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split_regex({BODY}, {q(R.CITATION)}) AS a FROM documents WHERE instr(text, {H}) > 0 AND {has(BODY, R.CITATION)})"


def body_with(mark: str) -> str:
    return f"SELECT p.doc_id, string_agg(piece || coalesce({mark}, ''), '' ORDER BY i) AS body FROM ({_PIECES}) p LEFT JOIN ({_NEWS}) n ON p.doc_id = n.doc_id AND p.i = n.occ GROUP BY 1"


BODY_NEW = body_with("'[' || array_to_string(news, '][') || ']'")
_RUN = f"SELECT doc_id, occ, '[' || string_agg(CASE WHEN b - a >= 2 THEN a || '-' || b WHEN a = b THEN a::VARCHAR ELSE a || '][' || b END, '][' ORDER BY a) || ']' AS m FROM (SELECT doc_id, occ, min(x) AS a, max(x) AS b FROM (SELECT doc_id, occ, x, x - row_number() OVER (PARTITION BY doc_id, occ ORDER BY x) AS k FROM (SELECT doc_id, occ, unnest(news) AS x FROM ({_NEWS}))) GROUP BY doc_id, occ, k) GROUP BY 1, 2"
_BODY_RUNS = f"SELECT p.doc_id, string_agg(piece || coalesce(m, ''), '' ORDER BY i) AS body FROM ({_PIECES}) p LEFT JOIN ({_RUN}) n ON p.doc_id = n.doc_id AND p.i = n.occ GROUP BY 1"
REFLINES = f"SELECT r.doc_id, new, '[' || new || '] ' || coalesce(entry, '[待补：原编号 ' || old || ' 的文献条目缺失]') AS line FROM ({RENUMBER}) r LEFT JOIN ({CANON}) c ON r.doc_id = c.doc_id AND r.old = c.num"
STRICT = f"""WITH canon AS MATERIALIZED ({CANON}), u AS MATERIALIZED (SELECT DISTINCT x.doc_id, coalesce(k.canonical, x.num) AS num FROM ({CITES}) x LEFT JOIN canon k ON x.doc_id = k.doc_id AND x.num = k.num),
 m AS (SELECT u.doc_id, count(*) AS k FROM u WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.doc_id = u.doc_id AND c.canonical = u.num) GROUP BY 1), g AS (SELECT r.doc_id, count(*) AS k FROM ({RENUMBER}) r JOIN u ON u.doc_id = r.doc_id AND u.num = r.old WHERE r.old <> r.new GROUP BY 1),
 s AS (SELECT d.doc_id, CASE WHEN NOT {has(BODY.replace('text', 'd.text'), R.CITATION)} THEN 2 WHEN m.k > 0 THEN 1 ELSE 0 END AS status, coalesce(m.k, 0) AS missing, coalesce(g.k, 0) AS changed FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id) WHERE instr(d.text, {H}) > 0)
 SELECT s.*, md5(CASE WHEN status = 0 THEN b.body END) AS digest, md5(CASE WHEN status = 0 THEN l.t END) AS refs_digest FROM s LEFT JOIN ({_BODY_RUNS}) b USING (doc_id) LEFT JOIN (SELECT doc_id, {H} || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY new) || chr(10) AS t FROM ({REFLINES}) GROUP BY 1) l USING (doc_id)"""


def _shown(numbers: str, most: int = 40) -> str:
    return f"CASE WHEN len({numbers}) = 0 THEN '（空）' ELSE '[' || array_to_string({numbers}[1:{most}], '] [') || ']' || CASE WHEN len({numbers}) > {most} THEN ' … 共 ' || len({numbers}) || ' 个' ELSE '' END END"


_LISTED = f"SELECT DISTINCT doc_id, num FROM ({ENTRIES})"
CHECKED = f"""WITH c AS MATERIALIZED (SELECT doc_id, num, min(place) AS place FROM ({FIRST}) GROUP BY 1, 2), l AS MATERIALIZED ({_LISTED}),
 a AS (SELECT doc_id, list(num ORDER BY num) AS u, list(num ORDER BY place) FILTER (WHERE num <> place) AS w, count(*) FILTER (WHERE num <> place) AS mismatch, count(*) FILTER (WHERE (doc_id, num) NOT IN (SELECT (doc_id, num) FROM l)) AS missing FROM c GROUP BY 1),
 b AS (SELECT doc_id, list(num ORDER BY num) AS u, max(num) - count(*) FILTER (WHERE num > 0) AS gaps, count(*) FILTER (WHERE (doc_id, num) NOT IN (SELECT (doc_id, num) FROM c)) AS extra FROM l GROUP BY 1),
 r AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, num FROM ({ENTRIES}) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), z AS (SELECT doc_id, count(*) AS k FROM ({CANON}) WHERE canonical <> num GROUP BY 1),
 o AS (SELECT d.doc_id, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(gaps, 0) AS gaps, coalesce(r.k, 0) AS repeated, coalesce(z.k, 0) AS zombies, coalesce(mismatch, 0) AS mismatch, coalesce(a.u, []) AS au, coalesce(b.u, []) AS bu, coalesce(a.w, []) AS w
 FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id) WHERE instr(d.text, {H}) > 0)
 SELECT doc_id, missing, extra, gaps, repeated, zombies, mismatch, {_shown('au')} AS cited_shown, {_shown('bu')} AS listed_shown, {_shown('w', 8)} AS mismatch_shown, (missing + extra + gaps + repeated + zombies + mismatch > 0)::INT AS status FROM o"""
NOTES_CHECKED = f"""SELECT doc_id, coalesce(count(*) FILTER (WHERE refs > 0 AND defs = 0), 0) AS missing, coalesce(count(*) FILTER (WHERE refs = 0 AND defs > 0), 0) AS unused, coalesce(max(num) FILTER (WHERE defs > 0) - count(*) FILTER (WHERE defs > 0), 0) AS gaps FROM ({NOTES}) GROUP BY 1"""


_K = f"[{R.CJK_KANA}]"


def _pairs(mark: str) -> str:
    """Marks between two wide characters: what such pairs lose, the second time for those that share a character with the first."""
    gone = sub(sub("text", f"({_K}){mark}({_K})", r"\1\2"), f"({_K}){mark}({_K})", r"\1\2")
    return f"length(text) - length({gone})"


_SQ = "list_sum(list_transform(range(1, len(p)), lambda i: (CASE WHEN (" + _INNER + ") THEN 1 ELSE 0 END)))"
PUNCT_REPORT = f"""SELECT *, (double_quotes + single_quotes + commas + stops + dots + year_dashes > 0)::INT AS status FROM (SELECT doc_id, {literal('text', chr(34))} AS double_quotes, coalesce({_SQ}, 0)::INT AS single_quotes,
 {_pairs(',')} AS commas, {_pairs(chr(92) + '.')} AS stops, {count('text', chr(92) + '.{3,}')} AS dots, {count('text', f'[0-9]{{4}}[{R.WS}]*[—–][{R.WS}]*[0-9]{{4}}')} AS year_dashes FROM (SELECT doc_id, text, string_split(text, chr(39)) AS p FROM documents WHERE text IS NOT NULL))"""
_SOME = lambda a, f, b="": f"CASE WHEN {_C(f)} <> '' THEN {q(a)} || {f} || {q(b)} ELSE '' END"
_OR = lambda f: f"coalesce(nullif({f}, ''), '—')"
_NL1 = "chr(10)"
LISTING = f"""SELECT ord, md5(t) AS digest FROM (SELECT id + 1 AS ord, '### [' || id || '] ' || {_C('title')} || {_NL1} || {_NL1} || '- 作者：' || {_OR('authors')} || {_NL1} || '- 出处：' || {_OR('journal')} || ' ' || {_C('year')} || {_SOME('，', 'volume')} || {_SOME('(', 'issue', ')')} || {_SOME('：', 'pages')}
 || CASE WHEN {_C('keywords')} <> '' THEN {_NL1} || '- 关键词：' || keywords ELSE '' END || CASE WHEN {_C('abstract')} <> '' THEN {_NL1} || '- 摘要：' || left(abstract, 400) || CASE WHEN length(abstract) > 400 THEN '…' ELSE '' END ELSE '' END || {_NL1} AS t FROM bib
 UNION ALL SELECT 0, '# 题录清单' || {_NL1} || {_NL1} || '- 记录数：' || count(*) || {_NL1} || '- 含摘要：' || count(nullif(abstract, '')) || {_NL1} || '- 年份范围：' || min(nullif(year, '')) || ' — ' || max(nullif(year, '')) || {_NL1} || '- 来源文件：' || array_to_string(list_sort(list(DISTINCT source_file)), ', ') || {_NL1} FROM bib
 UNION ALL SELECT 1, '## 载文量前十期刊' || {_NL1} || {_NL1} || string_agg('- ' || journal || '（' || n || ' 篇）', {_NL1} ORDER BY n DESC, f) || {_NL1} || {_NL1} || '---' || {_NL1} || {_NL1} || '## 题录明细' || {_NL1} FROM (SELECT journal, count(*) AS n, min(id) AS f FROM bib WHERE journal <> '' GROUP BY 1 ORDER BY n DESC, f LIMIT 10))"""

_LAYOUT = rf"^>[{R.WS}]*({'|'.join(R.LAYOUT_KEYS)})[{R.WS}]*[:：][{R.WS}]*([^\n]+)\z"
_KEYWORDS = rf"^\*{{0,2}}关键词\*{{0,2}}[{R.WS}]*[:：]"
_REFLINE = rf"^#{{1,3}}[{R.WS}]*参考文献[{R.WS}]*\z"


def unwrap(x: str) -> str:
    s = strip(x)
    inner = f"substring({s}, 2, length({s}) - 2)"
    return f"CASE WHEN starts_with({s}, '《') AND ends_with({s}, '》') AND length({s}) > 2 AND NOT contains({inner}, '》') THEN {strip(inner)} ELSE {s} END"


_BL0 = f"SELECT *, {has('line', R.NOTE_HEAD)} AS note FROM (SELECT doc_id, line_no, line, {strip('line')} AS s FROM ({lines()})) WHERE s <> ''"
_BL1 = f"SELECT *, sum((NOT (note OR starts_with(s, '>') OR starts_with(s, '# ')))::INT) OVER w = 0 AS in_head, sum({has('s', _REFLINE)}::INT) OVER w > 0 AS in_refs FROM ({_BL0}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"
_BL2 = f"SELECT *, sum((in_head AND starts_with(s, '# '))::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS nth, {has('s', R.ABSTRACT_LINE)} AND NOT in_refs AS opens, in_refs AND {has('s', '^\\[[0-9]+\\]')} AS entry FROM ({_BL1})"
_CLOSES = f"({has('s', rf'^#{{1,3}}[{R.WS}]')} OR starts_with(s, '**关键词'))"
_BL3 = f"SELECT *, last_value(CASE WHEN opens THEN 'abstract' WHEN {_CLOSES} THEN 'body' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS state, coalesce(sum(entry::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entries FROM ({_BL2})"
_KIND = f"""CASE WHEN note THEN 'note' WHEN in_head AND {has('s', _LAYOUT)} THEN 'meta' WHEN in_head AND starts_with(s, '>') THEN NULL WHEN in_head AND starts_with(s, '# ') AND nth = 1 THEN 'title' WHEN {has('s', _REFLINE)} THEN NULL
 WHEN entry THEN 'ref' WHEN in_refs THEN CASE WHEN NOT starts_with(s, '#') AND entries > 0 THEN 'ref_more' END WHEN opens THEN NULL WHEN {has('s', _KEYWORDS)} THEN 'keywords' WHEN state = 'abstract' THEN 'abstract' WHEN s IN ('---', '***', '___') THEN NULL
 WHEN starts_with(s, '## ') THEN 'h1' WHEN starts_with(s, '### ') THEN 'h2' WHEN starts_with(s, '> ') THEN 'quote' WHEN starts_with(s, '|') AND ends_with(s, '|') THEN 'table' ELSE 'p' END"""
_TEXT = f"""CASE kind WHEN 'meta' THEN {unwrap(f"regexp_extract(s, {q(_LAYOUT)}, 2)")} WHEN 'title' THEN {unwrap('substring(s, 3)')} WHEN 'note' THEN {strip(sub('s', rf'{R.NOTE_HEAD}[{R.WS}]*'))} WHEN 'ref' THEN {strip(sub('s', '^\\[[0-9]+\\]'))} WHEN 'keywords' THEN {strip(sub('s', _KEYWORDS))}
 WHEN 'h1' THEN {strip('substring(s, 4)')} WHEN 'h2' THEN {strip('substring(s, 5)')} WHEN 'quote' THEN {strip('substring(s, 3)')} ELSE s END"""
BLOCKS = f"SELECT doc_id, line_no, kind, {_TEXT} AS text, CASE WHEN kind = 'meta' THEN regexp_extract(s, {q(_LAYOUT)}, 1) END AS key FROM (SELECT *, {_KIND} AS kind FROM ({_BL3})) WHERE kind IS NOT NULL"
_CELLS = f"SELECT doc_id, line_no, list_transform(string_split({sub('text', '^\\|+|\\|+\\z')}, '|'), lambda c: {strip('c')}) AS cells FROM ({BLOCKS}) WHERE kind = 'table'"
_CELL1 = f"SELECT * FROM ({_CELLS}) WHERE len(list_filter(cells, lambda c: NOT {has('c', '^:?-{2,}:?\\z')})) > 0"
_CELL2 = f"SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS tab FROM (SELECT *, (line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -9) > 2)::INT AS n FROM ({_CELL1}))"
CELLS = f"SELECT doc_id, line_no, unnest(range(1, wide + 1)) AS col, coalesce(cells[unnest(range(1, wide + 1))], '') AS cell FROM (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id, tab) AS wide FROM ({_CELL2}))"
_INLINE = r"\*\*[^\n]+?\*\*|\[\^[0-9]+\]|«FN[0-9]+»"
_SPANS = f"SELECT doc_id, line_no, string_split_regex(text, {q(_INLINE)}) AS t, regexp_extract_all(text, {q(_INLINE)}) AS m FROM ({BLOCKS}) WHERE kind = 'p'"
_MARKED = "CASE WHEN starts_with(m[i], '**') THEN {'kind': 'bold', 'text': substring(m[i], 3, length(m[i]) - 4)} ELSE {'kind': 'note', 'text': m[i]} END"
_BOTH = f"list_filter(flatten(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i <= len(m) THEN [{{'kind': 'plain', 'text': t[i]}}, {_MARKED}] ELSE [{{'kind': 'plain', 'text': t[i]}}] END)), lambda x: x.text <> '')"
RUNS = f"SELECT doc_id, line_no, run, x.kind AS kind, md5(x.text) AS digest FROM (SELECT doc_id, line_no, unnest(a) AS x, generate_subscripts(a, 1) AS run FROM (SELECT doc_id, line_no, {_BOTH} AS a FROM ({_SPANS})))"
_STYLED = {"title": ("黑体", 16.0), "subtitle": ("黑体", 14.0), "author": ("楷体", 12.0), "running_head": ("楷体", 9.0), "abstract": ("楷体", 12.0), "keywords": ("楷体", 12.0), "h1": ("黑体", 15.0), "h2": ("黑体", 12.0), "quote": ("楷体", 12.0), "table": ("宋体", 9.0), "p": ("宋体", 12.0), "ref": ("宋体", 10.5)}
_PRINTED = "CASE WHEN kind = 'meta' THEN CASE key WHEN '题目' THEN 'title' WHEN '副标题' THEN 'subtitle' WHEN '作者' THEN 'author' WHEN '页眉' THEN 'running_head' END WHEN kind = 'ref_more' THEN 'ref' ELSE kind END"
_LAY1 = f"SELECT *, {_PRINTED} AS k, max((kind = 'meta' AND key = '题目')::INT) OVER (PARTITION BY doc_id) AS named, sum((kind = 'ref')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM ({BLOCKS})"
_LAY2 = f"SELECT doc_id, k AS kind, min(line_no) AS line_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM (SELECT *, CASE WHEN kind IN ('ref', 'ref_more') THEN -e ELSE line_no END AS part FROM ({_LAY1}) WHERE k IS NOT NULL AND NOT (kind = 'title' AND coalesce(named, 0) = 1)) GROUP BY doc_id, k, part"
_OF = lambda i: "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(v[i]) if i == 0 else f'{v[i]}::DOUBLE'}" for k, v in _STYLED.items()) + " END"
LAYOUT = f"SELECT doc_id, line_no, kind, {_OF(0)} AS font, {_OF(1)} AS size, kind IN ('abstract', 'quote', 'p') AS indent, false AS bold, md5(text) AS digest FROM ({_LAY2}) WHERE kind IN ({', '.join(map(q, _STYLED))})"

_METALINE = rf"^>[{R.WS}]*({'|'.join(R.META_KEYS)})[{R.WS}]*[:：][{R.WS}]*([^\n]*)\z"
_PK0 = f"SELECT *, sum(starts_with(s, '## ')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) = 0 AS head FROM (SELECT doc_id, line_no, line, {strip('line')} AS s FROM ({lines()}))"
_INTERNAL = has("s", rf"^#[{R.WS}]*论文正文[^\n]*\z")
_PK1 = f"""SELECT doc_id, arg_max(regexp_extract(s, {q(_METALINE)}, 2), line_no) FILTER (WHERE head AND regexp_extract(s, {q(_METALINE)}, 1) = '题目') AS t1, arg_min(substring(s, 3), line_no) FILTER (WHERE head AND starts_with(s, '# ') AND NOT {_INTERNAL}) AS t2,
 coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT (head AND (starts_with(s, '>') OR {_INTERNAL} OR starts_with(s, '# ')))), '') AS b FROM ({_PK0}) GROUP BY 1"""
_PK2 = f"SELECT doc_id, coalesce(nullif({unwrap('t1')}, ''), nullif({unwrap('t2')}, '')) AS title, {count('b', R.COMMENT)} AS comments, {sub('b', R.COMMENT)} AS b FROM ({_PK1})"
_STATUS = rf"(?m)^[{R.WS}]*(?:状态|写作状态)[{R.WS}]*[:：][^\n]*$"
_PK3 = f"SELECT doc_id, title, comments, {count('b', _STATUS)} AS status_lines, {sub('b', _STATUS)} AS b FROM ({_PK2})"
_PK4 = f"SELECT doc_id, title, comments, status_lines, CASE WHEN title IS NOT NULL THEN '# ' || title || chr(10) || chr(10) || {sub('b', f'^[{R.WS}]+')} ELSE b END AS b FROM ({_PK3})"
_PK5 = f"SELECT *, {count('b', R.PLACEHOLDER)} AS placeholders, {count('b', R.TODO)} AS todos FROM ({_PK4})"
_ANON = "b"
for _pattern in (r"（?作者信息[:：][^）\n]*）?", rf"(?m)^>[{R.WS}]*(?:{'|'.join(R.META_KEYS)})[{R.WS}]*[:：][^\n]*$", rf"(?m)^[{R.WS}]*[*\-#]*[{R.WS}]*\[?作者姓名[^\n]*$"):
    _ANON = sub(_ANON, _pattern)
PACKET = f"SELECT doc_id, title, comments, status_lines, placeholders, todos, {strip(sub(_ANON, chr(92) + 'n{3,}', chr(10) + chr(10)))} || chr(10) AS text FROM ({_PK5})"


_NW = r"[^\p{L}\p{N}_\n]"  # RE2 knows word edges of ASCII only, and no look-around
_ID = r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}"
#: For each rule a pattern, its group, and what of its matches is the fragment.
_FIND = [
    (R.PII_RULES[0][3], 0, "m"), ("[0-9]+", 0, "CASE WHEN regexp_full_match(m, '1[3-9][0-9]{9}') THEN m END"), ("[0-9]+[Xx]?", 0, f"nullif(regexp_extract(m, '^({_ID}[0-9Xx])[Xx]?$', 1), '')"), ("[0-9]+", 0, "CASE WHEN regexp_full_match(m, '[1-9][0-9]{7,10}') THEN m END"),
    (R.PII_RULES[4][3], 0, "m"), (rf"(?:^|[^\p{{L}}\p{{N}}_.])([A-Za-z]:[\\/][^{R.WS}\"'<>|`]{{4,}})", 1, "m"), (R.PII_RULES[6][3], 0, "m"), (R.PII_RULES[7][3], 0, "m"),
    (R.PII_RULES[8][3], 0, f"CASE WHEN contains({q(R.SURNAMES)}, left({sub('m', rf'^(?:作者|姓名|著作人|执笔人)[{R.WS}]*[:：][{R.WS}]*')}, 1)) THEN m END"), (R.PII_RULES[9][3], 0, "m"),
    (rf"((?:[A-Z][a-z]+[{R.WS}]+){{1,4}}(?:of[{R.WS}]+)?[A-Z][a-z]+[{R.WS}]*,?[{R.WS}]*[A-Z]{{2,6}})(?:{_NW}|\z)", 1, "m"),
    (rf"(?:^|{_NW})((?:University|College|Institute|School|Academy){_NW}(?:[^\n]{{0,38}}?{_NW})?[A-Z]{{2,8}})(?:{_NW}|\z)", 1, "m"),
]
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {q(c)} AS category, {q(s)} AS severity, {q(d)} AS description, line_no AS line, {strip(f)} AS f FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, {q(p)}, {g})) AS m FROM l)"
    for (c, s, d, _), (p, g, f) in zip(R.PII_RULES, _FIND, strict=True)
)
PII = f"WITH l AS ({lines()}) SELECT doc_id, category, severity, description, line, left(f, 80) AS fragment FROM ({_HITS}) WHERE f <> '' AND NOT {has('f', R.REDACTED)}"


SQL = {
    "paragraphs": f"SELECT doc_id, line_no, length(text) AS text_chars FROM ({PARAGRAPHS})",
    "sentences": f"SELECT doc_id, line_no, sent_no, length(sentence) AS sentence_chars FROM ({SENTENCES})",
    "sentence_normalize": f"SELECT doc_id, line_no, sent_no, chars, md5(norm) AS digest FROM ({MEASURED})",
    "doc_stats": DOC_STATS,
    "sentence_quantiles": QUANT,
    "section_stats": SECTIONS,
    "long_sentences": f"SELECT doc_id, line_no, sent_no, chars FROM ({MEASURED}) WHERE chars > 150",
    "bloated_paragraphs": BLOATED,
    "repeated_ngrams": NGRAMS,
    "filler_hits": seeds.sql(f"SELECT doc_id, rank, label, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS rank FROM ({FILLER} WHERE hits >= 3)) WHERE rank <= 12"),
    "doc_stats_baseline": f"SELECT doc_id, n_sentences, n_chars, round(avg_chars, 6) AS avg_chars, round((avg_chars - 47) / 47 * 100, 6) AS deviation, abs((avg_chars - 47) / 47 * 100) <= 20 AS near FROM ({DOC_STATS})",
    "longest": f"SELECT doc_id, 'sentence' AS kind, r AS rank, chars, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, line_no, sent_no) AS r FROM ({MEASURED}) WHERE chars > 150) WHERE r <= 10 UNION ALL SELECT doc_id, 'paragraph', r, chars, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, line_no) AS r FROM ({BLOATED})) WHERE r <= 8",
    "version_curve": CURVE,
    "near_dup_jaccard": NEAR,
    "doc_split": f"SELECT doc_id, length({BODY}) AS body_chars, length({REFS}) AS list_chars FROM documents WHERE instr(text, {H}) > 0",
    "mode_detect": f"SELECT doc_id, CASE WHEN n AND NOT c THEN 'footnote' WHEN h AND c THEN 'journal' WHEN n THEN 'footnote' WHEN h THEN 'journal' ELSE 'error' END AS mode FROM (SELECT doc_id, {has('text', '(?m)' + R.NOTE_HEAD)} AS n, {has(BODY, R.CITATION)} AS c, instr(text, {H}) > 0 AS h FROM documents WHERE text IS NOT NULL)",
    "citations": f"SELECT doc_id, occ, raw FROM ({GROUPS})",
    "citation_expand": CITES,
    "ref_entries": ENTRIES,
    "cite_missing": f"SELECT DISTINCT doc_id, num FROM ({CITES}) EXCEPT SELECT doc_id, num FROM ({ENTRIES})",
    "cite_extra": f"SELECT DISTINCT doc_id, num FROM ({ENTRIES}) EXCEPT SELECT doc_id, num FROM ({CITES})",
    "cite_gaps": f"SELECT doc_id, b + 1 AS first, num - 1 AS last FROM (SELECT *, coalesce(lag(num) OVER (PARTITION BY doc_id ORDER BY num), 0) AS b FROM (SELECT DISTINCT doc_id, num FROM ({ENTRIES}))) WHERE num > b + 1",
    "cite_dup_numbers": seeds.sql(f"SELECT doc_id, num, count(*) AS n FROM ({ENTRIES}) GROUP BY 1, 2 HAVING count(*) > 1"),
    "cite_zombies": seeds.sql(f"SELECT doc_id, canonical AS first_num, num FROM ({CANON}) WHERE canonical <> num"),
    "cite_first_order": FIRST,
    "cite_order_mismatch": f"SELECT * FROM ({FIRST}) WHERE num <> place",
    "cite_summary": f"SELECT d.doc_id, coalesce(o, 0) AS occurrences, coalesce(c, 0) AS cited, coalesce(e, 0) AS entries, lowest, highest FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS o, count(DISTINCT num) AS c FROM ({CITES}) GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT num) AS e, min(num) AS lowest, max(num) AS highest FROM ({ENTRIES}) GROUP BY 1) USING (doc_id) WHERE instr(d.text, {H}) > 0",
    "cite_canonical": f"SELECT doc_id, num, canonical FROM ({CANON})",
    "renumber_map": RENUMBER,
    "renumber_refs": REFLINES,
    "renumber_body": f"SELECT doc_id, length(body) AS body_chars, md5(body) AS digest FROM ({BODY_NEW})",
    "renumber_strict": seeds.sql(STRICT),
    "cite_verdict": seeds.sql(CHECKED),
    "footnote_verdict": f"SELECT *, (missing + unused + gaps > 0)::INT AS status FROM ({NOTES_CHECKED})",
    "bib_field_lines": f"SELECT export_id, 'export-' || export_id || '.txt' AS source_file, rec, line_no, code, md5(value) AS digest FROM ({_field_lines('refworks')})",
    "bib_records": _records("refworks"),
    "bib_records_endnote": _records("endnote"),
    "fix_single_quotes": seeds.sql(SINGLE),
    "normalize_doc": seeds.sql(NORMALIZED),
    "trace_verdict_seeded": seeds.sql(VERDICT),
    "compress_ranges": COMPRESSED,
    "pii_hits": seeds.sql(PII),
    "pii_allowed": seeds.sql(f"SELECT * FROM ({PII}) WHERE NOT contains(fragment, 'mail5') AND NOT contains(fragment, '王某')"),
    "pii_severity": seeds.sql(f"SELECT severity, count(*) AS n FROM (SELECT severity FROM ({PII}) UNION ALL SELECT '中' FROM ({INSTITUTIONS})) GROUP BY 1"),
    "pii_verdict": seeds.sql(f"SELECT d.doc_id, coalesce(h, 0) AS high, coalesce(k, 0) AS medium, (coalesce(h, 0) + coalesce(k, 0) > 0)::INT AS status FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity = '高') AS h, count(*) FILTER (WHERE severity = '中') AS k FROM (SELECT doc_id, severity FROM ({PII}) UNION ALL SELECT doc_id, '中' FROM ({INSTITUTIONS})) GROUP BY 1) USING (doc_id) WHERE d.text IS NOT NULL"),
    "scan_detect": SCANS,
    "md_blocks": f"SELECT doc_id, line_no, kind, md5(text) AS digest FROM ({BLOCKS})",
    "md_table_cells": CELLS,
    "md_runs": RUNS,
    "layout_blocks": LAYOUT,
    "packet_clean": f"SELECT * EXCLUDE (text), md5(text) AS digest FROM ({PACKET})",
    "footnotes": NOTES,
    "footnote_missing": f"SELECT doc_id, num FROM ({NOTES}) WHERE refs > 0 AND defs = 0",
    "footnote_unused": f"SELECT doc_id, num FROM ({NOTES}) WHERE refs = 0 AND defs > 0",
    "footnote_resolve": f"SELECT n.doc_id, n.num, definition, refs FROM ({NOTES}) n JOIN (SELECT doc_id, {num('d')} AS num, arg_max({strip(sub('line', R.NOTE_HEAD + f'[{R.WS}]*'))}, line_no) AS definition FROM ({_NOTES}) WHERE d <> '' GROUP BY 1, 2) d ON n.doc_id = d.doc_id AND n.num = d.num WHERE refs > 0",
    "bib_detect_format": "SELECT DISTINCT (id - 1) // 20 AS export_id, 'refworks' AS fmt FROM bib",
    "bib_dedupe": DEDUPE,
    "bib_summary": "SELECT count(*) AS records, sum((coalesce(abstract, '') <> '')::INT)::BIGINT AS with_abstract, min(nullif(year, '')) AS first_year, max(nullif(year, '')) AS last_year, count(DISTINCT source_file) AS sources, array_to_string(list_sort(list(DISTINCT source_file)), ', ') AS source_files FROM bib",
    "bib_top_journals": "SELECT journal, count(*) AS n FROM bib WHERE journal <> '' GROUP BY 1 ORDER BY n DESC, min(id) LIMIT 10",
    "bib_filter": "SELECT id FROM bib WHERE id IN (SELECT bib_id + 3 FROM cite_occ WHERE bib_id IS NOT NULL)",
    "bib_filter_missing": "SELECT DISTINCT bib_id + 3 AS id FROM cite_occ WHERE bib_id IS NOT NULL EXCEPT SELECT id FROM bib",
    "bib_format_gbt": f"SELECT id, {no_doi('entry')} AS entry FROM ({GBT})",
    "bib_format_law": f"SELECT id, {no_doi('entry')} AS entry FROM ({LAW})",
    "bib_reference_list": f"SELECT num, '[' || num || '] ' || e AS line FROM (SELECT row_number() OVER (ORDER BY id) + 100 AS num, {no_doi('entry')} AS e FROM ({LAW}))",
    "bib_listing": LISTING,
    "packet": f"SELECT doc_id, '审稿稿_M1.md' AS file, md5(text) AS digest FROM ({PACKET}) UNION ALL SELECT doc_id, '审稿任务说明_M1.md', md5({q(INSTRUCTIONS.format(round_no=1, manuscript='审稿稿_M1.md', extra=''))}) FROM documents WHERE text IS NOT NULL",
    "punct_report": seeds.sql(PUNCT_REPORT),
    "paged_text": f"SELECT doc_id, doc_id || '.txt' AS file, s.scanned, md5(t) AS digest FROM (SELECT doc_id, string_agg(chr(10) || t, '' ORDER BY n) AS t FROM ({_PAGE}) GROUP BY 1) JOIN ({SCANS}) s USING (doc_id)",
    "run_counters": f"SELECT count(*) FILTER (WHERE NOT skip AND NOT scanned) AS ok, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE NOT skip AND scanned) AS need_ocr, count(*) FILTER (WHERE NOT skip AND scanned IS NULL) AS failed FROM (SELECT d.doc_id, coalesce(m >= saved_at, false) AS skip FROM documents d LEFT JOIN (SELECT doc_id, max(extracted_at) AS m FROM cite_occ GROUP BY 1) USING (doc_id)) LEFT JOIN ({SCANS}) USING (doc_id)",
    "pii_file_kinds": f"SELECT path, CASE WHEN x IN ('.pdf', '.caj', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.png', '.jpg', '.jpeg', '.gif', '.zip', '.7z', '.rar', '.pyc', '.exe', '.dll') THEN 'binary' WHEN x IN ('.md', '.markdown', '.txt', '.py', '.json', '.yml', '.yaml', '.toml', '.ini', '.cfg', '.html', '.htm', '.js', '.ts', '.css', '.sh', '.bat', '.ps1', '.csv', '.tsv', '') THEN 'text' ELSE 'other' END AS kind FROM (SELECT path, lower(regexp_extract(path, '[^./\\\\](\\.[^./\\\\]*)$', 1)) AS x FROM ({PATHS}))",
    "bib_missing_pages": f"SELECT id, p = '' AS no_pages, j = '' AS no_journal FROM ({FORMAT}) WHERE code = 'J' AND (p = '' OR j = '')",
    "abstract_split": f"SELECT doc_id, md5(abstract) AS digest, length(rest) AS rest_chars FROM ({ABSTRACT})",
    "lexicon_hits": seeds.sql(f"WITH cl AS MATERIALIZED ({CLEAN}) {LEXICON}"),
    "lexicon_density": seeds.sql(f"{DENSITY} WHERE total >= 3"),
    "vague_attribution": seeds.sql(VAGUE),
    "inflation_hits": seeds.sql(INFLATION),
    "self_reference": SELF,
    "heading_system": HEADS,
    "punct_profile": PUNCT,
    "uniformity": f"SELECT doc_id, paragraphs, round(mean, 6) AS mean, round(sd, 6) AS sd, round(cv, 6) AS cv FROM ({UNIFORM})",
    "trace_verdict": VERDICT,
    "fix_double_quotes": seeds.sql(fixed(DOUBLE)),
    "fix_ellipsis": seeds.sql(fixed(sub("text", r"\.{3,}|。{2,}", "……"))),
    "fix_cjk_punct": fixed(_wide_marks("text")),
    "fix_year_range": fixed(sub("text", rf"([0-9]{{4}})[{R.WS}]*[—–][{R.WS}]*([0-9]{{4}})", r"\1-\2")),
    "pii_institutions": seeds.sql(INSTITUTIONS),
    "pii_terms": f"WITH l AS ({lines()}) SELECT * FROM ({TERMS}) WHERE hits > 0",
    "pii_file_hygiene": f"SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(pdf|caj)$') THEN '高' ELSE '中' END AS severity FROM ({PATHS}) WHERE regexp_matches(lower(path), '\\.(pdf|caj|doc|docx)$')",
    "incremental_skip": "SELECT d.doc_id::VARCHAR AS path, coalesce(m >= saved_at, false) AS skip FROM documents d LEFT JOIN (SELECT doc_id, max(extracted_at) AS m FROM cite_occ GROUP BY 1) USING (doc_id)",
}
