"""DuckDB SQL for the registered queries.

Written apart from the operators: lines are rows and extents come from joins,
where the operators fold over arrays. Only rule lists and fixed values are shared.
"""

from __future__ import annotations

import json

from codesieve.functions import text
from codesieve.operators import history, patches, stubs
from codesieve.operators.guard import OPENERS
from codesieve.operators.rules import CONTENT, GUARD, POLICY, SECURITY, SEVERITIES, WEIGHTS, Rule
from codesieve.sources import corpus, responses
from codesieve.sources.corpus import quoted as q

NL = "chr(10)"


def _with(body: str, **tables: str) -> str:
    parts = [f"source_files AS ({corpus.SOURCE_FILES})"] + [f"{n} AS ({t})" for n, t in tables.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _newlines(c: str) -> str:
    return f"(len({c}) - len(replace({c}, {NL}, '')))"


def _code_for(rule: Rule) -> tuple[str, str]:
    """(text, pattern) without a lookahead: excluded hosts are renamed first."""
    if rule.rule_id == "SEC009":
        return r"regexp_replace(code, 'http://(localhost|127\.|0\.0\.0\.0)', 'hxxp://\1', 'g')", "'http://'"
    return "code", q(rule.pattern)


def _lines_of(code: str) -> str:
    body = f"rtrim({code}, {NL})"
    return f"CASE WHEN {code} = '' THEN 1 WHEN {body} = '' THEN 0 ELSE {_newlines(body)} + 1 END"


_SCANNER = """CASE WHEN contains(code, 'def ') OR (contains(code, 'import ') AND contains(code, ':')) THEN 'Python'
  WHEN contains(code, 'const ') OR contains(code, 'let ') OR contains(code, '=>') THEN 'JavaScript/TypeScript'
  WHEN contains(code, 'public class') OR contains(code, 'void main') THEN 'Java' ELSE 'Unknown' END"""

_CONTENT_LANGUAGE = """CASE WHEN contains(code, 'package ') AND contains(code, 'import android.') THEN 'java_android'
  WHEN contains(code, 'package ') AND contains(code, 'public class ') THEN 'java'
  WHEN contains(code, 'import React') OR contains(code, 'useState') THEN 'jsx'
  WHEN contains(code, 'def ') AND contains(code, 'import ') THEN 'python'
  WHEN contains(code, 'function ') OR contains(code, 'const ') OR contains(code, '=>') THEN 'javascript'
  WHEN contains(code, '<?php') THEN 'php' WHEN contains(code, '#include') THEN 'cpp' ELSE 'unknown' END"""


def _guard_language(code: str, path: str | None) -> str:
    t = f"lower(trim({code}, ' ' || chr(9) || chr(10) || chr(13)))"

    def has(*parts: str) -> str:
        return "(" + " OR ".join(f"contains({t}, {q(p)})" for p in parts) + ")"

    by_path = ""
    if path:
        by_path = " ".join(
            f"WHEN regexp_matches(lower({path}), '({'|'.join(e[1:] for e in ends)})$') AND regexp_matches(lower({path}), '[.]({'|'.join(e[1:] for e in ends)})$') THEN '{lang}'"
            for lang, ends in text.GUARD_EXTENSIONS
        )
    return f"""CASE {by_path} WHEN {t} = '' THEN 'UNKNOWN'
      WHEN starts_with({t}, '<!doctype html') OR {has('<html', '<body')} THEN 'HTML'
      WHEN starts_with({t}, 'import ') AND NOT {has(';')} THEN 'PYTHON'
      WHEN {has('def ')} AND {has(':')} AND NOT {has('{')} THEN 'PYTHON'
      WHEN {has('print(', 'if __name__ ==', 'except ', 'elif ')} THEN 'PYTHON'
      WHEN {has('public class', 'private class', 'system.out.println', '@override', 'extends ', 'implements ', 'package ')} THEN 'JAVA'
      WHEN {has('const ', 'let ', 'var ')} AND {has('document.', 'window.', 'console.', '=>', 'function ')} THEN 'JAVASCRIPT'
      WHEN {has('function ')} AND {has('=>', 'document.getelement')} THEN 'JAVASCRIPT'
      WHEN {has('fun ', 'val ', 'companion object', 'data class')} OR ({has('var ')} AND {has(':')}) THEN 'KOTLIN'
      ELSE 'UNKNOWN' END"""


def _rule_values(rule: Rule, order: int) -> str:
    rank = SEVERITIES.index(rule.severity) if rule.severity else 0
    return (
        f"{q(rule.rule_id)} AS rule_id, CAST({order} AS BIGINT) AS rule_ord, {q(rule.severity)} AS severity, CAST({rank} AS BIGINT) AS sev_rank, "
        f"{q(rule.category)} AS category, {str(rule.critical).lower()} AS critical"
    )


def _snippet(code: str, ln: str) -> str:
    return f"substr(trim(string_split({code}, {NL})[{ln}]), 1, 120)"


def _first(rules, source: str = "source_files", keep: str = "file_id") -> str:
    parts = []
    for k, rule in enumerate(rules):
        code, pattern = _code_for(rule)
        parts.append(
            f"""SELECT {keep}, {_rule_values(rule, k)}, CAST({_newlines('p')} + 1 AS BIGINT) AS ln,
  {_snippet('code', _newlines('p') + ' + 1')} AS snippet, substr(h, 1, 100) AS evidence
FROM (SELECT {keep}, code, string_split_regex(t, {pattern})[1] AS p, regexp_extract(t, {pattern}) AS h
      FROM (SELECT {keep}, code, {code} AS t FROM {source}) WHERE regexp_matches(t, {pattern}))"""
        )
    return "\nUNION ALL\n".join(parts)


def _all(rules, source: str = "source_files") -> str:
    parts = []
    for k, rule in enumerate(rules):
        code, pattern = _code_for(rule)
        skip = f"AND NOT ({_CONTENT_LANGUAGE}) IN ({', '.join(map(q, rule.skip))})" if rule.skip else ""
        parts.append(
            f"""SELECT file_id, {_rule_values(rule, k)}, CAST(i AS BIGINT) AS hit_no, CAST({_newlines('p')} + 1 AS BIGINT) AS ln, substr(h, 1, 100) AS evidence,
  (contains(c, '//') OR starts_with(trim(c), '#') OR (len(c) - len(replace(c, '"', ''))) % 2 = 1) AS in_comment,
  {_snippet('code', _newlines('p') + ' + 1')} AS snippet
FROM (SELECT *, string_split(p, {NL})[-1] AS c FROM (
  SELECT file_id, code, i, hits[i] AS h, substr(t, 1, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x)))
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS BIGINT)) AS p
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT file_id, code, t, string_split_regex(t, {pattern}) AS pieces, regexp_extract_all(t, {pattern}, 0) AS hits
    FROM (SELECT file_id, code, {code} AS t FROM {source}) WHERE regexp_matches(t, {pattern}) {skip}))))"""
        )
    return "\nUNION ALL\n".join(parts)


def _sum_rules(rules, value) -> str:
    terms = []
    for rule in rules:
        code, pattern = _code_for(rule)
        terms.append(f"CASE WHEN regexp_matches({code}, {pattern}) THEN {value(rule)} ELSE 0 END")
    return " + ".join(terms)


_DEDUCTION = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())

_POLICY_ROWS = "\nUNION ALL\n".join(
    f"""SELECT file_id, {q(r.rule_id)} AS rule_id, {q(r.category)} AS category, {str(r.critical).lower()} AS critical,
  substr(regexp_extract(code, {q(r.pattern)}), 1, 80) AS evidence FROM source_files WHERE regexp_matches(code, {q(r.pattern)})"""
    for r in POLICY
)

_POLICY = f"""SELECT file_id, CAST(n AS BIGINT) AS n_violations, CAST(least(100, risk) AS BIGINT) AS risk_score,
  CASE WHEN c > 0 THEN 'BLOCKED' WHEN n > 0 THEN 'WARNING' ELSE 'ALLOWED' END AS verdict,
  CASE WHEN c > 0 THEN 'refused: critical violation' WHEN n > 0 THEN 'warning: needs review' ELSE 'clean' END AS summary
FROM (SELECT file_id, {_sum_rules(POLICY, lambda r: 1)} AS n, {_sum_rules(POLICY, lambda r: 40 if r.critical else 20)} AS risk,
        {_sum_rules([r for r in POLICY if r.critical], lambda r: 1)} AS c FROM source_files)"""

_CONTENT_FIRST = f"""SELECT file_id, rule_id, rule_ord, category, critical, hit_no, ln, evidence
FROM ({_all(CONTENT)}) WHERE NOT in_comment QUALIFY row_number() OVER (PARTITION BY file_id, rule_id ORDER BY hit_no) = 1"""

_CONTENT = f"""SELECT f.file_id, CAST(coalesce(n, 0) AS BIGINT) AS n_violations,
  CASE WHEN c THEN 'ILLEGAL' WHEN n > 0 THEN 'RESTRICTED' ELSE 'LEGAL' END AS verdict, coalesce(c, false) AS blocked,
  CASE WHEN c THEN 'refused: unlawful content' WHEN n > 0 THEN 'warning: restricted content' ELSE 'accepted' END AS message
FROM source_files f LEFT JOIN (SELECT file_id, count(*) AS n, bool_or(critical) AS c FROM ({_CONTENT_FIRST}) GROUP BY file_id) v USING (file_id)"""

#: Lines as rows, and Python extents by joins. A nested definition is dropped
#: where it lies at or before the greatest end of those above it.
_LINES = f"""SELECT file_id, ln, x, trim(x) AS t, len(x) - len(ltrim(x)) AS ind,
    ends_with(rtrim(regexp_replace(x, '#.*', '')), ':') AS colon, trim(x) <> '' AND NOT starts_with(trim(x), '#') AS live
  FROM (SELECT file_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS ln FROM (SELECT file_id, string_split(code, {NL}) AS a FROM source_files))"""
_SKIPPED = "('__init__', '__del__', '__repr__', '__str__', '__eq__', '__hash__')"
_EXTENTS = rf"""
  WITH d AS (SELECT file_id, ln, ind, trim(regexp_extract(t, '^(?:async )?def ([^(]*)\(', 1)) AS name FROM lines
             WHERE regexp_matches(t, '^(?:async )?def [^(]*\(')),
  s AS (SELECT d.file_id, d.ln, d.ind, d.name, min(l.ln) AS sig FROM d JOIN lines l ON l.file_id = d.file_id AND l.ln >= d.ln AND l.colon
        WHERE d.name NOT IN {_SKIPPED} GROUP BY ALL),
  b AS (SELECT s.*, min(l.ln) AS body FROM s LEFT JOIN lines l ON l.file_id = s.file_id AND l.ln > s.sig AND l.live AND NOT starts_with(l.t, '\"\"\"')
        GROUP BY ALL),
  e AS (SELECT b.*, min(l.ln) AS dedent FROM b LEFT JOIN lines l ON l.file_id = b.file_id AND l.ln >= b.body AND l.live AND l.ind <= b.ind GROUP BY ALL),
  z AS (SELECT file_id, max(ln) FILTER (live) AS last_ln, max(ln) AS n FROM lines GROUP BY file_id),
  f AS (SELECT e.file_id, e.name, e.ln AS def_ln, e.sig AS sig_ln, coalesce(e.body, z.n + 1) AS body_ln, e.ind AS base,
          CASE WHEN e.body IS NULL THEN e.sig ELSE coalesce(e.dedent - 1, z.last_ln) END AS end_ln FROM e JOIN z USING (file_id)),
  v AS (SELECT *, max(end_ln) OVER (PARTITION BY file_id ORDER BY def_ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
  SELECT v.file_id, v.name, v.def_ln, v.sig_ln, v.body_ln, v.end_ln, v.base, CASE WHEN v.body_ln <= v.end_ln THEN l.t END AS first
  FROM v LEFT JOIN lines l ON l.file_id = v.file_id AND l.ln = v.body_ln WHERE before IS NULL OR def_ln > before""".replace('\\"', '"')
_RETURNS = r"""^return\s+(?:0|0\.0|\[\]|\{\}|None|False|""|''|"{3}.*"{3}|'{3}.*'{3})\s*$"""
_PY_STUBS = f"""SELECT *, CASE WHEN first IS NULL OR first IN ('pass', '...', 'Ellipsis') OR starts_with(first, 'raise NotImplementedError') THEN 'CONFIRMED'
      WHEN regexp_matches(first, {q(_RETURNS)}) THEN 'SUSPICIOUS' END AS risk,
    CASE WHEN first IS NULL THEN 'empty body' WHEN first IN ('pass', '...', 'Ellipsis') THEN 'placeholder'
      WHEN starts_with(first, 'raise NotImplementedError') THEN 'raises not implemented' ELSE 'returns empty value' END AS reason
  FROM extents WHERE risk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY def_ln) = 1"""
_JS = r"""(?:^|\n)[ ]*(?:(?:async\s+)?function\s+\w+\s*\([^{}]*\)\s*|(?:const|let|var)\s+\w+\s*=[^{};\n]*)\{\s*(?:return\s*(?:null|undefined|false|0|''|"")?\s*;?)?\s*\}"""
_JS_STUBS = rf"""SELECT file_id, name, header, ln, ln + {_newlines('m')} AS end_ln FROM (
    SELECT *, CASE WHEN starts_with(h, {NL}) THEN 1 ELSE 0 END AS lead, ltrim(h, {NL}) AS m, {_newlines('p')} + 1 + lead AS ln,
      regexp_extract(h, '(?:function|const|let|var)\s+(\w+)', 1) AS name, substr(trim(string_split(ltrim(h, {NL}), {NL})[1]), 1, 80) AS header
    FROM (SELECT file_id, hits[i] AS h, substr(code, 1, CAST(list_sum(list_transform(pieces[1:i], lambda x: len(x)))
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS BIGINT)) AS p
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT file_id, code, string_split_regex(code, {q(_JS)}) AS pieces, regexp_extract_all(code, {q(_JS)}, 0) AS hits FROM source_files))))
  QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY ln) = 1"""
_STUBS = """SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY js, risk, def_ln) - 1 AS pos, name, language, def_ln, start_ln, end_ln, base, risk,
      reason, snippet, single_line FROM (
    SELECT file_id, 0 AS js, name, 'python' AS language, def_ln, body_ln AS start_ln, end_ln, base, risk, reason, coalesce(first, '') AS snippet,
      sig_ln > def_ln AS single_line FROM py
    UNION ALL
    SELECT file_id, 1, name, 'javascript', ln, ln, end_ln, 0, 'CONFIRMED', 'empty function', header, false FROM js
    WHERE (file_id, name) NOT IN (SELECT file_id, name FROM py))"""
_STUB_TABLES = {"lines": _LINES, "extents": _EXTENTS, "py": _PY_STUBS, "js": _JS_STUBS, "stubs": _STUBS}


def _proposal(name: str, params: str) -> str:
    n = f"lower({name})"

    def filled(t: str) -> str:
        return f"replace(replace(replace({q(t)}, '<1>', coalesce({params}[1], 'value')), '<2>', coalesce({params}[2], 'items')), '<0>', {name})"

    cases = []
    for every, some, prefixes, t, _ in stubs.PROPOSALS:
        tests = [f"contains({n}, {q(p)})" for p in every]
        if some:
            tests.append("(" + " OR ".join(f"contains({n}, {q(p)})" for p in some) + ")")
        if prefixes:
            tests.append("(" + " OR ".join(f"starts_with({n}, {q(p)})" for p in prefixes) + ")")
        cases.append((" AND ".join(tests), t))
    return "CASE " + " ".join(f"WHEN {c} THEN {filled(t)}" for c, t in cases) + f" ELSE {filled(stubs.NO_PROPOSAL)} END"


def _proposal_import(name: str) -> str:
    cases = []
    for every, some, prefixes, _, needs in stubs.PROPOSALS:
        tests = [f"contains(lower({name}), {q(p)})" for p in every]
        if some:
            tests.append("(" + " OR ".join(f"contains(lower({name}), {q(p)})" for p in some) + ")")
        if prefixes:
            tests.append("(" + " OR ".join(f"starts_with(lower({name}), {q(p)})" for p in prefixes) + ")")
        cases.append(f"WHEN {' AND '.join(tests)} THEN {q(needs) if needs else 'NULL'}")
    return "CASE " + " ".join(cases) + " END"


def _params(raw: str) -> str:
    """Parameter names of a raw list."""
    one = "trim(string_split(trim(string_split(x, ':')[1]), '=')[1])"
    return (
        f"list_filter(list_transform(string_split(regexp_replace({raw}, '\\s+', ' ', 'g'), ','), lambda x: {one}), "
        "lambda y: y NOT IN ('self', 'cls', ''))"
    )


_PROPOSALS = f"""SELECT s.*, CASE WHEN language = 'python' THEN {_proposal('name', 'params')} ELSE '// TODO: implement ' || name END AS suggestion,
    CASE WHEN language = 'python' THEN {_proposal_import('name')} END AS required_import
  FROM (SELECT s.*, {_params("coalesce(raws[list_position(names, name)], '')")} AS params
        FROM stubs s JOIN (SELECT file_id, regexp_extract_all(code, 'def (\\w+)\\(([^)]*)\\)', 1) AS names,
                             regexp_extract_all(code, 'def (\\w+)\\(([^)]*)\\)', 2) AS raws FROM source_files) p USING (file_id)) s"""

_DEF = r"def\s+(\w+)\s*\(([^)]*)\)"
_PARAM_ROWS = f"""SELECT file_id, name, {_params('raw')} AS params FROM (
    SELECT file_id, unnest(regexp_extract_all(code, '{_DEF}', 1)) AS name, unnest(regexp_extract_all(code, '{_DEF}', 2)) AS raw,
      unnest(range(len(regexp_extract_all(code, '{_DEF}', 1)))) AS i FROM source_files)
  QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY i DESC) = 1"""
_BODIES = rf"""
  WITH d AS (SELECT file_id, ln, ind, regexp_extract(x, '^\s*def\s+(\w+)\s*\(', 1) AS name FROM lines WHERE regexp_matches(x, '^\s*def\s+\w+\s*\(')
             QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY ln) = 1),
  e AS (SELECT d.*, min(l.ln) AS stop FROM d LEFT JOIN lines l ON l.file_id = d.file_id AND l.ln > d.ln AND l.live AND l.ind <= d.ind GROUP BY ALL),
  z AS (SELECT file_id, {_lines_of('code')} AS n FROM source_files)
  SELECT e.file_id, e.name, string_agg(l.x, {NL} ORDER BY l.ln) || {NL} AS body
  FROM e JOIN z USING (file_id) JOIN lines l ON l.file_id = e.file_id AND l.ln BETWEEN e.ln AND coalesce(e.stop - 1, z.n) GROUP BY ALL"""


def _confidence(kind: str) -> str:
    terms = []
    for k, w, texts in stubs.CLUES:
        if k == kind:
            tests = " OR ".join(f"contains(scope, {q(t.split('<p>')[0])} || param || {q(t.split('<p>')[1])})" for t in texts)
            terms.append(f"CASE WHEN {tests} THEN CAST({w} AS DOUBLE) ELSE 0 END")
    return "round(" + " + ".join(terms) + ", 2)"


_TYPES = f"""SELECT file_id, name, param, dict, list, string, number,
    CASE WHEN greatest(dict, list, string, number) <= 0.15 THEN 'unknown' WHEN dict >= greatest(list, string, number) THEN 'dict'
      WHEN list >= greatest(string, number) THEN 'list' WHEN string >= number THEN 'string' ELSE 'number' END AS dominant
  FROM (SELECT file_id, name, param, {', '.join(_confidence(t) + ' AS ' + t for t in stubs.TYPES)}
        FROM (SELECT p.file_id, p.name, p.params[1] AS param, coalesce(b.body, f.code) AS scope
              FROM params p LEFT JOIN bodies b USING (file_id, name) JOIN source_files f USING (file_id) WHERE len(p.params) > 0))"""


_STRINGS = r'"(?:\\.|[^"\\\n])*"' + "|" + r"'(?:\\.|[^'\\\n])*'"
_COMMENTS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
#: Closed strings and comments; this engine needs no stack, so plain choices do.
_NOISE = {
    "PYTHON": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + _STRINGS + r"|#[^\n]*",
    "JAVASCRIPT": _STRINGS + r"|`(?:\\.|[^`\\])*`|" + _COMMENTS,
    "JAVA": _STRINGS + "|" + _COMMENTS,
    "HTML": r"<!--[\s\S]*?(?:-->|\z)",
    "UNKNOWN": _STRINGS,
}


def _balanced(code: str, language: str) -> str:
    def clean(kind: str) -> str:
        return f"regexp_replace({code}, {q(_NOISE[kind])}, '', 'g')"

    text_ = (
        f"CASE WHEN {language} = 'PYTHON' THEN {clean('PYTHON')} WHEN {language} = 'JAVASCRIPT' THEN {clean('JAVASCRIPT')} "
        f"WHEN {language} IN ('JAVA', 'KOTLIN') THEN {clean('JAVA')} WHEN {language} = 'HTML' THEN {clean('HTML')} ELSE {clean('UNKNOWN')} END"
    )

    def kind(o: str, c: str) -> str:
        tokens = f"list_transform(regexp_extract_all(w, '[\\{o}\\{c}]', 0), lambda x: CASE WHEN x = '{o}' THEN 1 ELSE -1 END)"
        return (
            f"(coalesce(list_sum({tokens}), 0) = 0 AND coalesce(list_min(list_transform(range(1, len({tokens}) + 1), "
            f"lambda i: list_sum(({tokens})[1:i]))), 0) >= 0)"
        )

    return (
        f"list_transform([{text_}], lambda w: {kind('(', ')')} AND {kind('[', ']')} AND {kind('{', '}')} "
        f"AND NOT ((contains(w, '\"') OR contains(w, '''') OR (contains(w, '`') AND {language} = 'JAVASCRIPT')) AND {language} <> 'HTML'))[1]"
    )


#: Files with a statement after a block opener that is not deeper.
_BAD_INDENT = f"""SELECT DISTINCT file_id FROM (SELECT file_id, t, ind, lag(t) OVER w AS bt, lag(ind) OVER w AS bi FROM lines WHERE live
    WINDOW w AS (PARTITION BY file_id ORDER BY ln))
  WHERE ends_with(bt, ':') AND ({' OR '.join(f"starts_with(bt, {q(o)})" for o in OPENERS)}) AND ind <= bi
    AND NOT starts_with(t, 'def ') AND NOT starts_with(t, 'class ')"""


def _guard_checks(source: str, code: str, id_: str = "file_id", indent: str | None = "bad_indent") -> str:
    """One row per check of ``source`` (id, code, lang)."""
    parts = [f"SELECT {id_}, 1 AS ord, 'AI001' AS check_id, true AS passed, false AS critical, 'scope: no original to compare' AS details FROM {source}"]
    parts.append(f"SELECT {id_}, 4, 'AI010', {_balanced(code, 'lang')}, true, 'brackets and strings' FROM {source}")
    if indent:
        parts.append(f"SELECT {id_}, 5, 'AI010b', {id_} NOT IN (SELECT {id_} FROM {indent}), false, 'indentation' FROM {source} WHERE lang = 'PYTHON'")
    order = 100
    for languages, rules in GUARD.items():
        for r in rules:
            order += 1
            parts.append(
                f"SELECT {id_}, {order}, {q(r.rule_id)}, NOT regexp_matches({code}, {q(r.pattern)}), {str(r.critical).lower()}, {q(r.category)} "
                f"FROM {source} WHERE lang IN ({', '.join(map(q, languages))})"
            )
    return "\nUNION ALL\n".join(parts)


def _guard_report(checks: str, id_: str = "file_id") -> str:
    return f"""SELECT {id_}, n_checks, safety_score, verdict, blocked_reason, verdict <> 'BLOCKED' AS can_proceed,
    CASE verdict WHEN 'BLOCKED' THEN 'do not apply' WHEN 'WARNING' THEN 'review before applying' ELSE 'safe to apply' END AS recommendation
  FROM (SELECT *, CASE WHEN bad > 0 THEN 'BLOCKED' WHEN safety_score < 100 THEN 'WARNING' ELSE 'SAFE' END AS verdict FROM (
    SELECT {id_}, count(*) AS n_checks, CAST(round(count(*) FILTER (passed) * 100.0 / count(*)) AS BIGINT) AS safety_score,
      count(*) FILTER (NOT passed AND critical) AS bad,
      string_agg(check_id || ': ' || details, ' | ' ORDER BY ord) FILTER (NOT passed AND critical) AS blocked_reason
    FROM ({checks}) GROUP BY {id_}))"""


_CODED = f"SELECT file_id, code, {_guard_language('code', 'path')} AS lang FROM source_files"


def _signatures(code: str, language: str) -> str:
    t = "trim(x)"
    return f"""list_distinct(list_filter(list_transform(string_split({code}, {NL}), lambda x:
      CASE WHEN {language} = 'PYTHON' THEN CASE WHEN regexp_matches({t}, '^(async )?def ') AND contains(x, ':') THEN trim(string_split({t}, ':')[1]) END
           WHEN {language} IN ('JAVA', 'KOTLIN') THEN CASE WHEN contains(x, '(') AND contains(x, ')') THEN regexp_replace({t}, '\\s+', ' ', 'g') END
           WHEN {language} = 'JAVASCRIPT' THEN CASE WHEN contains(x, 'function') OR contains(x, '=>') THEN regexp_replace({t}, '\\s+', ' ', 'g') END END),
      lambda s: s IS NOT NULL))"""


_VERSIONED = f"SELECT *, {_guard_language('modified', 'path')} AS lang FROM ({corpus.FILE_VERSIONS})"
_LOST = f"""SELECT file_id, unnest(list_filter(o, lambda s: NOT list_contains(m, s))) AS signature FROM (
    SELECT file_id, {_signatures('original', 'lang')} AS o, {_signatures('modified', 'lang')} AS m FROM versioned WHERE original IS NOT NULL)"""


def _signature_of(code: str) -> str:
    python = "'(?i)def\\s+' || function_name || '\\s*\\([^)]*\\)\\s*(?:->\\s*[^:]*)?:'"
    script = (
        "'(?i)(?:function\\s+' || function_name || '|' || function_name || "
        "'\\s*=\\s*(?:function|\\([^)]*\\)\\s*=>|async\\s*\\([^)]*\\)\\s*=>))\\s*\\(?[^)]*\\)?\\s*\\{?'"
    )
    java = (
        "'(?i)(?:public|private|protected|static|final|abstract|synchronized|\\s)*\\s*(?:<[^>]+>\\s*)?(?:[\\w<>\\[\\]]+\\s+)?' || function_name || "
        "'\\s*\\([^)]*\\)\\s*(?:throws\\s+[\\w,\\s]+)?\\s*\\{?'"
    )
    pattern = f"CASE lang WHEN 'PYTHON' THEN {python} WHEN 'JAVASCRIPT' THEN {script} WHEN 'JAVA' THEN {java} WHEN 'KOTLIN' THEN {java} END"
    return f"nullif(regexp_replace(trim(regexp_extract({code}, {pattern})), '\\s+', ' ', 'g'), '')"


_COMPARE_CHECKS = f"""
  SELECT file_id, 1 AS ord, 'AI001' AS check_id, o[1:h] = m[1:h] AND tail <= len(m) AND o[len(o) - tail + 1:] = m[len(m) - tail + 1:] AS passed,
    true AS critical, 'change outside the range' AS details
  FROM (SELECT *, least(start_line - 1, len(o), len(m)) AS h, greatest(len(o) - end_line, 0) AS tail FROM (
    SELECT file_id, start_line, end_line, string_split(original, {NL}) AS o, string_split(modified, {NL}) AS m FROM versioned WHERE original IS NOT NULL))
  UNION ALL
  SELECT file_id, 2, 'AI012', file_id NOT IN (SELECT file_id FROM lost), file_id IN (SELECT file_id FROM lost), 'signatures lost' FROM versioned WHERE original IS NOT NULL
  UNION ALL
  SELECT file_id, 3, 'AI011', coalesce({_signature_of('original')} = {_signature_of('modified')}, false),
    NOT coalesce({_signature_of('original')} = {_signature_of('modified')}, false), 'signature of the function' FROM versioned WHERE original IS NOT NULL
  UNION ALL
  SELECT * FROM ({_guard_checks('versioned', 'modified')}) WHERE check_id <> 'AI001'
  UNION ALL
  SELECT file_id, 1, 'AI001', true, false, 'scope: no original to compare' FROM versioned WHERE original IS NULL"""
_MODIFIED_LINES = _LINES.replace("code, chr(10)) AS a FROM source_files", "modified, chr(10)) AS a FROM versioned")

_TOTAL = f"({_newlines('code')} + 1)"
_FAKE = " OR ".join(f"contains(lower(after), {q(m)})" for m in patches.FAKE_MARKERS)
_VALIDATED = f"""SELECT file_id, patch_no, function_name,
    CASE WHEN so_far IS NOT NULL THEN so_far WHEN turn > 1 THEN 'same body as an earlier patch' END AS reject_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, body, so_far IS NULL ORDER BY patch_no) AS turn FROM (
    SELECT p.file_id, p.patch_no, p.function_name, regexp_replace(trim(after, ' ' || {NL}), '\\s+', ' ', 'g') AS body,
      CASE WHEN trim(before) = '' THEN 'empty before' WHEN trim(after) = '' THEN 'empty after'
        WHEN NOT contains(code, before) THEN 'before is not in the file'
        WHEN NOT EXISTS (SELECT 1 FROM stubs s WHERE s.file_id = p.file_id AND s.name = p.function_name) THEN 'function is no candidate'
        WHEN start_line < 0 OR end_line < 0 OR start_line > end_line OR end_line > {_TOTAL} THEN 'bad line range'
        WHEN len(list_filter(string_split(after, {NL}), lambda x: (starts_with(trim(x), 'import ') OR starts_with(trim(x), 'using ')) AND NOT contains(code, trim(x)))) > 0
          THEN 'unauthorised import'
        WHEN {_FAKE} OR len(list_filter(string_split(trim(after, ' ' || {NL}), {NL}), lambda x: NOT (trim(x) IN ('', 'pass')
          OR regexp_matches(trim(x), '^(def |public |private |[{{]|[}}])')))) = 0 THEN 'fake implementation' END AS so_far
    FROM patches p JOIN source_files f USING (file_id)))"""
_DIFF = f"""SELECT file_id, patch_no, CASE WHEN NOT contains(code, before) THEN 'no diff: the text before is not in the file' ELSE
    array_to_string(list_concat(['--- ' || function_name, '+++ ' || function_name || ' (modified)',
      '@@ -' || start_line || ',' || (end_line - start_line) || ' +' || start_line || ',? @@'],
      list_transform(range(greatest(0, start_line - 3), least(len(a), end_line + 3)), lambda i:
        CASE WHEN i >= start_line AND i < end_line THEN '- ' ELSE '  ' END || a[i + 1]),
      ['--- change ---'], list_transform(string_split(after, {NL}), lambda x: '+ ' || x)), {NL}) END AS diff
  FROM (SELECT p.*, code, string_split(rtrim(code, {NL}), {NL}) AS a FROM patches p JOIN source_files USING (file_id))"""
_APPLIED = f"""
  WITH e AS (SELECT file_id, start_ln AS ln, array_to_string(list_transform(string_split(suggestion, {NL}), lambda x: repeat(' ', CAST(base + 4 AS BIGINT)) || substr(x, 5)), {NL}) AS txt
             FROM proposals WHERE language = 'python')
  SELECT l.file_id, string_agg(coalesce(e.txt, l.x), {NL} ORDER BY l.ln) AS new_code, count(e.txt) AS n_applied
  FROM lines l LEFT JOIN e USING (file_id, ln) WHERE l.file_id IN (SELECT file_id FROM e) GROUP BY l.file_id"""

_REFINED = """SELECT p.*, CASE WHEN t.dominant = 'dict' AND contains(p.suggestion, 'sum(' || t.param || ')')
      THEN replace(p.suggestion, 'sum(' || t.param || ')', 'sum(x.get(''value'', x.get(''price'', x.get(''amount'', 0))) for x in ' || t.param || ')')
      ELSE p.suggestion END AS refined, p.file_id || ':' || p.pos AS item
  FROM proposals p LEFT JOIN types t USING (file_id, name)"""
_ITEM_LINES = (
    f"""SELECT item, ln, x, trim(x) AS t, len(x) - len(ltrim(x)) AS ind, trim(x) <> '' AND NOT starts_with(trim(x), '#') AS live
  FROM (SELECT item, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS ln FROM (SELECT item, string_split(refined, {NL}) AS a FROM refined_items))"""
)
_WORKFLOW = """SELECT file_id, pos, function_name, CASE gate WHEN 'none' THEN 'AWAITING_APPROVAL' ELSE 'BLOCKED' END AS stage,
    CASE gate WHEN 'content' THEN 'blocked by content' WHEN 'policy' THEN 'policy violation' WHEN 'guard' THEN 'blocked by guard' ELSE 'waiting for approval' END AS label,
    CAST(CASE gate WHEN 'none' THEN 90 ELSE 100 END AS BIGINT) AS progress,
    CASE gate WHEN 'content' THEN message WHEN 'policy' THEN summary WHEN 'guard' THEN blocked_reason END AS blocked_reason,
    CASE WHEN gate IN ('guard', 'none') THEN refined END AS suggestion, CASE WHEN gate IN ('guard', 'none') THEN safety_score END AS safety_score,
    CASE WHEN gate = 'none' THEN 'Function "' || function_name || '()" is unfinished (' || reason || '). Safety score ' || safety_score
      || ' of 100. The proposal rests on the name and its context.' END AS explanation
  FROM (SELECT i.file_id, i.pos, i.name AS function_name, i.reason, i.refined, g.safety_score, g.blocked_reason, c.message, p.summary,
      CASE WHEN c.blocked THEN 'content' WHEN p.verdict = 'BLOCKED' THEN 'policy' WHEN g.verdict = 'BLOCKED' THEN 'guard' ELSE 'none' END AS gate
    FROM refined_items i JOIN guarded g USING (item) JOIN content c USING (file_id) JOIN policy p USING (file_id))"""

_TEXT_SECTIONS = f"""SELECT file_id, CAST(i - 1 AS BIGINT) AS section, trim(regexp_extract(s, 'FUNCTION:([^\\n]*)', 1)) AS function_name,
    trim(regexp_extract(s, '(?s)BEFORE:.*?```[^\\n]*\\n(.*?)(?:```|\\z)', 1), ' ' || {NL}) AS before,
    trim(regexp_extract(s, '(?s)AFTER:.*?```[^\\n]*\\n(.*?)(?:```|\\z)', 1), ' ' || {NL}) AS after,
    trim(regexp_extract(s, 'REASON:([^\\n]*)', 1)) AS explanation
  FROM (SELECT file_id, unnest(string_split(raw, '---')) AS s, unnest(range(1, len(string_split(raw, '---')) + 1)) AS i FROM ({corpus.TEXT_RESPONSES}))
  WHERE contains(s, 'FUNCTION:') AND contains(s, 'AFTER:')"""


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {default} END"


_FIXABILITY = (
    f"CASE WHEN regexp_matches(lower(name), '^({'|'.join(text.CLEAR_NAMES)})') THEN 'HIGH' "
    f"WHEN len(name) > 5 AND NOT regexp_matches(lower(name), '^({'|'.join(text.VAGUE_NAMES)})') THEN 'MEDIUM' ELSE 'LOW' END"
)
_INTENT = _case(
    [
        (" OR ".join([f"starts_with(lower(name), {q(p)})" for p in pre] + [f"contains(lower(name), {q(p)})" for p in parts]), q(what))
        for what, pre, parts in text.INTENTS
    ],
    "'unspecified'",
)

#: A def is reported once a line below it, at its indent plus four, begins with pass
#: or '...'; the next def is looked for behind that line. By joins and a recursive walk.
_REPORTED = rf"""
  WITH RECURSIVE d AS (SELECT file_id, ln, ind, regexp_extract(head, 'def\s+(\w+)', 1) AS name, {_newlines('head')} AS span FROM (
      SELECT file_id, ln, ind, regexp_extract(array_to_string(a[ln:], {NL}), '^\s*def\s+\w+\s*\([^)]*\).*:\s*\n') AS head
      FROM lines JOIN (SELECT file_id, string_split(code, {NL}) AS a FROM source_files) USING (file_id) WHERE regexp_matches(x, '^\s*def\s')) WHERE head <> ''),
  e AS (SELECT d.file_id, d.name, d.ln, min(l.ln) AS stop FROM d JOIN lines l ON l.file_id = d.file_id AND l.ln >= d.ln + d.span AND l.ind = d.ind + 4
      AND regexp_matches(l.t, '^(pass|[.][.][.])') GROUP BY ALL),
  w AS (SELECT file_id, name, ln, stop, 0 AS pos FROM e QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ln) = 1
    UNION ALL
    SELECT file_id, name, ln, stop, pos FROM (SELECT e.file_id, e.name, e.ln, e.stop, w.pos + 1 AS pos,
        row_number() OVER (PARTITION BY e.file_id ORDER BY e.ln) AS turn FROM w JOIN e ON e.file_id = w.file_id AND e.ln > w.stop) WHERE turn = 1)
  SELECT file_id, CAST(pos AS BIGINT) AS pos, name, {_FIXABILITY} AS fix FROM w"""


def _fix_text(part: int) -> str:
    return _case([(f"fix = {q(k)}", q(t[part]) if t[part] else "NULL") for k, t in text.FIX_TEXTS.items()], "NULL")


#: First line of a prompt, and what a request holds behind its contents.
_ASK = "Complete the unfinished functions of one file. Change nothing else, add no import that is not needed, and return no placeholder.\n"
_ENVELOPE = json.dumps(responses.ENVELOPE, separators=(",", ":"))[1:]

_VERSIONS, _SESSIONS = f"({corpus.VERSIONS})", f"({corpus.SESSIONS})"


#: (file_id, prompt) of the files with stubs.
_PROMPTS = f"""SELECT f.file_id, {q(_ASK)} || 'File: ' || path || {NL} || '```' || {NL} || code || {NL} || '```' || {NL} || coalesce(related, '') || listed
      || {NL} || 'Line numbers of fixes begin at 0.' || {NL} AS prompt
    FROM source_files f JOIN (SELECT file_id, string_agg({NL} || '--- Candidate #' || (pos + 1) || ' ---' || {NL} || 'Function: ' || name || {NL}
        || 'Lines: ' || start_ln || ' to ' || end_ln || {NL} || 'Code:' || {NL} || '```' || {NL} || array_to_string(a[def_ln:end_ln], {NL})
        || CASE WHEN end_ln >= def_ln THEN {NL} ELSE '' END || {NL} || '```', {NL} ORDER BY pos) AS listed
      FROM stubs JOIN (SELECT file_id, string_split(code, {NL}) AS a FROM source_files) USING (file_id) GROUP BY file_id) USING (file_id)
    LEFT JOIN (SELECT r.file_id, string_agg({NL} || 'Related file: ' || path || {NL} || '```' || {NL} || code || {NL} || '```', {NL} ORDER BY path) AS related
      FROM ({corpus.RELATED}) r JOIN source_files g ON g.file_id = r.related_id GROUP BY r.file_id) x ON x.file_id = f.file_id"""


def oracle_sql() -> dict[str, str]:
    out = {
        "scan_score": _with(
            f"""SELECT file_id, {_SCANNER} AS language, CAST({_lines_of('code')} AS BIGINT) AS scanned_lines,
  CAST({_sum_rules(SECURITY, lambda r: 1)} AS BIGINT) AS n_issues,
  CAST(greatest(0, 100 - ({_sum_rules(SECURITY, lambda r: WEIGHTS[r.severity])})) AS BIGINT) AS score FROM source_files"""
        ),
        "scan_first_match": _with(_first(SECURITY)),
        "scan_all_matches": _with(_all(SECURITY)),
        "issues_per_file": _with(
            f"""SELECT file_id, count(*) AS n_issues, string_agg(rule_id || '@' || ln, ',' ORDER BY sev_rank, rule_ord) AS issues,
  CAST(sum(CASE severity {_DEDUCTION} END) AS BIGINT) AS deduction FROM ({_first(SECURITY)}) GROUP BY file_id"""
        ),
        "policy_findings": _with(_POLICY_ROWS),
        "policy_verdict": _with(_POLICY),
        "content_findings": _with(_CONTENT_FIRST),
        "content_verdict": _with(_CONTENT),
        "corpus_rollup": _with(
            f"""SELECT repo, category, severity, CAST(grouping(repo, category, severity) AS BIGINT) AS level, count(*) AS n_findings,
  count(DISTINCT file_id) AS n_files FROM ({_first(SECURITY, keep='file_id, repo')}) GROUP BY ROLLUP (repo, category, severity)"""
        ),
        "language_flavours": _with(
            f"""SELECT file_id, {_SCANNER} AS scanner, {_guard_language('code', 'path')} AS guard, {_guard_language('code', None)} AS guard_by_content,
  {_CONTENT_LANGUAGE} AS content, CASE WHEN contains(code, 'def ') THEN 'Python' ELSE 'Unknown' END AS report FROM source_files"""
        ),
        "source_normalised": _with(
            f"""SELECT file_id, string_split(path, '/')[-1] AS name, 'fixed_' || string_split(path, '/')[-1] AS out_name,
  CAST({_lines_of('code')} AS BIGINT) AS lines, md5(code) AS digest
FROM (SELECT file_id, path, replace(replace(code, chr(13) || chr(10), {NL}), chr(13), {NL}) AS code FROM ({corpus.RAW_FILES}))
WHERE trim(code, ' ' || {NL} || chr(9)) <> ''"""
        ),
        "python_functions": _with("SELECT file_id, name, def_ln, sig_ln, body_ln, end_ln FROM extents", lines=_LINES, extents=_EXTENTS),
        "stub_detect": _with("SELECT * FROM stubs", **_STUB_TABLES),
        "stub_candidates": _with(
            f"""SELECT file_id, pos, name AS function_name,
  array_to_string(a[def_ln:end_ln], {NL}) || CASE WHEN end_ln >= def_ln THEN {NL} ELSE '' END AS code_snippet,
  array_to_string(list_transform(range(greatest(1, start_ln - 5), least(len(a), end_ln + 5) + 1), lambda i: printf('%4d | %s', i, a[i])), {NL}) || {NL} AS context,
  start_ln AS start_line, end_ln AS end_line
FROM stubs JOIN (SELECT file_id, string_split(code, {NL}) AS a FROM source_files) USING (file_id)""",
            **_STUB_TABLES,
        ),
        "suggestion_by_name": _with(
            "SELECT file_id, pos, name, suggestion, required_import FROM proposals", **_STUB_TABLES, proposals=_PROPOSALS
        ),
        "name_classes": _with(
            f"""SELECT name, count(*) AS n, {_FIXABILITY} AS fixability, {_INTENT} AS intent
FROM (SELECT unnest(regexp_extract_all(code, '{_DEF}', 1)) AS name FROM source_files) GROUP BY name"""
        ),
        "context_imports": _with(
            r"""SELECT file_id, CAST(i AS BIGINT) AS pos, trim(v) AS imported FROM (SELECT file_id, unnest(a) AS v, unnest(range(len(a))) AS i
FROM (SELECT file_id, regexp_extract_all(code, '(?m)^(?:import|from)\s+(.+)', 1) AS a FROM source_files))"""
        ),
        "context_classes": _with(
            r"""SELECT file_id, CAST(i AS BIGINT) AS pos, v AS class_name FROM (SELECT file_id, unnest(a) AS v, unnest(range(len(a))) AS i
FROM (SELECT file_id, regexp_extract_all(code, '(?m)^class\s+(\w+)', 1) AS a FROM source_files))"""
        ),
        "context_params": _with("SELECT file_id, name, array_to_string(params, ',') AS params FROM params", params=_PARAM_ROWS),
        "context_members": _with(
            r"""SELECT file_id, ln, regexp_extract(t, '^def (\w+)\(', 1) AS name, ind > 0 AND coalesce(starts_with(top, 'class '), false) AS in_class
FROM (SELECT *, last_value(CASE WHEN ind = 0 AND t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ln) AS top FROM lines)
WHERE regexp_matches(t, '^def \w+\(')""",
            lines=_LINES,
        ),
        "function_bodies": _with("SELECT * FROM bodies", lines=_LINES, bodies=_BODIES),
        "type_confidence": _with(_TYPES, lines=_LINES, bodies=_BODIES, params=_PARAM_ROWS),
        "signature_sets": _with(f"SELECT file_id, unnest({_signatures('code', 'lang')}) AS signature FROM coded", coded=_CODED),
        "bracket_balance": _with(f"SELECT file_id, {_balanced('code', 'lang')} AS balanced FROM coded", coded=_CODED),
        "indentation_check": _with(
            "SELECT file_id, file_id NOT IN (SELECT file_id FROM bad_indent) AS ok FROM source_files", lines=_LINES, bad_indent=_BAD_INDENT
        ),
        "guard_checks": _with(
            f"SELECT file_id, check_id, passed, critical, details FROM ({_guard_checks('coded', 'code')})", lines=_LINES, bad_indent=_BAD_INDENT, coded=_CODED
        ),
        "guard_checks_html": "\nUNION ALL\n".join(
            f"SELECT page_id AS file_id, {q(r.rule_id)} AS check_id, NOT regexp_matches(html, {q(r.pattern)}) AS passed, {str(r.critical).lower()} AS critical, "
            f"{q(r.category)} AS details FROM pages"
            for r in GUARD[("HTML",)]
        ),
        "guard_secret_docs": (
            "SELECT file_id AS doc_id, ln, evidence FROM ("
            + _first([r for r in GUARD[("JAVASCRIPT",)] if r.rule_id == "AI306"], source="(SELECT doc_id AS file_id, text AS code FROM documents)")
            + ")"
        ),
        "guard_verdict": _with(_guard_report(_guard_checks("coded", "code")), lines=_LINES, bad_indent=_BAD_INDENT, coded=_CODED),
        "guard_compare": _with(
            _guard_report(_COMPARE_CHECKS), versioned=_VERSIONED, lost=_LOST, lines=_MODIFIED_LINES, bad_indent=_BAD_INDENT
        ),
        "lost_signatures": _with("SELECT * FROM lost", versioned=_VERSIONED, lost=_LOST),
        "patch_validate": _with(_VALIDATED, **_STUB_TABLES, patches=corpus.PATCHES),
        "patch_counts": _with(
            f"""SELECT file_id, count(*) FILTER (reject_reason IS NULL) AS accepted, count(reject_reason) AS rejected FROM ({_VALIDATED}) GROUP BY file_id""",
            **_STUB_TABLES, patches=corpus.PATCHES,
        ),
        "patch_without_candidates": _with(
            """SELECT file_id, CAST(0 AS BIGINT) AS n_fixes, CAST(0 AS BIGINT) AS rejected FROM source_files
WHERE file_id NOT IN (SELECT file_id FROM stubs)""",
            **_STUB_TABLES,
        ),
        "patch_diff": _with(_DIFF, patches=corpus.PATCHES),
        "apply_change": _with(f"SELECT * FROM ({_APPLIED})", **_STUB_TABLES, proposals=_PROPOSALS),
        "workflow_stage": _with(
            _WORKFLOW, **_STUB_TABLES, proposals=_PROPOSALS, bodies=_BODIES, params=_PARAM_ROWS, types=_TYPES, refined_items=_REFINED,
            item_lines=_ITEM_LINES, item_bad=_BAD_INDENT.replace("file_id", "item").replace("FROM lines", "FROM item_lines"),
            item_coded=f"SELECT item, refined, {_guard_language('refined', None)} AS lang FROM refined_items",
            guarded=_guard_report(_guard_checks("item_coded", "refined", "item", "item_bad"), "item"), content=_CONTENT, policy=_POLICY,
        ),
        "workflow_name_proposals": _with(
            """SELECT file_id, pos, name AS function_name, snippet AS before, suggestion AS after, 'proposal by name: ' || reason AS explanation,
CAST(100 AS BIGINT) AS safety_score FROM proposals""",
            **_STUB_TABLES, proposals=_PROPOSALS,
        ),
        "history_current": f"""WITH v AS {_VERSIONS}, s AS {_SESSIONS},
r AS (SELECT session_id, max((ts, version_id)) AS restored FROM v WHERE is_restore GROUP BY 1),
a AS (SELECT session_id, after FROM v LEFT JOIN r USING (session_id) WHERE approved AND NOT is_restore AND (restored IS NULL OR (ts, version_id) > restored)
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) = 1)
SELECT session_id, coalesce(after, original_code) AS current_code, after IS NOT NULL AS changed FROM s LEFT JOIN a USING (session_id)""",
        "history_code_after_each": f"""WITH v AS {_VERSIONS}, s AS {_SESSIONS},
e AS (SELECT *, CAST(count(*) FILTER (is_restore) OVER (PARTITION BY session_id ORDER BY ts, version_id) AS BIGINT) AS epoch FROM v)
SELECT session_id, version_id, epoch, coalesce(last_value(CASE WHEN approved AND NOT is_restore THEN after END IGNORE NULLS)
  OVER (PARTITION BY session_id, epoch ORDER BY ts, version_id), original_code) AS current_code FROM e JOIN s USING (session_id)""",
        "history_retention": f"""SELECT session_id, version_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) AS age
FROM {_VERSIONS} QUALIFY age <= {history.MAX_VERSIONS}""",
        "history_newest_sessions": f"""SELECT session_id, n_versions FROM (SELECT session_id, count(*) AS n_versions, min(ts) AS c FROM {_VERSIONS} GROUP BY 1)
ORDER BY c DESC, session_id DESC LIMIT {history.MAX_SESSIONS}""",
        "history_counts": f"""SELECT session_id, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected,
round(avg(safety_score), 4) AS mean_score FROM {_VERSIONS} WHERE NOT is_restore GROUP BY 1""",
        "history_delete": f"""SELECT session_id, count(*) AS n FROM {_VERSIONS}
WHERE session_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""",
        "history_upsert": f"""SELECT session_id, function_name, version_id, approved FROM {_VERSIONS}
QUALIFY row_number() OVER (PARTITION BY session_id, function_name ORDER BY approved DESC, ts DESC, version_id DESC) = 1""",
        "history_document": f"""SELECT session_id, version_id, function_name, after, approved, safety_score FROM {_VERSIONS}
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) <= {history.MAX_VERSIONS}""",
        "review_counters": f"""SELECT session_id, version_id, count(*) OVER w AS position, count(*) FILTER (approved) OVER w AS approved_so_far,
count(*) FILTER (NOT approved) OVER w AS rejected_so_far FROM {_VERSIONS} WINDOW w AS (PARTITION BY session_id ORDER BY ts, version_id)""",
        "decision_replay": _with(
            f"""SELECT s.file_id, s.name AS function_name, s.risk, v.approved FROM stubs s
JOIN {_VERSIONS} v ON v.version_id = s.file_id AND s.name = 'is_ready_' || (v.version_id % 10)""",
            **_STUB_TABLES,
        ),
        "apply_decisions": _with(
            f"SELECT * FROM ({_APPLIED})",
            **_STUB_TABLES,
            all_proposals=_PROPOSALS,
            proposals=f"""SELECT p.* FROM all_proposals p
JOIN {_VERSIONS} v ON v.version_id = p.file_id AND p.name = 'is_ready_' || (v.version_id % 10) WHERE v.approved""",
        ),
        "history_record": f"""SELECT session_id, count(*) AS n, max(version_id) AS last FROM (SELECT * FROM {_VERSIONS}
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) <= {history.MAX_VERSIONS}) GROUP BY 1""",
        "history_increments": f"""WITH v AS {_VERSIONS}, s AS {_SESSIONS},
r AS (SELECT session_id, max((ts, version_id)) AS restored FROM v WHERE is_restore GROUP BY 1),
a AS (SELECT session_id, after FROM v LEFT JOIN r USING (session_id) WHERE approved AND NOT is_restore AND (restored IS NULL OR (ts, version_id) > restored)
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) = 1),
k AS (SELECT session_id, count(*) AS n, CAST(sum(version_id) AS BIGINT) AS id_sum FROM (SELECT * FROM v
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, version_id DESC) <= {history.MAX_VERSIONS}) GROUP BY 1)
SELECT session_id, coalesce(after, original_code) AS current_code, after IS NOT NULL AS changed, n, id_sum FROM s LEFT JOIN a USING (session_id) JOIN k USING (session_id)""",
        "stream_history": f"""WITH v AS {_VERSIONS}, s AS {_SESSIONS},
e AS (SELECT *, CAST(count(*) FILTER (is_restore) OVER (PARTITION BY session_id ORDER BY ts, version_id) AS BIGINT) AS epoch FROM v),
c AS (SELECT session_id, version_id, ts, epoch, coalesce(last_value(CASE WHEN approved AND NOT is_restore THEN after END IGNORE NULLS)
  OVER (PARTITION BY session_id, epoch ORDER BY ts, version_id), original_code) AS current_code FROM e JOIN s USING (session_id))
SELECT session_id, version_id, epoch, current_code FROM c
WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM v)""",
        "model_responses": """
SELECT o_orderkey AS file_id, CAST(0 AS BIGINT) AS fix_no, 'f' || (o_orderkey % 10) AS function_name, 'pass' AS before, 'return 1' AS after, 'r' AS reason,
  CAST(1 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line FROM orders WHERE o_orderkey % 5 = 0
UNION ALL
SELECT o_orderkey, 1, 'unknown', '', 'return 2', '', -1, -1 FROM orders WHERE o_orderkey % 5 = 0""",
        "text_responses": _TEXT_SECTIONS,
        "text_responses_guarded": f"""WITH t AS ({_TEXT_SECTIONS}), r AS ({corpus.TEXT_RESPONSES}),
coded AS (SELECT *, file_id || ':' || section AS item, {_guard_language('after', None)} AS lang FROM t),
g AS ({_guard_report(_guard_checks('coded', 'after', 'item', None), 'item')}),
kept AS (SELECT file_id, section, function_name, before, after, explanation, safety_score, false AS raw_view FROM coded JOIN g USING (item) WHERE can_proceed)
SELECT * FROM kept UNION ALL
SELECT file_id, 0, '', '', raw, '', 0, true FROM r WHERE file_id NOT IN (SELECT file_id FROM kept)""",
        "related_files": _with(
            f"SELECT r.file_id, path AS related_path, len(code) AS n_chars FROM ({corpus.RELATED}) r JOIN source_files f ON f.file_id = r.related_id"
        ),
        "prompt_rows": _with(
            f"""SELECT file_id, len(body) AS n_chars, md5(body) AS digest FROM (
  SELECT file_id, '{{"contents":[{{"role":"user","parts":[{{"text":' || to_json(prompt) || '}}]}}],' || {q(_ENVELOPE)} AS body FROM ({_PROMPTS}))""",
            **_STUB_TABLES,
        ),
        "prompt_parts": _with(
            f"SELECT file_id, CAST(0 AS BIGINT) AS part, len(prompt) AS n_chars, md5(prompt) AS digest FROM ({_PROMPTS})", **_STUB_TABLES
        ),
        "report_functions": _with(
            f"""SELECT file_id, pos, name, 'confirmed' AS risk, fix AS fixability, {_INTENT} AS intent, {_fix_text(0)} AS fix_reason,
  {_fix_text(1)} AS warning_note, {_fix_text(2)} AS signal, fix = 'HIGH' AS can_auto_fix FROM reported""",
            lines=_LINES, reported=_REPORTED,
        ),
        "report_summary": _with(
            f"""SELECT file_id, language, total_lines, n_stubs, high_fixable, medium_fixable, low_fixable,
  CASE WHEN n_stubs = 0 THEN 'no unfinished function found' ELSE n_stubs || ' unfinished functions: ' || high_fixable || ' clear, ' || medium_fixable
    || ' to review, ' || low_fixable || ' hard' END AS message,
  CASE WHEN n_stubs = 0 THEN 'the file looks complete' ELSE 'review each proposal before approval' END AS recommendation
FROM (SELECT f.file_id, CASE WHEN contains(code, 'def ') THEN 'Python' ELSE 'Unknown' END AS language, CAST({_lines_of('code')} AS BIGINT) AS total_lines,
    coalesce(n, 0) AS n_stubs, coalesce(high, 0) AS high_fixable, coalesce(medium, 0) AS medium_fixable, coalesce(low, 0) AS low_fixable
  FROM source_files f LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (fix = 'HIGH') AS high, count(*) FILTER (fix = 'MEDIUM') AS medium,
    count(*) FILTER (fix = 'LOW') AS low FROM reported GROUP BY file_id) USING (file_id))""",
            lines=_LINES, reported=_REPORTED,
        ),
        "conversation_prompts": f"""SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS part, count(*) AS n_turns,
md5(string_agg(role || ': ' || coalesce(text, ''), {NL} ORDER BY turn)) AS digest FROM conversations GROUP BY ALL""",
        "stream_decisions": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
count(*) FILTER (event_type IN ('purchase', 'signup', 'click')) AS approved,
count(*) FILTER (event_type NOT IN ('purchase', 'signup', 'click')) AS rejected FROM events GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    }
    out["function_totals"] = _with(
        r"""SELECT f.file_id, CAST(coalesce(n, 0) AS BIGINT) AS total_visited, CAST(len(regexp_extract_all(code, '(?m)^\s*def\s+\w+', 0)) AS BIGINT) AS total_def_lines
FROM source_files f LEFT JOIN (
  SELECT l.file_id, count(*) AS n FROM lines l WHERE regexp_matches(t, '^(async )?def ')
    AND NOT EXISTS (SELECT 1 FROM extents e WHERE e.file_id = l.file_id AND e.def_ln < l.ln AND l.ln <= e.end_ln) GROUP BY l.file_id) USING (file_id)""",
        lines=_LINES, extents=_EXTENTS,
    )
    out["stream_scan"] = out["scan_score"]
    out["scan_rule_table"] = out["scan_first_match"]
    return out
