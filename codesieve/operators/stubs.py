"""Unfinished functions, their context windows and a proposal by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import clean_params, let, one_by_name, split_lines
from codesieve.operators.copies import once_per_text
from codesieve.operators.functions import bodies_of, javascript_functions, params_of, python_functions

#: First statements that make a stub (fixed values).
PLACEHOLDERS = ("pass", "...", "Ellipsis")
RETURNS_EMPTY = r"""\Areturn\s+(?:0|0\.0|\[\]|\{\}|None|False|""|''|\"{3}.*\"{3}|'{3}.*'{3})\s*\z"""
JS_TRIVIAL = r"""\A(?:;?|return\s*;?|return\s+(?:undefined|null|false|0|''|"")\s*;?)\z"""
CONTEXT_LINES = 5


def _python_class(first: Column) -> Column:
    """struct(risk, reason), null for a complete function."""

    def verdict(risk: str, reason: str) -> Column:
        return F.struct(F.lit(risk).alias("risk"), F.lit(reason).alias("reason"))

    return (
        F.when(first.isNull(), verdict("CONFIRMED", "empty body"))
        .when(first.isin(*PLACEHOLDERS), verdict("CONFIRMED", "placeholder"))
        .when(first.startswith("raise NotImplementedError"), verdict("CONFIRMED", "raises not implemented"))
        .when(first.rlike(RETURNS_EMPTY), verdict("SUSPICIOUS", "returns empty value"))
    )


def stubs_of(code: Column) -> Column:
    """Stubs of a text as an array, Python's by risk and line, then JavaScript's.

    Fields: name, language, def_ln, start_ln (first body line), end_ln, base
    (indent), risk, reason, snippet, single_line (the signature ends on a later
    line because the definition is on one line). Of one name the first wins;
    JavaScript names that Python stubs have are dropped.
    """

    def python(f: Column) -> Column:
        c = _python_class(f["first"])
        return F.struct(
            f["name"].alias("name"), F.lit("python").alias("language"), f["def_ln"].alias("def_ln"), f["body_ln"].alias("start_ln"),
            f["end_ln"].alias("end_ln"), f["base"].alias("base"), c["risk"].alias("risk"), c["reason"].alias("reason"),
            F.coalesce(f["first"], F.lit("")).alias("snippet"), (f["sig_ln"] > f["def_ln"]).alias("single_line"),
        )

    def javascript(f: Column) -> Column:
        return F.struct(
            f["name"].alias("name"), F.lit("javascript").alias("language"), f["ln"].alias("def_ln"), f["ln"].alias("start_ln"),
            f["end_ln"].alias("end_ln"), F.lit(0).alias("base"), F.lit("CONFIRMED").alias("risk"), F.lit("empty function").alias("reason"),
            f["header"].alias("snippet"), F.lit(False).alias("single_line"),
        )

    def both(x: Column) -> Column:
        first = one_by_name(F.transform(F.filter(x["py"], lambda f: _python_class(f["first"]).isNotNull()), python), "def_ln")
        js = F.transform(F.filter(x["js"], lambda f: f["body"].rlike(JS_TRIVIAL)), javascript)

        def joined(py: Column) -> Column:
            new = let(F.transform(py, lambda p: p["name"]), lambda names: F.filter(js, lambda f: ~F.array_contains(names, f["name"])))
            sure = F.filter(py, lambda p: p["risk"] == "CONFIRMED")
            unsure = F.filter(py, lambda p: p["risk"] != "CONFIRMED")
            return F.concat(sure, unsure, one_by_name(new, "def_ln"))

        return let(first, joined)

    return let(F.struct(python_functions(code)["found"].alias("py"), javascript_functions(code).alias("js")), both)


def stubs(files: DataFrame) -> DataFrame:
    """One row per stub, in its order ``pos`` in the file. See ``stubs_of``."""
    found = F.posexplode(stubs_of(F.col("code"))).alias("pos", "s")
    return once_per_text(files, lambda texts: texts.select("file_id", found)).select("file_id", "pos", "s.*")


def visited_functions(files: DataFrame) -> DataFrame:
    """One row per Python function with a signature: name, def_ln, sig_ln, body_ln, end_ln."""
    found = F.inline(python_functions(F.col("code"))["found"])
    return once_per_text(files, lambda texts: texts.select("file_id", found).drop("first", "base"))


def function_totals(files: DataFrame) -> DataFrame:
    """Visited definitions and all line-leading ones, per file."""
    code = F.col("code")
    totals = (
        python_functions(code)["total"].cast("long").alias("total_visited"),
        F.size(F.regexp_extract_all(code, F.lit(r"(?m)^\s*def\s+\w+"), F.lit(0))).cast("long").alias("total_def_lines"),
    )
    return once_per_text(files, lambda texts: texts.select("file_id", *totals))


def _numbered(lines: Column, first: Column, last: Column) -> Column:
    part = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.concat(F.array_join(F.transform(part, lambda x, i: F.format_string("%4d | %s", i + first, x)), "\n"), F.lit("\n"))


def candidates(files: DataFrame) -> DataFrame:
    """One row per stub: function_name, code_snippet, context (five lines around,
    numbered), start_line, end_line. All is cut in the text's own row."""

    def shown(lines: Column) -> Column:
        def texts(s: Column) -> Column:
            snippet = F.slice(lines, s["def_ln"], F.greatest(s["end_ln"] - s["def_ln"] + 1, F.lit(0)))
            return F.struct(
                s["name"].alias("function_name"),
                F.concat(F.array_join(snippet, "\n"), F.when(F.size(snippet) > 0, "\n").otherwise("")).alias("code_snippet"),
                _numbered(lines, F.greatest(F.lit(1), s["start_ln"] - CONTEXT_LINES), F.least(F.size(lines), s["end_ln"] + CONTEXT_LINES)).alias("context"),
                s["start_ln"].alias("start_line"), s["end_ln"].alias("end_line"),
            )

        return F.transform(stubs_of(F.col("code")), texts)

    found = F.posexplode(let(split_lines(F.col("code")), shown)).alias("pos", "c")
    return once_per_text(files, lambda texts: texts.select("file_id", found)).select("file_id", "pos", "c.*")


_CHECK4 = ("is_", "validate_", "check_", "verify_")
_CHECK3 = ("is_", "validate_", "check_")
_CHECK6 = ("is_", "has_", "can_", "validate_", "check_", "verify_")
#: Proposals by name: (all of these parts, any of these parts, any of these
#: prefixes, text, import). First that holds wins. Fixed values.
PROPOSALS = (
    (("email",), (), _CHECK4, '    return bool(re.match(r"^[\\w._%+-]+@[\\w.-]+\\.[a-zA-Z]{2,}$", str(<1>)))', "re"),
    (("hash", "password"), (), (), '    return hashlib.sha256(str(<1>).encode("utf-8")).hexdigest()', "hashlib"),
    ((), ("hash", "encrypt", "digest"), (), "    return hashlib.sha256(str(<1>).encode()).hexdigest()", "hashlib"),
    (("password",), (), _CHECK3, "    p = str(<1>)\n    return len(p) >= 8 and any(c.isupper() for c in p) and any(c.isdigit() for c in p)", None),
    ((), ("normalize", "clean", "sanitize"), (), '    return str(<1>).strip().lower().replace("  ", " ")', None),
    ((), ("palindrome",), (), '    s = str(<1>).lower().replace(" ", "")\n    return s == s[::-1]', None),
    ((), (), _CHECK6, "    return <1> is not None and bool(<1>)", None),
    ((), ("calculate", "total", "count"), (), "    return sum(<1>) if <1> else 0", None),
    ((), ("average", "avg", "mean"), (), "    items = list(<1>)\n    return sum(items) / len(items) if items else 0.0", None),
    ((), ("sort",), (), "    return sorted(<1>)", None),
    ((), ("unique", "distinct", "dedup"), (), "    return list(dict.fromkeys(<1>))", None),
    ((), ("read", "load"), (), '    if not os.path.exists(str(<1>)):\n        return None\n    with open(<1>, "r", encoding="utf-8") as f:\n        return f.read()', "os"),
    ((), ("write", "save"), (), '    with open(<1>, "w", encoding="utf-8") as f:\n        f.write(str(<2>))\n    return True', None),
    ((), ("find", "search", "fetch"), (), "    return next((x for x in <2> if x == <1>), None)", None),
    ((), ("delete", "remove"), (), "    return [x for x in <2> if x != <1>]", None),
    ((), ("format", "convert", "parse"), (), "    return str(<1>).strip()", None),
    ((), ("json",), (), "    try:\n        return json.loads(str(<1>))\n    except Exception:\n        return None", "json"),
    ((), ("log", "debug"), (), "    print(str(<1>))\n    return True", None),
    ((), ("send", "notify"), (), '    return {"status": "pending", "to": str(<1>), "sent": False}', None),
)
#: What a name that no rule knows gets. Fixed value.
NO_PROPOSAL = '    raise NotImplementedError(f"<0>() not implemented - requires manual implementation")'


def proposal(name: Column, params: Column) -> Column:
    """struct(code, required_import) for a name and its parameter names."""
    bound = F.struct(
        name.alias("name"), F.lower(name).alias("n"), F.coalesce(F.get(params, 0), F.lit("value")).alias("p1"),
        F.coalesce(F.get(params, 1), F.lit("items")).alias("p2"),
    )
    return let(bound, _proposal)


def _proposal(x: Column) -> Column:
    def template(text: str, needs: str | None) -> Column:
        return F.struct(F.lit(text).alias("code"), F.lit(needs).cast("string").alias("required_import"))

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    n = x["n"]
    out = template(NO_PROPOSAL, None)
    for every, some, prefixes, text, needs in reversed(PROPOSALS):
        tests = [n.contains(part) for part in every]
        if some:
            tests.append(any_of([n.contains(p) for p in some]))
        if prefixes:
            tests.append(any_of([n.startswith(p) for p in prefixes]))
        holds = tests[0]
        for t in tests[1:]:
            holds = holds & t
        out = F.when(holds, template(text, needs)).otherwise(out)

    def filled(t: Column) -> Column:
        code = F.replace(F.replace(F.replace(t["code"], F.lit("<1>"), x["p1"]), F.lit("<2>"), x["p2"]), F.lit("<0>"), x["name"])
        return F.struct(code.alias("code"), t["required_import"].alias("required_import"))

    return let(out, filled)


def proposals_of(code: Column) -> Column:
    """Stubs of a text with suggestion and required_import; JavaScript stubs get a comment."""
    pattern = F.lit(r"def (\w+)\(([^)]*)\)")
    defined = F.struct(
        F.regexp_extract_all(code, pattern, F.lit(1)).alias("names"), F.regexp_extract_all(code, pattern, F.lit(2)).alias("raws")
    )

    def made(s: Column, d: Column) -> Column:
        at = F.array_position(d["names"], s["name"])  # the first ``def name(``
        python = proposal(s["name"], clean_params(F.coalesce(F.get(d["raws"], (at - 1).cast("int")), F.lit(""))))
        comment = F.struct(
            F.concat(F.lit("// TODO: implement "), s["name"]).alias("code"), F.lit(None).cast("string").alias("required_import")
        )
        fields = ("name", "risk", "reason", "snippet", "def_ln", "start_ln", "end_ln", "base", "language")
        return let(
            F.when(s["language"] == "python", python).otherwise(comment),
            lambda m: F.struct(
                *[s[k].alias(k) for k in fields], m["code"].alias("suggestion"), m["required_import"].alias("required_import")
            ),
        )

    return let(defined, lambda d: F.transform(stubs_of(code), lambda s: made(s, d)))


def proposals(files: DataFrame) -> DataFrame:
    """(file_id, pos, name, suggestion, required_import and the stub's extent) for each stub."""
    found = F.posexplode(proposals_of(F.col("code"))).alias("pos", "s")
    return once_per_text(files, lambda texts: texts.select("file_id", found)).select("file_id", "pos", "s.*")


#: (type, weight, text around the parameter <p>) of the clues. Fixed values.
CLUES = (
    ("dict", 0.5, ("<p>.get(",)), ("dict", 0.4, ('<p>["',)), ("dict", 0.4, ("<p>['",)), ("list", 0.5, (" in <p>",)), ("list", 0.3, ("len(<p>)",)),
    ("list", 0.4, ("<p>.append(",)), ("list", 0.3, ("<p>[0]",)), ("string", 0.5, ("<p>.split(",)), ("string", 0.4, ("<p>.strip(",)),
    ("string", 0.3, ("<p>.lower(",)), ("string", 0.3, ("<p>.replace(",)), ("number", 0.5, ("int(<p>)",)), ("number", 0.5, ("float(<p>)",)),
    ("number", 0.3, ("<p> + ", "<p> * ")),
)
TYPES = ("dict", "list", "string", "number")
LEAST_CONFIDENCE = 0.15


def type_confidence(scope: Column, param: Column) -> dict[str, Column]:
    """Confidence per type; ties of the best go to the first of TYPES."""
    out = {t: F.lit(0.0) for t in TYPES}
    for kind, weight, texts in CLUES:
        hit = F.lit(False)
        for text in texts:
            before, after = text.split("<p>")
            hit = hit | scope.contains(F.concat(F.lit(before), param, F.lit(after)))
        out[kind] = out[kind] + F.when(hit, weight).otherwise(0.0)
    return {k: F.round(v, 2) for k, v in out.items()}


def dominant_type(scores: dict[str, Column]) -> Column:
    best = F.greatest(*scores.values())
    out = F.lit("unknown")
    for kind in reversed(TYPES):
        out = F.when((scores[kind] == best) & (best > LEAST_CONFIDENCE), kind).otherwise(out)
    return out


def refine(suggestion: Column, kind: Column, param: Column) -> Column:
    """A plain sum over dicts becomes a sum over their values."""
    plain = F.concat(F.lit("sum("), param, F.lit(")"))
    better = F.concat(F.lit("sum(x.get('value', x.get('price', x.get('amount', 0))) for x in "), param, F.lit(")"))
    return F.when((kind == "dict") & suggestion.contains(plain), F.replace(suggestion, plain, better)).otherwise(suggestion)


def types_of(code: Column) -> Column:
    """Per function with parameters: name, param, a confidence per type, dominant.
    The scope is the function's body, else the whole text."""

    def typed(bodies: Column) -> Column:
        names = F.transform(bodies, lambda b: b["name"])

        def one(p: Column, ns: Column) -> Column:
            at = F.array_position(ns, p["name"])
            scope = F.coalesce(F.get(bodies, (at - 1).cast("int"))["body"], code)
            param = F.get(p["params"], F.lit(0))

            def scored(x: Column) -> Column:
                scores = F.struct(*[c.alias(k) for k, c in type_confidence(x["scope"], x["param"]).items()])
                return let(
                    scores,
                    lambda v: F.struct(
                        p["name"].alias("name"), x["param"].alias("param"), *[v[k].alias(k) for k in TYPES],
                        dominant_type({k: v[k] for k in TYPES}).alias("dominant"),
                    ),
                )

            return let(F.struct(scope.alias("scope"), param.alias("param")), scored)

        with_params = F.filter(params_of(code), lambda p: F.size(p["params"]) > 0)
        return let(names, lambda ns: F.transform(with_params, lambda p: one(p, ns)))

    return let(bodies_of(code), typed)


def first_param_types(files: DataFrame) -> DataFrame:
    """(file_id, name, param, dict, list, string, number, dominant); see ``types_of``."""
    return once_per_text(files, lambda texts: texts.select("file_id", F.inline(types_of(F.col("code")))))
