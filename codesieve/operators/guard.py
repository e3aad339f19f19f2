"""Guard checks on one text, and on an original against a modified text.

Checks are an array in the file's row, so a report needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import guard_language, indent_width, let, split_lines, trim_control
from codesieve.operators.copies import once_per_text
from codesieve.operators.functions import signatures
from codesieve.operators.rules import GUARD


def _body(quote: str, ends: str = "") -> str:
    """What stands behind an opening quote. Possessive, and with no repeated choice:
    the matcher takes a literal of any length in one loop, without a stack."""
    return rf"{quote}[^{quote}\\{ends}]*+(?:\\.[^{quote}\\{ends}]*+)*+"


_DOUBLE, _SINGLE, _TEMPLATE = _body('"', r"\n"), _body("'", r"\n"), _body("`")
_CLOSED = f"{_DOUBLE}\"|{_SINGLE}'"
_OPEN = f"|({_DOUBLE}|{_SINGLE})"
_C_COMMENTS = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
#: Strings and comments by language, longest form first. Group 1 is a string that
#: stays open; it is kept, so that no character is looked at again from each quote in it.
NOISE = {
    "PYTHON": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|" + _CLOSED + r"|#[^\n]*+" + _OPEN,
    "JAVASCRIPT": f"{_CLOSED}|{_TEMPLATE}`|{_C_COMMENTS}|({_DOUBLE}|{_SINGLE}|{_TEMPLATE})",
    "JAVA": f"{_CLOSED}|{_C_COMMENTS}{_OPEN}",
    "HTML": r"<!--[\s\S]*?(?:-->|\z)|(?!)()",
    "UNKNOWN": _CLOSED + _OPEN,
}
OPENERS = ("def ", "class ", "if ", "for ", "while ", "try:", "with ", "elif ", "else:")


def noise_free(code: Column, language: Column) -> Column:
    """Text without comments and closed strings."""
    out = F.regexp_replace(code, NOISE["UNKNOWN"], "$1")
    for name, pattern in NOISE.items():
        same = language.isin("JAVA", "KOTLIN") if name == "JAVA" else language == name
        out = F.when(same, F.regexp_replace(code, pattern, "$1")).otherwise(out)
    return out


def balanced(code: Column, language: Column) -> Column:
    """Whether each kind of bracket closes and no string stays open."""

    def per_kind(text: Column, opens: str, closes: str) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(f"[\\{opens}\\{closes}]"), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
        return F.aggregate(
            tokens, start,
            lambda s, t: let(
                s["depth"] + F.when(t == opens, 1).otherwise(-1),
                lambda d: F.struct(d.alias("depth"), F.least(s["low"], d).alias("low")),
            ),
            lambda s: (s["depth"] == 0) & (s["low"] >= 0),
        )

    def all_kinds(text: Column) -> Column:
        open_string = (text.contains('"') | text.contains("'") | (text.contains("`") & (language == "JAVASCRIPT"))) & (language != "HTML")
        return per_kind(text, "(", ")") & per_kind(text, "[", "]") & per_kind(text, "{", "}") & ~open_string

    return let(noise_free(code, language), all_kinds)


def indentation_ok(code: Column) -> Column:
    """Each statement after a block opener is deeper, or a def or class."""
    lines = F.filter(
        F.transform(split_lines(code), lambda x: F.struct(trim_control(x).alias("t"), indent_width(x).alias("ind"))),
        lambda l: (l["t"] != "") & ~l["t"].startswith("#"),
    )

    def pairs(ls: Column) -> Column:
        def bad(l: Column, i: Column) -> Column:
            before = F.get(ls, i - 1)
            opener = F.lit(False)
            for o in OPENERS:
                opener = opener | before["t"].startswith(o)
            return (
                F.coalesce(opener & before["t"].endswith(":"), F.lit(False)) & (l["ind"] <= before["ind"])
                & ~l["t"].startswith("def ") & ~l["t"].startswith("class ")
            )

        return ~F.exists(F.transform(ls, bad), lambda b: b)

    return let(lines, pairs)


def _check(check_id: str, order: int, passed: Column, critical, details: str) -> Column:
    return F.struct(
        F.lit(order).alias("ord"), F.lit(check_id).alias("check_id"), passed.alias("passed"),
        (critical if isinstance(critical, Column) else F.lit(critical)).alias("critical"), F.lit(details).alias("details"),
    )


def _language_checks(code: Column, language: Column) -> list[Column]:
    out = []
    order = 100
    for languages, rules in GUARD.items():
        for rule in rules:
            order += 1
            out.append(
                F.when(language.isin(*languages), _check(rule.rule_id, order, ~code.rlike(rule.pattern), rule.critical, rule.category))
            )
    return out


def direct_checks(code: Column, language: Column) -> Column:
    """Checks of one text, without an original. Both are evaluated once."""
    return let(F.struct(code.alias("code"), language.alias("language")), lambda x: _direct(x["code"], x["language"]))


def _direct(code: Column, language: Column) -> Column:
    every = F.array(
        _check("AI001", 1, F.lit(True), False, "scope: no original to compare"),
        _check("AI010", 4, balanced(code, language), True, "brackets and strings"),
        F.when(language == "PYTHON", _check("AI010b", 5, indentation_ok(code), False, "indentation")),
        *_language_checks(code, language),
    )
    return F.filter(every, lambda c: c.isNotNull())


def scope_ok(original: Column, modified: Column, start: Column, end: Column) -> Column:
    """Lines before [start, end] and after it are unchanged (1-based, inclusive)."""

    def compare(x: Column) -> Column:
        o, m = x["o"], x["m"]
        head = F.least(start - 1, F.size(o), F.size(m))
        tail = F.greatest(F.size(o) - end, F.lit(0))
        return (
            (F.slice(o, F.lit(1), head) == F.slice(m, F.lit(1), head)) & (tail <= F.size(m))
            & (F.slice(o, F.size(o) - tail + 1, tail) == F.slice(m, F.greatest(F.size(m) - tail + 1, F.lit(1)), tail))
        )

    valid = (start >= 1) & (end >= 1) & (start <= end)
    both = F.struct(split_lines(original).alias("o"), split_lines(modified).alias("m"))
    return F.when(original.isNull() | modified.isNull() | ~valid, False).otherwise(let(both, compare))


#: Read backwards from a name: a type, a generic clause and modifiers (fixed values).
_BACK_MODIFIERS = r"\s*+(?:(?:cilbup|etavirp|detcetorp|citats|lanif|tcartsba|dezinorhcnys)\s*+)*+"
_BACK_GENERIC = r"(?:\s*+>[^>]+<)?+"
_BACK_TYPED, _BACK_UNTYPED = (rf"(?i)\A{t}{_BACK_GENERIC}{_BACK_MODIFIERS}" for t in (r"\s++[\w<>\[\]]++", ""))
#: A Python header read backwards, what follows a Java header, a JavaScript header.
_BACK_DEF = r"(?i)\A\s*+(\w++)\s++fed"
_AFTER_JAVA = r"(?i)\A\s*+(?:throws\s[\w,\s]++)?+\{?"
_JS_HEADER = r"(?i)function\s++(?=(\w++))|(?<!\w)(\w++)\s*+=\s*+(?=(function|async\s*+\(|\())"
_EVERYTHING = 1 << 30


def _first(found: Column, body) -> Column:
    """``body`` of the first element; null without one."""
    return F.get(F.transform(F.slice(found, 1, 1), body), F.lit(0))


def _tail(x: Column, m: Column) -> Column:
    """Pieces behind the ``m``-th (from 0), as they were between round brackets."""
    return F.array_join(F.slice(x, m + 2, F.size(x)), "(")


def _headers(parts: Column, heads: Callable[[Column], Column], follows: Callable[[Column], Column]) -> Column:
    """(k, m, pieces) of the parts, cut at ')', of which a piece, cut at '(', ends
    with a wanted head and whose next part may follow it."""

    def one(part: Column, k: Column) -> Column:
        def placed(pieces: Column) -> Column:
            wanted = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), heads)
            return F.struct(k.alias("k"), (F.array_position(wanted, True) - 1).cast("int").alias("m"), pieces.alias("pieces"))

        return F.when((k < F.size(parts) - 1) & follows(k), let(F.split(part, r"\(", -1), placed))

    return F.filter(F.transform(parts, one), lambda x: x["m"] >= 0)


def _python_signature(code: Column, name: Column) -> Column:
    back = F.reverse(F.lower(name))

    def of(parts: Column) -> Column:
        last_colon = F.coalesce(F.array_max(F.transform(parts, lambda p, k: F.when(p.contains(":"), k))), F.lit(-1))

        def text(x: Column) -> Column:
            head = F.reverse(F.regexp_extract(F.reverse(F.get(x["pieces"], x["m"])), _BACK_DEF, 0))
            near = F.get(parts, x["k"] + 1)
            rest = F.when(near.contains(":"), near).otherwise(F.array_join(F.slice(parts, x["k"] + 2, F.size(parts)), ")"))
            return F.concat(head, F.lit("("), _tail(x["pieces"], x["m"]), F.lit(")"), F.substring_index(rest, ":", 1), F.lit(":"))

        def with_last(last: Column) -> Column:
            def follows(k: Column) -> Column:
                after = F.get(parts, k + 1)
                return after.rlike(r"\A\s*+:") | (after.rlike(r"\A\s*+->") & (k + 1 <= last))

            heads = _headers(parts, lambda p: F.lower(F.regexp_extract(F.reverse(p), _BACK_DEF, 1)) == back, follows)
            return _first(heads, text)

        return let(last_colon, with_last)

    return let(F.split(code, r"\)", -1), of)


def _java_signature(code: Column, name: Column) -> Column:
    back = F.reverse(F.lower(name))

    def bare(piece: Column) -> Column:
        """A piece read backwards from its last character that is no blank."""
        return F.reverse(F.regexp_replace(piece, r"(?<!\s)\s++\z", ""))

    def of(parts: Column) -> Column:
        def text(x: Column) -> Column:
            piece = F.get(x["pieces"], x["m"])
            before = F.substring(bare(piece), F.length(name) + 1, F.lit(_EVERYTHING))
            typed, untyped = F.regexp_extract(before, _BACK_TYPED, 0), F.regexp_extract(before, _BACK_UNTYPED, 0)
            prefix = F.reverse(F.when(F.length(typed) > F.length(untyped), typed).otherwise(untyped))
            head = F.reverse(F.substring(bare(piece), F.lit(1), F.length(name)))
            blank = F.regexp_extract(piece, r"(?<!\s)\s++\z", 0)
            return F.concat(
                prefix, head, blank, F.lit("("), _tail(x["pieces"], x["m"]), F.lit(")"), F.regexp_extract(F.get(parts, x["k"] + 1), _AFTER_JAVA, 0)
            )

        heads = _headers(parts, lambda p: F.lower(bare(p)).startswith(back), lambda k: F.lit(True))
        return _first(heads, text)

    return let(F.split(code, r"\)", -1), of)


def _javascript_signature(code: Column, name: Column) -> Column:
    low = F.lower(name)

    def of(parts: Column) -> Column:
        def found(part: Column, k: Column) -> Column:
            groups = [F.regexp_extract_all(part, F.lit(_JS_HEADER), F.lit(g)) for g in range(4)]
            arrow = F.coalesce(F.get(parts, k + 1).rlike(r"\A\s*+=>"), F.lit(False))

            def wanted(g: Column) -> Column:
                def one(whole: Column, i: Column) -> Column:
                    called, set_, kind = (F.get(g[f"g{n}"], i) for n in (1, 2, 3))
                    fits = (called != "") & F.lower(called).startswith(low)
                    given = (set_ != "") & F.lower(set_).endswith(low) & ((F.lower(kind) == "function") | arrow)
                    return F.struct(
                        (fits | given).alias("fits"), k.alias("k"), i.alias("i"), (fits | (F.lower(kind) == "function")).alias("near"),
                        F.when(fits, 0).otherwise(F.length(set_) - F.length(name)).alias("skipped"),
                    )

                return F.filter(F.transform(g["g0"], one), lambda x: x["fits"])

            return F.slice(let(F.struct(*[c.alias(f"g{n}") for n, c in enumerate(groups)]), wanted), 1, 1)

        def text(x: Column) -> Column:
            part = F.get(parts, x["k"])
            heads = F.slice(F.regexp_extract_all(part, F.lit(_JS_HEADER), F.lit(0)), 1, x["i"])
            between = F.slice(F.split(part, _JS_HEADER, -1), 1, x["i"] + 1)
            before = F.length(F.array_join(between, "")) + F.length(F.array_join(heads, "")) + x["skipped"]
            end = x["k"] + F.when(x["near"], 0).otherwise(1)
            rest = F.when(~x["near"], F.concat(F.lit(")"), F.get(parts, end))).otherwise("")
            closed = F.when(end < F.size(parts) - 1, F.concat(F.lit(")"), F.regexp_extract(F.get(parts, end + 1), r"\A\s*+\{?", 0))).otherwise("")
            return F.concat(F.substring(part, before + 1, F.lit(_EVERYTHING)), rest, closed)

        return _first(F.flatten(F.transform(parts, found)), text)

    return let(F.split(code, r"\)", -1), of)


def signature_of(code: Column, name: Column, language: Column) -> Column:
    """A function's signature with single spaces; null where there is none.

    The text is cut at ')' and its parts at '(': a header's arguments end with its
    part, so each part is read once, whatever its length. Names are compared, not
    built into a pattern. The first header counts whose arguments close and which
    goes on as its language asks.
    """

    def of(x: Column) -> Column:
        text = (
            F.when(x["language"] == "PYTHON", _python_signature(x["code"], x["name"]))
            .when(x["language"].isin("JAVA", "KOTLIN"), _java_signature(x["code"], x["name"]))
            .when(x["language"] == "JAVASCRIPT", _javascript_signature(x["code"], x["name"]))
        )
        return F.regexp_replace(trim_control(text), r"\s++", " ")

    held = let(F.struct(code.alias("code"), name.alias("name"), language.alias("language")), of)
    return F.when(F.lower(code).contains(F.lower(name)), held)


def compared_checks(original: Column, modified: Column, start: Column, end: Column, name: Column, language: Column) -> Column:
    """Checks of a modified text against its original. All are evaluated once."""
    named = {"original": original, "modified": modified, "start": start, "end": end, "name": name, "language": language}
    return let(F.struct(*[c.alias(k) for k, c in named.items()]), lambda x: _compared(*[x[k] for k in named]))


def _compared(original: Column, modified: Column, start: Column, end: Column, name: Column, language: Column) -> Column:
    lost = F.size(F.array_except(signatures(original, language), signatures(modified, language)))
    whole = F.coalesce(lost == 0, F.lit(False))
    old, new = signature_of(original, name, language), signature_of(modified, name, language)
    same = F.coalesce(old == new, F.lit(False))
    every = F.array(
        _check("AI001", 1, scope_ok(original, modified, start, end), True, "change outside the range"),
        _check("AI012", 2, whole, ~whole, "signatures lost"),
        F.when(F.coalesce(name, F.lit("")) != "", _check("AI011", 3, same, ~same, "signature of the function")),
        _check("AI010", 4, balanced(modified, language), True, "brackets and strings"),
        F.when(language == "PYTHON", _check("AI010b", 5, indentation_ok(modified), False, "indentation")),
        *_language_checks(modified, language),
    )
    return F.filter(every, lambda c: c.isNotNull())


def checks(files: DataFrame, language: Column | None = None) -> DataFrame:
    """(file_id, ord, check_id, passed, critical, details): one row per check."""
    language = guard_language(F.col("code"), F.col("path")) if language is None else language
    return files.select("file_id", F.inline(direct_checks(F.col("code"), language)))


def report_of(df: DataFrame, keys: list[str]) -> DataFrame:
    passed = F.size(F.filter("checks", lambda c: c["passed"]))
    failed = F.filter("checks", lambda c: ~c["passed"] & c["critical"])
    score = F.when(F.size("checks") == 0, 0).otherwise(F.round(passed * F.lit(100.0) / F.size("checks"))).cast("long")
    rows = df.select(*keys, F.size("checks").cast("long").alias("n_checks"), score.alias("safety_score"), failed.alias("failed"))
    verdict = F.when(F.size("failed") > 0, "BLOCKED").when(F.col("safety_score") < 100, "WARNING").otherwise("SAFE")
    reason = F.array_join(
        F.transform(F.array_sort("failed"), lambda c: F.concat(c["check_id"], F.lit(": "), c["details"])), " | "
    )
    return rows.select(
        *keys, "n_checks", "safety_score", verdict.alias("verdict"),
        F.when(F.size("failed") > 0, reason).alias("blocked_reason"), (verdict != "BLOCKED").alias("can_proceed"),
        F.when(verdict == "BLOCKED", "do not apply").when(verdict == "WARNING", "review before applying").otherwise("safe to apply").alias("recommendation"),
    )


def guard_report(files: DataFrame) -> DataFrame:
    """One row per file: n_checks, safety_score, verdict, blocked_reason, can_proceed."""
    language = guard_language(F.col("code"), F.col("path"))
    return report_of(files.select("file_id", direct_checks(F.col("code"), language).alias("checks")), ["file_id"])


def guard_compare(versions: DataFrame) -> DataFrame:
    """As ``guard_report`` for (file_id, original, modified, path, start_line,
    end_line, function_name); without an original or a range, a direct check. Equal
    pairs of texts are compared once."""
    on = ("original", "modified", "path", "start_line", "end_line", "function_name")
    return once_per_text(_by_extension(versions), _compare, *on)


def _by_extension(versions: DataFrame) -> DataFrame:
    """Of paths only what tells the language, so that copies elsewhere are equal."""
    return versions.withColumn("path", F.regexp_extract(F.lower("path"), r"\.[^./]*+\z", 0))


def _compare(versions: DataFrame) -> DataFrame:
    language = guard_language(F.col("modified"), F.col("path"))
    direct = F.col("original").isNull() | (F.col("start_line") < 0) | (F.col("end_line") < 0)
    both = F.when(direct, direct_checks(F.col("modified"), language)).otherwise(
        compared_checks(
            F.col("original"), F.col("modified"), F.col("start_line"), F.col("end_line"), F.col("function_name"), language
        )
    )
    return report_of(versions.select("file_id", both.alias("checks")), ["file_id"])


def lost_signatures(versions: DataFrame) -> DataFrame:
    """(file_id, signature): in the original and not in the modified text."""
    language = guard_language(F.col("modified"), F.col("path"))
    lost = F.array_except(signatures(F.col("original"), language), signatures(F.col("modified"), language))
    rows = versions.where("original IS NOT NULL AND modified IS NOT NULL")
    return once_per_text(_by_extension(rows), lambda texts: texts.select("file_id", F.explode(lost).alias("signature")), "original", "modified", "path")
