"""Column functions over source text: trimming, lines, indents, languages, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it in ``body``.

    An expression that is only mentioned inside a lambda would otherwise run
    again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Items that a fold reads before it joins what they gave to the long list.
GATHERED = 128


def gather(
    items: Column, start: Column, kind: str, step: Callable[[Column, Column], Column], finish: Callable[[Column, Column], Column]
) -> Column:
    """Fold over ``items`` whose state's ``emit`` (an array of type ``kind``) is gathered.

    ``finish`` takes the last state and the list of all that was emitted. A fold
    copies its state for each item, so items are read in blocks: the long list is
    copied once for each block, and lists within a block are short.
    """
    empty = F.array().cast(kind)

    def move(a: Column, x: Column) -> Column:
        emit = a["state"]["emit"]
        return F.struct(
            step(a["state"], x).alias("state"), F.when(F.size(emit) > 0, F.concat(a["list"], emit)).otherwise(a["list"]).alias("list")
        )

    def block(a: Column, k: Column) -> Column:
        part = F.slice(items, k * GATHERED + 1, GATHERED)
        read = F.aggregate(part, F.struct(a["state"].alias("state"), empty.alias("list")), move)
        return let(read, lambda r: F.struct(r["state"].alias("state"), F.concat(a["list"], r["list"]).alias("list")))

    blocks = F.sequence(F.lit(0), (F.size(items) / GATHERED).cast("int"))
    return F.aggregate(
        blocks, F.struct(start.alias("state"), empty.alias("list")), block, lambda a: finish(a["state"], F.concat(a["list"], a["state"]["emit"]))
    )


def trim_control(c: Column) -> Column:
    """Cut every character up to U+0020 from both ends (``trim`` cuts spaces only)."""
    # Looking behind lets a run be tried once, not from each of its characters.
    return F.regexp_replace(c, r"\A[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z", "")


def cut_newlines(c: Column) -> Column:
    """Cut newlines from the end."""
    return F.regexp_replace(c, r"(?<!\n)\n++\z", "")


def normal_newlines(code: Column) -> Column:
    """CR and CRLF become LF and a text that is not empty ends with one."""
    lf = F.regexp_replace(F.coalesce(code, F.lit("")), r"\r\n?", "\n")
    return F.when(lf == "", lf).when(lf.endswith("\n"), lf).otherwise(F.concat(lf, F.lit("\n")))


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def line_count(code: Column) -> Column:
    """Lines without trailing empty ones; empty text counts 1, only newlines 0."""
    body = cut_newlines(code)
    return F.when(code == "", 1).when(body == "", 0).otherwise(count_of(body, "\n") + 1)


def split_lines(code: Column) -> Column:
    return F.split(code, "\n", -1)


def indent_width(line: Column) -> Column:
    """Width of the leading blanks, a tab counting 4."""
    lead = F.regexp_extract(line, r"\A[ \t]*", 0)
    return F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))


def indent_spaces(line: Column) -> Column:
    """Number of leading spaces."""
    return F.length(F.regexp_extract(line, r"\A *", 0))


def strip_comment(line: Column) -> Column:
    """Cut from the first '#' on, unless that '#' stands inside quotes.

    Triple quotes before it do not open a string; closed strings are removed
    from left to right, and a quote that remains is an open one.
    """
    head = F.substring_index(line, "#", 1)
    plain = F.replace(F.replace(head, F.lit('"""'), F.lit("")), F.lit("'''"), F.lit(""))
    rest = F.regexp_replace(plain, "\"[^\"]*\"|'[^']*'", "")
    return F.when(rest.contains('"') | rest.contains("'"), line).otherwise(head)


def comment_or_string(line_so_far: Column) -> Column:
    """Whether a match after this start of a line lies in a comment or string."""
    return (
        line_so_far.contains("//")
        | trim_control(line_so_far).startswith("#")
        | (count_of(line_so_far, '"') % 2 == 1)
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scanner_language(code: Column) -> Column:
    return (
        F.when(code.contains("def ") | (code.contains("import ") & code.contains(":")), "Python")
        .when(code.contains("const ") | code.contains("let ") | code.contains("=>"), "JavaScript/TypeScript")
        .when(code.contains("public class") | code.contains("void main"), "Java")
        .otherwise("Unknown")
    )


#: File extensions of the guard's languages (fixed values).
GUARD_EXTENSIONS = (
    ("JAVA", (".java",)),
    ("PYTHON", (".py",)),
    ("JAVASCRIPT", (".js", ".mjs", ".cjs")),
    ("KOTLIN", (".kt", ".kts")),
    ("HTML", (".html", ".htm")),
)


def guard_language(code: Column, path: Column | None = None) -> Column:
    """By extension, else by content."""
    out = let(F.lower(trim_control(code)), _language_of_content)
    if path is None:
        return out

    def by_extension(name: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for language, extensions in reversed(GUARD_EXTENSIONS):
            ends = name.endswith(extensions[0])
            for e in extensions[1:]:
                ends = ends | name.endswith(e)
            chosen = F.when(ends, language).otherwise(chosen)
        return chosen

    return F.coalesce(let(F.lower(path), by_extension), out)


def _language_of_content(text: Column) -> Column:
    """The tests and their order are fixed values."""

    def has(*parts: str) -> Column:
        found = text.contains(parts[0])
        for p in parts[1:]:
            found = found | text.contains(p)
        return found

    return (
        F.when(text == "", "UNKNOWN")
        .when(text.startswith("<!doctype html") | has("<html", "<body"), "HTML")
        .when(text.startswith("import ") & ~has(";"), "PYTHON")
        .when(has("def ") & has(":") & ~has("{"), "PYTHON")
        .when(has("print(", "if __name__ ==", "except ", "elif "), "PYTHON")
        .when(
            has("public class", "private class", "system.out.println", "@override", "extends ", "implements ", "package "),
            "JAVA",
        )
        .when(has("const ", "let ", "var ") & has("document.", "window.", "console.", "=>", "function "), "JAVASCRIPT")
        .when(has("function ") & has("=>", "document.getelement"), "JAVASCRIPT")
        .when(has("fun ", "val ", "companion object", "data class") | (has("var ") & has(":")), "KOTLIN")
        .otherwise("UNKNOWN")
    )


def content_language(code: Column) -> Column:
    """The tests and their order are fixed values."""
    return (
        F.when(code.contains("package ") & code.contains("import android."), "java_android")
        .when(code.contains("package ") & code.contains("public class "), "java")
        .when(code.contains("import React") | code.contains("useState"), "jsx")
        .when(code.contains("def ") & code.contains("import "), "python")
        .when(code.contains("function ") | code.contains("const ") | code.contains("=>"), "javascript")
        .when(code.contains("<?php"), "php")
        .when(code.contains("#include"), "cpp")
        .otherwise("unknown")
    )


def report_language(code: Column) -> Column:
    return F.when(code.contains("def "), "Python").otherwise("Unknown")


#: Name prefixes of clear and of vague functions (fixed values).
CLEAR_NAMES = (
    "is_", "has_", "can_", "validate_", "check_", "verify_", "calculate", "compute", "sum", "total", "avg", "read_", "load_",
    "save_", "write_", "get_", "fetch_", "log_", "hash_", "encrypt_", "format_", "parse_", "send_", "email_",
)
VAGUE_NAMES = ("process", "handle", "run", "execute", "do", "action", "work", "main")


def fixability(name: Column) -> Column:
    """HIGH, MEDIUM or LOW: how sure a proposal for this name can be."""
    n = F.lower(name)
    return (
        F.when(n.rlike(r"\A(?:" + "|".join(CLEAR_NAMES) + ")"), "HIGH")
        .when((F.length(n) > 5) & ~n.rlike(r"\A(?:" + "|".join(VAGUE_NAMES) + ")"), "MEDIUM")
        .otherwise("LOW")
    )


#: (intent, prefixes, parts of a name), first that holds wins (fixed values).
INTENTS = (
    ("validate", ("is_", "has_", "can_", "check_", "verify_", "validate_"), ()),
    ("calculate", (), ("calculate", "sum", "total")),
    ("read file", (), ("read", "load")),
    ("write file", (), ("write", "save")),
    ("send", (), ("send", "email")),
    ("fetch data", (), ("get", "fetch")),
    ("encrypt", (), ("hash", "encrypt")),
    ("log", (), ("log", "debug")),
    ("convert data", (), ("parse", "format")),
    ("delete", (), ("delete", "remove")),
    ("create", (), ("create", "build")),
)


def intent(name: Column) -> Column:
    n = F.lower(name)
    out = F.lit("unspecified")
    for what, prefixes, parts in reversed(INTENTS):
        tests = [n.startswith(p) for p in prefixes] + [n.contains(p) for p in parts]
        holds = tests[0]
        for t in tests[1:]:
            holds = holds | t
        out = F.when(holds, what).otherwise(out)
    return out


#: What a fixability class says (ours): reason, warning, signal.
FIX_TEXTS = {
    "HIGH": ("the name is clear", None, "name follows a known pattern"),
    "MEDIUM": ("a proposal is possible, review it", "review the proposal with care", "name needs more context"),
    "LOW": ("the name says little, the proposal will be general", "rename the function first", "name is not descriptive"),
}


def fix_text(fix: Column, part: int) -> Column:
    out = F.lit(None).cast("string")
    for kind, texts in FIX_TEXTS.items():
        out = F.when(fix == kind, F.lit(texts[part])).otherwise(out)
    return out


def clean_params(raw: Column) -> Column:
    """Parameter names of a signature: no self, no cls, no annotation or default."""
    names = F.transform(
        F.split(F.regexp_replace(raw, r"\s+", " "), ","),
        lambda p: trim_control(F.substring_index(trim_control(F.substring_index(p, ":", 1)), "=", 1)),
    )
    return F.filter(names, lambda n: ~n.isin("self", "cls", ""))


def one_by_name(found: Column, place: str, last: bool = False) -> Column:
    """The element of each name with the least (or greatest) ``place``, in the order
    of places. Neighbours are compared after a sort, so no name is searched for."""

    def chosen(xs: Column) -> Column:
        def keeps(x: Column, i: Column) -> Column:
            other = F.get(xs, i + 1) if last else F.get(xs, i - 1)
            return other.isNull() | (other["name"] != x["name"])

        return F.filter(xs, keeps)

    sorted_ = F.array_sort(F.transform(found, lambda f: F.struct(f["name"].alias("name"), f[place].alias("place"), f.alias("f"))))
    back = F.array_sort(F.transform(let(sorted_, chosen), lambda x: F.struct(x["place"].alias("place"), x["f"].alias("f"))))
    return F.transform(back, lambda x: x["f"])
