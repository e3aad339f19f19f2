"""Model exchange as tables: prompts out, responses in. No call is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.text import guard_language, let, trim_control
from codesieve.operators.guard import direct_checks, report_of

#: Name of the tool whose arguments hold the fixes (fixed value).
TOOL = "submit_fixes"
FIX = "struct<function_name:string,before:string,after:string,reason:string,start_line:int,end_line:int>"
RESPONSE = (
    "struct<candidates:array<struct<content:struct<parts:array<struct<text:string,"
    f"functionCall:struct<name:string,args:struct<fixes:array<{FIX}>>>>>>>>>"
)
MAX_TOKENS, TEMPERATURE = 8000, 0.1


def _fixes_of_text(text: Column) -> Column:
    """Fixes of a JSON text, which may stand in a code fence."""
    trimmed = trim_control(text)
    inner = F.when(
        trimmed.startswith("```"), trim_control(F.regexp_replace(F.regexp_replace(trimmed, r"\A```[^\n]*\n", ""), r"```\z", ""))
    ).otherwise(trimmed)
    ok = inner.startswith("{") & inner.endswith("}")
    return F.when(ok, F.from_json(inner, f"struct<fixes:array<{FIX}>>")["fixes"])


def model_fixes(responses: DataFrame) -> DataFrame:
    """(file_id, fix_no, function_name, before, after, reason, start_line, end_line).

    The named call's fixes of the first candidate, else those of its joined text
    parts. Missing fields get defaults; bad JSON gives no rows.
    """
    parts = F.get(F.from_json("raw", RESPONSE)["candidates"], F.lit(0))["content"]["parts"]

    def chosen(ps: Column) -> Column:
        calls = F.filter(ps, lambda p: (p["functionCall"]["name"] == TOOL) & p["functionCall"]["args"].isNotNull())
        text = F.array_join(F.transform(F.filter(ps, lambda p: p["functionCall"].isNull() & p["text"].isNotNull()), lambda p: p["text"]), "")
        return F.when(F.size(calls) > 0, F.get(calls, F.lit(0))["functionCall"]["args"]["fixes"]).otherwise(_fixes_of_text(text))

    rows = responses.select("file_id", F.posexplode(let(parts, chosen)).alias("fix_no", "f"))
    return rows.select(
        "file_id", "fix_no", F.coalesce("f.function_name", F.lit("unknown")).alias("function_name"),
        F.coalesce("f.before", F.lit("")).alias("before"), F.coalesce("f.after", F.lit("")).alias("after"),
        F.coalesce("f.reason", F.lit("")).alias("reason"), F.coalesce("f.start_line", F.lit(-1)).alias("start_line"),
        F.coalesce("f.end_line", F.lit(-1)).alias("end_line"),
    )


def _between(text: Column, label: str) -> Column:
    rest = F.regexp_extract(text, rf"{label}([^\n]*)", 1)
    return trim_control(rest)


def _fenced(text: Column, label: str) -> Column:
    """Text of the first code fence after a label; an open fence runs to the end."""
    return trim_control(F.regexp_extract(text, rf"(?s){label}.*?```[^\n]*\n(.*?)(?:```|\z)", 1))


def text_proposals(responses: DataFrame) -> DataFrame:
    """(file_id, section, function_name, before, after, explanation): sections of a
    delimited text that name a function and give a text after."""
    rows = responses.select("file_id", F.posexplode(F.split("raw", "---")).alias("section", "s"))
    usable = rows.where(F.col("s").contains("FUNCTION:") & F.col("s").contains("AFTER:"))
    s = F.col("s")
    return usable.select(
        "file_id", "section", _between(s, "FUNCTION:").alias("function_name"), _fenced(s, "BEFORE:").alias("before"),
        _fenced(s, "AFTER:").alias("after"), _between(s, "REASON:").alias("explanation"),
    )


def guarded_proposals(responses: DataFrame) -> DataFrame:
    """``text_proposals`` that the guard does not block, with their score; a
    response without any gives one raw row."""
    rows = text_proposals(responses)
    keys = rows.columns
    checks = let(F.col("after"), lambda t: direct_checks(t, guard_language(t)))
    kept = report_of(rows.select(*keys, checks.alias("checks")), keys).where("can_proceed").select(*keys, "safety_score", F.lit(False).alias("raw_view"))
    none = responses.join(kept.select("file_id").distinct(), "file_id", "left_anti")
    raw = none.select(
        "file_id", F.lit(0).alias("section"), F.lit("").alias("function_name"), F.lit("").alias("before"), F.col("raw").alias("after"),
        F.lit("").alias("explanation"), F.lit(0).cast("long").alias("safety_score"), F.lit(True).alias("raw_view"),
    )
    return kept.unionByName(raw)


ASK = "Complete the unfinished functions of one file. Change nothing else, add no import that is not needed, and return no placeholder.\n"
CLOSING = "\nLine numbers of fixes begin at 0.\n"
#: Characters after which a long prompt goes on in its next part.
PART_CHARS = 1 << 20


def _listed() -> Column:
    return F.format_string(
        "\n--- Candidate #%d ---\nFunction: %s\nLines: %d to %d\nCode:\n```\n%s\n```", F.col("pos") + 1, "function_name", "start_line", "end_line", "code_snippet"
    )


def _shown() -> Column:
    return F.format_string("\nRelated file: %s\n```\n%s\n```", "related_path", "related_code")


def _opening() -> Column:
    return F.concat(F.lit(ASK), F.lit("File: "), F.col("path"), F.lit("\n```\n"), F.col("code"), F.lit("\n```\n"))


def prompts(files: DataFrame, candidates: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(file_id, n_candidates, prompt): one per file that has candidates.

    ``related`` (file_id, related_path, related_code) adds files for reading only. A
    prompt is one cell; where a file's related texts may outgrow one, see ``prompt_parts``.
    """
    listed = candidates.select("file_id", F.struct("pos", _listed().alias("t")).alias("c")).groupBy("file_id").agg(
        F.count("*").alias("n_candidates"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["t"]), "\n").alias("listed")
    )
    rows = files.join(listed, "file_id")
    extra = F.lit("")
    asked = candidates.select("file_id").distinct()
    if related is not None:
        # Texts are only shown to files that are asked about.
        related = related.join(asked, "file_id", "left_semi")
        texts = related.select("file_id", F.struct("related_path", _shown().alias("t")).alias("r")).groupBy("file_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("related_text")
        )
        rows = rows.join(texts, "file_id", "left")
        extra = F.coalesce("related_text", F.lit(""))
    return rows.select("file_id", "n_candidates", F.concat(_opening(), extra, F.col("listed"), F.lit(CLOSING)).alias("prompt"))


def prompt_parts(files: DataFrame, candidates: DataFrame, related: DataFrame | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(file_id, part, text): the prompts of ``prompts`` in numbered parts, which
    follow on one another; a part ends behind the piece that fills it.

    A piece is the opening with the file itself, a related file, a candidate or the
    closing line. No cell holds more than one part, however many files are related.
    """
    asked = candidates.select("file_id").distinct()
    wanted = files.join(asked, "file_id", "left_semi")
    kinds = [
        wanted.select("file_id", F.lit(0).alias("kind"), F.lit("").alias("key"), F.lit(0).cast("long").alias("pos"), _opening().alias("t")),
        candidates.select("file_id", F.lit(2), F.lit(""), F.col("pos").cast("long"), _listed()),
        wanted.select("file_id", F.lit(3), F.lit(""), F.lit(0).cast("long"), F.lit(CLOSING)),
    ]
    if related is not None:
        kinds.append(related.join(asked, "file_id", "left_semi").select("file_id", F.lit(1), F.col("related_path"), F.lit(0).cast("long"), _shown()))
    pieces = kinds[0]
    for more in kinds[1:]:
        pieces = pieces.union(more)
    order = Window.partitionBy("file_id").orderBy("kind", "key", "pos", "t")
    # Within a kind pieces are joined by a newline.
    joint = F.when(F.lag("kind").over(order) == F.col("kind"), F.concat(F.lit("\n"), F.col("t"))).otherwise(F.col("t"))
    joined = pieces.withColumn("text", joint).withColumn("place", F.row_number().over(order))
    before = F.sum(F.length("text")).over(Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = joined.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / part_chars))
    gathered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return placed.groupBy("file_id", "part").agg(F.array_join(F.transform(gathered, lambda x: x["text"]), "").alias("text"))


def related_files(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, related_path, related_code): every related file that ``pairs``
    (file_id, related_id) names, a file itself aside; repeated pairs count once.

    The pairs are an input, as a person or a build system gives them: nothing is
    capped, and no repo is paired with itself. They meet texts by the related id;
    a file that many others name is split by the skew join.
    """
    wanted = pairs.where("file_id <> related_id").select("file_id", "related_id").distinct()
    texts = files.select(F.col("file_id").alias("_of"), F.col("path").alias("related_path"), F.col("code").alias("related_code"))
    return wanted.join(texts, F.col("related_id") == F.col("_of")).select("file_id", "related_path", "related_code")


#: Standing instruction of a request (ours), and the schema of the tool's arguments (fixed value).
INSTRUCTION = (
    "You complete unfinished functions. Change only the functions that are listed, keep their signatures, use no name that is not "
    f"in reach, and always call {TOOL} to return the result."
)
_FIELDS = {
    "function_name": "STRING", "before": "STRING", "after": "STRING", "reason": "STRING", "start_line": "INTEGER", "end_line": "INTEGER",
}
DECLARATION = {
    "name": TOOL,
    "description": "Sends the list of exact fixes for the unfinished functions; an empty list if none is needed or sure.",
    "parameters": {
        "type": "OBJECT",
        "properties": {
            "fixes": {
                "type": "ARRAY",
                "items": {"type": "OBJECT", "properties": {k: {"type": t} for k, t in _FIELDS.items()}, "required": list(_FIELDS)},
            }
        },
        "required": ["fixes"],
    },
}
#: What a request holds behind its contents.
ENVELOPE = {
    "systemInstruction": {"parts": [{"text": INSTRUCTION}]},
    "tools": [{"functionDeclarations": [DECLARATION]}],
    "toolConfig": {"functionCallingConfig": {"mode": "ANY", "allowedFunctionNames": [TOOL]}},
    "generationConfig": {"temperature": TEMPERATURE, "maxOutputTokens": MAX_TOKENS},
}


def _literal(value) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def request_bodies(prompted: DataFrame) -> DataFrame:
    """(file_id, body): the JSON that another system sends: contents, instruction,
    tool declaration, the choice of that tool, and generation settings."""
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("parts")))
    body = F.struct(contents.alias("contents"), *[_literal(v).alias(k) for k, v in ENVELOPE.items()])
    return prompted.select("file_id", F.to_json(body).alias("body"))
