"""Registered queries of the audit operators, over data derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import text
from codesieve.operators import functions, guard, history, patches, report, scan, stubs, verdict, workflow
from codesieve.operators.rules import GUARD, SECURITY
from codesieve.sources import corpus, files, responses, rule_table
from codesieve.sources.history_store import HistoryStore
from codesieve.streaming import history_stream, streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(f: Query) -> Query:
    _QUERIES[f.__name__] = lambda spark, sf_dir: _longs(f(spark, sf_dir))
    return f


def _longs(df: DataFrame) -> DataFrame:
    """Integer columns as long, so that both engines have one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_files(spark, sf_dir)


@_register
def scan_score(spark, sf_dir):
    return scan.scan_summary(_code(spark, sf_dir), SECURITY)


@_register
def scan_first_match(spark, sf_dir):
    return scan.scan_first(_code(spark, sf_dir), SECURITY)


@_register
def scan_all_matches(spark, sf_dir):
    return scan.scan_all(_code(spark, sf_dir), SECURITY)


@_register
def issues_per_file(spark, sf_dir):
    return scan.issues_per_file(_code(spark, sf_dir), SECURITY)


@_register
def policy_findings(spark, sf_dir):
    return verdict.policy_findings(_code(spark, sf_dir))


@_register
def policy_verdict(spark, sf_dir):
    return verdict.policy_verdict(_code(spark, sf_dir))


@_register
def content_findings(spark, sf_dir):
    return verdict.content_findings(_code(spark, sf_dir))


@_register
def content_verdict(spark, sf_dir):
    return verdict.content_verdict(_code(spark, sf_dir))


@_register
def corpus_rollup(spark, sf_dir):
    return verdict.corpus_rollup(_code(spark, sf_dir), SECURITY)


@_register
def corpus_rollup_sketch(spark, sf_dir):
    """Two increments merged, then rolled up."""
    code = _code(spark, sf_dir)
    parts = [verdict.finding_sketches(code.where(F.col("file_id") % 2 == k), SECURITY) for k in (0, 1)]
    return verdict.rolled_up(verdict.merged_sketches(*parts))


@_register
def scan_rule_table(spark, sf_dir):
    """The security pack written as a table and read back."""
    folder = streams.shared_folder(spark)
    rule_table.rule_rows(spark, SECURITY).write.parquet(f"{folder}/rules")
    rules, _ = rule_table.load_rules(spark.read.parquet(f"{folder}/rules"))
    return scan.scan_first(_code(spark, sf_dir), rules)


@_register
def language_flavours(spark, sf_dir):
    code = F.col("code")
    return _code(spark, sf_dir).select(
        "file_id", text.scanner_language(code).alias("scanner"), text.guard_language(code, F.col("path")).alias("guard"),
        text.guard_language(code).alias("guard_by_content"), text.content_language(code).alias("content"),
        text.report_language(code).alias("report"),
    )


@_register
def source_normalised(spark, sf_dir):
    rows = files.rewritten_names(files.normalised(corpus.derived(spark, sf_dir, corpus.RAW_FILES)))
    return rows.select("file_id", "name", "out_name", text.line_count(F.col("code")).alias("lines"), F.md5("code").alias("digest"))


@_register
def python_functions(spark, sf_dir):
    return stubs.visited_functions(_code(spark, sf_dir))


@_register
def function_totals(spark, sf_dir):
    return stubs.function_totals(_code(spark, sf_dir))


@_register
def stub_detect(spark, sf_dir):
    return stubs.stubs(_code(spark, sf_dir))


@_register
def stub_candidates(spark, sf_dir):
    return stubs.candidates(_code(spark, sf_dir))


@_register
def suggestion_by_name(spark, sf_dir):
    return stubs.proposals(_code(spark, sf_dir)).select("file_id", "pos", "name", "suggestion", "required_import")


@_register
def report_functions(spark, sf_dir):
    return report.function_analysis(_code(spark, sf_dir))


@_register
def report_summary(spark, sf_dir):
    return report.report(_code(spark, sf_dir))


@_register
def name_classes(spark, sf_dir):
    rows = _code(spark, sf_dir).select(F.explode(F.regexp_extract_all("code", F.lit(functions.DEF_PATTERN), F.lit(1))).alias("name"))
    name = F.col("name")
    return rows.groupBy("name").count().select(
        "name", F.col("count").alias("n"), text.fixability(name).alias("fixability"), text.intent(name).alias("intent")
    )


@_register
def context_imports(spark, sf_dir):
    return functions.imports(_code(spark, sf_dir))


@_register
def context_classes(spark, sf_dir):
    return functions.classes(_code(spark, sf_dir))


@_register
def context_params(spark, sf_dir):
    rows = functions.function_params(_code(spark, sf_dir))
    return rows.select("file_id", "name", F.array_join("params", ",").alias("params"))


@_register
def context_members(spark, sf_dir):
    return functions.class_members(_code(spark, sf_dir))


@_register
def function_bodies(spark, sf_dir):
    return functions.function_bodies(_code(spark, sf_dir))


@_register
def type_confidence(spark, sf_dir):
    return stubs.first_param_types(_code(spark, sf_dir))


@_register
def signature_sets(spark, sf_dir):
    code = F.col("code")
    rows = _code(spark, sf_dir)
    return rows.select("file_id", F.explode(functions.signatures(code, text.guard_language(code, F.col("path")))).alias("signature"))


@_register
def bracket_balance(spark, sf_dir):
    code = F.col("code")
    return _code(spark, sf_dir).select("file_id", guard.balanced(code, text.guard_language(code, F.col("path"))).alias("balanced"))


@_register
def indentation_check(spark, sf_dir):
    return _code(spark, sf_dir).select("file_id", guard.indentation_ok(F.col("code")).alias("ok"))


@_register
def guard_checks(spark, sf_dir):
    return guard.checks(_code(spark, sf_dir)).drop("ord")


@_register
def guard_checks_html(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("code"))
    return guard.checks(pages, F.lit("HTML")).where("check_id like 'AI4%'").drop("ord")


@_register
def guard_secret_docs(spark, sf_dir):
    secret = next(r for rules in GUARD.values() for r in rules if r.rule_id == "AI306")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("code"))
    return scan.scan_first(docs, [secret]).select(F.col("file_id").alias("doc_id"), "ln", "evidence")


@_register
def guard_verdict(spark, sf_dir):
    return guard.guard_report(_code(spark, sf_dir))


@_register
def guard_compare(spark, sf_dir):
    return guard.guard_compare(corpus.derived(spark, sf_dir, corpus.FILE_VERSIONS))


@_register
def lost_signatures(spark, sf_dir):
    return guard.lost_signatures(corpus.derived(spark, sf_dir, corpus.FILE_VERSIONS))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    allowed = stubs.stubs(code).select("file_id", F.col("name").alias("function_name"))
    return patches.validate(corpus.derived(spark, sf_dir, corpus.PATCHES), code, allowed)


@_register
def patch_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("file_id", "patch_no", "function_name", "reject_reason")


@_register
def patch_counts(spark, sf_dir):
    return patches.rejected_counts(_code(spark, sf_dir), _validated(spark, sf_dir))


@_register
def patch_without_candidates(spark, sf_dir):
    code = _code(spark, sf_dir)
    return patches.without_candidates(code, stubs.stubs(code))


@_register
def patch_diff(spark, sf_dir):
    return patches.diffs(corpus.derived(spark, sf_dir, corpus.PATCHES), _code(spark, sf_dir))


@_register
def apply_change(spark, sf_dir):
    code = _code(spark, sf_dir)
    return patches.apply_own(code, F.filter(stubs.proposals_of(F.col("code")), lambda s: s["language"] == "python"))


@_register
def workflow_stage(spark, sf_dir):
    return workflow.workflow_items(_code(spark, sf_dir))


@_register
def workflow_name_proposals(spark, sf_dir):
    return workflow.name_proposals(_code(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, corpus.VERSIONS)


@_register
def history_current(spark, sf_dir):
    return history.current_code(_versions(spark, sf_dir), corpus.derived(spark, sf_dir, corpus.SESSIONS))


@_register
def history_code_after_each(spark, sf_dir):
    return history.code_after_each(_versions(spark, sf_dir), corpus.derived(spark, sf_dir, corpus.SESSIONS))


@_register
def history_retention(spark, sf_dir):
    return history.retained(_versions(spark, sf_dir)).select("session_id", "version_id", "age")


@_register
def history_newest_sessions(spark, sf_dir):
    return history.newest_sessions(_versions(spark, sf_dir)).select("session_id", "n_versions")


@_register
def history_counts(spark, sf_dir):
    return history.counts(_versions(spark, sf_dir)).select("session_id", "approved", "rejected", "mean_score")


@_register
def history_delete(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("session_id"))
    return history.delete(_versions(spark, sf_dir), gone).groupBy("session_id").agg(F.count("*").alias("n"))


@_register
def history_upsert(spark, sf_dir):
    rows = _versions(spark, sf_dir)
    return history.upsert(rows.where("NOT approved"), rows.where("approved")).select("session_id", "function_name", "version_id", "approved")


@_register
def history_document(spark, sf_dir):
    return history.decode(history.encode(_versions(spark, sf_dir)))


@_register
def review_counters(spark, sf_dir):
    return workflow.review_counters(_versions(spark, sf_dir))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the first stub of the file whose id is the event's."""
    return _versions(spark, sf_dir).select(
        F.col("version_id").alias("file_id"), F.concat(F.lit("is_ready_"), (F.col("version_id") % 10).cast("string")).alias("function_name"),
        "approved", "ts", F.col("version_id").alias("seq"),
    )


@_register
def apply_decisions(spark, sf_dir):
    return workflow.apply_decisions(_code(spark, sf_dir), _decisions(spark, sf_dir))


@_register
def history_record(spark, sf_dir):
    rows = _versions(spark, sf_dir)
    return history.record(rows.where("NOT approved"), rows.where("approved")).groupBy("session_id").agg(
        F.count("*").alias("n"), F.max("version_id").alias("last")
    )


@_register
def history_increments(spark, sf_dir):
    """The store after five batches, one of them given twice, others out of order."""
    rows = _versions(spark, sf_dir)
    store = HistoryStore(spark, streams.shared_folder(spark), buckets=8)
    store.create(corpus.derived(spark, sf_dir, corpus.SESSIONS))
    for k in (1, 0, 3, 0, 2):
        store.record(rows.where(F.col("version_id") % 4 == k))
    kept = store.versions().groupBy("session_id").agg(F.count("*").alias("n"), F.sum("version_id").alias("id_sum"))
    return store.current().join(kept, "session_id")


@_register
def stream_history(spark, sf_dir):
    stream = history_stream.code_after_each(history_stream.versions(spark, f"{sf_dir}/events.parquet"))
    return history_stream.drained(stream, streams.shared_folder(spark), corpus.derived(spark, sf_dir, corpus.SESSIONS))


@_register
def decision_replay(spark, sf_dir):
    items = stubs.stubs(_code(spark, sf_dir)).select("file_id", F.col("name").alias("function_name"), "risk")
    return workflow.replay(_decisions(spark, sf_dir), items)


@_register
def model_responses(spark, sf_dir):
    return responses.model_fixes(corpus.derived(spark, sf_dir, corpus.MODEL_RESPONSES))


@_register
def text_responses(spark, sf_dir):
    return responses.text_proposals(corpus.derived(spark, sf_dir, corpus.TEXT_RESPONSES))


@_register
def text_responses_guarded(spark, sf_dir):
    return responses.guarded_proposals(corpus.derived(spark, sf_dir, corpus.TEXT_RESPONSES))


def _related(spark: SparkSession, sf_dir: str, code: DataFrame) -> DataFrame:
    return responses.related_files(code, corpus.derived(spark, sf_dir, corpus.RELATED))


@_register
def prompt_rows(spark, sf_dir):
    code = _code(spark, sf_dir)
    found = stubs.candidates(code)
    made = responses.prompts(code, found, _related(spark, sf_dir, code))
    return responses.request_bodies(made).select("file_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@_register
def related_files(spark, sf_dir):
    code = _code(spark, sf_dir)
    return _related(spark, sf_dir, code).select("file_id", "related_path", F.length("related_code").alias("n_chars"))


@_register
def prompt_parts(spark, sf_dir):
    code = _code(spark, sf_dir)
    parts = responses.prompt_parts(code, stubs.candidates(code), _related(spark, sf_dir, code))
    return parts.select("file_id", "part", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@_register
def conversation_prompts(spark, sf_dir):
    """A conversation's turns in numbered parts of 64, so that one of any length fits."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = _table(spark, sf_dir, "conversations").withColumn("part", F.floor(F.col("turn") / 64))
    rows = rows.groupBy("conv_id", "part").agg(turns.alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    return rows.select("conv_id", "part", F.size("t").alias("n_turns"), F.md5(joined).alias("digest"))


@_register
def stream_scan(spark, sf_dir):
    folder = streams.shared_folder(spark)
    _code(spark, sf_dir).write.parquet(f"{folder}/arrived")
    schema = "file_id long, repo string, path string, code string"
    arriving = spark.readStream.schema(schema).parquet(f"{folder}/arrived")
    return streams.drain(streams.scan_stream(arriving), folder)


@_register
def stream_decisions(spark, sf_dir):
    counted = streams.decision_windows(streams.decisions(spark, f"{sf_dir}/events.parquet"))
    return streams.drain(counted, streams.shared_folder(spark))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
