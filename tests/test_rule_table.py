"""Rules from a table, and sketches of files that merge."""

import pytest

from codesieve.operators import scan, verdict
from codesieve.operators.rules import CONTENT, GUARD, POLICY, SECURITY
from codesieve.sources import corpus, rule_table


@pytest.mark.parametrize(
    "pattern, bad",
    [
        (r"(?:a|b)*c", True), (r"(a|b)+", True), (r"(?:a|(b|c)d)+", True), (r"(?:x(a|b)y)*", True), (r"(?:a|b){2,}", True), (r"(?:a|b){200}", True),
        (r"(?:a|b)*+c", False), (r"(?:a|b)?c", False), (r"(a|b){3}", False), (r"(?:ab)*", False), (r"[(a|b)]*", False), (r"\(a|b\)*", False), (r"(a|b).*", False), (r"[]|(]+(a)*", False),
    ],
)
def test_repeated_choices_are_seen(pattern, bad):
    assert rule_table.repeated_choice(pattern) is bad


def test_packs_come_back_from_a_table(spark, tmp_path):
    for k, pack in enumerate((SECURITY, POLICY, CONTENT)):
        rule_table.rule_rows(spark, pack).repartition(3).write.parquet(str(tmp_path / str(k)))
        rules, refused = rule_table.load_rules(spark.read.parquet(str(tmp_path / str(k))))
        assert tuple(rules) == tuple(pack) and refused.count() == 0
    assert not any(rule_table.repeated_choice(r.pattern) for pack in GUARD.values() for r in pack)


def test_unfit_rules_are_rows(spark):
    good = SECURITY[0]
    rows = [
        (0, "R1", "HIGH", "c", r"eval\(", True, None), (1, "R2", "HIGH", "c", r"(unclosed", False, []), (2, "R3", "HIGH", "c", r"(?:\\.|[^x])*", False, []),
        (3, "R1", "LOW", "c", "other", False, []), (4, None, "LOW", "c", "x", None, []), (5, "R4", "BAD", "c", "x", False, []), (None, "R0", "LOW", "c", "last", False, ["java"]),
        (6, "R5", "LOW", "c", None, False, []),
    ]
    rules, refused = rule_table.load_rules(spark.createDataFrame(rows, rule_table.SCHEMA))
    assert [(r.rule_id, r.critical, r.skip) for r in rules] == [("R1", True, ()), ("R0", False, ("java",))]
    got = {(r.rule_id, r.problem.split(":")[0]) for r in refused.collect()}
    assert got == {("R2", "pattern does not compile"), ("R3", "pattern repeats a choice"), ("R1", "id is taken"), (None, "no id"), ("R4", "unknown severity"), ("R5", "no pattern")}
    df = spark.createDataFrame([(1, "x = eval(y)\nlast")], "file_id long, code string")
    assert {r.rule_id for r in scan.scan_first(df, rules).collect()} == {"R0", "R1"}
    assert good.rule_id == "SEC001"
    empty, none = rule_table.load_rules(spark.createDataFrame([], rule_table.SCHEMA))
    assert empty == [] and none.count() == 0
    with pytest.raises(ValueError):
        rule_table.load_rules(spark.createDataFrame(rows, rule_table.SCHEMA), limit=3)


def test_sketches_are_close_and_merge(spark):
    files = corpus.source_files(spark, "/root/testdata/sf0.01").cache()
    exact = {tuple(r)[:3] + (r.level,): r for r in verdict.corpus_rollup(files, SECURITY).collect()}
    parts = [verdict.finding_sketches(files.where(f"file_id % 3 = {k}"), SECURITY) for k in range(3)]
    merged = verdict.merged_sketches(verdict.merged_sketches(parts[2], parts[0]), parts[1])
    got = {tuple(r)[:3] + (r.level,): r for r in verdict.rolled_up(merged).collect()}
    assert set(got) == set(exact)
    for k, r in got.items():
        assert r.n_findings == exact[k].n_findings and abs(r.n_files - exact[k].n_files) <= 0.02 * exact[k].n_files
    files.unpersist()
