from pyspark.sql import functions as F

from codesieve.operators import scan, verdict
from codesieve.operators.rules import CONTENT, POLICY, SECURITY, Rule


def files(spark, *codes):
    return spark.createDataFrame([(i, f"r{i % 2}", f"r/f{i}.py", c) for i, c in enumerate(codes)], "file_id long, repo string, path string, code string")


def test_first_match_line_and_snippet(spark):
    rows = scan.scan_first(files(spark, "# 😀\n  x = eval(1)  \neval(2)\n"), SECURITY).collect()
    assert [(r.rule_id, r.ln, r.snippet, r.evidence) for r in rows] == [("SEC004", 2, "x = eval(1)", "eval(")]


def test_all_matches_keep_order_and_comments(spark):
    code = "eval(1)\n# eval(2)\nx = \"eval(3)\"; eval(4)\n"
    rows = scan.scan_all(files(spark, code), SECURITY).orderBy("hit_no").collect()
    assert [(r.hit_no, r.ln, r.in_comment) for r in rows] == [(1, 1, False), (2, 2, True), (3, 3, True), (4, 3, False)]


def test_local_hosts_are_no_finding(spark):
    code = "http://localhost/a http://127.0.0.1 http://0.0.0.0\nhttp://h.example"
    assert [r.ln for r in scan.scan_first(files(spark, code), SECURITY).where("rule_id = 'SEC009'").collect()] == [2]


def test_score_and_empty_files(spark):
    rows = {r.file_id: r for r in scan.scan_summary(files(spark, "", "\n\n", 'password = "abc"\neval(1)'), SECURITY).collect()}
    assert [(rows[i].scanned_lines, rows[i].n_issues, rows[i].score) for i in range(3)] == [(1, 0, 100), (0, 0, 100), (2, 2, 60)]


def test_issues_sorted_by_severity(spark):
    row = scan.issues_per_file(files(spark, 'verify=False\neval(1)\npassword = "abc"\n'), SECURITY).first()
    assert row.issues == "SEC001@3,SEC004@2,SEC008@1" and row.deduction == 48


def test_policy_verdict(spark):
    rows = {r.file_id: r for r in verdict.policy_verdict(files(spark, "x", "mkfs.ext4", "os.remove('/etc/x') setuid")).collect()}
    assert [(rows[i].verdict, rows[i].risk_score) for i in range(3)] == [("ALLOWED", 0), ("WARNING", 20), ("BLOCKED", 80)]


def test_policy_dot_stops_at_newline(spark):
    assert verdict.policy_findings(files(spark, "chmod\n777")).count() == 0


def test_content_verdict_ignores_comments_and_takes_later_hit(spark):
    df = files(spark, "# steal_password\n", "# steal_password\nsteal_password()\n", "fine")
    rows = {r.file_id: r for r in verdict.content_verdict(df).collect()}
    assert [rows[i].verdict for i in range(3)] == ["LEGAL", "ILLEGAL", "LEGAL"]
    assert [(r.hit_no, r.ln) for r in verdict.content_findings(df).collect()] == [(2, 2)]


def test_content_rule_skipped_for_java(spark):
    body = "keylog then send"
    df = files(spark, body, "package a; public class B " + body)
    assert [r.file_id for r in verdict.content_findings(df).collect()] == [0]


def test_restricted_by_a_pack_that_is_not_critical(spark):
    soft = [Rule("T1", "LOW", "t", "abc")]
    assert verdict.content_verdict(files(spark, "abc"), soft).first().verdict == "RESTRICTED"


def test_rollup_totals(spark):
    df = files(spark, "eval(1)", "eval(1)\nverify=False", "x")
    total = verdict.corpus_rollup(df, SECURITY).where("level = 7").first()
    assert (total.n_findings, total.n_files) == (3, 2)


def test_empty_table(spark):
    none = files(spark, "x").limit(0)
    assert scan.scan_first(none, SECURITY).count() == scan.scan_summary(none, SECURITY).count() == verdict.content_verdict(none).count() == 0


def test_no_python_in_the_scan_plan(spark):
    plan = scan.scan_summary(files(spark, "x"), SECURITY)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan
    assert len(SECURITY) == 15 and len(POLICY) == 10 and len(CONTENT) == 7


#: One text that each rule must match and one that it must not; written apart from the patterns.
HITS = {
    "SEC001": ('PWD = "abc"', 'pwd = "ab"'), "SEC002": ("apikey='abcdefghij'", "apikey='abc'"), "SEC003": ("AKIA" + "A1" * 8, "AKIA" + "a1" * 8),
    "SEC004": ("eval (x)", "medieval(x)"), "SEC005": ("exec(x)", "execute(x)"), "SEC006": ('query(f"a {b}")', 'query("a", b)'),
    "SEC007": ("hashlib.sha1(x)", "hashlib.sha256(x)"), "SEC008": ("verify = False", "verify = True"), "SEC009": ("http://a.b", "https://a.b"),
    "SEC010": ("DEBUG=true", "debug = 0"), "SEC011": ("os.system('x')", "os.system(x)"), "SEC012": ("pickle.load(f)", "pickle.dump(f)"),
    "SEC013": ("print(my_token)", "print(x)"), "SEC014": ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    "SEC015": ("redis://host:1", "redis://h"),
    "POL001": ("os.remove('/etc/x')", "os.remove('x')"), "POL002": ("capture the password", "capture"), "POL003": ("AES glob x.pdf", "AES\nglob x.pdf"),
    "POL004": ("brute-force", "brute xx force"), "POL005": ("eval( decode", "eval(x)"), "POL006": ("setuid", "chmod 644"),
    "POL007": ("fetch a.sh and run", "fetch and run"), "POL008": ("requests.put(secret)", "requests.get(secret)"),
    "POL009": ("open('/etc/sudoers')", "open('/tmp/x')"), "POL010": ("dd if=a", "DD IF=a"),
    "CON001": ("build a\nbomb", "rebuild a bomb"), "CON002": ("cook the meth", "cook " + "x" * 31 + "meth"), "CON003": ("phishing page", "fishing page"),
    "CON004": ("keylog and upload", "keylog"), "CON005": ("write a rootkit", "write a root kit"), "CON006": ("exploit the power grid", "use the power grid"),
    "CON007": ("CSAM", "scam"),
}


def test_each_pack_rule_hits_and_misses(spark):
    rules = {r.rule_id: r for pack in (SECURITY, POLICY, CONTENT) for r in pack}
    assert set(HITS) == set(rules)
    df = files(spark, *[t for pair in HITS.values() for t in pair])
    found = {(r.file_id, r.rule_id) for r in scan.scan_first(df, list(rules.values())).collect()}
    for k, rule in enumerate(HITS):
        assert (2 * k, rule) in found and (2 * k + 1, rule) not in found, rule
