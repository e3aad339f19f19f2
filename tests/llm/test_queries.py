"""Registered corpus queries: their SQL, and the pipeline stage by stage."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from codesieve.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(map(plain, r)) for r in cur.fetchall())


def test_all_are_registered():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)] + ["mixing", "quality"]


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    from codesieve.llm import exact_dedup, mixing, quality, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality.quality(docs, labels).collect() if r.kept}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in after} == kept and 0 < len(after) < len(before)
        elif name == "exact_dedup":
            best = defaultdict(int)
            for r in before:
                best[r.text] = max(best[r.text], r.doc_id)
            assert {r.doc_id for r in after} == set(best.values())
        elif name == "simhash_near_dedup":
            fps = {r.doc_id: simhash.simhash(r.text) for r in before}
            left = {r.doc_id for r in after}
            assert all(any(bin(fps[i] ^ fps[j]).count("1") <= 4 for j in left) for i in set(fps) - left)
            assert all(bin(fps[i] ^ fps[j]).count("1") > 4 for i in left for j in left if i < j)
        elif name == "mix_sources":
            words = defaultdict(int)
            for r in after:
                words[r.source] += len(r.text.encode().split())
            plan = mixing.mix_sources(spark.read.parquet(str(tmp_path / str(k - 1)))).collect()
            targets = {r.source: r.target for r in plan}
            assert all(abs(words[s] - t) < 20 for s, t in targets.items())
    assert docs.agg({"length": "max"}).first()[0] <= 4096
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
