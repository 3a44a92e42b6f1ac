"""Null, empty, repeated and very long rows, clashing columns and empty tables, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import decontam, html_main, line_dedup, mixing, near_dup, pii, quality, secret_scan, substring_dedup, token_counts

REPORTS = {
    "lines": line_dedup.line_report,
    "secrets": secret_scan.report,
    "substrings": substring_dedup.factored,
    "pii": pii.report,
    "mixture": mixing.mixture,
    "quality": quality.verdicts,
    "near": lambda d: near_dup.near_duplicates(d)[0],
}


@pytest.fixture(scope="module")
def tokens():
    public = pytest.importorskip("public_tokenizers")
    return lambda d: token_counts.counted(d, public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", [*REPORTS, "tokens"])
def test_reports(name, edge, empty, request):
    report = REPORTS.get(name) or request.getfixturevalue("tokens")
    rows = report(edge).collect()
    assert len(rows) == edge.count()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r.doc_id or 0 for r in edge.select("doc_id").collect())
    assert report(empty).count() == 0
    if name == "near":
        by = {r.doc_id: r for r in rows if r.doc_id not in (None, 2)}
        assert by[1].component_id == 1 and by[1].kept and by[10].component_id == 1 and not by[10].kept
        assert by[7].component_id == 1 and by[3].n_shingles == 0 and by[3].kept and by[11].n_shingles == 1
    if name == "substrings":
        by = {r.doc_id: r for r in rows if r.doc_id not in (None, 2)}
        assert by[1].n_removed == 0 and by[10].n_removed == 80 and by[7].n_removed == 80 and by[7].n_words == 81
    if name == "lines":
        by = {r.doc_id: r for r in rows if r.doc_id not in (None, 2)}
        assert by[9].n_lines == 3 and by[9].removed_lines == "3" and by[10].removed_lines == "0" and by[3].n_lines == 0
    if name == "mixture":
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        assert {r.doc_id: r.size for r in rows if r.doc_id}[3] == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, edge, empty, sf_dir):
    name, run = stage
    out = run(spark, edge, sf_dir)
    added = [c for c in out.columns if c not in edge.columns]
    assert out.columns[: len(edge.columns)] == edge.columns and len(added) == (name == "mixing sources")
    rows = out.collect()
    if name == "mixing sources":
        assert added == ["copy_"]
    else:
        assert {r.doc_id for r in rows} <= {r.doc_id for r in edge.select("doc_id").collect()}
        assert any(r.doc_id == 1 for r in rows)
    if name == "minhash near-dedup":
        assert {r.doc_id for r in rows} == {None, 1, 3, 4, 5, 6, 8, 9, 11}
    assert run(spark, empty, sf_dir).count() == 0


def test_empty_benchmark(edge, spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id < 0")
    assert decontam.contaminated(edge, none).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>a &amp; b<br>c</p>"), (None, "u", "<article><p>x</p></article>"), (4, "u", "<article><p>" + "word " * 300_000), (4, "u", "<unfinished")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_main.extracted(df).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert next(r.text for r in out if r.page_id == 1) == "" and max(r.n_chars for r in out) == 5 * 300_000 - 1
    assert html_main.extracted(df.where("page_id > 9")).count() == 0
