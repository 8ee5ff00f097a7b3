"""The corpus pipeline: each stage on its own input against brute force."""

import collections

import pytest
from pyspark.sql import functions as F

from breakline.llm import queries

from .test_operators import LOW, brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("text IS NOT NULL").first().text
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        a, b = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
        assert set(b) <= set(a) and all(a[i] == t for i, t in b.items())
        if name == "toxicity":
            assert 0 < len(a) - len(b) < 0.25 * len(a)
        elif name == "exact dedup":
            keep = collections.defaultdict(int)
            for i, t in a.items():
                keep[(t or "").translate(LOW)] = max(i, keep[(t or "").translate(LOW)])
            assert set(b) == set(keep.values())
        elif name.startswith("n-gram"):
            want = brute_components([(i, t, "") for i, t in a.items()], 5, 80)
            assert set(b) == {i for i, (_, c) in want.items() if c == i}
        elif name.startswith("benchmark"):
            assert all(" ".join(item.split()) not in " ".join((t or "").split()) for t in b.values()) and len(b) > 0.8 * len(a)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before = after
    assert after.filter("taken <= 0 OR taken > 2 * size").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == after.count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_every_query_runs(spark, sf):
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 13


def test_stages_with_clashing_columns_null_and_repeated_ids(spark, tmp_path):
    """Every stage judges rows by their texts, whatever their ids and further columns."""
    words = [f"w{k}" for k in range(200)]
    long = [" ".join(words[(i * 13 + k) % 200] + str(i) for k in range(40)) for i in range(8)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    texts = [*long, long[0].upper(), long[0], long[1] + " one", long[2] + " two", f"{long[3]} {item}", "you scum", None, "", "", None, long[4], long[4]]
    ids = [1, 1, 2, 2, None, None, 7, 8, 9, None, 1, 7, 8, 9, 10, 11, 12, None, 20, 20]
    columns = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, _id long, _sha string, _hit long, row long, rid long"
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, 1, 5, "x", 6, "y", 7, k, 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in stages.items()}
    every = set(range(len(rows)))
    assert {r.row for r in out["toxicity"]} == every
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[(t or "").translate(LOW)].append(k)
    assert len(out["exact dedup"]) == len(groups) == len({(r.text or "").translate(LOW) for r in out["exact dedup"]})
    assert all(r.doc_id == max((ids[k] for k in groups[(r.text or "").translate(LOW)] if ids[k] is not None), default=None) for r in out["exact dedup"])
    want = brute_components([(k, t, "") for k, t in enumerate(texts)], 5, 80)
    kept = [r.row for r in out["n-gram Jaccard join"]]
    assert sorted(want[k][1] for k in kept) == sorted({c for _, c in want.values()})
    assert {r.row for r in out["benchmark decontamination"]} == every - {12}
    mixed = out["mixing sources"]
    assert all(0 < r.taken <= 2 * r.size and r["size"] == len((r.text or "").split()) for r in mixed)
    total = sum(len((t or "").split()) for t in texts)
    assert abs(sum(r.taken for r in mixed) - 1.5 * total) <= 4
    assert all(set(r.asDict()) == {c.split()[0] for c in columns.split(", ")} for rows_ in out.values() for r in rows_)


def test_stages_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_hold_when_the_cluster_changes_between_two_reads(spark, sf, tmp_path, monkeypatch, name):
    """Files are split by the cores of the moment; a stage that reads its table twice must not mistake rows for others."""
    from breakline.llm import common, decontaminate, exact_dedup, mixing, ngram_join, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    docs.union(docs.limit(40)).write.parquet(str(tmp_path / "docs"))
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(map(str, stage(spark, docs, sf).collect()))
    turns = iter(range(1000))

    def shifting(df, *args):
        out = common_cut(df, *args)
        k = next(turns) % 3
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", (16, 2, 7)[k])
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("40k", "90k", "2m")[k])
        return out

    common_cut = common.cut
    for module in (common, decontaminate, exact_dedup, mixing, ngram_join, toxicity):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", shifting)
    try:
        got = sorted(map(str, stage(spark, docs, sf).collect()))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_rows_keep_their_numbers(spark, tmp_path):
    from breakline.llm.common import numbered

    spark.range(1000).withColumn("row", F.col("id") % 3).repartition(4).write.parquet(str(tmp_path / "t"))
    docs, found = spark.read.parquet(str(tmp_path / "t")), []
    for parallel in (1, 9, 40):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallel)
        rows, name = numbered(docs)
        found.append({r["id"]: r[name] for r in rows.collect()})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert name != "row" and found[0] == found[1] == found[2] and len(set(found[0].values())) == 1000
    joined, name = numbered(docs.join(docs.select(F.col("id").alias("other")), F.col("id") % 500 == F.col("other") % 500))
    assert joined.select(name).distinct().count() == joined.count() == 2000
