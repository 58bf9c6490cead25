"""The contract queries and the pipeline over the small tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylog.llm import queries
from quarrylog.llm.common import standing

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pivot_near_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op2_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op3_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_line_dedup": {"doc_id", "n_lines", "n_removed", "kept_md5"},
    "op5_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_quality_classifier": {"doc_id", "log_weight", "gumbel_key", "selected"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(spark, name):
    got = queries.queries()[name](spark, DIR)
    table = "embeddings" if name.startswith("op1_") else "documents"
    assert COLUMNS[name] <= set(got.columns) and got.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op4_line_dedup", "op9_mixing", "training_inputs"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DIR).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        assert k + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] < before and sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[3] > sizes[2] and sizes[4] == sizes[3]
    out = corpus_pipeline.run(spark, DIR)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == sizes[-1]
    assert sorted(r.ids_sha256 for r in out.collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_pipeline_deletes_superseded_tables(spark, tmp_path):
    """A stage's own tables go when the next one starts on its written result; an unwritten result keeps what it reads."""
    docs, start = spark.read.parquet(f"{DIR}/documents.parquet"), standing()
    (_, quality), (_, lines) = corpus_pipeline.STAGES[:2]
    quality(spark, docs, DIR).write.parquet(str(tmp_path / "kept"))
    own = standing() - start
    lines(spark, spark.read.parquet(str(tmp_path / "kept")), DIR)
    assert own and not own & standing()
    before = standing()
    unwritten = quality(spark, docs, DIR)
    needed = {p for p in standing() - before if any(p.rsplit("/", 1)[1] in f for f in unwritten.inputFiles())}
    assert needed and lines(spark, unwritten, DIR).count() == unwritten.count() and needed <= standing()
    before = standing()
    out = corpus_pipeline.run(spark, DIR)
    assert len(standing() - before) == 1 and before <= standing() and out.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(docs, empty, spark, k):
    """Null and empty texts, ties, repeated rows, null ids and columns that are named as the operators' own; and no row at all."""
    name, stage = corpus_pipeline.STAGES[k]
    named = docs.withColumns({c: F.lit(f"own {c}") for c in ("selected", "log_weight", "gumbel_key", "n_lines", "n_removed", "copies", "row", "component", "__row")})
    out = stage(spark, named, DIR)
    assert stage(spark, empty, DIR).collect() == []
    if name == "tokenize":
        assert out.count() == docs.count()
        return
    assert out.columns == named.columns and 0 < out.count() and out.where("selected != 'own selected' or n_removed != 'own n_removed' or copies != 'own copies'").count() == 0
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    before = Counter((r.doc_id, r.text) for r in named.collect())
    if name == "line dedup":
        assert sorted(map(repr, (i for i, _ in kept.elements()))) == sorted(map(repr, (i for i, _ in before.elements())))
    elif name == "mix sources":
        assert all(n <= 2 * before[x] for x, n in kept.items())
    else:
        assert all(n <= before[x] for x, n in kept.items())
    if name == "near dedup":  # one of equal texts, null and empty being equal
        assert len(kept) == sum(kept.values()) and {t or "" for _, t in before} >= {t or "" for _, t in kept}
