import zlib

import pyspark.sql.functions as F
import pytest
from test_minhash import brute as near_brute

import corpus_pipeline
from orrery.llm.queries import QUERIES as LLM_QUERIES
from orrery.llm.quality_rules import quality_rules
from orrery.llm.toxicity import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, out[-1], SF)
        assert rows.schema.fieldNames() == docs.schema.fieldNames()
        out.append(spark.createDataFrame(rows.collect(), docs.schema))
    return out


def test_filters_do_as_their_operators(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in stages]
    assert ids[1] == sorted(r.doc_id for r in quality_rules(stages[0], labels).filter("kept").collect())
    assert ids[2] == sorted(r.doc_id for r in toxicity(stages[1], labels).filter("predicted = 0").collect())
    assert ids[3] == [r[0] for r in near_brute([(r.doc_id, r.text) for r in stages[2].collect()], 5, 80) if r[3]]
    assert len(ids[3]) > 0.5 * len(ids[0])


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = stages[0].join(labels, "doc_id").filter((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.size(F.split("text", r"\s+")) > 25))
    n = good.count()
    assert good.join(stages[2].select("doc_id"), "doc_id", "left_semi").count() > 0.95 * n


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[3].select("doc_id").collect()}


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " more", None, None, None), (None, text, "en", "s", 1), (None, "x y", "en", "s", 1), (4, None, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert sorted((r.doc_id for r in near.collect()), key=str) == [1, 4, None, None]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert [r.doc_id for r in docs.collect()].count(1) == 1
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


#: Columns of every registered query by contract (more may follow), and the table whose rows it has one each of (None: not one each).
CONTRACT = {
    "op1_toxicity": ({"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "documents"),
    "op2_url_filter": ({"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}, "pages"),
    "op3_near_duplicates": ({"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}, "documents"),
    "op4_token_counts": ({"doc_id": "bigint", "n_tokens": "bigint"}, "documents"),
    "op5_quality_rules": ({"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}, "documents"),
    "op6_best_fit_packing": ({"doc_id": "bigint", "bin_id": "bigint"}, None),
    "op7_html_text": ({"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}, "pages"),
    "op8_quality_votes": ({"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "documents"),
    "op9_byte_bpe": ({"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, "documents"),
    "op10_fingerprints": ({"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}, "documents"),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_queries(spark, name):
    """Every registered operator over its whole table: columns, types, one row for each row, held-out rows and cuts of the score."""
    wanted, table = CONTRACT[name]
    df = LLM_QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {k: kinds.get(k) for k in wanted} == wanted
    rows = df.collect()
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if "held_out" in wanted:
        (m, left), least = {"op1_toxicity": ((3, 1), 0.7), "op8_quality_votes": ((5, 0), 0.3)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == left) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    if name == "op5_quality_rules":
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in rows)


def test_stages_take_clashing_columns_and_long_texts(spark):
    """Extra columns named as the operators' own, and a text of 200,000 words, through all stages but the last, which reports no such columns."""
    long = " ".join(f"w{i % 997}q{i // 997}" for i in range(200_000))
    fine = " ".join(f"plain{i}" for i in range(50))
    extra = ["score", "kept", "digest", "set_size", "n", "features", "predicted", "shard"]
    rows = [(1, long, "en", "s", 1, *"abcdefgh"), (2, fine, "en", "s", 1, *"abcdefgh"), (3, fine + " more", None, "s", 1, *"abcdefgh"), (None, fine, "en", "s", 1, *"abcdefgh"), (2, "unlike " + " ".join(f"other{i}" for i in range(50)), "en", "s", 1, *"abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        kept.collect()
    near = sorted(((r.doc_id, len(r.text)) for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()), key=str)
    assert [i for i, _ in near] == [1, 2, 2, None]
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {1, 2, 3, None}
