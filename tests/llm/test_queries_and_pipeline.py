"""Queries with a SQL form against it, and the pipeline against its stages in plain Python."""

import math

import pytest
from test_operators import components, cut_words, rows_of

import corpus_pipeline
from tapewright.llm.queries import ORACLES, QUERIES


def canonical(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    wanted = [tuple(map(canonical, r)) for r in cursor.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, wanted))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    rows = rows_of(docs)
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe"]
    first = by_name["language_id"](spark, docs, sf_dir)
    assert first.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(rows_of(first)) == sorted((i, t) for i, t in rows if any(c.isalpha() for c in t or ""))
    near = by_name["ngram_jaccard_join"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, n, c in components(rows) if n == 0 or c == i)
    cut = {r["doc_id"]: r["text"] for r in by_name["substring_dedup"](spark, docs, sf_dir).collect()}
    texts = dict(rows)
    assert cut == {i: kept if gone else texts[i] for i, _, gone, kept in cut_words(rows)}


def test_whole_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(len(r["ids"]) == r["n_tokens"] for r in out) and len({r["doc_id"] for r in out}) == len(out)


def test_near_copies_of_five_word_shingles(spark, sf_dir):
    words = [f"w{i}" for i in range(204)]  # 200 shingles of five words
    edited = lambda a, z: " ".join(words[:a] + [f"new{i}" for i in range(a, z)] + words[z:])
    # a contiguous edit of k words loses k + 4 shingles of five: 178 / 222 is 0.802 (4 words: 180 / 222 is 0.811), 177 / 223 is 0.794
    texts = [" ".join(words), edited(80, 98), edited(80, 99).replace("w", "v"), " ".join(words).replace("w", "v"), "a b", "a b", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 6]


PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlike_documents_under_one_id_or_none_are_kept(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    rows = [(None, t, "en", "s", 1) for t in texts[:4]] + [(3, t, "en", "s", 1) for t in texts[4:]] + [(None, texts[0], "en", "s", 1), (3, texts[5], "fr", "s", 1)]
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, spark.createDataFrame(rows, PIPELINE_SCHEMA), "")
    assert sorted(r["text"] for r in kept.collect()) == texts


def test_a_corpus_without_labels_keeps_its_documents(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some words", "плюс", "123 ...", None, ""])]
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, spark.createDataFrame(rows, PIPELINE_SCHEMA), "")
    assert sorted((r["doc_id"], r["lang"]) for r in kept.collect()) == [(0, None), (1, None)]


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], PIPELINE_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        docs = out if name != "bpe" else docs


def test_the_identified_language_reaches_the_result(spark):
    stages = dict(corpus_pipeline.STAGES)
    english, german = "the house and the garden of the king", "das haus und der garten des alten mannes"
    rows = [(i, f"{english} {i}", "en", "s", 1) for i in range(20)] + [(i, f"{german} {i}", "de", "s", 1) for i in range(20, 40)]
    rows += [(40, english, None, "s", 1), (41, german, "en", "s", 1), (42, german, None, "s", 1)]
    found = stages["language_id"](spark, spark.createDataFrame(rows, PIPELINE_SCHEMA), "")
    out = {r["doc_id"]: r["lang"] for r in stages["bpe"](spark, found, "").collect()}
    assert (out[40], out[41], out[42]) == ("en", "de", "de") and len(out) == len(rows)


def test_the_last_stage_encodes_and_decodes_in_one_worker(spark):
    from tokenizers import Tokenizer

    texts = ["The king's house,  12 of them\n", "", None, "плюс <|endoftext|> minus", " wide \t blank", "a" * 300]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts * 3)], PIPELINE_SCHEMA)
    out = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    wanted = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts * 3)}
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["text"]) for r in out.collect()}
    assert got == {i: (ids, len(ids), library.decode(ids, skip_special_tokens=False)) for i, ids in wanted.items()}


def test_op4_encodes_and_decodes_in_one_worker(spark, sf_dir):
    from tapewright.llm.queries import QUERIES

    plan = QUERIES["op4_bpe_automaton"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
