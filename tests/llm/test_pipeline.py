import public_tokenizers
import tiktoken

import corpus_pipeline
from brute import DATA, cut_repeats, jaccard_groups, words
from tidemark.llm import bpe, scratch


def test_stages_equal_plain_versions(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        texts.append({r.doc_id: r.text for r in docs.collect()})
    clean, single, cut, last = texts
    assert set(single) == {i for i, _, least in jaccard_groups(list(clean.items()), 5, 4, 5) if i == least}
    removed = {i: n for i, _, n, _ in cut_repeats(list(single.items()), 50)}
    assert set(cut) == set(single) and all((cut[i] == single[i]) == (removed[i] == 0) for i in cut)
    again = {i: (len(words(t)), n) for i, t in cut.items() for n in [removed[i]]}
    assert all(left == len(words(single[i])) - n for i, (left, n) in again.items())
    items = [b" ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, t in cut.items() if any(b" " + x + b" " in b" " + b" ".join(words(t)) + b" " for x in items)}
    assert leaked and not leaked & set(last) and len(last) >= len(cut) - len(leaked) - 2
    codec = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in last.items()}


def _tables(spark, place, rows, extra=True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in ("tid", "component", "pid", "__cand", "score") if extra else ():
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)][: 4 * bool(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20))), (None, "none of this"), (2, None), (3, "")][: 4 * bool(rows)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_odd_rows(spark, tmp_path):
    """Null ids, null, empty and very long texts, repeated rows, extra columns whose names stages use inside."""
    long = " ".join(f"long{i}" for i in range(60_000))
    one = " ".join(f"one{i}" for i in range(30))
    rows = [(1, one, "en", "a"), (1, one, "en", "a"), (2, one + " more", "en", None), (3, None, None, None), (4, "", "en", "a"), (4, "", "en", "a"), (None, "a text without an id", "de", "b")]
    rows += [(5, long, "en", "a"), (6, "x " + " ".join(f"bench{i}" for i in range(20)) + " y", "en", "a"), (7, "wörd " * 40_000, "de", "a"), (8, "u" * 300_000, "en", "a")]
    place = _tables(spark, tmp_path / "odd", rows)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, place).collect()}
    assert set(got) == {1, 3, 4, None, 5, 7, 8}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[5].n_tokens > 60_000
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.written(stage(spark, docs, place), name)
        assert docs.columns == spark.read.parquet(f"{place}/documents.parquet").columns
    assert sum(r.doc_id == 1 for r in docs.collect()) == 1 and sum(r.doc_id == 4 for r in docs.collect()) == 2


def test_empty_tables(spark, tmp_path):
    place = _tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, place).count() == 0
