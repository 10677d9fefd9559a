import collections

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import PROSE, components, words

from keystrata.llm.queries import default_tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    import random

    r = random.Random(3)
    text = lambda n: " ".join(f"t{r.randrange(5000)}" for _ in range(n)) + "."
    item = text(15)
    rows = [(i, text(40), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200, PROSE.replace("w7 ", "x "), "en", "s1"), (201, PROSE, "en", "s1"), (202, "short.", "en", "s1"), (203, None, "en", None), (204, text(20) + " " + item + " " + text(9), "en", "s2"), (205, "menu | a | b | c | d | e\n" * 9, "en", "s3"), (None, text(30), None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    states = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        states.append(docs.collect())
    quality, near, clean, mixed, out = states
    assert all(s and list(s[0].asDict()) == corpus_pipeline.COLUMNS for s in states[:-1])
    assert {x[0] for x in rows} - {d.doc_id for d in quality} == {202, 203, 205}
    group = components([(d.doc_id, d.text) for d in quality], 80)
    assert sorted(d.doc_id for d in near if d.doc_id is not None) == sorted({*group.values()}) and any(d.doc_id is None for d in near)
    assert {d.doc_id for d in near} - {d.doc_id for d in clean} == {204}
    taken = collections.Counter(d.doc_id for d in mixed)
    assert max(taken.values()) <= 3 and {*taken} <= {d.doc_id for d in clean}
    total = sum(len(words(d.text)) for d in clean)
    assert abs(sum(len(words(d.text)) for d in mixed) - total) < 0.05 * total
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter((d.doc_id, len(plain.encode(d.text, add_special_tokens=False).ids) + 1) for d in mixed)
    assert collections.Counter((d.doc_id, d.n_tokens) for d in out) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)


def test_shards_keep_the_training_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of many", "en", f"s{i % 3}", 14) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs.withColumn("position", F.lit(None).cast("double")), str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    want = [r.doc_id for r in sorted(mixed.collect(), key=lambda r: (r.position, r.doc_id))]
    out = corpus_pipeline.token_output(spark, mixed, str(tmp_path)).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == want != sorted(want)


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
