import random

from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import bpe


def test_run_against_planted_cases(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: prose(60) for i in range(200)}
    toxic = {i: f"{prose(20)} zorgblat {prose(20)} vexnurk {prose(5)}" for i in range(200, 280)}
    passage = prose(30)
    planted = {300: f"{prose(20)} {passage} {prose(5)}", 301: None, 302: ""}
    copies = {310: prose(80)}
    copies |= {311: copies[310] + " end", 312: copies[310]}
    lines = {i: f"{prose(20)}\n  Shared LINE of all \n{prose(12)}" for i in range(320, 332)}
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in (texts | toxic | planted | copies | lines).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*range(0, 150), *range(200, 260)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    cut = corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).filter(F.col("doc_id") >= 320).collect()
    expected = {i: "\n".join(t.split("\n")[::2]) for i, t in lines.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut} == {i: (t, len(t)) for i, t in expected.items()}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = texts | {301: "", 302: "", 310: copies[310]} | expected
    assert set(got) == set(kept)
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    assert all(got[i].ids == tokenizer.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids) for i, t in kept.items())
