import numpy as np
import public_tokenizers

from claimspark.llm import attention
from claimspark.llm.attention import Attention, Tree


def test_texts_are_encoded_once_and_read_as_ids(spark, monkeypatch):
    staged, tables = {}, []
    kept = attention.stage
    monkeypatch.setattr(attention, "stage", lambda df, name: staged.setdefault(name, kept(df, name)))
    monkeypatch.setattr(attention, "fitted", lambda train, frequency: tables.append(train) or Attention(Tree(frequency)))
    docs = spark.createDataFrame([(i, f"word{i} again and again") for i in range(40)] + [(40, None)], "doc_id long, text string")
    got = attention.text_scores(docs, public_tokenizers.path("byte_bpe_50k.json"))
    written = set(staged["encoded"].inputFiles())
    assert "ids" in tables[0].columns and set(tables[0].inputFiles()) <= written
    assert set(got.inputFiles()) <= written | set(staged["word-counts"].inputFiles())
    assert [r["score"] < 0 for r in got.collect()] == [True] * 41


def test_targets_that_are_not_new_change_nothing():
    model = Attention(Tree(np.arange(30)))
    model.table[:] = np.random.default_rng(2).normal(0, 0.3, model.table.shape)
    given, target, new = attention.windows(np.arange(100) % 29, 30)
    assert np.array_equal(model.logs(given, target, new), model.logs(given, target) * new)
