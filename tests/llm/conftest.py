import random

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Rows with nulls, empty and long texts, repeated rows, ties, and columns whose names clash with results."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = " ".join(rng.choice(words) for _ in range(400))
    near = base.replace(base.split()[200], "changed", 1)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, near, long, "x" * 50_000, "日本語 テキスト ▁ <s> é́", "<|endoftext|> the <|startoftext|>",
             "it's 12 o'clock, isn't it?", "ΑΣ Σ ßİ ǅ Ⅷ ½ \x85 \xa0 nbsp", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    rows = [(i, t, rng.choice(["en", "de", None]), 1, "x", 2.0) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a row without id", "en", 1, "x", 2.0), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, piece int, component_id string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
