from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def small_docs(spark):
    """doc_id, text, lang, source, and a column whose name clashes with those the operators make."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "délta", "EPS", "zeta9", "eta.", "theta", "ïota", "kappa", "don't", "mu", "###", "xi|"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(40) for _ in range(6)]
    texts = [None, "", "  \t\n ", "one", "One two", "a b c", "x" * 5000, line(6000)]
    texts += [base[0], base[0], base[0].upper(), base[1] + " tail", base[1] + " other tail"]
    for k in range(30):
        own = base[k % 6].split(" ")
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += ["\n".join(line(8) for _ in range(12)) for _ in range(10)] + ["same line\nsame line\n\nsame line\n" + line(30)] * 2 + [("rep eat these five words " * 9).strip()]
    texts += ["Text with odd\x0bspaces\x1fand\x85more", "emoji 🤖🤖 ok", "<|endoftext|> raw <|endoftext|>"]
    rows = [(k, text, "en", [None, "src1", "src0", "sé"][k % 4], k) for k, text in enumerate(texts)]
    rows += [(5, "a b c", "en", "src1", 1), (5, "another text under the same id", "en", "src1", 1), (None, base[0], "en", None, 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id long").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(small_docs):
    return small_docs.limit(0)
