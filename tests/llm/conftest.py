import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents():
    """Nulls in every column, empty, very long, tied and repeated rows, control characters, non-ASCII and near copies."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "naïve", "ZETA", "eta", "theta", "iota", "kappa", "lambda", "mu", "x1", "42"]
    plain = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(plain)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t\n", "de", "s1", 3), (103, long, "en", "s0", len(long)), (104, long + " end", "en", None, 0),
             (105, plain[5], "en", "s1", 1), (105, plain[5], "en", "s1", 1), (106, plain[5].upper(), "en", "s2", 1), (None, plain[6], "en", "s2", 2), (None, None, None, None, None),
             (107, "one", "en", "s3", 3), (108, "one two", "en", "s3", 7), (109, "a\x0bb\x0cc d e", "fr", "s3", 9)]
    return rows
