import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own, and one that differs in case only.
CLASHES = ["shard", "slot", "size", "n", "cls", "rep", "key", "salt", "part", "band", "kept", "digest", "bucket", "label", "Text", "__chunk", "spans", "docs"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with extra columns of clashing names."""

    def build(rows, clashes: bool = True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if not clashes:
            return df
        extra = ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in full], f"{DOCS}, {extra}")

    return build


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a long text."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20_000))
    plain = "the quick brown fox jumps over the lazy dog and then it runs away from all of the other animals in the wood again"
    return [(1, plain), (2, plain), (2, plain), (None, plain), (3, None), (4, ""), (5, " \t\n"), (6, "x"), (7, long), (8, "naïve café – 東京 🙂 <|endoftext|> end"), (None, None), (9, "one two"), (10, "One  TWO")]
