"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

WORDS = "the quick brown fox jumps over a lazy dog near one quiet river bank while seven grey geese watch from tall reeds".split()


def text_of(seed: int, n: int = 60) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


def rows():
    base = text_of(1)
    near = base.replace(base.split()[30], "changed", 1)
    out = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, near, "en", "b"), (3, text_of(2), "de", "a"), (4, None, None, None), (5, "", "en", ""), (6, LONG, "en", "a"), (7, "Ünï código 123 don't <|endoftext|> x", "es", "c"),
        (8, text_of(3), "en", "a"), (8, text_of(3), "en", "a"), (9, "one", "en", "c"), (10, "one two", "en", "c"), (11, "  \t\n ", "en", "b"), (None, text_of(9), "en", "b"), (12, text_of(4) + "\n" + text_of(5), "en", "a"), (13, "Intro words here. " + text_of(5) + " end", "en", "b"),
    ]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, clash=True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        for name in ("fp", "words", "score", "epoch", "block", "start", "key", "kind", "n", "row", "_drop", "bucket", "label"):
            df = df.withColumn(name, df.doc_id)
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
