import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words of a fixed sequence."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_rows():
    """doc_id, text of documents with every awkward case; ids are unique unless a row repeats as a whole."""
    shared = prose(1, 70)
    long = prose(2, 30_000)
    return [
        (0, None), (1, ""), (2, "   "), (3, "one"), (4, "two words"), (5, shared), (6, "head " + shared + " tail"), (7, shared.upper()), (8, shared), (8, shared),
        (9, long), (10, long[: len(long) // 2] + " changed " + long[len(long) // 2 :]), (11, "x" * 5000), (12, "ab " * 400), (13, "Ünïcode ñandú — “quoted” 漢字 " * 10), (None, shared), (14, "\x00\x01 ctl"),
        (15, prose(3, 60) + " " + shared), (16, "!!! 123 ???"), (17, prose(4, 9)), (18, prose(4, 9)),
    ]


DDL = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, score double, spans int, runs int, h long, n int, x int, kept string, component_id long"


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows with nulls in other columns and columns whose names operators use too."""
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, k, "big", 0.5, 1, 2, 3, 4, 5, "k", 6) for k, (i, t) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
