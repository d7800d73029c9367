import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, block int, bucket int, n_words long, target double, host string, count long, label int, bits int"
PASSAGE = " ".join(f"pass{i} of" for i in range(30))


def rows_of(texts):
    """(doc_id, text, source) as rows of SCHEMA: columns whose names operators use inside are there too."""
    return [(i, t, "en", s, None if t is None else len(t), 1, 2, 3, 4, 5, 6.0, "h", 7, 1, 8) for i, t, s in texts]


def edge_rows():
    """Null, empty, blank and very long texts, equal and near texts, repeated rows, null ids and sources."""
    base = [f"w{i}x" for i in range(120)]
    near = [*base[:60], "other", *base[61:]]
    long = " ".join(f"t{i}" for i in range(40_000))
    texts = [
        (1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), None), (4, None, "a"), (5, "", "a"), (6, " \t\n\x0b ", "b"),
        (7, long, "a"), (8, f"{long} end", "c"), (9, "Ünï ÇÖDÉ ẞ 漢字 🙂 a\u00a0b", "b"), (10, "one two three", "a"), (11, "One TWO three", "c"),
        (12, f"start here {PASSAGE} and an end", "b"), (12, f"start here {PASSAGE} and an end", "b"), (None, "no id at all in this row of text", "a"),
        (None, None, None), (13, "same same same same " * 40, "c"), (14, "x" * 200_000, "c"), (15, "a\nb\na\n\nb\r\nb", "b"),
    ]
    return rows_of(texts + [(100 + i, " ".join(f"s{j * 7 + i}" for j in range(30 + i % 9)), "abc"[i % 3]) for i in range(60)])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
