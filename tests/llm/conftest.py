import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows: nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    plain = [f"the cat number {k} sat on the mat and looked at bird {k * 7} over there" for k in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(plain)]
    rows += [(k + 100, f"el gato numero {k} mira la luna y canta una cancion de {k * 3} palabras", "es", None if k % 4 == 0 else "s1", 5) for k in range(30)]
    rows += [(200, None, "en", "s0", None), (201, "", "es", "s1", 0), (202, " \n\t ", None, None, 3), (203, "123 456 !!", "en", "s2", 10), (None, "a text without an id", "en", "s0", 20), (None, None, None, None, None)]
    rows += [(204, "long words here " * 20_000, "en", "s1", 320_000), (205, plain[3], "en", "s0", 3), (205, plain[3], "en", "s0", 3), (206, "Été à Noël, ça va? ÀÉ " * 5, "fr", "s2", 9), (207, "emoji 😀 and a surrogate pair 𝒳 letter", "en", "s2", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "fp", "row", "size", "component_id", "key", "target", "labels", "raw", "taken", "weight", "a.b"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, int(k % 5 != 0), 0) for k in range(30)] + [(100 + k, 1, 0) for k in range(10)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
