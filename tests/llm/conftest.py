import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash string, fp string, packed string, ids string, score string, range string"

_EN = "the cat sat on the mat and the dog looked at it for a very long time before it went away again to sleep"
_FR = "le chat dort sur la table et le chien regarde la fenêtre pendant que la pluie tombe sur les toits de la ville"
_DE = "der hund läuft über die straße und die katze schläft auf dem dach während es draußen regnet und stürmt"


def _rows():
    x = ("x",) * 7
    rows = []
    for i in range(60):
        lang, text = (("en", _EN), ("fr", _FR), ("de", _DE))[i % 3]
        words = text.split()
        words = words[i % 7 :] + words[: i % 7]
        rows.append((i, " ".join(words) + f" {words[i % 5]}.", lang, f"s{i % 4}", 1, *x))
    rows += [
        (100, None, "en", "s0", None, *x), (101, "", None, None, 0, *x), (102, " \n\t ", "en", "s1", 3, *x), (103, "1234 !!", None, "s1", 7, *x),
        (104, "Word", "en", None, 4, *x), (105, _EN, "en", "s0", 1, *x), (105, _EN, "en", "s0", 1, *x), (106, _EN, "en", "s2", 1, *x),
        (None, _FR, "fr", "s3", 1, *x), (None, _FR, "fr", "s3", 1, *x), (None, None, None, None, None, *x),
        (107, "long " * 30000 + "ende", "en", "s0", 1, *x), (108, "z" * 50000, None, "s0", 1, *x),
        (109, "<|startoftext|>Größe  ΣΑΣ́ 漢字 it's 1999 \x1cend\r\n\n  x<|endoftext|>", "de", "s1", 1, *x),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, blank and very long texts, copies, repeated ids and columns with clashing names."""
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in _rows()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
