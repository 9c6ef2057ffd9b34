import random

import pandas as pd
import pytest

COLUMNS = {"doc_id": "int64", "text": "object", "lang": "object", "source": "object", "n_chars": "int64"}


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("aeioustrnl", k=r.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, base, hub = say(70), say(120), say(200)
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t ", "de", None, 4), (3, "Ein", None, "b", 3),
        (4, "1234 567 -- !!", "en", "b", 14), (None, say(40), "en", "c", 5), (None, None, None, None, None),
        (5, base, "en", "a", 9), (6, base, "en", "a", 9), (7, base.upper(), "fr", "b", 9),
        (8, base.replace(" ", "\n", 5), "fr", "b", 9), (8, base.replace(" ", "\n", 5), "fr", "b", 9),
        (9, say(30) + "\n" + passage + " " + say(30), "es", "c", 1),
        (10, passage + " " + say(200), "es", "c", 1), (11, say(60) + " " + passage, "de", "c", 1),
        (12, passage, "en", "é", 1), (12, say(80), "en", "z", 1),
        (13, "x" * 30_000 + " " + say(6000), "en", "a", 1), (14, "wort " * 300, "de", "a", 1),
        (15, ("zeile eins zwei drei\n" * 30), "de", "b", 1), (16, "one two three", "en", "b", 1),
        (17, "日本語 テキスト 🙂 " + say(30), "en", "b", 1), (18, "\x0b\x0c\r", "en", "b", 1),
        (19, "ab cd ef gh", "en", "b", 1), (20, "Ab CD ef gh", "en", "b", 1),
    ]
    # a hub and copies of it that resemble the hub but not each other
    rows.append((30, hub, "en", "a", 1))
    for i in range(12):
        w = hub.split()
        for k in range(1 + i * 15, 1 + i * 15 + 12, 12):
            w[k] = f"new{i}"
        w[(i * 7 + 3) % 200] = f"other{i}"
        rows.append((21 + i if i < 9 else 40 + i, " ".join(w), "en", "a", 1))
    return rows


def write(folder, rows, labels) -> str:
    """documents (with columns whose names the operators use themselves) and labels."""
    d = pd.DataFrame(rows, columns=list(COLUMNS)).astype(
        {"doc_id": "Int64", "n_chars": "Int64", "text": "string", "lang": "string", "source": "string"})
    for c in ("key", "h", "o", "s", "w", "rid", "quality", "range", "kept_id", "cuts", "mix_rid", "n"):
        d[c] = 1
    d.to_parquet(folder / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64").to_parquet(folder / "labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    rows = edge_rows()
    labels = [(r[0], int(i % 3 > 0), int(i % 5 == 0)) for i, r in enumerate(rows) if r[0] is not None]
    return write(tmp_path_factory.mktemp("edge"), rows, labels + [(None, 1, 0), (999, None, None)])


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [])
