"""Rows that every operator is held against: nulls, empty and long texts, ties, equal rows, clashing columns."""

import random

CLASH = "row long, n long, word string, block int, h string, x string, line string, key string, cid string, length string, first string, gone string, wanted string"


def frame(spark, rows, parts=3):
    """doc_id, text and lang, and columns whose names the operators also use inside."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    full = [(d, t, lang, *[7 if "long" in c or "int" in c else c for c in CLASH.split(", ")]) for d, t, lang in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, {CLASH}").repartition(parts).select("doc_id", *names, "lang", "text")


def rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(200)]

    def sentence(k):
        return " ".join(rng.choice(words) for _ in range(k)) + rng.choice([".", "!", "", "  ", "\t"])
    shared = [sentence(rng.choice([3, 12, 40])) for _ in range(8)]
    out = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.3 else sentence(rng.choice([1, 4, 9, 30])) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), rng.choice(["en", "fr", None])))
    out += [(100, None, "en"), (None, None, None), (101, "", "en"), (102, " \n\t\n ", "fr"), (None, out[3][1], "en"), (103, out[3][1], "en")]
    out += [(104, "a b c\nsame id", "en"), (104, "other text, same id", "en")] + [(105, out[5][1], "fr")] * 2
    out += [(106, " ".join(rng.choice(words) for _ in range(30_000)), "en"), (107, "日本語 текст 🙂 ́ \x85 ", "xx"), (108, "q" * 3000, "en")]
    rng.shuffle(out)
    return out


def key(row):
    return [(False, x) if isinstance(x, (str, bytes, tuple)) else (x is None, x or 0) for x in row]
