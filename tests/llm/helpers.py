import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    """A documents table of these texts, with ids in order."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n):
    import random

    r = random.Random(seed)
    parts = ["the", "er", "tion", "an", "re", "ment", "la", "ung", "ing", "st", "de", "con", "ver", "al", "ou"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
