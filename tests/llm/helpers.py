"""Small documents for the operators' tests, and plain versions of what they share."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def table(spark, texts, lang="en", source="s", more=""):
    """Documents 0, 1, ... with these texts; a text may come as (doc_id, text)."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in pairs], SCHEMA)
    return df if not more else df.selectExpr("*", *(f"'x' AS {c}" for c in more.split()))


def edge_texts():
    """Null, empty, blank, one very long, two equal ones, other white space and letters."""
    long = prose(99, 30_000)
    return [None, "", " \n\t ", long, "same words here again and again " * 3, "same words here again and again " * 3, "ünïcödé 漢字 words here \x0b and\rthere", "one"]


CLASHING = "sig block tokens words key at _key _doc _text _words token grp first component_id score held_out row shard part"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return [root(i) for i in range(n)]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
