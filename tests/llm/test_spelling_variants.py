import random
import re
import zlib
from collections import Counter

import duckdb

from skerry.llm import spelling_variants as sv
from tests.llm import helpers as h


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs, s):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            x = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if x % s.edit_every == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= s.min_length and k >= s.min_count}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    best = {w: min(own, key=lambda x: (-n[x], x)) for w, own in near.items() if own}
    form = {w: best[w] if w in best and n[best[w]] >= s.ratio * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in h.rows(df))


def _docs(seed=3):
    """Words over few letters with copies that chain, among them very long and repeated-letter ones."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(4, 9))) for _ in range(250)]
    words += ["planet", "planets", "plänet", "PLANET", "plane", "lanet", "xplanet", "a" * 400, "a" * 399, "a" * 401, "×÷øßÿ", "xy"]
    docs = [(i, " ".join(w for w in words for _ in range(draw.choice((0, 1, 1, 2, 5)))) + draw.choice((".", "\n1", "_"))) for i in range(6)]
    return docs + [(None, "planet planet planets"), (2, "planet"), (2, "planet"), (9, None), (10, ""), (12, "gardenxy " * 3 + "gardenx " * 7 + "garden " * 15), (11, " 12 34 ")]


def test_variants_equal_all_pairs(spark):
    docs = _docs()
    for s in (sv.Settings(), sv.Settings(edit_every=3), sv.Settings(min_length=2, min_count=1, ratio=1, edit_every=5)):
        if s.ratio > 1:
            want = plain(docs, s)
            assert sum(w[4] > 0 for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)
            for block in (20_000, 4):  # groups dealt out anew
                assert found(sv.variants(h.table(spark, docs, more=h.CLASHING), sv.Settings(s.min_length, s.min_count, s.ratio, s.edit_every, block))) == want
        else:
            words = sv.count_words(h.table(spark, docs), s)
            pairs = {(r["word"], r["near"]) for r in h.rows(sv.near_words(sv.meetings(words, s), chars=50))}
            own = [r["word"] for r in h.rows(words)]
            assert pairs == {(a, b) for a in own for b in own if _one_edit(a, b)}


def test_tables_without_words(spark):
    assert found(sv.variants(h.table(spark, ["x"]).limit(0))) == []
    assert found(sv.variants(h.table(spark, [None, "", "one two"]))) == []


def test_automaton_numbers_its_words_and_shares_states():
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 8))) + draw.choice(("", "ing", "ings")) for _ in range(400)})
    a = sv.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zz") is None and a.number(words[0] + "q") is None
    assert len(a.edges) < sum(len({w[:i] for w in words if len(w) >= i}) for i in range(1, 11)) // 2
    for w in words[::7]:
        for exact in range(len(w)):
            assert {words[k] for k in a.near(w, exact)} == {x for x in words if x[:exact] == w[:exact] and len(x) >= exact and _one_edit(w[exact:], x[exact:])}
    assert sv.Automaton([]).near("abc", 1) == set()


def test_long_runs_are_searched_in_a_step_a_character():
    a = sv.Automaton(["a" * 20_000, "a" * 20_001])
    assert a.near("a" * 20_000, 10_000) == {1} and a.near("a" * 20_001, 10_000) == {0}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((r[0], r[1] or "", r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in con.execute(sv.oracle()).fetchall())
    assert len(want) > 1000 and found(sv.query(spark, "/root/testdata/sf0.001")) == want
