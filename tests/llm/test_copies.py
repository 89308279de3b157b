import random

import numpy as np

from skerry.llm import blocks, decontamination, hashing, jaccard_join, paragraph_dedup, suffix_dedup
from skerry.llm.components import connected_components
from tests.llm import helpers as h


def edited(text, seed, share):
    draw, w = random.Random(seed), text.split()
    for i in draw.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"edit{draw.randrange(10**6)}"
    return " ".join(w)


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(4)
    order = draw.sample(range(60), 60)
    links = [(order[i], order[i + 1]) for i in range(30)] + [(order[40], order[i]) for i in range(41, 55)] + [(order[58], order[58])]
    want = h.components(60, links)
    got = {r["node"]: r["component"] for r in h.rows(connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {n: want[n] for n in {x for link in links for x in link}}


def test_blocks_connect_what_all_pairs_connect():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**60, 200, dtype=np.uint64)
    sets = []
    for i in range(80):
        own = base.copy() if i % 3 else draw.integers(0, 2**60, 60, dtype=np.uint64)
        own[draw.integers(0, len(own), i % 14)] = draw.integers(0, 2**60, i % 14, dtype=np.uint64)
        sets.append(np.unique(own))
    pairs = [(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    got = blocks.links_in_block(np.arange(80), sets, 90)
    assert h.components(80, got) == h.components(80, pairs) and len(got) < len(pairs)


def test_large_groups_link_what_all_pairs_link(spark):
    draw = np.random.default_rng(7)
    common, sets = draw.integers(0, 2**60, 3, dtype=np.uint64), []
    for k in range(3):  # near copies, some chained, and sets that share but a few tokens with all others
        base = draw.integers(0, 2**60, 60, dtype=np.uint64)
        for i in range(25):
            base = base.copy()
            base[draw.integers(0, 60, 1 if k else 2)] = draw.integers(0, 2**60)
            sets.append(np.unique(np.concatenate([common, base])))
    sets += [np.unique(np.concatenate([common, draw.integers(0, 2**60, 12, dtype=np.uint64)])) for _ in range(40)]
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    tokens = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "sig long, tokens binary").cache()
    meet = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(n) if g == 1 or i < 5], "grp long, sig long")
    for block in (1000, 7):
        links = blocks.group_links(blocks.meeting(meet), lambda wanted: wanted.join(tokens, "sig").select("block", "sig", "tokens"), 90, block)
        assert h.components(n, [(r["a"], r["b"]) for r in h.rows(links)]) == h.components(n, pairs)


def test_word_hashes_tell_long_patterned_words_apart():
    one, two = "a", "b"
    for _ in range(12):  # equal for every polynomial modulo 2**64
        one, two = one + two, two + one
    got = hashing.words(f"{one} {two} {one.upper()} x{one} ab ba {'q' * 63} {'q' * 64} {'q' * 65}".encode())[0].tolist()
    assert got[0] == got[2] and len(set(got)) == 8
    draw = random.Random(5)
    made = {"".join(draw.choice("ab") for _ in range(draw.randrange(1, 90))) for _ in range(5000)}
    assert len(set(hashing.words(" ".join(made).encode())[0].tolist())) == len(made)


def _jaccard(texts, n, percent):
    sets = [h.shingle_set(t, n) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(x) for x in sets], h.components(len(texts), links)


def test_jaccard_join_equals_all_pairs(spark):
    texts = list(h.edge_texts())
    for k in range(6):
        base = h.prose(k, 60 + 90 * k)
        texts += [base, base.upper(), *(edited(base, 100 * k + i, 0.004 * i) for i in range(14))]
    texts += ["two words", "Two  words", "a b c", "a b c d", *(h.prose(50 + i, 40) for i in range(20))]
    size, component = _jaccard(texts, 3, 90)
    for settings in (jaccard_join.Settings(), jaccard_join.Settings(block=4, frequent_rows=5)):  # small blocks meet in parts
        found = {r["doc_id"]: r for r in h.rows(jaccard_join.join(h.table(spark, texts, more=h.CLASHING), settings))}
        assert [found[i]["n_shingles"] for i in range(len(texts))] == size
        assert [found[i]["component_id"] for i in range(len(texts))] == component
    kept = jaccard_join.keep_one(h.table(spark, texts, more="sig"))
    assert sorted(r["doc_id"] for r in h.rows(kept)) == sorted(set(component)) and kept.columns[-1] == "sig"


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard_join.join(h.table(spark, ["x"]).limit(0)).count() == 0
    found = h.rows(jaccard_join.join(h.table(spark, [(None, "a b c d"), (7, "a b c d"), (5, "a b c d"), (5, "other text here"), (None, "alone and without id")])))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5)]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    copied, lone, mine = h.prose(1, 80), [h.prose(10 + k, 80) for k in range(6)], h.prose(2, 80)
    for settings in (None, jaccard_join.Settings(n=5, percent=80)):
        rows = [(None, copied), (None, copied.upper()), (None, copied), (5, copied), *((5, t) for t in lone[:3]), (4, copied), (4, copied), *((None, t) for t in lone[3:]), (6, copied), (6, mine), (None, mine.upper()), (None, ""), (None, None)]
        kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in h.rows(jaccard_join.keep_one(h.table(spark, rows), settings)))
        assert kept == sorted([(4, copied), *((5, t) for t in lone[:3]), *((-1, t) for t in lone[3:]), (6, mine), (-1, ""), (-1, "")])
    kept = h.rows(jaccard_join.keep_one(h.table(spark, [(None, copied), (None, copied.upper()), (None, copied), (None, lone[0])])))
    assert len(kept) == 2 and lone[0] in {r["text"] for r in kept}


def _covered(texts, min_words):
    """Words of each text inside a passage of min_words words that an earlier place has, and whether the place is the first."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w, inside = h.words(t), set()
        for p in range(len(w) - min_words + 1):
            gram = tuple(w[p : p + min_words])
            if gram in seen:
                inside |= set(range(p, p + min_words))
            else:
                seen[gram] = (i, p)
        out.append(inside)
    return out


def test_suffix_repeats_cover_every_passage(spark):
    passage, other = h.prose(1, 70), h.prose(2, 50)
    texts = [*h.edge_texts(), f"{h.prose(3, 30)} {passage} {h.prose(4, 10)}", f"{passage.upper()}", f"{h.prose(5, 5)}\n{passage}\n{other}", f"{other} {h.prose(6, 80)} {other}", edited(passage, 1, 0.01), h.prose(7, 49), h.prose(7, 49), *(h.prose(8, 400) for _ in range(3)), h.prose(9, 60), "tick tock " * 60]
    found = h.rows(suffix_dedup.find_repeats(h.table(spark, texts, more=h.CLASHING)))
    got = [set() for _ in texts]
    for r in found:
        assert r["n_words"] >= 50
        own, source = (h.words(texts[r[x]]) for x in ("doc_id", "source_id"))
        assert own[r["first_word"] : r["first_word"] + 26] == source[r["source_word"] : r["source_word"] + 26]
        assert (r["source_id"], r["source_word"]) < (r["doc_id"], r["first_word"])
        got[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    want = _covered(texts, 50)
    assert all(w <= g for w, g in list(zip(want, got, strict=True))[:-1])  # the last one is periodic: equal neighbours
    assert all(not g for t, g in zip(texts, got, strict=True) if t and t in (h.prose(7, 49), h.prose(9, 60)))
    cut = {r["doc_id"]: r for r in h.rows(suffix_dedup.cut_repeats(h.table(spark, texts, more="_doc _spans")))}
    assert cut[8]["text"] == texts[8] and 9 not in cut and h.words(cut[10]["text"]) == h.words(f"{h.prose(5, 5)} {other}")
    assert all(cut[i]["n_chars"] == len(cut[i]["text"]) for i in cut if cut[i]["text"])


def _reported(spark, pairs):
    got = {}
    for r in h.rows(suffix_dedup.find_repeats(h.table(spark, pairs))):
        assert r["n_words"] >= 50
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return [got.get(i, set()) for i in range(len(pairs))]


def test_suffix_repeats_equal_every_earlier_place(spark):
    passage, one, two = h.prose(1, 70), h.prose(2, 45), h.prose(3, 45)
    # the first place of many words has but a piece of the passage, the second one all of it
    texts = [f"{h.prose(4, 20)} {' '.join(passage.split()[12:57])} {h.prose(5, 20)}", passage, f"{h.prose(6, 9)} {passage} {h.prose(7, 9)}"]
    # phrases of two documents that meet in a third one are no passage
    texts += [f"{h.prose(8, 20)} {one} {h.prose(9, 20)}", f"{h.prose(10, 20)} {two} {h.prose(11, 20)}", f"{one} {two}"]
    texts += ["tick tock " * 60, "tick " * 90, "tock " + "tick " * 70, "tick tock " * 40 + "tick " * 60]
    for k in range(4):
        base = h.prose(20 + k, 300)
        texts += [base, *(edited(base, 50 * k + i, 0.005 * i) for i in range(8))]
    got = _reported(spark, texts)
    assert got == _covered(texts, 50)
    assert len(got[2]) == 70 and not got[5]
    small = suffix_dedup.find_repeats(h.table(spark, texts), suffix_dedup.Settings(classes=2))  # passages by an aggregation
    assert sorted((r["doc_id"], r["first_word"], r["n_words"]) for r in h.rows(small)) == sorted((r["doc_id"], r["first_word"], r["n_words"]) for r in h.rows(suffix_dedup.find_repeats(h.table(spark, texts))))


def test_a_passage_of_all_documents_is_no_tasks_burden(spark, monkeypatch):
    """Unlike texts that share 55 words: none of the tasks that compare passages side by side gets more than its bound of classes."""
    passage, seen, compared = h.prose(1, 55), [], suffix_dedup._compared
    texts = [f"{h.prose(100 + k, 20)} {passage} {h.prose(600 + k, 15)}" for k in range(250)] + [passage, h.prose(3, 90), h.prose(3, 90)]
    s = suffix_dedup.Settings(classes=20)
    monkeypatch.setattr(suffix_dedup, "_compared", lambda passages, s: seen.append(passages) or compared(passages, s))
    found = h.rows(suffix_dedup.find_repeats(h.table(spark, texts), s))
    got = {r["doc_id"]: set(range(r["first_word"], r["first_word"] + r["n_words"])) for r in found}
    assert [got.get(i, set()) for i in range(len(texts))] == _covered(texts, 50)
    # but where the word before or after is the same by chance, the first document is the source
    assert sum((r["source_id"], r["source_word"]) == (0, 20) for r in found) > 200
    sizes = [r["count"] for p in seen for r in p.groupBy("slot").count().collect()]
    assert len(seen) == 1 and max(sizes, default=0) <= s.classes


def test_texts_are_shuffled_once_and_a_copied_passage_is_one_row(spark, monkeypatch):
    """A long passage of many unlike texts: one row of each copy, not one for each of its suffixes, and one reading of texts for keys of any size."""
    passage, calls, stored = h.prose(1, 300), [], {}
    texts = [f"{h.prose(100 + k, 20)} {passage} {h.prose(600 + k, 15)}" for k in range(40)] + [passage, *(" ".join(passage.split()[:200]) for _ in range(2))]
    read, keep = suffix_dedup._passages, suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "_passages", lambda *a: calls.append(a) or read(*a))
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    for s in (suffix_dedup.Settings(), suffix_dedup.Settings(classes=10)):  # one list of each class, then several
        stored.clear()
        calls.clear()
        rows = h.rows(suffix_dedup.find_repeats(h.table(spark, texts), s))
        got = {r["doc_id"]: set(range(r["first_word"], r["first_word"] + r["n_words"])) for r in rows}
        assert [got.get(i, set()) for i in range(len(texts))] == _covered(texts, 50) and len(rows) == len(texts) - 1
        assert len(calls) == 1
        assert stored["suffixes"].selectExpr("sum(size(at)) AS n").first()["n"] > 15 * len(texts) and stored["joined"].count() <= 4
        # the ends of the passage, whose surroundings differ, come in further rows, those of large keys one by one
        assert s.classes < 1000 or stored["spans"].count() < 6 * len(texts)


def test_a_periodic_text_is_no_list_of_its_periods(spark):
    text = "tick tock " * 400
    assert suffix_dedup.suffixes(h.table(spark, [text, "x " + text]), suffix_dedup.Settings()).count() < 20
    assert _reported(spark, [text, "x " + text, "tick " * 200, "tick tock " * 30]) == _covered([text, "x " + text, "tick " * 200, "tick tock " * 30], 50)


def test_cuts_go_by_row_not_by_id(spark):
    passage = h.prose(1, 60)
    for own in (None, 7):
        clean = [h.prose(10 + k, 200) for k in range(4)]
        rows = [(1, passage), (own, f"{h.prose(2, 100)} {passage} {h.prose(3, 40)}"), *((own, t) for t in clean)]
        # without an id a document comes first
        texts = [r["text"] for r in h.rows(suffix_dedup.cut_repeats(h.table(spark, rows)))]
        assert set(clean) <= set(texts)
        assert sum(passage in t for t in texts) == 1


def test_suffix_repeats_of_odd_tables(spark):
    assert suffix_dedup.find_repeats(h.table(spark, ["x"]).limit(0)).count() == 0
    text = h.prose(1, 60)
    found = h.rows(suffix_dedup.find_repeats(h.table(spark, [(None, text), (4, h.prose(2, 70)), (4, text), (4, text)])))
    assert [(r["doc_id"], r["n_words"], r["source_id"]) for r in found] == [(4, 60, None)]


def pieces(text):
    begin, count = paragraph_dedup.fragments(*hashing.words(text.encode()), text.encode(), paragraph_dedup.Settings())
    return {tuple(h.words(text)[a : a + n]) for a, n in zip(begin, count, strict=True) if n >= 5}


def test_near_paragraphs_are_found(spark):
    near = [". ".join(h.prose(10 * k + j, 14) for j in range(4)) + "." for k in range(8)]
    texts = [*h.edge_texts()]
    for k, p in enumerate(near):
        texts += [f"{h.prose(200 + k, 30)}\n{p}\n{h.prose(300 + k, 30)}", f"{h.prose(400 + k, 30)}\n{p.replace(' ', '  ', 3)}\n{h.prose(500 + k, 20)}", h.prose(600 + k, 60)]
    found = h.rows(paragraph_dedup.find_repeats(h.table(spark, texts, more=h.CLASHING)))
    by_doc = {}
    for r in found:
        assert (r["cluster_doc"], r["cluster_word"]) <= (r["doc_id"], r["first_word"]) and r["removed"] == ((r["cluster_doc"], r["cluster_word"]) != (r["doc_id"], r["first_word"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k in range(8):
        first, second, clean = 8 + 3 * k, 9 + 3 * k, 10 + 3 * k
        # the line's first cut may depend on the word before it; every piece that both documents have is found
        both = pieces(texts[first]) & pieces(texts[second])
        want = sum(len(x) for x in both)
        assert want >= 30
        assert sum(r["n_words"] for r in by_doc[second] if r["removed"] and r["cluster_doc"] == first) >= want
        assert not any(r["removed"] for r in by_doc[first]) and clean not in by_doc
    assert paragraph_dedup.find_repeats(h.table(spark, ["x"]).limit(0)).count() == 0


def test_edited_paragraphs_join_by_exact_jaccard(spark):
    base = h.prose(1, 60)
    found = h.rows(paragraph_dedup.find_repeats(h.table(spark, [base, edited(base, 3, 0.02), edited(base, 4, 0.6), base])))
    assert {r["doc_id"] for r in found if r["removed"]} >= {3} and 2 not in {r["doc_id"] for r in found}


def test_edited_lines_are_compared_whole(spark):
    texts, pairs = [h.prose(900, 15), h.prose(901, 40), h.prose(900, 15)], []
    for k in range(12):
        # one edit in each of two of eight sentences, which alone are under 0.8
        base = [h.prose(20 * k + j, 15) + "." for j in range(8)]
        near = [edited(x, k, 0.01) if j in (1, 4) else x for j, x in enumerate(base)]
        a, b = (h.shingle_set(" ".join(x), 5) for x in (base, near))
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs.append((len(texts), len(texts) + 1, 120))
        texts += [f"{h.prose(500 + k, 30)}\n{' '.join(base)}\n{h.prose(600 + k, 20)}", f"{h.prose(700 + k, 20)}\n{' '.join(near)}"]
    found = h.rows(paragraph_dedup.find_repeats(h.table(spark, texts)))
    assert len(pairs) >= 8
    for first, second, n in pairs:
        assert [(r["cluster_doc"], r["cluster_word"], r["run"] >= n) for r in found if r["doc_id"] == second and r["n_words"] == n and r["removed"]] == [(first, 30, True)]
    # of a short copy, 15 words are a paragraph, fewer are none
    assert any((r["doc_id"], r["removed"], r["paragraph"]) == (2, True, True) and r["run"] <= 15 for r in found)


def test_near_copies_of_paragraphs_are_recalled(spark):
    """Against all pairs of lines: of copies with a Jaccard similarity of 0.8 or more, and of exact ones of 15 words on."""
    texts, want = [], []
    for k in range(160):
        words = (15, 20, 24, 40, 60, 100)[k % 6]
        base = h.prose(2000 + k, words)
        near = base if words < 40 else edited(base, k, 0.0100001 * (1 + k // 6 % 2))
        a, b = h.shingle_set(base, 5), h.shingle_set(near, 5)
        if 100 * len(a & b) >= 80 * len(a | b):
            want.append((len(texts), len(texts) + 1))
        texts += [f"{h.prose(4000 + k, 30)}\n\n{base}\n\n{h.prose(5000 + k, 30)}", f"{h.prose(6000 + k, 25)}\n \n{near}\n\n{h.prose(7000 + k, 40)}"]
    found = {(r["cluster_doc"], r["doc_id"]) for r in h.rows(paragraph_dedup.find_repeats(h.table(spark, texts))) if r["removed"] and r["paragraph"]}
    assert len(want) > 120 and len(found & set(want)) >= 0.98 * len(want) and {b // 2 for _, b in found} <= {a // 2 for a, _ in want}


def test_blocks_of_lines_are_paragraphs(spark):
    lines = [h.prose(30 + k, 8) for k in range(12)]
    near = [edited(x, 1, 0.1) if k == 5 else x for k, x in enumerate(lines)]
    texts = ["\n".join(lines) + "\n\n" + h.prose(1, 40), h.prose(2, 40) + "\n\n" + "\n".join(near), h.prose(3, 40)]
    found = [(r["cluster_doc"], r["cluster_word"], r["first_word"], r["n_words"]) for r in h.rows(paragraph_dedup.find_repeats(h.table(spark, texts))) if r["doc_id"] == 1 and r["paragraph"]]
    assert found == [(0, 0, 40, 96)]


def test_paragraphs_of_odd_tables(spark):
    text = h.prose(1, 30)
    # within one document it isn't across documents; equal rows with one id are one document
    alone = [(1, f"{text}\n\n{text}"), (2, h.prose(2, 30)), (2, h.prose(2, 30)), (3, None), (None, "")]
    assert paragraph_dedup.find_repeats(h.table(spark, alone, more=h.CLASHING)).count() == 0
    rows = [(None, f"{h.prose(3, 20)}\n{text}"), (None, f"{h.prose(4, 20)}\n{text}"), (7, text), (7, text), (7, h.prose(5, 30))]
    found = sorted(((r["doc_id"] or -1, r["first_word"], r["removed"]) for r in h.rows(paragraph_dedup.find_repeats(h.table(spark, rows))) if r["paragraph"] and r["n_words"] == 30))
    assert [(a, b) for a, b, _ in found] == [(-1, 20), (-1, 20), (7, 0)] and [x for *_, x in found].count(False) == 1 and found[2][2]


def _best_score(item, passage):
    now, best = [0] * (len(passage) + 1), 0
    for w in item:
        new = [0]
        for j, p in enumerate(passage, 1):
            new.append(max(0, now[j - 1] + (2 if p == w else -1), now[j] - 1, new[-1] - 1))
        best, now = max(best, *new), new
    return best


def test_leaks_equal_full_alignments(spark):
    items = [h.prose(900 + i, 25, 500) for i in range(6)]
    texts = [*h.edge_texts(), *(f"{h.prose(i, 40, 500)} {edited(items[i % 6], i, 0.02 * i)} {h.prose(70 + i, 40, 500)}" for i in range(24)), *(h.prose(300 + i, 90, 500) for i in range(8)), items[0].upper() + "!", items[1] + " " + items[2]]
    tests = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "two words"), (0, items[0])], "item_id long, text string")
    found = h.rows(decontamination.find_leaks(h.table(spark, texts, more=h.CLASHING), tests))
    ids = decontamination.WordIds()
    want = {}
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            own = ids.of(item.encode()).tolist()
            score = _best_score(own, ids.of((t or "").encode()).tolist()) / (2 * len(own))
            if score >= 0.5:
                want[d, k] = score
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert got == want and len(got) >= 20
    kept = decontamination.drop_leaks(h.table(spark, texts, more="key"), tests)
    assert {r["doc_id"] for r in h.rows(kept)} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.find_leaks(h.table(spark, ["x"]).limit(0), tests).count() == 0
    assert decontamination.find_leaks(h.table(spark, ["x"]), tests.limit(0)).count() == 0


def test_leaks_of_odd_tables(spark):
    item = h.prose(1, 25, 500)
    tests = spark.createDataFrame([(1, item), (None, h.prose(2, 25, 500))], "item_id long, text string")
    twice = f"{h.prose(3, 30)} {item} {h.prose(4, 60)} {item}"
    rows = [(None, item), (7, item), (7, item), (7, h.prose(5, 40)), (8, twice), (9, h.prose(2, 25, 500)), (None, None)]
    found = sorted((r["doc_id"] or -1, r["item_id"] or -1, r["first_word"], r["last_word"]) for r in h.rows(decontamination.find_leaks(h.table(spark, rows), tests)))
    # of equally good places the first one
    assert found == [(-1, 1, 0, 24), (7, 1, 0, 24), (7, 1, 0, 24), (8, 1, 30, 54), (9, -1, 0, 24)]
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in h.rows(decontamination.drop_leaks(h.table(spark, rows), tests)))
    assert kept == [(-1, ""), (7, h.prose(5, 40))]


def test_alignment_of_a_long_repetitive_text_takes_little_memory():
    import tracemalloc

    draw = np.random.default_rng(1)
    item, passage = draw.integers(0, 3, 200).astype(np.uint64), draw.integers(0, 3, 100_000).astype(np.uint64)
    tracemalloc.start()
    score, first, end = decontamination.align(item, passage)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000 and 0 <= first < end <= len(passage) and score > 100
    tracemalloc.stop()


def test_items_in_several_blocks_give_the_same(spark):
    items = [h.prose(900 + i, 25, 500) for i in range(6)]
    docs = h.table(spark, [f"{h.prose(i, 20)} {items[i]}" for i in range(6)])
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    few = decontamination.find_leaks(docs, tests, decontamination.Settings(block_words=40))
    assert sorted((r["doc_id"], r["item_id"]) for r in h.rows(few)) == [(i, i) for i in range(6)]


def test_alignment_scores_like_a_plain_version():
    draw = random.Random(6)
    for _ in range(40):
        item, passage = ([draw.randrange(5) for _ in range(draw.randrange(1, 15))] for _ in range(2))
        score, first, end = decontamination.align(np.array(item), np.array(passage))
        assert score == _best_score(item, passage) and score == _best_score(item, passage[first:end])
