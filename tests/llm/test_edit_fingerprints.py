import hashlib
import random

import numpy as np

from skerry.llm import edit_fingerprints as ef
from tests.llm import helpers as h


def plain_samples(walker, text, w, level):
    """One place at a time: the embedded string, then the place kept of every block whose kept place is before its end."""
    bits, string, i = [[walker.stay[w, c, p] == 1 for p in range(ef.PERIOD)] for c in range(ef.KINDS)], [], 0
    kinds = ef.codes(text)
    while i < len(kinds):
        p = len(string)
        string.append(int(walker.value[w, kinds[i], p % ef.PERIOD]))
        i += bits[kinds[i]][p % ef.PERIOD]
    kept = ef._kept_places(level, len(string) // 2**level + 2)
    return [string[p] for p in kept if p < len(string)]


def test_walks_equal_one_place_at_a_time():
    walker = ef.Walker(ef.Settings())
    for text in ("", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "漢字 ünïcödé 🙂", h.prose(3, 700)):
        f = walker.fingerprint(text)
        assert f.level == walker.level(len(text)) and all(len(x) <= 200 for x in f.samples)
        for w in (0, 1):
            assert list(f.samples[w]) == plain_samples(walker, text, w, f.level)


def test_walks_go_on_where_they_stood():
    walker, texts = ef.Walker(ef.Settings()), [h.prose(k, 5 + 90 * k) for k in range(70)] + ["", "a", "ab", "漢字 ü"]
    kinds = [ef.codes(t) for t in texts]
    together, walks = walker.trails(kinds), np.array([0, 1])
    for k in (0, 1, 30, 69, 70, 71, 72, 73):
        alone = walker.trails([kinds[k]])[0]  # fewer than FEW go stride by stride
        for cut in (0, 1, len(kinds[k]) // 2, len(kinds[k])):
            if cut <= len(kinds[k]):
                stood = [t.place(cut) for t in alone]
                rest = walker.walk([kinds[k][cut:]] * 2, walks, np.array(stood))
                for w in (0, 1):
                    whole = together[k][w].samples(2)
                    assert list(whole) == list(alone[w].samples(2)) == list(np.concatenate([alone[w].samples(2, cut), rest[w].samples(2)]))
                    assert rest[w].place(len(kinds[k]) - cut) == alone[w].place(len(kinds[k]))


def test_coarser_samples_are_those_of_a_coarser_fingerprint():
    walker, text = ef.Walker(ef.Settings()), h.prose(5, 800)
    trails = walker.trails([ef.codes(text)])[0]
    fine = ef.Fingerprint(2, tuple(t.samples(2) for t in trails))
    for level in (3, 4, 5):
        for a, b in zip(fine.at_level(level), trails, strict=True):
            assert list(a[a != ef.NONE]) == list(b.samples(level))


def test_likeness_follows_edits():
    walker, draw = ef.Walker(ef.Settings()), random.Random(6)
    texts = [h.prose(10 + k, 500) for k in range(12)]
    own = [walker.fingerprint(t) for t in texts]
    assert all(ef.likeness(f, f) == 1 for f in own)
    assert max(ef.likeness(own[i], own[j]) for i in range(12) for j in range(i)) < 0.5
    halves = [ef.likeness(f, walker.fingerprint(t[: len(t) // 2] + texts[k - 1][: len(t) - len(t) // 2])) for k, (f, t) in enumerate(zip(own, texts, strict=True))]
    assert all(0.38 < x < 0.75 for x in halves)
    few = []
    for f, t in zip(own, texts, strict=True):
        for _ in range(2):
            i = draw.randrange(len(t))
            t = t[:i] + draw.choice(("", "x", "yy")) + t[i + 1 :]
        few.append(ef.likeness(f, walker.fingerprint(t)))
    assert np.mean(few) > 0.75 and all(x > y for x, y in zip(few, [0.3] * 12, strict=True))
    none = walker.fingerprint("")
    assert ef.likeness(none, none) == 1 and ef.likeness(none, own[0]) == 0


def plain(walker, pairs):
    texts = [t or "" for _, t in pairs]
    prints = [walker.fingerprint(t) for t in texts]
    out = []
    for k, t in enumerate(texts):
        nxt = (k + 1) % len(texts)
        edited = t[: len(t) - len(t) // 2] + texts[nxt][: len(t) // 2]
        f = walker.fingerprint(edited)
        out.append((pairs[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k].text(), f.text(), ef.likeness(prints[k], f), ef.likeness(prints[k], prints[nxt])))
    return out


def test_edits_equal_a_walk_over_the_ordered_table(spark):
    texts = h.edge_texts() + [h.prose(k, 3 + 40 * k) for k in range(12)] + ["a", "ab", "abc", "é"]
    draw = random.Random(7)
    ids = draw.sample(range(-40, 40), len(texts))
    pairs = list(zip(ids, texts, strict=True))
    want = plain(ef.Walker(ef.Settings()), sorted(pairs))
    for parts in (1, 5, 40):
        got = ef.with_edits(h.table(spark, pairs, more=h.CLASHING), parts=parts)
        assert sorted(tuple(r.values())[:7] for r in h.rows(got)) == want


def test_odd_tables(spark):
    assert ef.with_edits(h.table(spark, ["x"]).limit(0)).count() == 0
    lone = h.rows(ef.with_edits(h.table(spark, [(3, "only this one")])))
    assert lone[0]["near_next"] == 1 and lone[0]["edited_sha256"] == hashlib.sha256(b"only thonly t").hexdigest()
    same = h.rows(ef.with_edits(h.table(spark, [(None, "equal rows here")] * 30 + [(None, "another")]), parts=4))
    assert len(same) == 31 and sum(r["near_next"] == 1 for r in same) >= 29 and all(r["doc_id"] is None for r in same)


def test_near_documents_are_found_and_others_left_alone(spark):
    draw, texts, family = random.Random(8), [], []
    for k in range(15):
        base = h.prose(100 + k, 30 + 60 * k)
        for copy in range(4):
            t = base
            if copy >= 2:  # an edit in the last tenth, one of them a character less
                i = draw.randrange(9 * len(t) // 10, len(t))
                t = t[:i] + ("" if copy == 2 else "zz") + t[i + 1 :]
            texts.append(t)
            family.append(k)
    texts += [None, "", ""]
    for s in (ef.Settings(), ef.Settings(block=3)):
        found = {r["doc_id"]: r["component_id"] for r in h.rows(ef.near_documents(h.table(spark, texts, more="sig key"), s))}
        right = sum(found[i] == 4 * k for i, k in enumerate(family))
        assert right >= 0.95 * len(family) and all(family[found[i]] == k for i, k in enumerate(family))
        assert all(found[i] == i for i in range(len(family), len(texts)))
