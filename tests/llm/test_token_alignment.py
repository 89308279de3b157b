import hashlib
import random
from collections import Counter

import pytest

from skerry.llm import token_alignment as ta
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def sides():
    return ta.default_sides()


def _tokens(side, text):
    """Ids and ends straight from the library, one token at a time; none where the bytes differ from those of space and text."""
    if not text:
        return []
    ids, out, at = side.ids(text), [], 0
    if b"".join(side.bytes[i] for i in ids) != b" " + text.encode():
        return None
    for i in ids:
        at += len(side.bytes[i])
        out.append((i, at))
    return out


def plain(texts, sides):
    a, b = (kind(file) for kind, file in sides)
    docs, links = [], []
    for t in texts:
        both = _tokens(a, t), _tokens(b, t)
        x, y = both if None not in both else ([], [])
        joint = sorted({e for _, e in x} & {e for _, e in y})
        low, groups = 0, []
        for e in joint:
            groups.append("|".join(",".join(str(i) for i, z in s if low < z <= e) for s in (x, y)))
            low = e
        links.append([(i, j) for e in joint for i, z in x if z == e for j, w in y if w == e])
        docs.append((len(x), len(y), groups))
    count = Counter(p for own in links for p in own)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for (n_a, n_b, groups), own in zip(docs, links, strict=True)
    ]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, sides):
    texts = [None, "", " ", " \n\t ", "one", "a▁b holds the mark", "<|endoftext|> <s> </s> <0x0A> <unk>", "漢字かな ünïcödé 🙂🙂 ÀÉ", "x" * 300, "hello world, it's   me\r\n\n 123 4567", "hello world, it's   me\r\n\n 123 4567"]
    texts += [h.prose(k, 40 + 30 * k) for k in range(6)] + ["é ﬁ     \u0085 \x1c \x00 end"]
    want = plain(texts, sides)
    assert sum(w[2] for w in want) > 500 and want[5][0] == 0 and want[6][0] > 0
    table = h.table(spark, texts, more=h.CLASHING)
    for s in (ta.Settings(), ta.Settings(window=16, piece=60, broadcast_pairs=0)):  # many windows, cut texts, counts joined by a shuffle
        found = {r["doc_id"]: tuple(r[c] for c in NUMBERS) for r in h.rows(ta.align(table, *sides, s))}
        assert [found[i] for i in range(len(texts))] == want


def test_rows_are_documents_of_their_own_whatever_their_ids(spark, sides):
    texts = [(None, "same text twice"), (None, "same text twice"), (7, "other words"), (7, "same text twice"), (7, "")]
    want = plain([t for _, t in texts], sides)
    found = [(r["doc_id"], *(r[c] for c in NUMBERS)) for r in h.rows(ta.align(h.table(spark, texts), *sides))]
    assert sorted(found, key=str) == sorted([(i, *w) for (i, _), w in zip(texts, want, strict=True)], key=str)
    assert ta.align(h.table(spark, ["x"]).limit(0), *sides).count() == 0


def test_a_group_may_span_windows_and_long_texts_stream(spark, sides):
    text = "𝔘" * 40 + " " + h.prose(5, 3000)
    want = plain([text], sides)
    for window in (8, 1 << 13):
        found = h.rows(ta.align(h.table(spark, [text]), *sides, ta.Settings(window=window)))
        assert tuple(found[0][c] for c in NUMBERS) == want[0]


def test_cuts_lose_nothing():
    text = h.prose(1, 2000) + "\n" + "y" * 500 + " é " + "abc def " * 100
    cut = list(ta.pieces(text, 70))
    assert " ".join(cut) == text and len(cut) > 5 and list(ta.pieces("", 5)) == [""]


def test_both_libraries_give_the_same_ids(sides):
    """Of every two neighbouring kinds of plain characters, and of words with marks; the other kinds take the file's own library."""
    a = sides[0][0](sides[0][1])
    own = lambda text: a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    assert a.fast is not None
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)] if c != 0xAD]
    draw = random.Random(3)
    texts = ["".join(plain), "".join(x + y for x in plain[::7] for y in plain[::5]), *("".join(draw.choice(plain) for _ in range(60)) for _ in range(400)), *("".join(draw.choice("a's1 \n\t.é") for _ in range(40)) for _ in range(400)), h.prose(4, 300), "<|endoftext|>"]
    for text in texts:
        assert ta._PLAIN.fullmatch(text) and a.ids(text) == own(text)
    assert not any(ta._PLAIN.fullmatch(x) for x in ("漢", "\u00a0", "\x1c", "\u180e", "\u2028", "\x85", "\u00ad"))
