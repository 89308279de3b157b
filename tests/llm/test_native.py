import random
import re

import numpy as np
from pyspark.sql import functions as F

from skerry.llm import license_rules, license_scan, quality_rules, sharding
from tests.llm import helpers as h


def _base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, inside = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            inside |= {p + k for p in places for k in range(5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def test_quality_rules_count_like_a_plain_version(spark):
    texts = [*h.edge_texts(), "a b c d e a b c d e f", "x x x x x x x x", "l1 $5\nl1 $5\n\n \nl2|", "p q r s t u " * 9, h.prose(5, 40), "a\nb\na\n a"]
    found = {r["doc_id"]: r for r in h.rows(quality_rules.judge(h.table(spark, texts, more=h.CLASHING)))}
    for i, text in enumerate(texts):
        own = _base(text)
        assert {k: found[i][k] for k in own} == own, text
        assert found[i]["base_failed"] == (own["n_words"] < 10 or 100 * own["n_repeat_words"] > 20 * own["n_words"])
        assert not (found[i]["kept"] and found[i]["base_failed"])
    assert quality_rules.judge(h.table(spark, ["x"]).limit(0)).count() == 0


def _mcd(x, s, starts):
    """Best (logdet, mean, covariance) by concentration steps in plain numpy."""
    n, floors = len(x), np.diag(np.array(s.floors, float) ** 2)
    h, factor = int(np.ceil(s.share * n)), s.share / (1 - quality_rules.chi2_tail(quality_rules.chi2_bound(1 - s.share, 4), 6))
    best = None
    for mean, cov in starts:
        for _ in range(60):
            q = np.floor(2000 * np.log1p(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)))
            order = np.argsort(q, kind="stable")
            bound = q[order[h - 1]]
            w = (q < bound) + (q == bound) * (h - (q < bound).sum()) / (q == bound).sum()
            mean = w @ x / h
            cov = factor * (np.einsum("i,ij,ik->jk", w, x, x) / h - np.outer(mean, mean)) + floors
        got = (np.linalg.slogdet(cov)[1], mean, cov)
        best = got if best is None or got[0] < best[0] else best
    return best


def _vectors(texts):
    out = []
    for t in texts:
        b = _base(t)
        n, c = b["n_words"], b["word_chars"]
        out.append([int(np.floor(1000 * v + 0.5)) for v in (np.log(n), np.log(c / n), np.log(1 + 1000 * b["n_symbols"] / c), np.log(1 + 100 * (b["n_repeat_words"] + 10 * b["n_dup_lines"]) / n))])
    return np.array(out, float)


def test_estimates_equal_a_plain_version_and_reach_the_least_determinant(spark):
    draw, texts, pools = random.Random(8), [], []
    for i in range(330):
        pools.append(("en", "big") if i < 200 else ("en", None) if i < 300 else ("de", "few"))
        size = draw.choice((20, 60, 200))
        odd = i % 9 == 0
        texts.append(" ".join(("#" * draw.randrange(4) if odd else "") + "x" * draw.randrange(2, 30 if odd else 9) + str(k) for k in range(size * (3 if odd else 1))) + ("\nsame line\nsame line" if i % 7 == 0 else ""))
    docs = spark.createDataFrame([(i, t, *p) for i, (t, p) in enumerate(zip(texts, pools, strict=True))], "doc_id long, text string, lang string, source string")
    s, x, rng = quality_rules.Settings(), _vectors(texts), np.random.default_rng(4)

    def plain(own):
        n, starts = len(own), []
        for _ in range(60):  # small random subsets, as many as find the least determinant surely
            some = own[rng.choice(n, min(n, 6), replace=False)]
            starts.append((some.mean(0), np.cov(some.T) + np.diag(np.array(s.floors, float) ** 2)))
        return _mcd(own, s, starts)

    groups = {(0, "", ""): range(330), (1, "en", ""): range(300), (1, "de", ""): range(300, 330), (2, "en", "big"): range(200), (2, "en", ""): range(200, 300), (2, "de", "few"): range(300, 330)}
    stat = quality_rules.statistics(docs).where("not base_failed").select("lang", "source", "x1", "x2", "x3", "x4")
    got = {(r["level"], r["lang"], r["source"]): r for r in h.rows(quality_rules.estimates(stat, s))}
    want = {}
    for k, own in groups.items():
        logdet, mean, cov = want[k] = plain(x[list(own)])
        assert abs(got[k]["logdet"] - logdet) < 0.02 and np.allclose([got[k][f"m{i}"] for i in range(1, 5)], mean, rtol=0.02, atol=5), k
    found = {r["doc_id"]: r for r in h.rows(quality_rules.judge(docs))}
    for key, own in list(groups.items())[3:]:
        near = lambda k, above: tuple((len(groups[k]) * a + s.prior * b) / (len(groups[k]) + s.prior) for a, b in zip(want[k][1:], above, strict=True))
        mean, cov = near(key, near((1, key[1], ""), want[0, "", ""][1:]))
        for i in own:
            d = (x[i] - mean) @ np.linalg.inv(cov) @ (x[i] - mean)
            assert abs(found[i]["distance"] - d) <= 0.03 * d + 0.1 and found[i]["kept"] == (found[i]["distance"] <= quality_rules.chi2_bound(s.tail, 4) + 1e-3)


def test_quality_rules_reject_outliers_of_pools_of_any_size(spark):
    usual = [h.prose(i, 150 + i) for i in range(120)]
    odd = " ".join(f"{c * 60}{i}" for i, c in enumerate("abcdefghij" * 30))
    docs = h.table(spark, [*usual, odd]).withColumn("source", F.when(F.col("doc_id") % 40 == 3, None).otherwise(F.col("source")))
    found = {r["doc_id"]: r["kept"] for r in h.rows(quality_rules.judge(docs))}
    assert not found[120] and all(found[i] for i in range(120))
    few = {r["doc_id"]: r["kept"] for r in h.rows(quality_rules.judge(h.table(spark, [*usual[:20], odd])))}
    assert not few[20] and all(few[i] for i in range(20))
    # equal rows, and one row alone
    assert all(r["kept"] for r in h.rows(quality_rules.judge(h.table(spark, [usual[0]] * 30)))) and h.rows(quality_rules.judge(h.table(spark, usual[:1])))[0]["kept"]
    nulls = h.table(spark, [usual[0], (None, usual[1]), None]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(str(r["kept"]) for r in h.rows(quality_rules.judge(nulls))) == ["False", "True", "True"]


def test_cut_off_has_its_share_beyond_it():
    for tail in (0.25, 1e-3, 1e-20):
        assert abs(quality_rules.chi2_tail(quality_rules.chi2_bound(tail, 4), 4) / tail - 1) < 1e-6


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        f = sharding.Feistel(n, 5)
        assert sorted(f.number(x) for x in range(n)) == list(range(n))


def test_sharding_follows_the_row_number(spark):
    texts = [*h.edge_texts(), (None, "no id"), (3, "twice"), (3, "twice")]
    found = h.rows(sharding.shard(h.table(spark, texts, more=h.CLASHING), shards=4, seed=2))
    f = sharding.Feistel(len(texts), 2)
    assert sorted(r["row"] for r in found) == list(range(len(texts)))
    assert all((r["shard"], r["slot"]) == (f.number(r["row"]) % 4, f.number(r["row"]) // 4) for r in found)
    assert {r["size"] for r in found if r["doc_id"] in (0, 1)} == {16} and next(r for r in found if r["doc_id"] is None)["row"] == 0
    again = h.rows(sharding.shard(h.table(spark, texts).repartition(7), shards=4, seed=2))
    assert sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in found)
    assert sharding.shard(h.table(spark, ["x"]).limit(0)).count() == 0


def _phrases(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return {"n_words": len(w), "n_base": len(at), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted({x for _, x in at}))}


LICENCES = [
    "Under the MIT License, and the mit-license again; GNU General\nPublic   License v3", "mit licenses submit license MIT LICENSÉ", "apache\tlicense version 2.0 apache license", "İmit license ımit license", "mit license" * 3,
    "SPDX-License-Identifier: Apache-2.0", "released into the public domain", "no terms here", "the permit license general public licensed", "😀 😀 😀 mit license and more 😀mit license MIT\U00020000 license, Mit\n*\nLicense", "mit license mit license apache license general public license",
]


def _scanned(text):
    """Labels, score and detections (label, first word, word after the last) word by word, without gates or keywords."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joint, found = " ".join(w), []
    for label, regex, priority, _ in license_rules.parsed():
        for m in re.finditer(f"(?<![^ ])(?:{regex})(?![^ ])", joint):
            low, high = joint[: m.start()].count(" "), joint[: m.end()].count(" ") + 1
            # lengths count two spaces between words
            found.append((priority, -len(m[0].replace(" ", "  ")), low, high, label))
    kept = []
    for x in sorted(found, key=lambda x: (*x[:3], x[4])):
        if not any(k[2] < x[3] and x[2] < k[3] for k in kept):
            kept.append(x)
    return [(x[4], x[2], x[3]) for x in kept], max([license_scan.WEIGHTS[x[0]] for x in kept], default=0.0)


def _sample(tree, draw):
    """A text that a parsed regular expression matches."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += "x"
        elif kind == "IN":
            what, value = draw.choice(arg)
            out += "x" if str(what) == "NEGATE" else chr(value) if str(what) == "LITERAL" else chr(draw.randint(*value))
        elif kind == "BRANCH":
            out += _sample(draw.choice(arg[1]), draw)
        elif kind == "SUBPATTERN":
            out += _sample(arg[3], draw)
        else:
            least, most, inner = arg
            out += "".join(_sample(inner, draw) for _ in range(draw.randint(least, min(int(most), least + 3))))
    return out


def test_license_scan_equals_a_plain_version(spark):
    texts = [*h.edge_texts(), *LICENCES, (None, "licensed under the MIT license"), h.prose(1, 20_000) + " apache license " + h.prose(2, 5000)]
    texts += ["GNU Lesser General Public License version 2.1", "licensed under the terms of the Mozilla Public License 2.0", "SPDX-License-Identifier: MIT-0", "Creative Commons Attribution-ShareAlike"]
    found = h.rows(license_scan.scan(h.table(spark, texts, more=h.CLASHING)))
    assert len(found) == len(texts)
    by_id = {r["doc_id"]: r for r in found}
    for i, text in enumerate(texts):
        i, text = text if isinstance(text, tuple) else (i, text)
        own, (detections, score) = _phrases(text), _scanned(text)
        assert {k: by_id[i][k] for k in own} == own, text
        assert [(x["label"], x["first_word"], x["end_word"]) for x in by_id[i]["detections"]] == detections, text
        assert by_id[i]["labels"] == ",".join(sorted({x[0] for x in detections} | set(own["base_labels"].split(",")) - {""}))
        assert by_id[i]["score"] == (score or (license_scan.WEIGHTS[5] if own["n_base"] else 0.0))
    assert license_scan.scan(h.table(spark, ["x"]).limit(0)).count() == 0
    last = len(texts) - 4
    assert [by_id[last + k]["labels"] for k in range(4)] == ["gpl,lgpl", "mpl", "mit-0", "cc-by-sa"]


def test_every_license_rule_passes_the_gates_and_matches_across_lines(spark):
    import re._parser

    draw, texts, rules = random.Random(3), [], license_rules.parsed()
    assert len(rules) > 400 and len({regex for _, regex, *_ in rules}) == len(rules)
    for label, regex, _, key in rules:
        made = [_sample(re._parser.parse(regex), draw) for _ in range(20)]
        assert all(key in x and any(g in f" {x} " for g in license_rules.GATES) for x in made), regex
        texts += [gap.join(["See,", *made[0].split(), "etc."]) for gap in ("\n", " \t*\n ")]
    found = {r["doc_id"]: r for r in h.rows(license_scan.scan(h.table(spark, texts)))}
    for i, text in enumerate(texts):
        detections, score = _scanned(text)
        assert detections and [(x["label"], x["first_word"], x["end_word"]) for x in found[i]["detections"]] == detections, text
        assert found[i]["score"] == score


def test_suppression_restores_what_a_suppressed_interval_contains(spark):
    made = lambda *x: "array(" + ", ".join(f"named_struct('priority', {p}, 'neg_size', {start - end}, 'start', {start}, 'label', '{label}')" for p, start, end, label in x) + ")"
    # b overlaps the stronger a and goes; c, inside b alone, stays; d is inside a
    rows = spark.range(1).select(F.expr(f"cast({made((1, 0, 10, 'a'), (3, 8, 30, 'b'), (5, 20, 25, 'c'), (5, 2, 4, 'd'))} as {license_scan.INTERVALS})").alias("x"))
    assert [x["label"] for x in h.rows(rows.select(license_scan._resolved(F.col("x")).alias("x")))[0]["x"]] == ["a", "c"]
