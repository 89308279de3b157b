import os
import zlib

import numpy as np
import pytest

from skerry.llm import quality_classifier, sentencepiece_codec, token_files
from skerry.llm.common import scratch_path
from tests.llm import helpers as h

SF = "/root/testdata/sf0.01"


def _labelled(spark, n=240):
    good, bad = [f"good{i} fine" for i in range(40)], [f"junk{i} buy" for i in range(40)]
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(bad if i % 2 else good, 30)) + " " + h.prose(i, 10) for i in range(n)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return h.table(spark, texts), labels


def test_classifier_separates_held_out_documents(spark):
    docs, labels = _labelled(spark)
    found = h.rows(quality_classifier.classify(docs, labels))
    held = [r for r in found if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_classifier_learns_nothing_from_the_held_out_fold(spark):
    docs, labels = _labelled(spark)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    a, b = (quality_classifier.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_scores_are_those_of_a_forward_pass():
    s = quality_classifier.Settings(bits=12, epochs=2)
    texts = [h.prose(i, 5 + 40 * i).encode() for i in range(12)] + [b"", b"same same same", "ünï 漢字".encode()]
    vectors, out, bias = quality_classifier.train(texts, np.arange(len(texts)) % 2, s)
    known, shift = quality_classifier._Scores(quality_classifier.folded(vectors, out, bias)[0]), float(bias[1] - bias[0])
    for text in texts:
        buckets, counts = quality_classifier.document_features(text, (1 << s.bits) - 1, {})
        hidden = counts @ vectors[buckets] / max(1, counts.sum()) if len(buckets) else np.zeros(s.dim)
        assert abs(quality_classifier.score_text(text, known, shift) - quality_classifier.softmax(out @ hidden + bias)[1]) < 1e-5


def test_a_step_follows_the_gradient_of_the_loss():
    s = quality_classifier.Settings(bits=10, epochs=1, dim=4)
    texts, labels = [b"one two two three", b"four five"], np.array([1, 0])
    vectors, out, bias = quality_classifier.train(texts * 20, np.tile(labels, 20), s)
    for text, label in zip(texts, labels, strict=True):
        buckets, counts = quality_classifier.document_features(text, (1 << s.bits) - 1, {})
        share = counts / counts.sum()

        def loss(v, share=share, buckets=buckets, label=label):
            return -np.log(quality_classifier.softmax(out @ (share @ v[buckets]) + bias)[label])

        error = quality_classifier.softmax(out @ (share @ vectors[buckets]) + bias)
        error[label] -= 1
        wide = vectors.astype(np.float64)
        for k in range(0, len(buckets), 5):
            moved = wide.copy()
            moved[buckets[k], 0] += 1e-5
            assert abs((loss(moved) - loss(wide)) / 1e-5 - share[k] * (out.T @ error)[0]) < 1e-4


def test_labels_and_ids_of_odd_kinds(spark):
    docs, labels = _labelled(spark, 60)
    more = spark.createDataFrame([(0, 0, 0), (1, None, 0), (2, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels.union(more))
    # the smallest of conflicting labels counts; null, other labels and null ids are ignored
    assert np.array_equal(model[0], quality_classifier.fit(docs, labels.selectExpr("doc_id", "if(doc_id = 0, 0, quality) AS quality", "toxic"))[0])
    found = h.rows(quality_classifier.score(h.table(spark, [(None, "x"), (None, None)]), (np.zeros(1 << 18, np.float32), float(np.log(0.7 / 0.3)))))
    assert all(not r["held_out"] and r["predicted"] == (r["score"] >= 0.7) for r in found) and abs(found[0]["score"] - 0.7) < 1e-9


def test_classifier_scores_odd_rows(spark):
    docs, labels = _labelled(spark, 40)
    model = quality_classifier.fit(docs, labels)
    odd = h.table(spark, [*h.edge_texts(), (None, "good1 fine")], more=h.CLASHING)
    found = h.rows(quality_classifier.score(odd, model))
    assert len(found) == 9 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1, 2)}) == 1
    assert quality_classifier.keep(odd, model).columns == odd.columns
    empty = docs.limit(0)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r["score"] for r in h.rows(quality_classifier.classify(docs, labels.limit(0)))} == {0.5}


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_classifier_on_the_driver_tables(spark):
    found = quality_classifier.query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert ((found["score"] >= 0.5).astype(int) == found["quality"]).mean() > 0.8


# --- SentencePiece ---------------------------------------------------------------------------------------------------

TOY = sentencepiece_codec.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a", *(f"<{i}>" for i in range(256))], [-1.0, -1.1, -1.5, -1.6, -2.2, -2.0, -2.1, *([-9.0] * 256)], list(range(7, 263)), [True] * 7 + [False] * 256, ranks=False)


def _best(text):
    """Highest total over all segmentations by plain dynamic programming."""
    best = [0.0] + [-1e9] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            got = TOY.ids.get(text[start:end])
            score = TOY.scores[got] if got is not None else TOY.unknown if end - start == 1 else None
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_viterbi_stream_finds_the_best_total_and_keeps_a_short_window():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40, 300):
        text = "".join(draw.choice(list("ab▁x"), n))
        ids = list(sentencepiece_codec.viterbi_stream(text, TOY))
        total, i = 0.0, 0
        while i < len(ids):
            if ids[i] < 7:
                total += TOY.scores[ids[i]]
            else:
                total += TOY.unknown
            i += 1
        assert abs(total - _best(text)) < 1e-6
        # the same in parts of any length
        parts = [text[i : i + 3] for i in range(0, n, 3)]
        assert list(sentencepiece_codec.viterbi_stream(parts, TOY)) == ids
    search, done = sentencepiece_codec.Search(TOY), 0
    for i in range(20_000):
        done += len(search.feed("a" if i % 3 else "b"))
        assert len(search.text) <= 4 * TOY.longest
    assert done > 5_000


def test_stream_by_ranks_equals_the_library_without_a_split_into_words():
    import sentencepiece

    path = sentencepiece_codec.default_model()
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Pieces.load(path)
    assert pieces.ranks
    text = h.prose(5, 2000) + " " + "naïve 漢字 😀 antidisestablishmentarianism" * 30 + "the" * 2000
    search, ids, widest = sentencepiece_codec.Search(pieces), [], 0
    for c in (sentencepiece_codec.MARK + text).replace(" ", sentencepiece_codec.MARK):
        ids += search.feed(c)
        widest = max(widest, len(search.text))
    assert ids + search.finish() == library.encode(text) and widest <= 4 * pieces.longest


def test_pairs_are_kept_apart_as_by_merging():
    pieces, draw = sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model()), np.random.default_rng(2)
    known = list(pieces.ids)
    for _ in range(20_000):
        a, b = known[draw.integers(len(known))][-3:], known[draw.integers(len(known))][:4]
        if a in pieces.ids and b in pieces.ids:
            assert pieces.may_follow(a, b) == (pieces.merged(a + b) == [a, b])


def test_codec_equals_the_library_and_round_trips(spark):
    import sentencepiece

    texts = [*h.edge_texts(), "  two  spaces ", "line\nline\n\n end", "emoji 😀 and \t tab", " lead", "x" * 500, "a\u2581b \u2581"]
    path = sentencepiece_codec.default_model()
    encoded = sentencepiece_codec.encode(h.table(spark, texts, more=h.CLASHING), path)
    found = {r["doc_id"]: r for r in h.rows(encoded)}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, text in enumerate(texts):
        assert found[i]["ids"] == library.encode(text or ""), text
        assert found[i]["n_ids"] == len(found[i]["ids"]) and found[i]["round_trip"] == ("\u2581" not in (text or ""))
    back = {r["doc_id"]: r["text"] for r in h.rows(sentencepiece_codec.decode(encoded, path))}
    assert all(back[i] == (t or "").replace("\u2581", " ") for i, t in enumerate(texts))
    assert sentencepiece_codec.encode(h.table(spark, ["x"]).limit(0), path).count() == 0


# --- token files -----------------------------------------------------------------------------------------------------


def test_token_files_hold_what_the_tokenizer_gives(spark):
    from tokenizers import Tokenizer

    tokenizer = token_files.default_tokenizer()
    plain = Tokenizer.from_str(tokenizer)
    texts = [*h.edge_texts(), "Don't stop!! it's 3.5%", "naïve Éá co op a\x1cb", (2, "repeated id"), (None, "no id"), (40, "Mixed CASE, words."), (31, "x")]
    docs = h.table(spark, texts, more=h.CLASHING)
    folder = scratch_path(spark, "test")
    manifest = token_files.write(docs, folder, tokenizer, parts=3)
    found = sorted(h.rows(token_files.read(manifest, folder)), key=lambda r: r["start"])
    assert len(found) == len(texts)
    at, last = 0, None
    expected = sorted((zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in (x[1] if isinstance(x, tuple) else x for x in texts)))
    for r in found:
        assert r["start"] == at and (last is None or r["doc_id"] is not None and r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]
    assert sorted(r["ids_crc32"] for r in found) == expected
    part = next(m for m in h.rows(manifest) if m["documents"])
    assert token_files.tokens_of(folder, part["part"], 0, part["width"])[-1] == 1
    empty = scratch_path(spark, "test")
    assert token_files.read(token_files.write(docs.limit(0), empty, tokenizer), empty).count() == 0


def test_another_tokenizer_encodes_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        tokenizer = f.read()
    texts = ["two words  and   spaces", "x", None, " lead\nline"]
    folder = scratch_path(spark, "test")
    found = h.rows(token_files.read(token_files.write(h.table(spark, texts), folder, tokenizer, parts=2), folder))
    plain = Tokenizer.from_str(tokenizer)
    want = [zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts]
    assert [r["ids_crc32"] for r in sorted(found, key=lambda r: r["doc_id"])] == want


def test_word_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 2_000)
    words = token_files._Words(token_files.default_tokenizer(), "H")
    text = h.prose(3, 2000)
    parts = [text[i : i + 60] for i in range(0, len(text), 60)]
    assert all(words.encode(x) == words.ids(x) and len(words) <= 50 for x in parts)
    closed = sentencepiece_codec._Closed(sentencepiece_codec.Pieces.load(sentencepiece_codec.default_model()), sentencepiece_codec.MARK, 10_000)
    for word in text.split():
        closed[word]
    assert len(closed) <= 50


def test_training_reads_features_up_to_a_bound_of_bytes(spark):
    docs = h.table(spark, [h.prose(k, 50) for k in range(40)] + [h.prose(99, 60_000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(41)], "doc_id long, quality int, toxic int")
    s = quality_classifier.Settings()
    sample = quality_classifier.labelled_sample(docs, labels, s).collect()
    assert 20 < len(sample) < 41 and all(len(r["buckets"]) == len(r["counts"]) for r in sample)
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in sample)
    for r in sample[:5]:
        buckets, counts = quality_classifier.document_features(h.prose(r["doc_id"], 50).encode(), (1 << s.bits) - 1, {}) if r["doc_id"] < 40 else (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.uint32))
        assert np.array_equal(buckets, np.frombuffer(r["buckets"], np.int32)) and np.array_equal(counts, np.frombuffer(r["counts"], np.uint32))
    few = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample_bytes=40_000))
    none = quality_classifier.fit(docs, labels, quality_classifier.Settings(sample_bytes=10))
    assert few[0].any() and not none[0].any() and not np.array_equal(few[0], quality_classifier.fit(docs, labels)[0])


def test_words_of_one_run_are_encoded_without_offsets():
    """Only words that are several runs need offsets."""
    from skerry.llm.token_files import _Words, default_tokenizer

    words = _Words(default_tokenizer(), "H")
    library, text = words.tokenizer, "Some plain words, and (again) some more plain words."

    class Counted:
        asked = 0

        def encode(self, *a, **b):
            Counted.asked += 1
            return library.encode(*a, **b)

        def encode_batch_fast(self, *a, **b):
            return library.encode_batch_fast(*a, **b)

    words.tokenizer = Counted()
    plain = "several plain words"
    assert np.frombuffer(words.encode(plain), "<u2").tolist() == library.encode(plain, add_special_tokens=False).ids and not Counted.asked
    assert np.frombuffer(words.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
