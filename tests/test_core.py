"""The engine's parts on small tables of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import transforms, values
from skerry.operators import chunks, files, graph, listing, quality, search, semantic, sync
from skerry.plans import base_query as bq
from skerry.plans import registry
from skerry.sources import markdown, vault
from skerry.streaming import events


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def code(f, *args, **kwargs):
    with pytest.raises(EngineError) as e:
        f(*args, **kwargs)
    return e.value.code


# --- view queries ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def notes(spark):
    heads = [{"k": [1, 2], "s": "a && (b)", "n": 12, "f": 12.0, "t": True, "z": None, "o": {"x": 1}}, {"k": ["1", "x"], "s": 'say "b"', "n": 3}, {"k": "1", "s": "other"}, {}]
    data = [(f"{'work/deep' if i == 0 else 'work' if i == 1 else ''}{'/' if i < 2 else ''}n{i}.md", f"n{i}", "work/deep" if i == 0 else "work" if i == 1 else "", ["a/b"] if i == 0 else ["a"], json.dumps(x)) for i, x in enumerate(heads)]
    return spark.createDataFrame(data, "path string, basename string, folder string, tags array<string>, frontmatter_json string").cache()


def kept(notes, filters):
    got = bq.run(notes, bq.from_inline({"filters": filters, "order": ["file.path"]}))
    return sorted(int(r[0].rsplit("n", 1)[1][0]) for r in got.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ('k.contains("1")', [1, 2]),  # strings of an array only, or a part of a string
        ('s.contains("a && (b)")', [0]),
        ("s == 'say \"b\"'", [1]),
        ("n == 12", [0]),
        ("n == 12.0", []),
        ("f == 12.0", [0]),
        ("f == 12", []),
        ("t == true", [0]),
        ("z == null && missing == null", [0, 1, 2, 3]),
        ("z != null", []),
        ('n == 3 || n == 12 && s == "other"', [1]),
        ('(n == 3 || n == 12) && !s.contains("say")', [0]),
        ("!(n == 3) && !!(n == 12)", [0]),
        ('file.inFolder("work")', [0, 1]),
        ('file.inFolder("work/deep/")', [0]),
        ('file.hasTag("a")', [1, 2, 3]),
        ("n==3||n==12", [0, 1]),
        ({"or": [{"and": ["n == 3"]}, {"not": ["k != null"]}]}, [1, 3]),
        ({"and": []}, [0, 1, 2, 3]),
        ({"or": []}, []),
        ({"not": []}, []),
        (None, [0, 1, 2, 3]),
    ],
)
def test_filters(notes, text, want):
    assert kept(notes, text) == want


@pytest.mark.parametrize("text", ["(n == 3", "n == 3)", "n > 3", "n == other", "n == 3 &&", "|| n == 3", "n", "file.hasTag(a)", "n == 3 n == 4 )", "! ", "f(1) == 2", ""])
def test_bad_filters(notes, text):
    assert code(kept, notes, text) == "query/base-query-unsupported-filter"


def test_codes_of_definitions(notes):
    ok = {"order": ["file.path"]}
    assert code(bq.from_inline, {}) == "query/base-query-no-columns"
    assert code(bq.from_inline, ok | {"limit": 0}) == code(bq.from_inline, ok | {"limit": True}) == code(bq.from_inline, ok | {"sort": [{"property": "a", "direction": "up"}]}) == "query/base-query-malformed"
    assert code(kept, notes, "formula.x == 1") == "query/base-query-formula-reference"
    assert code(kept, notes, "file.other == 1") == "query/base-query-unsupported-file-property"
    assert code(kept, notes, {"xor": []}) == code(kept, notes, 7) == "query/base-query-malformed"
    assert code(bq.from_document, {"views": []}, "x") == "query/base-view-not-found"
    assert code(bq.parse_base, "- a\n- b") == code(bq.parse_base, "a: [") == "format/base-schema"


def test_documents_merge_filters_and_sort_dynamic_values(notes):
    document = bq.parse_base('filters: file.inFolder("work")\nformulas: {l: file.asLink(s)}\nviews: [{name: v, type: table, filters: "n != 3", order: [file.path, formula.l, formula.q]}]')
    got = rows(bq.run(notes, bq.from_document(document, "v")))
    assert [(r["file.path"], r["formula.l"]["display"], r["formula.q"]) for r in got] == [("work/deep/n0.md", "a && (b)", "formula.q (not evaluated)")]
    by_k = bq.from_inline({"order": ["file.path"], "sort": [{"property": "k", "direction": "DESC"}]})
    # arrays after strings, and the missing one first; descending is the reverse
    assert [r[0][-4] for r in bq.run(notes, by_k).collect()] == ["0", "1", "2", "3"]
    assert bq.run(notes, by_k, limit=2).count() == 2 and rows(bq.matched(notes, by_k))[0]["matched"] == 4
    marks = notes.selectExpr("path", "path LIKE 'work%' AS done")
    got = bq.summarize(marks, bq.from_inline({"order": ["path"], "summaries": {"done": "Checked"}})), bq.summarize(marks, bq.from_inline({"order": ["path"], "summaries": {"done": "Unchecked"}}))
    assert [r.first()[0] for r in got] == [2, 2]
    assert rows(notes.select(values.scalar_text(values.of_json(F.col("frontmatter_json"), "k")).alias("x")))[0]["x"] == "1, 2"


# --- notes -------------------------------------------------------------------------------------------------------------


NOTE = """---
title: " My Note "
tags: [one, "#two", 3]
when: 2024-01-02
---
# First # ##
Body #tag and `#code` ``a ` #no`` #12 #x/y. See [[Other#Head|shown]] and ![[pic.png]] \\[[not]].
```
# no heading #no [[no]]
```
%% [[hidden]]
[[hidden too]] %% [[#^block]]
## Second
"""


def test_markdown():
    head, body = markdown.frontmatter(NOTE)
    assert head["title"] == " My Note " and head["when"] == "2024-01-02"
    assert markdown.tags(head, body) == ["one", "two", "tag", "x/y"]
    assert markdown.headings(body) == ["First #", "Second"] and markdown.title(head, [], "p.md") == "My Note"
    found = markdown.links(body)
    assert [(x.target, x.heading, x.block, x.display, x.embed) for x in found] == [("Other", "Head", None, "shown", False), ("pic.png", None, None, None, True), ("", None, "block", None, False)]
    targets = lambda text: [(x.target, x.embed, x.pos) for x in markdown.links(text)]
    assert targets("a ` [[x]]\n[[y]]") == [("y", False, 10)] and targets("a ` [[x") == [] and targets("``a ` [[x]]`` ![[y]]") == [("y", True, 15)]
    assert targets("[[a`b]] `[[c]]` [[d]]") == [("a`b", False, 0), ("d", False, 16)] and targets("\\[[no]] \\![[yes]] \\` [[z]]") == [("yes", False, 10), ("z", False, 21)]
    assert targets("%% [[no]] \n [[no %% [[yes]] %%`%%` [[no") == [("yes", False, 20)] and targets("%% ` %%\n[[no]] %% [[yes]]") == [("yes", False, 18)]
    assert targets("```\n[[no]] %%\n```\n[[a]]\n~~~\n[[open") == [("a", False, 18)]
    assert markdown.tags({}, "a ` #no\n#yes `x`#no `#no` #too") == ["yes", "too"]
    assert code(markdown.links, "[[open") == code(markdown.links, "[[ ]]") == "format/markdown"
    assert code(markdown.frontmatter, "---\na: 1") == code(markdown.frontmatter, "---\n[\n---\n") == code(markdown.frontmatter, "---\n- a\n---\n") == "format/frontmatter"
    assert markdown.merge_frontmatter({"a": 1, "b": {"c": 1, "d": 2}}, {"a": None, "b": {"c": None}, "e": [1]}, "now") == {"b": {"d": 2}, "e": [1], "updated": "now"}
    assert markdown.summary({}, "# Head\nA sentence. Another.", "x/a-b.md") == "Head: A sentence." and markdown.summary({}, "", "x/a-b.md") == "a b"
    assert markdown.directory_title("my-big_FOLDER x") == "My Big FOLDER X"
    assert markdown.sections("intro\n# A\none\r\n## B\n```\n# no\n```\n# C\n\n") == [([], "intro"), (["A"], "one"), (["A", "B"], "```\n# no\n```")]


def test_chunks_cover_their_sections(spark):
    text = "# Long\n" + " ".join(f"word{i}" for i in range(900)) + "\n# Short\nfew words"
    got = rows(chunks.chunk(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text"))
    assert {r["id"] for r in got} == {1} and [r["ordinal"] for r in got] == list(range(len(got))) and len(got) > 3
    body = got[0]["text"]
    for a in got[:-1]:
        assert len(a["text"]) <= 1600 + 800 and a["heading_context"] == ["Long"]
    for a, b in zip(got, got[1:-1]):
        shared = b["text"].split()[0]
        assert shared in a["text"].split() and len(a["text"].split(shared)[-1]) <= 160
    assert body in text and got[-1]["text"] == "few words"
    assert chunks.word_ranges([]) == [] and chunks.word_ranges([9000]) == [(0, 1)] and chunks.word_ranges([9000, 3]) == [(0, 2)]


def test_vault_folders_are_listed_by_tasks(spark, tmp_path):
    for path in ("r.md", "a/1.md", "a/b/2.md", "a/b/c/3.md", "d/4.md", "d/.git/5.md", "memory/log/6.md", "d/x.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    whole = {"r.md", "a/1.md", "a/b/2.md", "a/b/c/3.md", "d/4.md", "d/.git/5.md", "memory/log/6.md"}
    vault.register(spark)
    for options, parts in (({}, 4), ({"levels": 2}, 3 + 1), ({"levels": 9, "batch": 2}, 4), ({"folder": "a"}, 2), ({"folder": "a/b"}, 2), ({"folder": "none"}, 1)):
        df = spark.read.format("vault").options(**options).load(str(tmp_path))
        want = {p for p in whole if p.startswith(options.get("folder", "") + "/" if "folder" in options else "")}
        assert {r["path"] for r in rows(df)} == want, options
        assert len(vault.VaultReader({"path": str(tmp_path)} | {k: str(v) for k, v in options.items()}).partitions()) == parts, options
    kept = {r["path"] for r in rows(df.sparkSession.read.format("vault").load(str(tmp_path)).where(vault.indexed(F.col("path"))))}
    assert kept == whole - {"memory/log/6.md"}


def test_vault_source(spark, tmp_path):
    for path, text in {"a.md": NOTE, "b/c.md": "see [[a]]", "b/_d.md": "x", ".git/e.md": "no", "b/bad.md": None, "b/f.txt": "no", "g.md": "---\nopen"}.items():
        full = tmp_path / path
        full.parent.mkdir(exist_ok=True)
        full.write_bytes(b"\xff\xfe" if text is None else text.encode())
    vault.register(spark)
    df = spark.read.format("vault").load(str(tmp_path))
    got = {r["path"]: r for r in rows(df)}
    assert set(got) == {"a.md", "b/c.md", "b/_d.md", "g.md"}
    assert got["a.md"]["title"] == "My Note" and got["a.md"]["links"] == ["Other", ""] and got["a.md"]["embeds"] == ["pic.png"] and json.loads(got["a.md"]["frontmatter_json"])["when"] == "2024-01-02"
    assert got["g.md"]["fm_error"] and got["b/c.md"]["folder"] == "b" and got["b/c.md"]["ext"] == "md"
    assert [r["path"] for r in rows(spark.read.format("vault").option("exclude", "b").load(str(tmp_path)).orderBy("path"))] == ["a.md", "g.md"]
    assert sorted(r["path"] for r in rows(df.where("folder = 'b'"))) == ["b/_d.md", "b/c.md"]
    assert sorted(r["path"] for r in rows(spark.read.format("vault").option("folder", "b").load(str(tmp_path)))) == ["b/_d.md", "b/c.md"]
    edges = rows(vault.out_links(df))
    assert {(e["from"], e["target"], e["kind"]) for e in edges} == {("a.md", "Other", "link"), ("a.md", "pic.png", "embed"), ("a.md", "", "link"), ("b/c.md", "a", "link")}
    parsed = vault.parse_notes(spark.createDataFrame([("x.md", b"# T\n#q"), ("y.md", b"\xff")], "path string, content binary"))
    assert [(r["path"], r["tags"]) for r in rows(parsed)] == [("x.md", ["q"])]
    assert rows(quality.bad_frontmatter(df))[0]["path"] == "g.md"


# --- graph and search ----------------------------------------------------------------------------------------------------


def _graph(spark):
    notes = spark.createDataFrame([("a.md", "A"), ("b/x.md", "X"), ("c/x.md", "X2"), ("lone.md", "L")], "path string, title string")
    links = spark.createDataFrame([("1", "a.md", "x", "link"), ("2", "b/x.md", "gone", "link"), ("3", "c/x.md", "a", "link"), ("4", "a.md", "", "link")], "edge_id string, `from` string, target string, kind string")
    return graph.resolve(links, notes)


def test_graph_errors_and_paths(spark):
    nodes, edges = _graph(spark)
    assert code(graph.distances, edges, "zzz") == code(graph.shortest_path, edges, "a.md", "zzz") == "path/not-found"
    assert code(graph.distances, edges, "a.md", 5) == code(graph.distances, edges, "a.md", 1, "up") == "index/invalid-query"
    assert rows(graph.distances(edges, "lone.md", nodes=nodes)) == [{"path": "lone.md", "distance": 0}]
    assert [r["path"] for r in rows(graph.shortest_path(edges, "c/x.md", "gone").orderBy("hop"))] == ["c/x.md", "a.md", "b/x.md", "gone"]
    assert graph.shortest_path(edges, "gone", "a.md").count() == 0
    chain = spark.createDataFrame([(str(i), f"n{i:03}", f"n{i + 1:03}", "link") for i in range(12)], "edge_id string, `from` string, to string, kind string")
    assert graph.shortest_path(chain.coalesce(1), "n000", "n012").count() == 13


def test_graph_upkeep(spark):
    nodes, edges = _graph(spark)
    notes = spark.createDataFrame([("gone", "Now here"), ("a.md", "A2")], "path string, title string")
    links = spark.createDataFrame([("9", "a.md", "new", "link")], "edge_id string, `from` string, target string, kind string")
    nodes, edges = graph.upsert(nodes, edges, notes, links)
    assert {(r["path"], r["title"], r["phantom"]) for r in rows(nodes)} == {("a.md", "A2", False), ("b/x.md", "X", False), ("c/x.md", "X2", False), ("lone.md", "L", False), ("gone", "Now here", False), ("new", "new", True)}
    assert {(r["from"], r["to"]) for r in rows(edges)} == {("a.md", "new"), ("b/x.md", "gone"), ("c/x.md", "a.md")}
    nodes, edges = graph.remove(nodes, edges, spark.createDataFrame([("a.md",), ("lone.md",)], "path string"))
    assert {(r["path"], r["title"], r["phantom"]) for r in rows(nodes)} == {("a.md", "a.md", True), ("b/x.md", "X", False), ("c/x.md", "X2", False), ("gone", "Now here", False)}
    assert {(r["from"], r["to"]) for r in rows(edges)} == {("b/x.md", "gone"), ("c/x.md", "a.md")}


def test_links_for_reading(spark):
    found = spark.createDataFrame([("Folder/Note.md",), ("pic.PNG",)], "path string")
    links = spark.createDataFrame([("x", t) for t in ("note", "folder/note", "FOLDER/NOTE.md", "other/note", "pic.png", "pic", "../note", "/note", "a:b", "")], "`from` string, target string")
    got = {r["target"]: r["resolved"] for r in rows(graph.resolve_reading(links, found))}
    assert [t for t, x in got.items() if x] and {t for t, x in got.items() if x} == {"note", "folder/note", "FOLDER/NOTE.md", "pic.png"}


def test_words_and_phrases_of_a_search(spark):
    df = spark.range(1)
    assert code(search.parse, '"open', ["body"]) == code(search.parse, "x:y", ["body"]) == code(search.parse, "", ["body"]) == "index/invalid-query"
    counted = df.select(search.frequency(search.tokens(F.lit("a b a b a a b")), search.Clause(["a", "b"])).alias("n"), search.frequency(search.tokens(F.lit("a a a")), search.Clause(["a", "a"])).alias("m")).first()
    assert counted["n"] == 3 and counted["m"] >= 1


def test_tokens_snippets_and_nested_fields(spark):
    def of(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert of(search.tokens(F.lit("Ünï-código 42 " + "x" * 40 + " " + "y" * 39))) == ["ünï", "código", "42", "y" * 39]
    text = "# Top\n" + "filler " * 60 + "apple once.\n## Deep ##\n" + "more " * 60 + "apple and pear, apple again.\n```\n# code\n```\ntail"
    got = of(search.snippet(F.lit(text), ["apple", "pear"]))
    assert got.startswith("Deep › ") and got.count("<b>apple</b>") == 2 and "<b>pear</b>" in got
    assert of(search.snippet(F.lit("  no match here " + "z" * 300), ["apple"])) == ("no match here " + "z" * 300)[:160]
    document = F.lit('{"a": {"b": ["x", 1], "c": 3}, "a.b": 9}')
    assert of(search.field_equals(document, "a.b", "x")) and of(search.field_equals(document, "a.c", 3)) and not of(search.field_equals(document, "a.b", "1")) and code(search.field_equals, document, "a", None) == "index/invalid-query"


def test_semantic_queries(spark):
    made = [("a.md", i, ["H"], f"text {i}", f"h{i}") for i in range(6)]
    now = spark.createDataFrame(made, "path string, ordinal int, heading_context array<string>, text string, content_hash string")
    stored = semantic.embed(now).cache()
    hits = rows(semantic.query(stored, now.where("ordinal <> 2"), "text 4", 6))
    assert hits[0]["text"] == "text 4" and abs(hits[0]["score"] - 1) < 1e-6 and len(hits) == 5 and hits[0]["heading_context"] == ["H"]
    assert semantic.query(stored, now, "x", 0).count() == 0 and code(semantic.embed, now, "none") == "embedding/local-unavailable"
    edited = now.where("ordinal > 0").withColumn("content_hash", F.when(F.col("ordinal") == 1, "other").otherwise(F.col("content_hash")))
    fresh, report = semantic.refresh(stored, edited)
    assert fresh.count() == 5 and rows(report) == [{"paths_scanned": 1, "embedded": 1, "skipped": 4, "failed": 0}]
    indexed = spark.createDataFrame([("a", 1, 10), ("b", 1, 12)], "path string, mtime long, indexed_at long")
    assert rows(semantic.status(indexed, spark.createDataFrame([("a", 2), ("c", 1)], "path string, mtime long"))) == [{"documents": 2, "stale_estimate": 3, "last_build": 12}]


# --- files ---------------------------------------------------------------------------------------------------------------


def test_files(spark):
    content = [("d/a.md", b"# hi"), ("d/x.png", b"\x89PNG\r\n\x1a\n123"), ("d/y.md", b"%PDF-1"), ("z", b"a\x00b"), ("e/q.json", b"{}"), ("w", "hé".encode())]
    df = spark.createDataFrame(content, "path string, content binary")
    got = {r["path"]: r for r in rows(files.attachments(df, 10))}
    assert {p: r["mime"] for p, r in got.items()} == {"d/a.md": "text/markdown", "d/x.png": "image/png", "d/y.md": "application/pdf", "z": "application/octet-stream", "e/q.json": "application/json", "w": "text/plain"}
    assert got["d/x.png"]["error"] == "io/too-large" and got["d/x.png"]["content"] is None and not got["z"]["is_text"] and got["w"]["is_text"]
    facts = {r["path"]: r for r in rows(files.info(df, 5))}
    assert facts["d/a.md"]["size"] == 4 and len(facts["d/a.md"]["sha256"]) == 64 and facts["d/x.png"]["sha256"] is None
    texts = spark.createDataFrame([("d/a.md", "hello"), ("b.md", "x" * 20)], "path string, text string")
    asked = spark.createDataFrame([(0, "d/a.md"), (1, "no"), (2, "d"), (3, "b.md"), (4, "d/a.md")], "seq int, path string")
    assert [(r["text"], r["error"]) for r in rows(files.read_many(asked, texts, 10).orderBy("seq"))] == [("hello", None), (None, "path/not-found"), (None, "path/not-file"), (None, "io/too-large"), ("hello", None)]
    sized = spark.createDataFrame([("v", "a/b.md", 1), ("v", "a/b.md", 1), ("v", ".git/c.md", 1), ("w", "c.txt", 2), ("w", "d.md", 3)], "vault string, path string, size int")
    found = files.resources(sized, ["**/*.md", "*.txt"])
    assert {(r["vault"], r["path"], r["mime"]) for r in rows(found)} == {("v", "a/b.md", "text/markdown"), ("w", "c.txt", "text/plain"), ("w", "d.md", "text/markdown")}
    assert {(r["vault"], r["resources"]) for r in rows(files.resource_counts(found))} == {("v", 1), ("w", 2)}
    assert rows(files.allowed_roots(spark, {"home": "/v/"}, ["home"])) == [{"name": "home", "path": "/v", "managed": True}] and code(files.allowed_roots, spark, {"a/b": "/"}) == "path/invalid-vault-name"


def test_edits(spark):
    texts = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", "keep")], "path string, text string")
    more = spark.createDataFrame([("a", "!"), ("b", "x"), ("n", "y")], "path string, addition string")
    assert {(r["path"], r["text"]) for r in rows(files.append(texts, more, "# P\n"))} == {("a", "one two two!"), ("b", "# P\nx"), ("c", "keep"), ("n", "# P\ny")}
    edits = spark.createDataFrame([("a", 1, "one", "1"), ("a", 2, "1 two", "3"), ("c", 1, "keep", "gone"), ("c", 2, "keep", "no")], "path string, seq int, old_text string, new_text string")
    assert {(r["path"], r["text"], r["error"]) for r in rows(files.exact_edits(texts, edits))} == {("a", "3 two", None), ("b", "", None), ("c", "keep", "edit/not-found at 2")}
    twice = spark.createDataFrame([("a", 1, "two", "2")], edits.schema)
    assert {r["error"] for r in rows(files.exact_edits(texts, twice))} == {"edit/ambiguous at 1", None}
    after = spark.createDataFrame([("a", "one 2 two"), ("c", "keep"), ("d", "new")], "path string, text string")
    got = {r["path"]: r for r in rows(files.diff(texts, after))}
    assert {p: r["status"] for p, r in got.items()} == {"a": "changed", "b": "removed", "d": "added"} and "-one two two\n+one 2 two" in got["a"]["patch"]
    assert rows(files.diff(texts, after, 12).where("path = 'a'"))[0]["truncated"] and code(files.diff, texts, after, 0) == "io/invalid-argument"
    new = spark.createDataFrame([("n.md", "A \"T\"", "body", {"status": '"done"', "extra": "[1]"}), ("m.md", " ", "", None)], "path string, title string, content string, overrides map<string,string>")
    made = {r["path"]: r for r in rows(files.new_notes(new, F.lit("2024-01-02")))}
    head, body = markdown.frontmatter(made["n.md"]["text"])
    assert list(head) == ["type", "title", "entity", "status", "created", "updated", "tags", "aliases", "extra"] and head["status"] == "done" and head["title"] == 'A "T"' and head["tags"] == [] and head["extra"] == [1] and body == "body"
    assert made["m.md"]["error"] == "note/empty-title" and made["m.md"]["text"] is None


def test_previews(spark):
    def cut(text, n):
        r = spark.range(1).select(files.bounded_preview(F.lit(text), n).alias("p")).first()["p"]
        return r["text"], r["shortened"]

    assert cut("ab\ncd\nef", 6) == ("ab\ncd\n", True) and cut("ab\ncd", 5) == ("ab\ncd", False) and cut("", 3) == ("", False)
    assert cut("abcdef", 3) == ("abcd", True) and cut("ééé", 2) == ("éé", True)


def test_managed_indexes(spark):
    begin, end = listing.MARKERS
    entries = spark.createDataFrame([("", "b.md", True, "B  text|x"), ("", "a", False, None), ("d", "c.md", True, "C"), ("e", "f.md", True, "F"), ("g", "h.md", True, "H")], "folder string, name string, is_file boolean, summary string")
    old = spark.createDataFrame([("", f"# Mine\n{begin}\n| Name | Summary |\n| --- | --- |\n| b.md | my own |\n| gone.md | x |\n{end}\ntail"), ("d", "# Text"), ("e", f"{end} {begin}")], "folder string, text string")
    made = listing.managed_indexes(entries, old)
    got = {r["folder"]: r for r in rows(made)}
    assert got[""]["text"] == f"# Mine\n{begin}\n| Name | Summary |\n| --- | --- |\n| a |  <!-- auto --> |\n| b.md | my own |\n{end}\ntail" and got[""]["state"] == "updated"
    assert got["d"]["text"].startswith("# Text\n\n## Contents\n\n" + begin) and "| c.md | C <!-- auto --> |" in got["d"]["text"]
    assert got["e"] == {"folder": "e", "text": f"{end} {begin}", "state": "invalid"} and got["g"]["state"] == "created"
    assert rows(listing.rebuild_report(made)) == [{"directories_scanned": 4, "created": 1, "updated": 2, "unchanged": 0, "invalid": 1}]
    again = listing.managed_indexes(entries, made.select("folder", "text"))
    assert {r["state"] for r in rows(again)} == {"unchanged", "invalid"}


def test_listings(spark):
    sized = spark.createDataFrame([("b/x.md", 5), ("a.md", 9), ("b/c/y.md", 1)], "path string, size int")
    assert [(r["name"], r["is_file"]) for r in rows(listing.listing(sized))] == [("b", False), ("a.md", True)]
    assert [r["name"] for r in rows(listing.listing(sized, by_size=True))] == ["b", "a.md"]
    assert [r["path"] for r in rows(listing.search(sized, "**/*.MD", ["b/c"]))] == ["a.md", "b/x.md"] and code(listing.glob_regex, "a[") == "io/invalid-pattern"
    assert [r["slug"] for r in rows(listing.slugs(spark.createDataFrame([(1, 1, "A b!"), (1, 2, "a-B"), (1, 3, "c")], "k int, n int, t string"), "k", "t", "n").orderBy("n"))] == ["a-b", "a-b-1", "c"]
    assert code(listing.lines, sized, "path", "path", head=1, tail=1) == "io/invalid-range"


# --- documents of other kinds ----------------------------------------------------------------------------------------------


def test_canvas(spark):
    drawn = {"nodes": [{"id": "a", "type": "text", "x": 0, "y": 0, "width": 100, "height": 50}, {"id": "b", "type": "text", "x": 200, "y": 10, "width": 10, "height": 10}, {"id": "b", "type": "text"}], "edges": [{"id": "e", "fromNode": "a", "toNode": "b"}, {"id": "f", "fromNode": "a", "toNode": "zz"}]}
    nodes, edges = quality.canvas_tables(spark.createDataFrame([("c", json.dumps(drawn))], "path string, json string"))
    found = quality.all_problems(quality.canvas_problems(nodes, edges), quality.canvas_problems(nodes, edges))
    assert {(r["code"], r["at"]) for r in rows(found)} == {("canvas/duplicate-id", "b"), ("canvas/dangling-edge", "edges[1].toNode")} and found.count() == 2
    left, near = quality.remove_canvas_nodes(nodes, edges, spark.createDataFrame([("c", "b")], "path string, id string"))
    assert [r["id"] for r in rows(left)] == ["a"] and [r["id"] for r in rows(near)] == ["f"]
    box = rows(quality.group_bounds(nodes.where("width > 0")))[0]
    assert (box["x"], box["y"], box["width"], box["height"]) == (-40, -40, 290, 130)
    more = quality.add_canvas_nodes(nodes, spark.createDataFrame([("c", 0, "text", 5)], "path string, pos int, type string, width int"))
    new = rows(more.where("width = 5"))[0]
    assert (new["x"], new["y"], new["id"], new["pos"]) == (270, 0, "node-3", 3)
    moved = rows(quality.update_canvas(nodes, spark.createDataFrame([("c", "a", 7)], "path string, id string, x int")).where("id = 'a'"))[0]
    assert moved["x"] == 7 and moved["width"] == 100
    grouped = quality.add_canvas_groups(nodes, spark.createDataFrame([("c", "a")], "path string, id string"))
    assert rows(grouped.where("type = 'group'"))[0]["width"] == 180
    assert [r["id"] for r in rows(quality.remove_canvas_edges(quality.add_canvas_edges(edges, spark.createDataFrame([("c", "g", "a", "b")], "path string, id string, fromNode string, toNode string")), spark.createDataFrame([("c", "e")], "path string, id string")).orderBy("id"))] == ["f", "g"]


def test_base_operations():
    base = {"formulas": {"f": "x"}, "views": [{"name": "v", "type": "table", "order": ["file.name", "formula.f"]}]}
    done = quality.edit_base(base, [{"op": "add_formula", "name": "g", "value": "y"}, {"op": "add_view", "name": "w", "value": {"type": "list", "order": ["formula.g"]}}, {"op": "update_view", "name": "v", "value": {"limit": 3}}, {"op": "set_property", "name": "p", "value": {"displayName": "P"}}, {"op": "set_summary", "name": "s", "value": "x"}, {"op": "remove_summary", "name": "s"}, {"op": "set_filters", "value": "a == 1"}])
    assert [v["name"] for v in done["views"]] == ["v", "w"] and done["views"][0]["limit"] == 3 and done["formulas"]["g"] == "y" and done["summaries"] == {} and "filters" not in base
    for bad in ({"op": "add_formula", "name": "f", "value": "z"}, {"op": "remove_view", "name": "no"}, {"op": "add_view", "name": "v"}, {"op": "set_property", "name": " "}, {"op": "other", "name": "x"}):
        assert code(quality.edit_base, base, [bad]) == "base/operation"
    assert code(quality.edit_base, base, [{"op": "remove_formula", "name": "f"}]) == "format/base-schema"
    assert quality.base_problems({"views": [{"type": "odd", "order": ["formula.no"], "summaries": {"a": "No"}}], "filters": {"xor": []}})


def test_transforms(spark):
    def of(f, text):
        return spark.range(1).select(f(F.lit(text)).alias("x")).first()["x"]

    assert of(transforms.strip_comments, "a %%x%% b `%%y%%`\n%%\nhid\nden\n%%\nc %%open") == "a  b `%%y%%`\nc %%open"
    assert of(transforms.highlights, "==a b== `==c==` == d ==\n```\n==e==\n```") == "<mark>a b</mark> `==c==` == d ==\n```\n==e==\n```"
    assert of(transforms.tag_spans, "#a/b x#c #1 `#d`") == '<span class="tag">#a/b</span> x#c #1 `#d`'
    assert of(transforms.block_ids, "text ^id-1\n^two\nno^three\n```\nx ^y\n```") == 'text <span id="id-1"></span>\n<span id="two"></span>\nno^three\n```\nx ^y\n```'
    text = "p one\np two ^a\n\n- l1\n- l2\n\n^b\n\nlast"
    assert [of(lambda t, n=n: transforms.block(t, F.lit(n)), text) for n in ("a", "b", "c")] == ["p one\np two", "- l1\n- l2", None]
    got = of(transforms.callouts, "> [!Hint]- Title\n> body\n> more\n\n> [!odd]\n```\n> [!no]\n```")
    assert [tuple(x) for x in got] == [("hint", "tip", "Title", "body\nmore"), ("odd", "odd", "Odd", "")]
    assert of(transforms.bad_callouts, "> [!ok]\n> [!bad one]\n```\n> [!x\n```\n>> [!]") == [2, 6]
    assert [tuple(x) for x in of(transforms.fences, "a\n```py\nx = 1\n```\n~~~\ny\n~~~")] == [("py", "x = 1"), ("", "y")]
    assert [tuple(x) for x in of(transforms.wikilinks, "[[a#h|d]] ![[p.png]] `[[no]]` [[^blk]]")] == [("a", "h", "d", False), ("p.png", None, None, True), ("", "^blk", None, False)]


def test_registry(spark):
    registry.register("ones", lambda spark, n=1: spark.range(n), "test")
    assert registry.names("test") == ["test_ones"] and registry.call(spark, "test_ones", n=3).count() == 3
    assert code(registry.register, "ones", lambda s: s, "test") == "registry/invalid-name" and code(registry.call, spark, "no") == "registry/unknown"


# --- change events -----------------------------------------------------------------------------------------------------------


def test_a_stream_fans_out_and_survives_a_failing_consumer(spark, tmp_path):
    schema = "kind string, path string, from_path string, origin string, summary string, at timestamp"
    at = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([("create", "a.md", None, "tool", "made\n it", at), ("move", "b.md", "a.md", "internal", "moved", at)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen, errors = {}, []

    def keep(name):
        return lambda df: seen.setdefault(name, []).extend(r["path"] for r in rows(df))

    def fail(df):
        raise ValueError("down")

    def log(df):
        lines = df.select(F.date_format("at", "yyyy-MM-dd").alias("day"), events.log_line(F.col("at"), F.col("origin"), F.col("kind"), F.col("summary"), F.array("path")).alias("line"))
        events.write_log(lines, f"{tmp_path}/log")

    query = events.run_fanout(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), {"index": keep("index"), "version": fail, "search": keep("search"), "log": log}, errors, f"{tmp_path}/state")
    assert query.awaitTermination(120) in (True, None)
    assert sorted(seen["search"]) == ["a.md", "b.md"] and seen["index"] == ["a.md"] and [(n, "down" in e) for _, n, e in errors] == [("version", True)]
    assert [r["value"] for r in rows(spark.read.text(f"{tmp_path}/log"))] == ["10:00:00 | tool | create | made it | files: a.md"]
    batch = spark.read.parquet(f"{tmp_path}/in")
    assert {(r["path"], r["action"]) for r in rows(events.applied(batch))} == {("a.md", "sync"), ("a.md", "remove"), ("b.md", "sync")}


def test_replay_of_a_change_log(spark):
    log = spark.createDataFrame([("node", "a", 1, "x", 1), ("node", "a", 2, "y", 2), ("edge", "a", 3, "z", 3), ("reset", "", 4, "", 4)], "kind string, key string, seq int, value string, generation int")
    assert sync.replay(log, 0, 4) is None and sync.replay(log, 0, 20_000) is None
    assert {(r["kind"], r["value"]) for r in rows(sync.replay(log.where("kind <> 'reset'"), 0, 3))} == {("node", "y"), ("edge", "z")}
    assert sync.replay(log, 4, 4).count() == 0
