"""Small parsers for one Markdown note: frontmatter, tags, headings, sections, links, summaries. Pure functions on text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from skerry.errors import EngineError

_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_TAG = re.compile(r"(?:(?<=\s)|^)#([\w/-]+)")
#: Code in a line: from a run of ticks to the next run of as many, or, where none follows, to the line's end.
_CODE = re.compile(r"(?P<ticks>`+)(?!`)(?:[^\n]*?(?<!`)(?P=ticks)(?!`)|[^\n]*)")


def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """YAML whose scalars are those of JSON: no dates, and only true and false as booleans."""

    Loader.yaml_implicit_resolvers = {
        c: [(tag, r) for tag, r in found if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int")] for c, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*)$"), list("-+0123456789"))
    return Loader


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """The YAML between a first line --- and the next one, and what follows; without such a first line the whole is the body."""
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip("\r") == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    raise EngineError("format/frontmatter", "the frontmatter isn't closed")


def frontmatter(text: str) -> tuple[dict, str]:
    """The frontmatter as a mapping, empty if there is none, and the body."""
    import yaml

    head, body = split_frontmatter(text)
    if head is None:
        return {}, body
    try:
        got = yaml.load(head, _loader())  # a SafeLoader
    except yaml.YAMLError as e:
        raise EngineError("format/frontmatter", str(e)) from e
    if got is not None and not isinstance(got, dict):
        raise EngineError("format/frontmatter", "the frontmatter is not a mapping")
    return got or {}, body


def merge_frontmatter(old: dict, patch: dict, today: str | None = None) -> dict:
    """A JSON merge patch: null removes a key, mappings merge; `updated` is stamped unless the patch sets it."""
    out = dict(old)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = merge_frontmatter(out[k] if isinstance(out.get(k), dict) else {}, v)
        else:
            out[k] = v
    if today and "updated" not in patch:
        out["updated"] = today
    return out


def _prose(text: str) -> list[str]:
    """Lines outside fenced code."""
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            out.append(line)
    return out


def valid_tag(tag: str) -> bool:
    return bool(re.fullmatch(r"[\w/-]+", tag)) and not re.fullmatch(r"[0-9]+", tag)


def tags(head: dict, body: str) -> list[str]:
    """Frontmatter tags first, then inline ones, each once."""
    given = head.get("tags")
    own = given if isinstance(given, list) else [given] if isinstance(given, str) else []
    found = [str(t).strip().lstrip("#") for t in own if isinstance(t, str)]
    for line in _prose(body):
        found += _TAG.findall(_CODE.sub("`", line))
    return list(dict.fromkeys(t for t in found if valid_tag(t)))


def headings(body: str) -> list[str]:
    return [m[2] for line in _prose(body) if (m := _HEADING.match(line.strip()))]


def title(head: dict, heads: list[str], path: str) -> str:
    """The frontmatter's title, else the first heading, else the file's name with spaces for - and _."""
    given = head.get("title")
    if isinstance(given, str) and given.strip():
        return given.strip()
    return heads[0] if heads else re.sub(r"[-_]", " ", re.sub(r"(?i)\.md$", "", path.rsplit("/", 1)[-1]))


_FENCED = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)")
_HEADINGS = re.compile(r"(?m)^[ \t]*(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")


def masked(text: str) -> str:
    """A text of the same length with blanks in place of fenced code, its lines and their places unchanged."""
    return _FENCED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def sections(text: str) -> list[tuple[list[str], str]]:
    """(headings above, trimmed text) of each part between headings that has any."""
    text = re.sub(r"\r\n?", "\n", text)
    heads = [(m.start(), m.end(), len(m[1]), m[2]) for m in _HEADINGS.finditer(masked(text))]
    trails = [[]]
    for _, _, level, name in heads:
        trails.append([x for x in trails[-1] if x[0] < level] + [(level, name)])
    begins, ends = [0, *(x[1] for x in heads)], [*(x[0] for x in heads), len(text)]
    parts = [([name for _, name in trail], text[a:b].strip()) for trail, a, b in zip(trails, begins, ends, strict=True)]
    return [(trail, body) for trail, body in parts if body]


@dataclass(frozen=True)
class Link:
    target: str
    display: str | None
    heading: str | None
    block: str | None
    embed: bool
    pos: int


#: What stands in prose besides letters, in the order in which one hides the others: code, a comment up to its second mark
#: (whose code may hold marks of its own), a character after a backslash, a link, and the beginning of an unclosed one.
_MARKUP = re.compile(rf"""(?x)
    {_CODE.pattern}
  | %%(?:{_CODE.pattern.replace("ticks", "inner")}|[^%`]|%(?!%))*(?:%%|\Z)
  | \\[^\n]?
  | (?P<embed>!?)\[\[(?P<link>[^\n]*?)\]\]
  | (?P<open>!?\[\[)
""")


def links(text: str) -> list[Link]:
    """Every [[target#heading|display]] and ![[embed]] outside code and %% comments; an unclosed or empty one is an error."""
    found = list(_MARKUP.finditer(masked(text)))
    if any(m["open"] for m in found):
        raise EngineError("format/markdown", "a link isn't closed")
    return [_link(m["link"], m["embed"] == "!", m.end("embed")) for m in found if m["link"] is not None]


def _link(inner: str, embed: bool, pos: int) -> Link:
    target, _, display = inner.partition("|")
    target, _, anchor = target.partition("#")
    if not target.strip() and not anchor.strip():
        raise EngineError("format/markdown", "a link is empty")
    block = anchor[1:] if anchor.startswith("^") else None
    return Link(target.strip(), display.strip() or None, (anchor or None) if block is None else None, block, embed, pos)


def summary(head: dict, body: str, path: str) -> str:
    """Title or heading, and the first sentence; else the title of the file's name."""
    heads = headings(body)
    name = title(head, heads, path)
    prose = " ".join(line.strip() for line in _prose(body) if line.strip() and not _HEADING.match(line.strip()))
    first = re.match(r"(.+?[.!?])(?:\s|$)", prose)
    text = first[1] if first else prose
    return f"{name}: {text}" if text else name


def directory_title(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[-_ ]+", name) if w)


def as_json(head: dict) -> str:
    return json.dumps(head, ensure_ascii=False)
