"""Wikitext to sections, paragraphs and links: a small parser of our own, and its DataFrame form."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RESIDUE

Registry = dict[str, "str | Callable[[Template], str]"]


def page_title(t: str) -> str:
    t = t.strip().replace(" ", "_")
    return t if t[:1] == "ß" else t[:1].upper() + t[1:]


def anchor(t: str) -> str:
    return quote(t.replace(" ", "_"), safe=":").replace("%", ".")


@dataclass
class Template:
    name: str
    params: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, source: str) -> Template:
        """source: with its braces. Positional parameters are named 1, 2, ..."""
        first, *rest = _top_level(source[2:-2] if source.endswith("}}") else source[2:], "|")
        out, k = cls(page_title(first)), 0
        for p in rest:
            name, eq, value = p.partition("=")
            if not eq or re.search(r"[\[{<]", name):
                k += 1
                name, value = str(k), p
            out.params[name.strip()] = value.strip() if eq else value
            out.order.append(name.strip())
        return out

    def get(self, *names: str) -> str | None:
        return next((plain(self.params[n]) for n in names if n in self.params), None)


def _top_level(s: str, mark: str) -> list[str]:
    out, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|" + re.escape(mark), s):
        if m[0] == mark:
            if not depth:
                out.append(s[at : m.start()])
                at = m.end()
        else:
            depth = max(0, depth + (1 if m[0][0] in "{[" else -1))
    return [*out, s[at:]]


def _span(names: list[str]) -> str:
    return "".join('<span id="{}"></span>'.format(n.replace('"', '\\"')) for n in names)


def _visible_anchor(t: Template) -> str:
    values = [plain(t.params[k]) for k in t.order]
    return _span(values[1:]) + values[0] if values else ""


def _nihongo(t: Template) -> str:
    bracket = t.get("2")
    out = t.get("1") or ""
    if bracket is not None:
        out += f" ({bracket}?"
    out += "".join(f", {v}" for v in (t.get("3"), t.get("4")) if v is not None)
    if "4" not in t.params and "extra" in t.params and bracket is not None:
        out += ", " + t.get("extra")
    if bracket is not None:
        out += ")"
    after = t.get("5", "extra2")
    return out + (f" {after}" if after is not None else "")


def _quotation(*names: str) -> Callable[[Template], str]:
    def f(t: Template) -> str:
        q = t.get(*names)
        return "" if q is None else f"<blockquote>{q}</blockquote>"

    return f


_SAID = ("text", "quote", "quotetext", "content")
_TABLE_END = re.compile(r"(?i)(?:^|[^a-z])(?:end|footer|bottom|c-e)\d*$|(?:btm|[a-z]End|_footer_\w+)\d*$|^end(?:_box)?$")
_TABLE_START = re.compile(r"(?i)start|begin|header|(?:inttop|[-_/ ]top|jcttop|table_?top|^\w*listtop)|[-_ ]table\d*$|^electiontable$|table/|team_roster$|game_log|^munelec\d?$|^canelec\d-by$|^legseats\d$|election_box|^tls-h\d?$|^c-s$|^colort$|^ordinal_us_congress|^bab-exitlist$|^fb_rs$|_parliament_election$|basketball_player_statistics")


def default_template(name: str) -> str | Callable[[Template], str] | None:
    """What stands for a template that no registry names: opening and closing parts of tables, by the shape of their names."""
    if _TABLE_END.search(name):
        return "|}\n\n"
    if _TABLE_START.search(name):
        return "\n\n{|"
    return None


def _escapes() -> dict[str, str]:
    out = {"!": "&#124;", "!!": "&#124;" * 2, "=": "&#61;", "Nbsp": "&nbsp;"}
    for k in (1, 2, 3):
        out |= {"(" * k: "&#123;" * k, ")" * k: "&#125;" * k}
    for k in (1, 2):
        out |= {"!" + "(" * k: "&#91;" * k, ")" * k + "!": "&#93;" * k}
    return out


TEMPLATES: Registry = {
    **_escapes(),
    **dict.fromkeys(("Visible_anchor", "Visanc", "Vanchor"), _visible_anchor),
    "Anchor": lambda t: _span([plain(t.params[k]) for k in t.order]),
    "Flag": lambda t: t.get("name", "1") or "",
    "As_of": "As of DATE",
    "Convert": "MEASUREMENT",
    "Nihongo": _nihongo,
    "Iast": lambda t: t.get("1") or "",
    **dict.fromkeys(("Quote", "Quote_box", "Cquote", "Quote_frame"), _quotation(*_SAID, "1")),
    "Rquote": _quotation(*_SAID, "2"),
}

_DROPPED = re.compile(r"(?is)<\s*(onlyinclude|includeonly|ref)\s*>.*?<\s*/\s*\1\s*>|<!--.*?-->")
_LITERAL = re.compile(r"(?is)<\s*(nowiki|math|ce|chem)\s*>.*?<\s*/\s*\1\s*>|<\s*math\s*chem\s*>.*?<\s*/\s*math\s*>")


def _masked(s: str) -> str:
    return _LITERAL.sub(lambda m: " " * len(m[0]), s)


def outermost(s: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Ranges of the outermost pairs, literals aside; one that isn't closed goes to the end. Triple braces count as pairs of their own."""
    text, stack, out = _masked(s), [], []
    tokens = r"\{\{\{|\}\}\}|\{\{|\}\}" if opening == "{{" else re.escape(opening) + "|" + re.escape(closing)
    at = 0
    while m := re.compile(tokens).search(text, at):
        t, at = m[0], m.end()
        if t[0] == "{":
            stack.append((t, m.start()))
        elif stack:
            if t == "}}}" and len(stack[-1][0]) == 2:
                t, at = "}}", m.start() + 2
            if len(t) == len(stack[-1][0]):
                mark, begin = stack.pop()
                if mark == opening and not any(x == opening for x, _ in stack):
                    out.append((begin, at))
    left = [b for x, b in stack if x == opening]
    if left:
        out = [r for r in out if r[1] <= left[0]] + [(left[0], len(s))]
    return sorted(out)


def _replace(s: str, ranges: list[tuple[int, int]], by: Callable[[str], str]) -> str:
    out, at = [], 0
    for a, b in ranges:
        out += [s[at:a], by(s[a:b])]
        at = b
    return "".join([*out, s[at:]])


def preprocess(s: str, templates: Registry | None = None, unknown: str = " ") -> str:
    """Templates expanded, tables and marks of lists and style taken away."""
    registry = TEMPLATES if templates is None else TEMPLATES | templates

    def expand(source: str) -> str:
        t = Template.of(source)
        f = registry.get(t.name, default_template(t.name))
        return unknown if f is None else f if isinstance(f, str) else f(t)

    s = re.sub(r"(\[\[[^\[\]\n]*)\n([^\[\]\n]*\]\])", r"\1 \2", _DROPPED.sub("", s))
    s = _replace(s, outermost(s, "{{", "}}"), expand)
    s = _replace(s, outermost(s, "{|", "|}"), lambda _: "")
    s = re.sub(r"(?m)^[#*;:]+[^\S\n]*(.*)$", r"\n\n\1\n\n", s)
    s = re.sub(r"<\s*/?\s*(?:ol|ul|li)\b[^>]*>", "\n\n", s)
    return re.sub("'{2,3}", " ", s)


_NO_TEXT = frozenset("ref gallery score math ce sub sup pre table imagemap timeline source syntaxhighlight onlyinclude".split())
_INLINE = re.compile(r"(?is)\[\[|\[(?:https?|ftp)?:?//[^\s\]]*(?:\s+(?P<label>[^\]]*))?\]|<(?P<close>/?)\s*(?P<tag>[a-z][a-z0-9]*)\b[^>]*?(?P<empty>/?)>|&(?:\#\d+|\#x[0-9a-f]+|[a-z][a-z0-9]*);")


@dataclass
class Link:
    start: int
    end: int
    title: str
    article: str
    section: str | None


def _wikilink_end(s: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"\[\[|\]\]").finditer(s, at):
        depth += 1 if m[0] == "[[" else -1
        if not depth:
            return m.end()
    return -1


def render(s: str) -> tuple[str, list[Link]]:
    """Text of wikitext without templates, and its links with their places in it."""
    out: list[str] = []
    links: list[Link] = []
    size = at = 0

    def put(t: str) -> None:
        nonlocal size
        out.append(t)
        size += len(t)

    def words(t: str) -> None:
        if links and links[-1].end == size and (m := re.match("[a-zA-Z]+", t)):  # letters right after a link belong to it
            links[-1].end += len(m[0])
            links[-1].title += m[0]
        if t:
            put(t)

    while m := _INLINE.search(s, at):
        words(s[at : m.start()])
        at = m.end()
        if m[0] == "[[":
            end = _wikilink_end(s, m.start())
            if end < 0:
                put("[[")
                continue
            at = end
            target, *label = _top_level(s[m.start() + 2 : end - 2], "|")
            space, colon, _ = target.partition(":")
            if colon and space.strip().capitalize() in ("Category", "File", "Image"):
                continue
            title = (plain("|".join(label)) if label else "") or plain(target)
            lead, trail = len(title) - len(title.lstrip()), len(title) - len(title.rstrip())
            put(title[:lead])
            begin, core = size, title.strip()
            put(core)
            if core and not colon:
                article, sharp, section = target.partition("#")
                links.append(Link(begin, size, core, page_title(article), anchor(section) if sharp else None))
            put(title[len(title) - trail :] if core else "")
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag == "br":
                put("\n")
            elif tag in _NO_TEXT and not m["close"] and not m["empty"]:
                close = re.compile(rf"(?is)<\s*/\s*{tag}\s*>").search(s, at)
                at = close.end() if close else at
            elif tag in ("p", "blockquote"):
                put("\n\n")
        elif m[0][0] == "[":
            put(plain(m["label"]) if m["label"] else "URL")
        else:
            put(html.unescape(m[0]))
    words(s[at:])
    return "".join(out), links


def plain(s: str) -> str:
    return render(s)[0]


def paragraphs(s: str) -> tuple[list[tuple[str, list[Link]]], int]:
    """(text, links) of the paragraphs worth keeping, with single blanks for runs of white space, and the number of the others."""
    text, links = render(s)
    kept, skipped = [], 0
    cuts = [(m.start(), m.end()) for m in re.finditer(r"\s*\n\s*\n\s*", text)]
    for start, end in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]):
        begin = start + len(text[start:end]) - len(text[start:end].lstrip("\n"))
        raw = text[begin:end].rstrip("\n")
        gaps = [(g.start(), g.end()) for g in re.finditer(r"\s{2,}|\n", raw)]
        clean = re.sub(r"\s{2,}|\n", " ", raw)

        def place(i: int, gaps=gaps) -> int:
            return i - sum(min(i, b) - a - 1 for a, b in gaps if a < i and min(i, b) > a)

        own = []
        for x in links:
            if begin <= x.start and x.end <= end:
                a, b = place(x.start - begin), place(x.end - begin)
                title = re.sub(r"\s{2,}|\n", " ", x.title)
                if clean[a:b] == title:
                    own.append(Link(a, b, title, x.article, x.section))
        letters = len(re.findall("[A-Za-z]", clean))
        if not clean:
            continue
        if re.search(RESIDUE, clean) or len(clean.split(" ")) < 5 or len(clean) < 15 or 2 * letters < len(clean):
            skipped += 1
        else:
            kept.append((clean, own))
    return kept, skipped


_HEADING = re.compile(r"^(=+)(.*?)(=+)\s*$")


def parse(s: str, templates: Registry | None = None) -> tuple[list[dict], int]:
    """Sections with index, parent_index, level, title, ids and paragraphs, and the number of paragraphs left out."""
    blocks: list[str] = [""]
    for line in preprocess(s, templates).splitlines(keepends=True):
        if _HEADING.match(line):
            blocks.append("")
        blocks[-1] += line
    out, skipped, path = [], 0, []
    used: set[str] = set()
    numbers: dict[str, int] = {}
    anchors: set[str] = set()
    for block in (b for b in blocks if b.strip()):
        index, title, level, ids = len(out), None, 2, []
        first, _, rest = block.partition("\n")
        if m := _HEADING.match(first):
            level = min(len(m[1]), len(m[3]), 6)
            title = plain(m[2]).strip()
            name = anchor(title)
            while True:
                numbers[name] = numbers.get(name, 0) + 1
                unique = name if numbers[name] == 1 else f"{name}_{numbers[name]}"
                if unique not in used:
                    break
            used.add(unique)
            ids = [unique]
            for a in map(anchor, re.findall(r"""(?i)<[a-z][^>]*?\bid\s*=\s*["']?([^"'>]+)""", m[2])):
                if a not in anchors:
                    anchors.add(a)
                    ids.append(a)
            block = rest
        while path and path[-1][1] >= level:
            path.pop()
        kept, left = paragraphs(block)
        skipped += left
        out.append({"index": index, "parent_index": path[-1][0] if path else None, "level": level, "title": title, "ids": ids, "paragraphs": kept})
        path.append((index, level))
    return out, skipped


SECTIONS = "id long, skipped int, sections array<struct<section_index: int, parent_index: int, title: string, ids: array<string>, paragraphs: array<struct<text: string, links: array<struct<start: int, end: int, title: string, linked_article: string, linked_section: string>>>>>>"


def parse_pages(pages: DataFrame, templates: Registry | None = None) -> DataFrame:
    """(id, skipped, sections) for pages(id, text); text that can't be parsed has no sections."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, skipped = parse(s or "", templates)
                rows.append({"id": i, "skipped": skipped, "sections": [
                    {"section_index": x["index"], "parent_index": x["parent_index"], "title": x["title"], "ids": x["ids"], "paragraphs": [
                        {"text": t, "links": [{"start": y.start, "end": y.end, "title": y.title, "linked_article": y.article, "linked_section": y.section} for y in ls]} for t, ls in x["paragraphs"]]}
                    for x in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("id", "text").mapInArrow(run, SECTIONS)


def shred(parsed: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of parse_pages: sections, section_ids, paragraphs and links."""
    s = parsed.selectExpr("id article_id", "inline(sections)")
    p = s.selectExpr("article_id", "section_index", "posexplode(paragraphs) (paragraph_index, p)")
    return {
        "sections": s.select("article_id", "section_index", "parent_index", "title"),
        "section_ids": s.selectExpr("article_id", "section_index", "explode(ids) id_string"),
        "paragraphs": p.selectExpr("article_id", "section_index", "paragraph_index", "p.text text"),
        "links": p.selectExpr("article_id", "section_index", "paragraph_index", "inline(p.links)").withColumnRenamed("title", "link_title"),
    }


def counters(parsed: DataFrame) -> DataFrame:
    """One row of n_pages, n_paragraphs kept, n_skipped and n_pages_with_skips of parse_pages()."""
    kept = F.aggregate("sections", F.lit(0).cast("bigint"), lambda a, s: a + F.size(s["paragraphs"]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return parsed.agg(F.count("*").alias("n_pages"), total(kept).alias("n_paragraphs"), total(F.col("skipped")).alias("n_skipped"), F.count_if(F.col("skipped") > 0).alias("n_pages_with_skips"))
