"""Wikitext to HTML, HTML to TEI, and XMI to TEI (HTML3, TXT1-3, SO4, SNK6 of the survey).

These are string-to-string helpers; the columns at the end of each section run them
inside tasks, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wikitext to HTML

MAX_DEPTH = 10
_template = re.compile(r"\{\{([^{}]*)\}\}")
_parameter = re.compile(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}")
_comment = re.compile(r"<!--.*?-->", re.S)
_link = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_external = re.compile(r"\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]")
_heading = re.compile(r"(={1,6})\s*(.+?)\s*\1\s*$")
_verbatim = re.compile(r"<(nowiki|pre)>(.*?)</\1\s*>|<nowiki\s*/>", re.S | re.I)
_reference = re.compile(r"<ref(?:\s+name\s*=\s*\"?([^\"/>]*)\"?)?\s*(?:/>|>(.*?)</ref\s*>)", re.S | re.I)
_notes = re.compile(r"<references\s*/>", re.I)
_switch = re.compile(r"__[A-Z]+__")
_kept = re.compile("\x7f([0-9]+)\x7f")
#: Stands for HTML that is put back at the end, with its number between two of these, or for the notes.
MARK = "\x7f"
_redirect = re.compile(r"#redirect\s*:?\s*\[\[([^\]|]+)[^\]]*\]\]", re.I)


def template_title(name: str) -> str:
    """The title under which a template's name is looked up."""
    name = " ".join(name.replace("_", " ").split())
    if name.lower().startswith("template:"):
        name = name[9:].lstrip()
    return name[:1].upper() + name[1:]


def transclude(text: str, templates: dict[str, str], depth: int = MAX_DEPTH) -> str:
    """Put templates in place, innermost first; unknown ones give nothing, as does what is nested too deep."""

    def filled(m: re.Match) -> str:
        name, *arguments = m[1].split("|")
        values: dict[str, str] = {}
        for i, argument in enumerate(arguments, 1):
            key, equals, value = argument.partition("=")
            values[key.strip() if equals else str(i)] = value.strip() if equals else argument
        body = templates.get(template_title(name), "")
        return _parameter.sub(lambda p: values.get(p[1].strip(), p[2] or ""), body)

    for _ in range(depth):
        text, n = _template.subn(filled, text)
        if not n:
            return text
    return _template.sub("", text)


def _href(target: str) -> str:
    return "/wiki/" + re.sub(r"[^\w:/().,#~-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), target.strip().replace(" ", "_"))


def _inline(text: str, categories: list[str], category_names: frozenset[str]) -> str:
    def link(m: re.Match) -> str:
        target, label = m[1].strip(), m[2]
        prefix, colon, rest = target.partition(":")
        if colon and prefix.strip() in category_names:
            categories.append(f"{prefix.strip()}:{rest.strip()}")
            return ""
        target = target.removeprefix(":")
        return f"<a href={quoteattr(_href(target))}>{label if label is not None else target}</a>"

    out = escape(text).replace("&lt;br/&gt;", "<br/>").replace("&lt;br /&gt;", "<br/>").replace("&lt;br&gt;", "<br/>")
    out = _link.sub(link, out)
    out = _external.sub(lambda m: f'<a href="{m[1]}">{m[2] or m[1]}</a>', out)
    out = re.sub(r"'''(.+?)'''", r"<b>\1</b>", out)
    return re.sub(r"''(.+?)''", r"<i>\1</i>", out)


def _cells(line: str, mark: str) -> list[str]:
    return [c.rpartition("|")[2] if "|" in c and "[[" not in c else c for c in re.split(r"\|\||!!" if mark == "!" else r"\|\|", line)]


def render(title: str | None, text: str | None, templates: dict[str, str] | None = None, category_names=frozenset({"Category"})) -> str | None:
    """HTML of a subset of wikitext: headings, emphasis, links, lists, nested tables, templates, categories, redirects, notes,
    literal and preformatted text, rules, page names; behaviour switches go.

    It begins with the title as a heading; categories come last, in the box that link
    extraction looks for. Markup outside the subset stays as text. Null text gives null.
    """
    if text is None:
        return None
    out = [f"<h1>{escape(title or '')}</h1>\n"]
    kept: list[str] = []
    notes: list[str] = []
    named: dict[str, int] = {}

    def keep(html: str) -> str:
        kept.append(html)
        return f"{MARK}{len(kept) - 1}{MARK}"

    def noted(m: re.Match) -> str:
        name, body = (m[1] or "").strip(), m[2] or ""
        number = named.get(name)
        if number is None:
            notes.append(body)
            number = len(notes)
            if name:
                named[name] = number
        elif not notes[number - 1]:
            notes[number - 1] = body
        return keep(f'<sup><a href="#note-{number}">[{number}]</a></sup>')

    text = _verbatim.sub(lambda m: "" if m[1] is None else keep(escape(m[2]) if m[1].lower() == "nowiki" else f"<pre>{escape(m[2])}</pre>"), text.replace(MARK, ""))
    text = _comment.sub("", text).replace("{{PAGENAME}}", title or "").replace("{{FULLPAGENAME}}", title or "")
    text = _reference.sub(noted, _switch.sub("", transclude(text, templates or {})))
    text = _notes.sub(f"\n{MARK}\n", text) if _notes.search(text) or not notes else f"{text}\n{MARK}"
    categories: list[str] = []
    if m := _redirect.match(text.lstrip()):
        out.append(f'<div class="redirectMsg"><p>Redirect to: <a href={quoteattr(_href(m[1]))}>{escape(m[1].strip())}</a></p></div>\n')
        text = text.lstrip()[m.end() :]
    lists, paragraph, table = "", [], 0
    names = {"*": ("ul", "li"), "#": ("ol", "li"), ";": ("dl", "dt"), ":": ("dl", "dd")}

    def end_paragraph() -> None:
        if paragraph and (body := " ".join(paragraph).strip()):
            out.append(f"<p>{body}</p>\n")
        paragraph.clear()

    def set_lists(new: str) -> None:
        nonlocal lists
        same = next((i for i, (a, b) in enumerate(zip(lists, new, strict=False)) if names[a][0] != names[b][0]), min(len(lists), len(new)))
        for mark in reversed(lists[same:]):
            out.append(f"</{names[mark][0]}>\n")
        for mark in new[same:]:
            out.append(f"<{names[mark][0]}>\n")
        lists = new

    for line in text.split("\n"):
        marks = re.match(r"[*#:;]+", line)
        if marks and not table:
            end_paragraph()
            set_lists(marks[0])
            tag = names[marks[0][-1]][1]
            out.append(f"<{tag}>{_inline(line[marks.end() :].strip(), categories, category_names)}</{tag}>\n")
            continue
        set_lists("")
        if m := _heading.match(line):
            end_paragraph()
            n = len(m[1])
            out.append(f"<h{n}>{_inline(m[2], categories, category_names)}</h{n}>\n")
        elif line.strip() == MARK:
            end_paragraph()
            if notes:
                items = "".join(f'<li id="note-{i}">{_inline(note.strip(), categories, category_names)}</li>\n' for i, note in enumerate(notes, 1))
                out.append(f'<ol class="references">\n{items}</ol>\n')
        elif (m := _kept.fullmatch(line.strip())) and kept[int(m[1])].startswith("<pre>"):
            end_paragraph()
            out.append(f"{line.strip()}\n")
        elif line.startswith("----"):
            end_paragraph()
            out.append("<hr/>\n")
        elif line.startswith("{|"):
            end_paragraph()
            out.append("<td><table>\n<tr>" if table else "<table>\n<tr>")
            table += 1
        elif table and line.startswith("|}"):
            table -= 1
            out.append("</tr>\n</table></td>" if table else "</tr>\n</table>\n")
        elif table and line.startswith("|-"):
            out.append("</tr>\n<tr>")
        elif table and line[:1] in ("|", "!"):
            tag = "th" if line[0] == "!" else "td"
            out += [f"<{tag}>{_inline(c.strip(), categories, category_names)}</{tag}>" for c in _cells(line[1:], line[0])]
        elif line.strip():
            paragraph.append(_inline(line, categories, category_names))
        else:
            end_paragraph()
    end_paragraph()
    set_lists("")
    out += ["</tr>\n</table>\n"] * table
    if categories:
        out.append('<div id="catlinks">' + " ".join(f"<a href={quoteattr(_href(c))}>{escape(c)}</a>" for c in dict.fromkeys(categories)) + "</div>\n")
    return _kept.sub(lambda m: kept[int(m[1])], "".join(out))


def rendered(title: Column, text: Column, templates: Column, category_names=("Category",)) -> Column:
    """HTML3: ``templates`` is a map from title to text."""
    names = frozenset(category_names)

    @F.pandas_udf(T.StringType())
    def run(titles: pd.Series, texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([render(a, b, dict(m) if m is not None else None, names) for a, b, m in zip(titles, texts, maps, strict=True)], dtype=object)

    return run(title, text, templates)


# HTML to TEI

#: The TEI elements, with attributes, that HTML elements become.
TEI_TAGS = {
    **{f"h{n}": ("head", "") for n in range(1, 7)}, "p": ("p", ""), "div": ("div", ""), "ol": ("list", ""), "ul": ("list", ""), "dl": ("list", ""),
    "li": ("item", ""), "dt": ("item", ""), "dd": ("item", ""), "b": ("hi", ' rend="bold"'), "i": ("hi", ' rend="italic"'), "u": ("hi", ' rend="underline"'),
    "s": ("del", ""), "em": ("emph", ""), "table": ("table", ""), "tr": ("row", ""), "th": ("cell", ""), "td": ("cell", ""),
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style"))


class _TeiBuilder(HTMLParser):
    def __init__(self, drop_categories: bool, flat: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.drop, self.flat = drop_categories, flat
        self.title: list[str] = []
        self.out: list[str] = []
        self.stack: list[tuple[str, str, bool]] = []  # HTML element, TEI element or "", what is in it is dropped
        self.bare = False

    def _dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def _end_bare(self) -> None:
        if self.bare:
            self.out.append("</p>")
            self.bare = False

    def handle_starttag(self, tag: str, attrs) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "br" and not self.flat and not self._dropped() and any(e for _, e, _ in self.stack):
            self.out.append("<lb/>")
        if tag in VOID:
            return
        element = ""
        dropped = self._dropped() or tag in SILENT or (self.drop and values.get("id") == "catlinks")
        if not dropped and not self.flat:
            if tag == "a" and "href" in values:
                element, extra = "link", f" target={quoteattr(values['href'])}"
            else:
                element, extra = TEI_TAGS.get(tag, ("", ""))
            if element:
                if not any(e for _, e, _ in self.stack) and element not in ("link", "hi", "emph", "del"):
                    self._end_bare()
                elif not any(e for _, e, _ in self.stack) and not self.bare:
                    self.out.append("<p>")
                    self.bare = True
                self.out.append(f"<{element}{extra}>")
        self.stack.append((tag, element, dropped))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            name, element, _ = self.stack.pop()
            if element:
                self.out.append(f"</{element}>")
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _, _ in self.stack):
            self.title.append(data)
        elif not self._dropped() and not any(t == "head" for t, _, _ in self.stack):
            if not self.flat and not any(e for _, e, _ in self.stack) and not self.bare:
                if not data.strip():
                    return
                self.out.append("<p>")
                self.bare = True
            self.out.append(escape(data))

    def closed(self) -> str:
        self.close()
        while self.stack:
            if element := self.stack.pop()[1]:
                self.out.append(f"</{element}>")
        self._end_bare()
        return "".join(self.out)


def html_to_tei(source: str | None, title: str | None = None, ids: dict[str, str] | None = None, drop_categories: bool = True, flat: bool = False) -> str | None:
    """TXT1/TXT2: a TEI document; ``ids`` become idno elements, ``title`` replaces the page's own.

    Elements without a TEI form go, their text stays; text right in the body gets a
    paragraph. The flat form has one division with one paragraph.
    """
    if source is None:
        return None
    builder = _TeiBuilder(drop_categories, flat)
    builder.feed(source)
    body = builder.closed()
    if flat:
        body = f"<div><p>{' '.join(body.split())}</p></div>"
    name = title if title is not None else "".join(builder.title).strip()
    idno = "".join(f"<idno type={quoteattr(k)}>{escape(str(v))}</idno>" for k, v in (ids or {}).items() if v is not None)
    header = f"<teiHeader><fileDesc><titleStmt><title>{escape(name)}</title></titleStmt><publicationStmt>{idno}</publicationStmt></fileDesc></teiHeader>"
    return f'<TEI xmlns="http://www.tei-c.org/ns/1.0">{header}<text><body>{body}</body></text></TEI>'


def tei(source: Column, title: Column, ids: Column, flat: bool = False, drop_categories: bool = True) -> Column:
    """SNK6: ``ids`` is a map of strings."""

    @F.pandas_udf(T.StringType())
    def run(sources: pd.Series, titles: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([html_to_tei(s, t, dict(m) if m is not None else None, drop_categories, flat) for s, t, m in zip(sources, titles, maps, strict=True)], dtype=object)

    return run(source, title, ids)


# XMI to TEI

#: Annotation elements by priority among equal spans, and the morphological features that are known.
XMI_SPANS = {"Div": ("div", 0), "Head": ("head", 1), "Paragraph": ("p", 2), "Sentence": ("s", 3)}
XMI_IGNORED = frozenset("XMI NULL View DocumentMetaData DocumentAnnotation TagsetDescription TagDescription Dependency ROOT NamedEntity Stem Heading".split())
MORPH_KEYS = frozenset("gender number case degree verbForm tense mood voice definiteness person aspect animacy negative numType possessive pronType reflex".split())


def xmi_to_tei(source: str | None) -> str | None:
    """TXT3: annotations nested by containment, tokens as w (with a letter or digit) or c.

    Spans are sorted by start, then longest first, then div, head, p, s; tokens come last.
    Unknown elements and unknown morphological keys are errors.
    """
    if source is None:
        return None
    text, spans, tokens = "", [], []
    lemmas: dict[str, str] = {}
    tags: dict[str, str] = {}
    morphs: dict[str, str] = {}
    for e in ElementTree.fromstring(source).iter():
        namespace, _, name = e.tag.rpartition("}")
        own = next((v for k, v in e.attrib.items() if k.endswith("}id")), "")
        if name == "Sofa":
            text = e.get("sofaString", "")
        elif name == "Token":
            tokens.append((int(e.get("begin")), int(e.get("end")), e.get("lemma", ""), e.get("pos", ""), e.get("morph", "")))
        elif name == "Lemma":
            lemmas[own] = e.get("value", "")
        elif name == "MorphologicalFeatures":
            morphs[own] = e.get("value", "")
        elif e.get("PosValue") is not None or "/pos" in namespace:
            tags[own] = e.get("PosValue", "")
        elif name in XMI_SPANS:
            element, priority = XMI_SPANS[name]
            spans.append((int(e.get("begin")), -int(e.get("end")), priority, element))
        elif name not in XMI_IGNORED:
            raise ValueError(f"unknown element: {name}")
    marks = [(*s, "") for s in spans]
    for begin, end, lemma, pos, morph in tokens:
        word = text[begin:end]
        element = "w" if any(c.isalnum() for c in word) else "c"
        attributes = {"lemma": lemmas.get(lemma)} if element == "w" else {}
        attributes["type"] = (tags.get(pos) or "").removeprefix("pos=") or None
        for pair in filter(None, morphs.get(morph, "").split("|")):
            key, _, value = pair.partition("=")
            if key not in MORPH_KEYS:
                raise ValueError(f"unknown morphological key: {key}")
            attributes[key] = value
        marks.append((begin, -end, 9, element, "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items() if v is not None)))
    out, open_ = [], []

    def close(until: int) -> Iterator[str]:
        while open_ and open_[-1][0] <= until:
            yield f"</{open_.pop()[1]}>"

    for begin, end, priority, element, attributes in sorted(marks):
        out += close(begin)
        out.append(f"<{element}{attributes}>")
        if priority == 9:
            out += [escape(text[begin:-end]), f"</{element}>"]
        else:
            open_.append((-end, element))
    out += close(len(text) + 1)
    return f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>{"".join(out)}</body></text></TEI>'


def xmi_tei(source: Column) -> Column:
    """SRC18/TXT3 over a column of whole XMI documents (``spark.read.text(..., wholetext=True)``)."""

    @F.pandas_udf(T.StringType())
    def run(sources: pd.Series) -> pd.Series:
        return sources.map(xmi_to_tei)

    return run(source)
