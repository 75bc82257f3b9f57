"""Element ids and simplification of pages, with the standard library's HTML parser."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that get ids, tags that go with all they hold, attributes that stay, elements without an end tag.
INTERACTIVE = ("a", "button", "input", "select", "textarea", "form", "label")
DROPPED = ("script", "style", "noscript", "svg", "meta", "link")
KEPT = ("id", "name", "type", "value", "placeholder", "aria-label", "href", "data-el-id")
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr")
#: Most characters of a text, and the marker of a page that is cut.
LONG = 200
CUT = "\n[...observation truncated due to length...]"


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Mark(str):
    """What a comment, declaration or instruction says; it is written between begin and end."""

    begin, end = "<!--", "-->"


class Doctype(Mark):
    begin, end = "<!DOCTYPE ", ">\n"


class CharacterData(Mark):
    begin, end = "<![CDATA[", "]]>"


class Declaration(Mark):
    begin, end = "<?", "?>"


class Instruction(Mark):
    begin, end = "<?", ">"


class Tree(HTMLParser):
    """Unclosed elements end with the one that holds them; an end tag without a start is ignored; the last of equal attributes counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        last = self.open[-1].children
        if last and type(last[-1]) is str:
            last[-1] += data
        else:
            last.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Mark(data))

    def handle_decl(self, decl):
        self.open[-1].children.append(Doctype(decl[len("doctype ") :]))

    def unknown_decl(self, data):
        cdata = data.upper().startswith("CDATA[")
        self.open[-1].children.append(CharacterData(data[6:]) if cdata else Declaration(data))

    def handle_pi(self, data):
        self.open[-1].children.append(Instruction(data))


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def quoted(value: str) -> str:
    """In double quotes, or in single ones if it has double quotes and no single ones."""
    value = escape(value, quote=False)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def text_of(node) -> str:
    """A node as HTML. Without recursion, as pages may nest deeply."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, Mark):
            out.append(x.begin + x + x.end)
        elif isinstance(x, str):
            out.append(escape(x, quote=False))
        else:
            if x.tag:
                attrs = "".join(f" {k}={quoted(v)}" for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}{'/' if x.tag in VOID else ''}>")
                if x.tag not in VOID:
                    todo.append((f"</{x.tag}>",))
            todo += reversed(x.children)
    return "".join(out)


def walk(node: Node):
    """All elements below, in document order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x is not node:
            yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]


def selector(node: Node) -> str:
    if node.attrs.get("id"):
        return f"{node.tag}#{node.attrs['id']}"
    return f"{node.tag}[name={node.attrs['name']}]" if node.attrs.get("name") else node.tag


def numbered(root: Node) -> dict[str, str]:
    """Gives interactive elements data-el-id from 0 in document order; their selectors by id."""
    found = {}
    for node in walk(root):
        if node.tag in INTERACTIVE:
            node.attrs["data-el-id"] = str(len(found))
            found[node.attrs["data-el-id"]] = selector(node)
    return found


def kept_text(text: str) -> str | None:
    """Stripped and cut if it is long, gone if it is blank."""
    bare = text.strip()
    return bare[:LONG] + "..." if len(bare) > LONG else text if bare else None


def simplified(root: Node) -> None:
    """Drops tags, attributes and blank texts, cuts long texts, and puts the only child of a div or span without attributes in its place."""
    order = [root]
    for node in order:
        node.children = [c for c in (kept_text(c) if isinstance(c, str) else c if c.tag not in DROPPED else None for c in node.children) if c is not None]
        node.attrs = {k: v for k, v in node.attrs.items() if k in KEPT}
        order += [c for c in node.children if isinstance(c, Node)]
    lone = lambda c: isinstance(c, Node) and c.tag in ("div", "span") and not c.attrs and len(c.children) == 1
    # children come after their parents in this order, so inner ones are done first
    for node in reversed(order):
        node.children = [c.children[0] if lone(c) else c for c in node.children]


def element_ids_of(html: str) -> dict[str, str]:
    return numbered(parse(html))


def with_element_ids(html: str) -> str:
    """The page, its interactive elements numbered."""
    root = parse(html)
    numbered(root)
    return text_of(root)


def simplify_text(html: str) -> str:
    root = parse(html)
    simplified(root)
    return re.sub(r"\s+", " ", text_of(root)).strip()


def fit_text(html: str, most: int) -> str:
    """As it is, simplified, or cut with a marker: the first that is short enough."""
    if len(html) <= most:
        return html
    short = simplify_text(html)
    return short if len(short) <= most else short[:most] + CUT


def element_ids(html: Column) -> Column:
    """Selector of each interactive element, by id."""

    @F.pandas_udf("map<string,string>")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: element_ids_of(p or ""))

    return each(html)


def numbered_html(html: Column) -> Column:
    """The page with its interactive elements numbered."""

    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: with_element_ids(p or ""))

    return each(html)


def simplify_html(html: Column) -> Column:
    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: simplify_text(p or ""))

    return each(html)


def fit_observation(html: Column, most: int) -> Column:
    """Only pages that are too long reach Python."""

    @F.pandas_udf("string")
    def fit(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else fit_text(p, most))

    return F.when(F.length(html) <= most, html).otherwise(fit(F.when(F.length(html) > most, html)))
