"""HTML to a token stream and to blocks of text, for wrapper inference (operator 12). Works on one page at a time, without Spark."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Elements by their part in HTML.
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = set("title meta link script style base basefont bgsound noscript template head html".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open elements of these kinds, up to one of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
#: Elements that never hold main text, and words of class, id and role that say so.
ASIDE = set("nav footer aside form dialog menu button select datalist noscript template svg math canvas object audio video head search".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe subscription signup login search widget widgets pagination pager complementary contentinfo dialog".split()
)
TOPS = {"header", "masthead", "banner"}
REPLIES = {"comment", "comments", "reply", "replies", "disqus"}
#: Elements below this depth are taken as parts of the one above them.
DEPTH = 32
#: A longer text is never a fixed text of a template.
FIXED = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(>?)", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@lru_cache(1 << 16)
def described(name: str, attributes: str) -> tuple[str, str]:
    """(key, part) of an element. The key is its name with the words of class and id (those with digits don't count, as they differ from page
    to page); part is "" for text, "drop" or, for headers, "top"."""
    words, given = set(), []
    for kind, *value in _NAMED.findall(attributes):
        for token in " ".join(value).split():
            found = [w.lower() for w in _WORD.findall(token)]
            words.update(found)
            if kind.lower() != "role" and not any(c.isdigit() for c in token):
                given.append(token.lower().replace("/", "-"))
    part = ""
    if name in ASIDE or _HIDDEN.search(attributes):
        part = "drop"
    elif name not in ("body", "html", "main", "article") and words & WORDS or name == "article" and words & REPLIES:
        part = "drop"
    elif name == "header" or name not in ("body", "html", "main", "article") and words & TOPS:
        part = "top"
    return ".".join([name, *sorted(set(given))]), part


class Page:
    """The blocks of a page, and its structure: paths of block elements below the body, and which stands after which."""

    def __init__(self, html: str):
        #: (path, whether it is text, block, characters in links)
        self.blocks: list[tuple[str, bool, str, int]] = []
        self.elements: dict[str, int] = {}
        #: Elements of the path above that hold one of this path.
        self.holders: dict[str, int] = {}
        self.order: set[tuple[str, str, str]] = set()
        self._pieces: list[str] = []
        self._links = 0
        # name, path, part, depth, last child, children
        self.stack: list[list] = [["", "", "", 0, "", set()]]
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if not m[4] and at == end:
                break
            if m[1]:
                self._close(name)
            elif name in RAW:
                over = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
                at = over.start() if over else end
                self._pieces.append(" ")
            elif name in VOID:
                if name == "hr":
                    self._flush()
                self._pieces.append(" ")
            else:
                self._open(name, m[3])
        self._flush()

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        top = self.stack[-1]
        if not top[2] or top[2] == "heading":
            self._pieces.append(text)
            if any(x[0] == "a" for x in self.stack[-3:]):
                self._links += len(text)
        elif self._pieces:
            self._pieces.append(" ")

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                holder = self._holder()
                self._child(holder, "#")
                self.blocks.append((holder[1], True, text, min(self._links, len(text))))
            self._pieces.clear()
        self._links = 0

    def _holder(self) -> list:
        """The innermost block element."""
        return next(x for x in reversed(self.stack) if x[5] is not None)

    def _child(self, holder: list, key: str) -> str:
        path = f"{holder[1]}/{key}"
        if holder[4]:
            self.order.add((holder[1], holder[4], key))
        holder[4] = key
        if key not in holder[5]:
            holder[5].add(key)
            self.holders[path] = self.holders.get(path, 0) + 1
        self.elements[path] = self.elements.get(path, 0) + 1
        return path

    def _open(self, name: str, attributes: str) -> None:
        stack = self.stack
        if name in BLOCKS:
            self._flush()
            if name not in HEAD and any(x[0] == "head" for x in stack[-2:]):
                self._close("head")
            if name in ("html", "body"):
                return
            if name in ENDS:
                kinds, until = ENDS[name]
                self._end(kinds, until)
            elif name != "summary":
                self._end({"p"}, {"td", "th", "table", "caption", "button", "object", "li", "dd", "dt", "blockquote", "div", "section", "article"})
        top = stack[-1]
        key, part = described(name, attributes)
        if top[2] == "top" and name in HEADINGS:
            part = part or "heading"
        elif top[2] in ("drop", "top"):
            part = top[2] if top[2] == "drop" or part != "drop" else "drop"
        elif top[2] == "heading":
            part = part or "heading"
        elif part == "top" and not any(x[0] in ("article", "main") for x in stack):
            part = "drop"
        if name in BLOCKS and top[3] < DEPTH:
            stack.append([name, self._child(self._holder(), key), part, top[3] + 1, "", set()])
        else:
            stack.append([name, top[1], part, top[3], "", None])

    def _end(self, kinds: set, until: set) -> None:
        lowest = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in kinds:
                lowest = i
            elif self.stack[i][0] in until:
                break
        if lowest is not None:
            del self.stack[lowest:]

    def _close(self, name: str) -> None:
        if name in ("html", "body"):
            self._flush()
            return
        if name == "br":
            self._pieces.append(" ")
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if any(x[0] in BLOCKS for x in self.stack[i:]):
                    self._flush()
                del self.stack[i:]
                return


class Wrapper:
    """The union-free expression of some pages of a host: every element once, below the one it stands in, with what the pages' token
    streams have in common. Where streams differ, an element becomes optional (some holders lack it) or repeated (it follows itself, or
    elements follow each other in both orders: they form a repeated group), and a text that differs a slot. Wrappers are added up in any
    order with the same result."""

    def __init__(self):
        self.pages = 0
        #: By path: elements, holders that have one, characters of text, of these in links, and the one text (None where texts differ).
        self.elements: dict[str, int] = {}
        self.holders: dict[str, int] = {}
        self.chars: dict[str, int] = {}
        self.links: dict[str, int] = {}
        self.text: dict[str, str | None] = {}
        self.order: set[tuple[str, str, str]] = set()

    def align(self, page: Page) -> None:
        """Take in a page's token stream."""
        own = Wrapper()
        own.pages, own.elements, own.holders, own.order = 1, page.elements, page.holders, page.order
        for path, _, text, links in page.blocks:
            own.chars[path] = own.chars.get(path, 0) + len(text)
            own.links[path] = own.links.get(path, 0) + links
            own.text[path] = text if len(text) <= FIXED and own.text.get(path, text) == text else None
        self.add(own)

    def add(self, other: Wrapper) -> None:
        self.pages += other.pages
        for mine, theirs in ((self.elements, other.elements), (self.holders, other.holders), (self.chars, other.chars), (self.links, other.links)):
            for path, n in theirs.items():
                mine[path] = mine.get(path, 0) + n
        for path, text in other.text.items():
            self.text[path] = text if self.text.get(path, text) == text else None
        self.order |= other.order

    def plain(self) -> dict:
        return {**{k: getattr(self, k) for k in ("pages", "elements", "holders", "chars", "links", "text")}, "order": sorted(self.order)}

    @classmethod
    def of(cls, plain: dict) -> Wrapper:
        w = cls()
        for k, v in plain.items():
            setattr(w, k, {tuple(x) for x in v} if k == "order" else v)
        return w

    def groups(self) -> dict[str, list[list[str]]]:
        """By path: what stands in it, in order; keys that follow each other in both orders share a group."""
        children: dict[str, set] = {}
        for path in self.elements:
            holder, _, key = path.rpartition("/")
            children.setdefault(holder, set()).add(key)
        after: dict[str, dict] = {}
        for holder, a, b in self.order:
            after.setdefault(holder, {}).setdefault(a, set()).add(b)
        out = {}
        for holder, keys in children.items():
            reach = {}
            for k in keys:
                seen, front = set(), [k]
                while front:
                    new = after.get(holder, {}).get(front.pop(), set()) - seen
                    seen |= new
                    front.extend(new)
                reach[k] = seen
            before = {k: sum(k in reach[j] and j not in reach[k] for j in keys) for k in keys}
            groups: list[list[str]] = []
            for k in sorted(keys, key=lambda k: (before[k], min([k, *(j for j in reach[k] if k in reach[j])]), k)):
                if groups and k in reach[groups[-1][0]] and groups[-1][0] in reach[k]:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            out[holder] = groups
        return out

    def expression(self) -> str:
        """The wrapper as text: # is a slot, ? an optional, + a repeated and * an optional repeated element or group."""
        groups = self.groups()

        def body(path: str) -> str:
            holder, _, key = path.rpartition("/")
            if key == "#":
                text = self.text.get(holder)
                return "#" if text is None else f"“{text}”"
            return f"<{key}>{inside(path)}</{key.split('.')[0]}>"

        def one(path: str, repeated: bool) -> str:
            holder = path.rpartition("/")[0]
            lacking = self.holders[path] < (self.elements[holder] if holder else self.pages)
            mark = {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}[repeated, lacking]
            return f"({body(path)}){mark}" if mark else body(path)

        def inside(path: str) -> str:
            out = []
            for g in groups.get(path, []):
                if len(g) == 1:
                    out.append(one(f"{path}/{g[0]}", (path, g[0], g[0]) in self.order))
                else:
                    out.append("(" + "".join(f"({body(f'{path}/{k}')})?" for k in g) + ")+")
            return "".join(out)

        return inside("")

    def regions(self) -> dict:
        """Where the main text is: lists of paths, best first, and the template's fixed texts of the last one."""
        dropped: dict[str, bool] = {"": False}
        for path in sorted(self.elements, key=lambda p: p.count("/")):
            holder, _, key = path.rpartition("/")
            name, *words = key.split(".")
            attributes = f' class="{" ".join(words)}"' if words else ""
            dropped[path] = dropped.get(holder, False) or key != "#" and described(name, attributes)[1] == "drop"
        fixed = {p: t for p, t in self.text.items() if t is not None and self.pages > 2 and self.elements.get(f"{p}/#", 0) > 2}
        weight: dict[str, int] = {}
        for path, n in self.chars.items():
            if dropped.get(path, False) or path in fixed:
                continue
            n, parts = n - self.links[path], path.split("/")
            for i in range(1, len(parts) + 1):
                up = "/".join(parts[:i])
                weight[up] = weight.get(up, 0) + n
        levels = []
        for kind in ("article", "main"):
            named = [p for p in self.elements if p.rpartition("/")[2].split(".")[0] == kind and not dropped[p]]
            named = sorted(p for p in named if not any(p.startswith(f"{q}/") for q in named))
            if named and 4 * sum(weight.get(p, 0) for p in named) >= weight.get("", 0):
                levels.append(named)
        at = ""
        while True:
            below = [p for p in weight if p.rpartition("/")[0] == at and p != at and p.rpartition("/")[2].split(".")[0] in ("div", "section", "center", "table", "tbody", "tr", "td", "main", "article")]
            best = max(below, key=lambda p: (weight[p], p), default=None)
            if best is None or 10 * weight[best] < 7 * weight[at]:
                break
            at = best
        within = {p: t for p, t in fixed.items() if p == at or p.startswith(f"{at}/")}
        return {"levels": [*levels, [at]], "fixed": within}


def main_text(page: Page, regions: dict) -> str:
    """The blocks of the first level that the page has, joined by empty lines."""
    for i, level in enumerate(regions["levels"]):
        fixed = regions["fixed"] if i == len(regions["levels"]) - 1 else {}
        own = [text for path, _, text, _ in page.blocks if fixed.get(path) != text and any(path == p or path.startswith(f"{p}/") or not p for p in level)]
        if own:
            return "\n\n".join(own)
    return ""
