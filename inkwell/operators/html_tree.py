"""A small page reader on the standard library's parser: links, titles, main content, ordered content."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements and class words that are not content.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "button", "select", "input", "textarea", "noscript", "iframe", "figure", "figcaption", "picture", "source", "meta", "link")
NOISE = re.compile(r"nav|menu|sidebar|header|footer|breadcrumb|social|share|comment|advert|ads?[-_]|banner|popup|modal|overlay|cookie|widget|toolbar|reader[-_]?setting|reader[-_]?control", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    def __init__(self, tag, attributes, parent):
        self.tag, self.attributes, self.parent, self.parts = tag, attributes, parent, []

    def noisy(self) -> bool:
        return self.tag in NOISE_TAGS or bool(NOISE.search(f"{self.attributes.get('class') or ''} {self.attributes.get('id') or ''}"))

    def walk(self):
        stack = [self]
        while stack:
            element = stack.pop()
            yield element
            stack += [p for p in reversed(element.parts) if isinstance(p, Element)]

    def select(self, selector: str) -> list:
        """Elements below this one, in page order, that a CSS selector names: tag, #id, .class and [name=value], blanks and > between, commas."""
        wanted = [_steps(part) for part in selector.split(",")]
        return [e for e in self.walk() if e is not self and any(_fits(e, steps) for steps in wanted)]

    def strings(self, skip_noise=False):
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, str):
                    if part.strip():
                        yield part.strip()
                elif part.tag not in ("script", "style") and not (skip_noise and part.noisy()):
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()


_STEP = re.compile(r"(>)|([^\s>]+)")
_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def _steps(selector: str) -> list[tuple[bool, list[tuple]]]:
    """(whether it must be the parent, its parts) of each step, the innermost first."""
    out, direct = [], False
    for arrow, text in _STEP.findall(selector):
        if arrow:
            direct = True
            continue
        if "".join(m[0] for m in _PART.finditer(text)) != text:
            raise ValueError(f"selector {selector!r} is not understood")
        out.append((direct, _PART.findall(text)))
        direct = False
    return out[::-1]


def _is(element, parts) -> bool:
    has = element.attributes
    for tag, own_id, own_class, name, value in parts:
        if tag and tag not in ("*", element.tag) or own_id and has.get("id") != own_id or own_class and own_class not in (has.get("class") or "").split():
            return False
        if name and (name not in has or value and has[name] != value):
            return False
    return True


def _fits(element, steps) -> bool:
    if not steps or not _is(element, steps[0][1]):
        return False
    if len(steps) == 1:
        return True
    up = element.parent
    while up is not None and up.parent is not None:
        if _fits(up, steps[1:]):
            return True
        if steps[0][0]:
            return False
        up = up.parent
    return False


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attributes):
        element = Element(tag, dict(attributes), self.at)
        self.at.parts.append(element)
        if tag not in _VOID:
            self.at = element

    def handle_startendtag(self, tag, attributes):
        self.at.parts.append(Element(tag, dict(attributes), self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.parts.append(data)

    def find(self, *tags):
        return [e for e in self.root.walk() if e.tag in tags]

    def text(self, glue="\n") -> str:
        return glue.join(self.root.strings())

    def links(self):
        """(href, text) of each anchor."""
        return [(e.attributes["href"] or "", " ".join(e.strings())) for e in self.find("a") if "href" in e.attributes]

    def remove(self, *selectors: str) -> None:
        """Takes out what the selectors name; one that is not understood is passed over."""
        for selector in selectors:
            try:
                found = self.root.select(selector)
            except ValueError:
                continue
            for element in found:
                if element in element.parent.parts:
                    element.parent.parts.remove(element)

    def content(self, *selectors: str) -> str:
        """Texts of what the selectors name, if anything; else the main content; else all text of the body."""
        found = ["\n".join(e.strings()) for selector in selectors for e in self.root.select(selector)]
        if found:
            return "\n\n".join(found)
        return self.main_content() or "\n".join(next(iter(self.find("body")), self.root).strings())

    def first_heading(self) -> str:
        return next((" ".join(e.strings()) for e in self.find("h1", "h2", "h3")), "")

    def title(self, default="Chapter") -> str:
        """The first heading, else the page's title, of under 200 characters."""
        for tag in ("h1", "h2", "title", "h3"):
            for element in self.find(tag)[:1]:
                text = "".join(element.strings())
                if 0 < len(text) < 200:
                    return text
        return default

    def _quiet(self, element):
        while element is not None:
            if element.parent is not None and element.noisy():
                return False
            element = element.parent
        return True

    def main_content(self) -> str | None:
        """An article or main of over 50 characters; else the div or section of the highest score over 100; else null.

        A score is paragraphs times their mean length, or the length of all text where there is no paragraph.
        """
        for tag in ("article", "main"):
            for element in [e for e in self.find(tag) if self._quiet(e)][:1]:
                text = "\n\n".join(element.strings(True))
                if len(text) > 50:
                    return text
        best, found = 100, None
        for element in self.find("div", "section"):
            if not self._quiet(element):
                continue
            paragraphs = [sum(map(len, p.strings(True))) for p in element.walk() if p.tag == "p" and self._quiet(p)]
            score = len(paragraphs) * (sum(paragraphs) // len(paragraphs)) if paragraphs else sum(map(len, element.strings(True)))
            if score > best:
                best, found = score, element
        return None if found is None else "\n\n".join(found.strings(True))

    def ordered_content(self) -> list[tuple[int, int, str]]:
        """(CSS order, place, text) of paragraphs; an order is inherited from the nearest ancestor that has one."""
        rows = []
        for place, element in enumerate(self.find("p")):
            up, order = element, 0
            while up is not None:
                found = re.search(r"(?:^|;|\s)order\s*:\s*(-?\d+)", up.attributes.get("style") or "")
                if found:
                    order = int(found[1])
                    break
                up = up.parent
            text = " ".join(element.strings())
            if text:
                rows.append((order, place, text))
        return sorted(rows)
