"""Web pages as sequences of text blocks: a forgiving reader of tags, and generated pages whose blocks' labels are known.

A block is a maximal run of text without a block-level tag in it. It carries its path (the open elements with their
class, id and role words) and how much of it stands in links.
"""

from __future__ import annotations

import html as _html
import random
import re
from dataclasses import dataclass

#: Elements that don't end a block. All others do.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
_RAW = frozenset("script style title textarea template noscript iframe object svg math".split())
#: What an opening tag closes, if it is the innermost of these that is open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th"}}
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class Block:
    """``path``: words that describe the open elements; ``linked``: characters within links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _described(tag: str, attributes: str) -> tuple[str, ...]:
    out = ["<" + tag]
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            out += [w for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())[:8]]
    return tuple(out)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, character references decoded, white space within them made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = at = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = [w for _, words in stack for w in words]
                out.append(Block(text, tuple(dict.fromkeys(path)) + ("=" + (stack[-1][0] if stack else ""),), linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = _html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if ends else 1
            continue
        if tag in _RAW and not ends:
            close_block()
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
                at = len(page) if end is None else end.start()
            continue
        close_block()
        links = 0
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":  # no block-level element can be in a paragraph
            stack.pop()
        if tag in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _WALLS[tag]:
                    break
                if stack[k][0] in _CLOSES[tag]:
                    del stack[k:]
                    break
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _described(tag, attributes)))
    close_block()
    return out


# Generated pages. The words below are training material: names that sites give to their parts.

_NAMES = {
    "menu": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination pager toc tabs links sitemap".split(),
    "header": "header masthead top topbar banner logo branding site-header site-title tagline hero".split(),
    "footer": "footer bottom site-footer colophon copyright legal imprint foot credits".split(),
    "sidebar": "sidebar aside side widget widgets related recommended popular trending secondary rail more-stories latest recent".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message banner popup modal overlay paywall disclaimer announcement".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner-ad commercial partner".split(),
    "form": "form newsletter subscribe signup login search contact newsletter-form".split(),
    "comments": "comments comment discussion replies reply responses disqus respond comment-list thread reactions".split(),
    "share": "share social sharing follow meta tags byline".split(),
}
_TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "p", "aside"], "advert": ["div", "div", "aside", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"]}
_ARTICLE = "article content post entry story article-body text body-text main main-content entry-content post-body page blog single prose richtext".split()
_CUES = {
    "menu": ["Home", "About", "Contact", "News", "Next", "Previous", "Login", "Archive", "Accueil", "Startseite", "Inicio", "Menu"],
    "footer": ["© 2024", "Copyright", "All rights reserved", "Privacy Policy", "Terms of Use", "Impressum", "Mentions légales", "Aviso legal", "·"],
    "notice": ["We use cookies", "Accept", "Please enable JavaScript", "Notice:", "Wir verwenden Cookies", "Nous utilisons des cookies", "Usamos cookies"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Publicidad", "50% off"],
    "form": ["Subscribe", "Your email", "Send", "Search", "Sign up for our newsletter", "Name", "Password"],
    "comments": ["Reply", "Leave a comment", "3 comments", "says:", "Report", "Like", "Kommentare", "Répondre", "Comentarios"],
    "share": ["Share", "Tweet", "Print", "Email", "Follow us", "Tags:", "min read"],
    "sidebar": ["Related", "Most read", "Popular", "See also", "Read more", "Latest posts"],
    "header": ["Welcome", "The Daily"],
}
_SYLLABLES = "an ba ch de el fo ga he in jo ka le mi no or pu qui re sa ti un ve wo xy za ción ment ung tion sch é è ñ ü ing ly ou aux der".split()
#: Labels of the blocks of generated pages, as marks before their texts.
KEPT, LEFT_OUT = "\ue000", "\ue001"


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out = rng, []
        self.noise = rng.random() < 0.2
        self.plain_names = rng.random() < 0.85  # others have class names that say nothing

    def word(self) -> str:
        rng = self.rng
        w = "".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3, 4))))
        return w + rng.choice(["###", "%%%", "&amp;&amp;", "***"]) if self.noise and rng.random() < 0.4 else w

    def sentence(self, n: int | None = None) -> str:
        rng = self.rng
        words = [self.word() for _ in range(n or rng.choice([1, 3, 6, 9, 12, 18, 25]))]
        words[0] = words[0].capitalize()
        if rng.random() < 0.05:
            words[rng.randrange(len(words))] = f'<a href="/{self.word()}">{self.word()}</a>'
        if rng.random() < 0.05:
            words[0] = f"<b>{words[0]}</b>"
        return (", " if rng.random() < 0.3 else " ").join(words) + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(self, most: int = 8) -> str:
        rng = self.rng
        return rng.choice([" ", " ", "<br>", "\n"]).join(self.sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, most])))

    def named(self, names: list[str]) -> str:
        rng = self.rng
        if not self.plain_names:
            names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6))]
        name = rng.choice(names)
        if rng.random() < 0.2:
            name = rng.choice(["js-", "c-", "site-", "block-", "l-"]) + name
        if rng.random() < 0.15:
            name += rng.choice(["-wrapper", "-inner", " clearfix", "_box", "-1", " container"])
        return rng.choice(["class", "class", "class", "id"]) + f'="{name}"'

    def part(self, kind: str) -> None:
        """A part of the page that isn't the article."""
        rng, mark = self.rng, LEFT_OUT
        tag = rng.choice(_TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        # A part whose tag says nothing must have a name that does, or look like one of its kind.
        named, keep = self.plain_names, self.plain_names
        if kind in ("advert", "notice", "comments", "sidebar", "share") and not semantic:
            self.plain_names = True
        opening = f"<{tag}>" if semantic else f"<{tag} {self.named(_NAMES[kind])}>"
        self.plain_names = keep
        cues = _CUES[kind]
        cue = lambda: rng.choice(cues) if rng.random() < 0.5 else self.sentence(rng.choice([1, 2, 3]))
        self.out.append(opening)
        if tag in ("ul", "ol") or (kind == "menu" and rng.random() < 0.7) or (kind in ("sidebar", "footer", "share", "header") and rng.random() < 0.4):
            items = [f"<li>{mark}<a href='/{self.word()}'>{cue()}</a></li>" for _ in range(rng.choice([2, 4, 6, 10]))]
            if kind == "comments":
                items = [f"<li>{mark}{self.prose(4)}<div>{mark}{cue()}</div></li>" for _ in range(rng.choice([1, 3, 6]))]
            self.out.append("".join(items) if tag in ("ul", "ol") else "<ul>" + "".join(items) + "</ul>")
            if kind == "header" and rng.random() < 0.6:
                self.out.append(f"<h1>{mark}{self.sentence(3)}</h1>")
        elif kind == "menu":
            self.out.append(mark + rng.choice([" | ", " &raquo; ", " ", " / "]).join(f'<a href="/{self.word()}">{cue()}</a>' for _ in range(rng.choice([2, 4, 7]))))
        elif kind == "form":
            self.out += [f"<h3>{mark}{cue()}</h3>" if rng.random() < 0.4 else "", f"<p>{mark}{self.prose(2)}</p>" if rng.random() < 0.5 else "", f"<label>{mark}{cue()}</label><input name='q'>", f"<button>{mark}{cue()}</button>"]
            if rng.random() < 0.3:
                self.out.append("<select>" + "".join(f"<option>{mark}{self.word()}" for _ in range(4)) + "</select>")
        elif kind == "comments":
            if rng.random() < 0.6:
                self.out.append(f"<h3>{mark}{cue()}</h3>")
            inner = rng.choice(["div", "article", "li", "blockquote"])
            for _ in range(rng.choice([1, 3, 6])):
                self.out.append(f"<{inner} {self.named(_NAMES['comments'])}>" if rng.random() < 0.6 else f"<{inner}>")
                self.out.append((f"<b>{self.word()}</b>" if rng.random() < 0.3 else "") + "".join(f"<p>{mark}{self.prose(4)}</p>" for _ in range(rng.choice([1, 1, 2]))) + (f"<div>{mark}{cue()}</div>" if rng.random() < 0.4 else "") + f"</{inner}>")
                if "<b>" in self.out[-1][:3]:
                    self.out[-1] = mark + self.out[-1]
        else:
            if kind in ("header", "sidebar") and rng.random() < 0.6:
                heading = rng.choice(["h1", "h2", "h3"]) if kind == "header" else "h3"
                self.out.append(f"<{heading}>{mark}{cue()}</{heading}>")
            if tag == "p" or rng.random() < 0.4:
                self.out.append(mark + (cue() + " " if rng.random() < 0.4 else "") + self.prose(3))
            else:
                for _ in range(rng.choice([1, 1, 2, 4])):
                    inner = rng.choice(["p", "p", "div"])
                    self.out.append(f"<{inner}>{mark}{self.prose(3) if rng.random() < 0.7 else cue()}</{inner}>")
        self.plain_names = named
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng, mark = self.rng, KEPT
        shape = rng.random()
        if shape < 0.4:
            opened = ["article"] if rng.random() < 0.6 else [f"article {self.named(_ARTICLE)}"]
        elif shape < 0.55:
            opened = ["main", rng.choice(["article", f"div {self.named(_ARTICLE)}", "section"])]
        elif shape < 0.9:
            opened = [f"{rng.choice(['div', 'div', 'section', 'td', 'main'])} {self.named(_ARTICLE)}"]
            if rng.random() < 0.4:
                opened.append(rng.choice(["div", f"div {self.named(_ARTICLE)}", "article"]))
        else:
            opened = []
        self.out += [f"<{o}>" for o in opened]
        if rng.random() < 0.75:
            self.out.append(f"<h1>{mark}{self.sentence(rng.choice([2, 4, 8, 12]))}</h1>")
        if rng.random() < 0.15:
            self.part("share")
        for _ in range(rng.choice([1, 1, 2, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.68:
                end = "</p>" if rng.random() < 0.85 else ""
                self.out.append(f"<p>{mark}{self.prose(12)}{end}" if rng.random() < 0.8 else f"<p>{mark}{self.sentence(rng.choice([1, 1, 2, 4]))}{end}")
            elif kind < 0.74:
                self.out.append(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{mark}{self.sentence(rng.choice([1, 2, 5]))}</{h}>")
            elif kind < 0.80:
                li = rng.choice(["ul", "ol"])
                self.out.append(f"<{li}>" + "".join(f"<li>{mark}{self.sentence()}" + ("</li>" if rng.random() < 0.8 else "") for _ in range(rng.choice([2, 4, 7]))) + f"</{li}>")
            elif kind < 0.84:
                self.out.append(f"<blockquote>{mark}{self.prose()}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{mark}{self.prose()}</p></blockquote>")
            elif kind < 0.87:
                self.out.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark}{self.word()}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.choice([2, 4]))) + "</table>")
            elif kind < 0.90:
                self.out.append(f"<pre>{mark}{self.sentence()} = {self.word()}({self.word()});</pre>")
            elif kind < 0.94:
                self.out.append(f"<div>{mark}{self.prose(12)}</div>")
            else:
                self.part(rng.choice(["advert", "advert", "sidebar", "form", "share", "notice", "menu"]))
        if rng.random() < 0.1:
            self.part("comments")
        self.out += [f"</{o.split()[0]}>" for o in reversed(opened)]

    def build(self) -> str:
        rng = self.rng
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("advert", 0.4), ("form", 0.12), ("sidebar", 0.15)) if rng.random() < p]
        after = [k for k, p in (("share", 0.12), ("advert", 0.2), ("sidebar", 0.35), ("comments", 0.35), ("form", 0.2), ("menu", 0.15), ("footer", 0.8), ("notice", 0.15)) if rng.random() < p]
        if rng.random() < 0.4:
            rng.shuffle(before)
        self.out.append(f"<html><head><title>{self.sentence(5)}</title></head><body>" if rng.random() < 0.8 else "<body>")
        wrapped = rng.random() < 0.3
        if wrapped:
            self.out.append(rng.choice(['<div id="page">', '<div class="wrapper">', "<div>", '<div class="container"><div class="row">']))
        for kind in before:
            self.part(kind)
        self.article()
        for kind in after:
            self.part(kind)
        if rng.random() < 0.8:
            self.out.append("</body></html>")
        return "".join(self.out)


def generated_page(rng: random.Random) -> tuple[list[Block], list[bool]]:
    """The blocks of a page made up by ``rng``, and whether each belongs to its article."""
    blocks, labels = [], []
    for b in read_blocks(_Page(rng).build()):
        kept, out = KEPT in b.text, LEFT_OUT in b.text
        if kept != out:  # a block that an unclosed tag has joined with its neighbour has no label
            text = " ".join(b.text.replace(KEPT, "").replace(LEFT_OUT, "").split())
            if text:
                blocks.append(Block(text, b.path, min(b.linked, len(text))))
                labels.append(kept)
    return blocks, labels
