"""Labelled pages of many layouts, which the classifier of ``mincut`` is fitted on.

Each page is a row of parts (menus, notices, an article, comments, ...) in elements and
under names as sites use them, with texts of invented words; each block of text is labelled
content or boilerplate. ``python -m scriptorium.llm.layouts`` fits and prints the weights.
"""

from __future__ import annotations

import random

import numpy as np

#: Labelled pages that the classifier is fitted on.
SAMPLE = 1500

_SYLLABLES = "an en in on er re the tion ing st nd ou ly ble of to as es os er ie ei sch ich au eau que oi le la de men ar ra no mo ti do".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, least: int, most: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(least, most)))


def _sentences(r: random.Random, least: int, most: int) -> str:
    found = []
    for _ in range(r.randint(least, most)):
        words = _words(r, 4, 22).split()
        for k in range(6, len(words), 9):
            words[k - 1] += ","
        found.append(" ".join(words).capitalize() + r.choice("....!?"))
    return " ".join(found)


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []

    def tag(self, text: str) -> None:
        self.html.append(text)

    def block(self, name: str, text: str, content: bool, shown: str | None = None) -> None:
        self.html.append(f"<{name}>{shown or text}</{name.split()[0]}>")
        self.labels.append((text, content))

    def inside(self, opening: str, fill) -> None:
        self.html.append(f"<{opening}>" if opening else "")
        fill()
        self.html.append(f"</{opening.split()[0]}>" if opening else "")

    def links(self, name: str, least: int, most: int) -> None:
        for _ in range(self.r.randint(least, most)):
            text = _words(self.r, 1, 3)
            self.block(name, text, False, f'<a href="/{text[:4]}">{text}</a>')


def _named(r: random.Random, names: str) -> str:
    name = r.choice(names.split())
    return r.choice([f'div class="{name}"', f'div id="{name}"', f'section class="{name}"', f'div class="box {name}"'])


def _menu(p: _Page) -> None:
    r = p.r
    if r.random() < 0.3:  # a line of plain words
        return p.block("div", _words(r, 2, 6), False)
    outer = r.choice(["nav", "nav", _named(r, "menu nav navbar main-menu site-navigation topbar breadcrumbs"), "div", ""])
    if r.random() < 0.3:
        text = [_words(r, 1, 2) for _ in range(r.randint(3, 7))]
        sep = r.choice([" | ", " · ", " "])
        return p.inside(outer, lambda: p.block("div", sep.join(text), False, sep.join(f'<a href="#">{t}</a>' for t in text)))
    p.inside(outer, lambda: p.inside("ul", lambda: p.links("li", 3, 8)))


def _head(p: _Page) -> None:
    r = p.r
    p.inside(r.choice(["header", "header", _named(r, "header masthead site-header banner"), "div"]), lambda: [p.block(r.choice(["div", "p", "h1"]), _words(r, 1, 4), False), p.block("p", _words(r, 2, 7), False) if r.random() < 0.4 else None])


def _notice(p: _Page) -> None:
    r = p.r
    p.inside(_named(r, "cookie-notice cookies consent gdpr-banner notice alert ad ads advert sponsored promo newsletter popup subscribe-box"), lambda: p.block(r.choice(["p", "div"]), _sentences(r, 1, 3), False))


def _side(p: _Page) -> None:
    r = p.r

    def fill() -> None:
        for _ in range(r.randint(1, 3)):
            p.block(r.choice(["h3", "h4", "div"]), _words(r, 1, 3), False)
            p.block("p", _sentences(r, 1, 4), False) if r.random() < 0.6 else p.inside("ul", lambda: p.links("li", 2, 6))

    p.inside(r.choice(["aside", "aside", _named(r, "sidebar left-sidebar widget-area rail related recommended trending sidebar-content")]), fill)


def _comments(p: _Page) -> None:
    r = p.r

    def one() -> None:
        p.block(r.choice(["h4", "div", "p"]), _words(r, 1, 2), False)
        for _ in range(r.randint(1, 2)):
            p.block("p", _sentences(r, 1, 4), False)

    def fill() -> None:
        p.block("h3", _words(r, 1, 3), False)
        for _ in range(r.randint(1, 6)):
            p.inside(r.choice(["div class=comment-body", "div class=comment", "li", "article class=comment", "div"]), one)

    p.inside(_named(r, "comments comment-list discussion disqus_thread replies reader-comments"), fill)


def _form(p: _Page) -> None:
    p.inside("form", lambda: [p.block("label", _words(p.r, 1, 3), False), p.tag("<input>"), p.block("p", _words(p.r, 4, 12), False)])


def _foot(p: _Page) -> None:
    r = p.r
    rights = r.choice(["© {} {}", "Copyright {} {}", "© {} {}. All rights reserved.", "(c) {} {}"]).format(r.randint(1999, 2026), _words(r, 1, 3))
    p.inside(r.choice(["footer", "footer", _named(r, "footer site-footer foot copyright"), "div", ""]), lambda: [p.block(r.choice(["div", "p"]), rights + (" " + _sentences(r, 1, 2) if r.random() < 0.4 else ""), False), p.links("li", 0, 4)])


def _article(p: _Page) -> None:
    r = p.r
    outer = r.choice(
        ["article", "article", "main", "main", "div", "div", "", "section", _named(r, "content post entry-content article-body story main-text prose"), _named(r, "content post entry-content article-body story main-text prose")]
        + [_named(r, "review-body legal-story notice-text privacy-article rating-content ad-article search-story social-post tag-content review notice legal")]
    )

    def fill() -> None:
        if r.random() < 0.8:
            p.block(r.choice(["h1", "h1", "h2"]), _words(r, 2, 9), True)
        size = r.choice([1, 2, 4, 8, 14])
        for _ in range(size):
            kind = r.random()
            if kind < 0.72:
                text = _sentences(r, 1, 6)
                words = text.split()
                k = r.randrange(len(words))
                shown = " ".join([*words[:k], f'<a href="x">{words[k]}</a>', *words[k + 1 :]]) if r.random() < 0.3 else text
                p.block("p" if r.random() < 0.9 else "div", text, True, shown)
            elif kind < 0.8:
                p.block(r.choice(["h2", "h3"]), _words(r, 1, 6), True)
            elif kind < 0.9:
                p.inside(r.choice(["ul", "ol"]), lambda: [p.block("li", _words(r, 2, 14) if r.random() < 0.5 else _sentences(r, 1, 1), True) for _ in range(r.randint(2, 5))])
            else:
                p.block("blockquote", _sentences(r, 1, 2), True)
        if r.random() < 0.15:
            _notice(p)
        p.block("p", r.choice(["All rights reserved.", "Copyright law says so."]) if r.random() < 0.05 else _sentences(r, 1, 4), True)

    inner = fill
    if r.random() < 0.25:
        inner = lambda: p.inside(r.choice(["div", "div class=inner", "section"]), fill)
    p.inside(outer, inner)


def page(seed: int) -> tuple[str, list[tuple[str, bool]]]:
    """The html of a page, and its blocks of text with whether they are content."""
    r = random.Random(seed)
    p = _Page(r)
    p.tag(r.choice(["<!DOCTYPE html><html><head><title>t</title></head><body>", "<body>", '<html><body class="home has-sidebar with-ads">', ""]))
    wrap = r.choice(["", "", "div", 'div id="page"', 'div class="site has_sidebar with-ads ad-free"', 'div class="wrapper no-comments"'])
    if wrap:
        p.tag(f"<{wrap}>")
    before = [f for f, share in ((_head, 0.6), (_menu, 0.8), (_notice, 0.4), (_menu, 0.2), (_side, 0.15)) if r.random() < share]
    after = [f for f, share in ((_side, 0.4), (_comments, 0.4), (_form, 0.2), (_notice, 0.15), (_foot, 0.8)) if r.random() < share]
    if r.random() < 0.1:  # a bare page
        p.block(r.choice(["p", "p", "div"]), _sentences(r, 1, 2), True)
        return "".join(p.html), p.labels
    for part in [*before, _article, *after]:
        part(p)
    if wrap:
        p.tag("</div>")
    return "".join(p.html), p.labels


def fit(pages: int = SAMPLE, first: int = 0, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic regression on the blocks of so many labelled pages, each page
    counting alike (Newton's method)."""
    from . import mincut

    rows, told, weight = [], [], []
    for seed in range(first, first + pages):
        html, labels = page(seed)
        blocks = mincut.blocks_of(html)
        if [b.text for b in blocks] != [t for t, _ in labels]:
            continue
        rows += mincut.features(blocks)
        told += [c for _, c in labels]
        weight += [10.0 / len(blocks)] * len(blocks)
    x, y, v = np.array(rows), np.array(told, float), np.array(weight)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (v * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return [round(float(a), 2) for a in w]


if __name__ == "__main__":
    print(fit())
