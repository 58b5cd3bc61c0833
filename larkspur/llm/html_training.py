"""Trains the block labeller on invented pages whose blocks are labelled as they are written.

    python -m larkspur.llm.html_training
"""

from __future__ import annotations

import html
import random

import numpy as np

from .html_blocks import WEIGHTS, Labeller, blocks, inputs

SYLLABLES = "an be ci do er fa ge hi in jo ka le mi no or pa qu re si te un ver wa zu ou eau ción ung tion the ing er st ñe ß é è ä ö å 的 の и".split()
MAIN_BOXES = ["<article>", '<article class="post">', "<main>", '<div id="content">', '<div class="article-body">', '<div class="entry-content">', '<section class="story">', '<div class="post-content">', '<main role="main"><article>', '<td class="content">', '<div class="text">']
SIDE = {
    "nav": ["<nav>", '<div class="menu">', '<ul class="navigation">', '<div id="nav">', '<div class="breadcrumbs">', '<nav class="main-menu">', '<div role="navigation">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<header class="site-header">', '<div class="topbar">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">'],
    "aside": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<div class="widget">', '<div class="related-posts">', '<section class="recommended">'],
    "ad": ['<div class="ad">', '<div class="advert">', '<div class="ads banner">', '<div id="ad-1">', '<div class="sponsored">', '<div class="promo">', '<aside class="advertisement">'],
    "notice": ['<div class="cookie-notice">', '<div class="cookie">', '<div class="notice">', '<div class="popup modal">', '<div id="cookie-banner">', '<div role="dialog">', '<div class="newsletter">', '<div class="gdpr consent">', '<div class="alert">', '<div class="subscribe">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="reader-comments">', '<div id="disqus_thread">', '<section class="responses">', '<div class="discussion">'],
    "form": ["<form>", '<form class="search">', '<form action="/subscribe">', '<form id="login">', '<div class="search"><form>'],
    "share": ['<div class="share">', '<div class="social">', '<ul class="tags">', '<div class="pagination">', '<div class="byline meta">'],
}


class Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, n: int) -> str:
        r = self.rng
        style = r.random()
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + (r.choice(["", "", "", ",", "."]) if style < 0.9 else r.choice(["%%%", "###", "&&&", "$$$", "!!", ""])) for _ in range(n)]
        if style > 0.97:
            out = [w.upper() for w in out]
        return " ".join(out)[:1].upper() + " ".join(out)[1:] + ("." if r.random() < 0.7 else "")

    def block(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        body = html.escape(text)
        if link:
            body = f'<a href="/{self.rng.randint(1, 999)}">{body}</a>'
        elif self.rng.random() < 0.15:
            body = f"<b>{body}" + self.rng.choice(["</b>", "<br>", "</b><br>"])
        close = f"</{tag}>" if self.rng.random() < 0.9 or tag not in ("p", "li") else ""
        self.out.append(f"<{tag}>{body}{close}")
        self.labels.append(main)

    def bare(self, text: str) -> None:
        self.out.append(html.escape(text))
        self.labels.append(False)

    def boxed(self, opening: str, fill) -> None:
        self.out.append(opening)
        fill()
        tags = [t.split(" ")[0].strip("<>") for t in opening.replace("><", "> <").split(" ") if t.startswith("<")]
        self.out += [f"</{t}>" for t in reversed(tags)]

    def side(self, kind: str) -> None:
        r = self.rng

        def fill():
            if kind in ("nav", "share"):
                wrap = r.random() < 0.7
                self.out.append("<ul>" if wrap else "")
                for _ in range(r.randint(1, 9)):
                    self.block("li" if wrap else "div", self.words(r.randint(1, 4)), False, r.random() < 0.85)
                self.out.append("</ul>" if wrap else "")
            elif kind == "form":
                self.out.append(f'<label>{self.words(2)}</label><input name="q"><button>{self.words(1)}</button>')
                self.labels.append(False)
            elif kind == "comments":
                if r.random() < 0.6:
                    self.block("h3", self.words(2), False)
                for _ in range(r.randint(1, 6)):
                    tag = r.choice(["p", "div", "li"])
                    self.out.append(r.choice(["", "", '<div class="comment">']))
                    shut = bool(self.out[-1])
                    self.block(tag, self.words(r.choice([3, 8, 20, 50, r.randint(50, 250)])), False)
                    self.out.append("</div>" if shut else "")
            elif r.random() < 0.5:
                self.bare(("© " if kind == "footer" else "") + self.words(r.randint(2, 25)))
            else:
                if kind in ("aside", "header") and r.random() < 0.6:
                    self.block(r.choice(["h2", "h3", "h4", "div"]), self.words(2), False)
                for _ in range(r.randint(1, 4)):
                    self.block(r.choice(["p", "div", "li", "p"]), self.words(r.choice([2, 6, 15, 40, r.randint(40, 200)])), False, kind == "aside" and r.random() < 0.6)

        self.boxed(r.choice(SIDE[kind]), fill)

    def article(self) -> None:
        r = self.rng

        def fill():
            if r.random() < 0.8:
                in_header = r.random() < 0.15
                self.out.append("<header>" if in_header else "")
                self.block("h1", self.words(r.randint(2, 12)), True)
                self.out.append("</header>" if in_header else "")
            for _ in range(r.choice([1, 2, 3, 5, 8, 13, 25])):
                u = r.random()
                if u < 0.75:
                    self.block("p", self.words(r.choice([1, 2, 5, 20, 40, 80, 80, r.randint(80, 400)])), True, r.random() < 0.02)
                elif u < 0.83:
                    self.block(r.choice(["h2", "h3", "h4"]), self.words(r.randint(1, 6)), True)
                elif u < 0.89:
                    self.out.append("<ul>")
                    for _ in range(r.randint(1, 5)):
                        self.block("li", self.words(r.choice([2, 6, 15])), True)
                    self.out.append("</ul>")
                elif u < 0.92:
                    self.block(r.choice(["blockquote", "pre", "figcaption"]), self.words(r.randint(3, 30)), True)
                elif u < 0.94:
                    self.out.append("<table><tr>")
                    for _ in range(r.randint(2, 4)):
                        self.block("td", self.words(r.randint(1, 4)), True)
                    self.out.append("</tr></table>")
                elif u < 0.97:
                    self.side(r.choice(["ad", "share", "form", "notice", "aside"]))
                else:
                    self.block("div", self.words(r.choice([5, 20, 60])), True)

        self.boxed(r.choice(MAIN_BOXES), fill)

    def page(self) -> tuple[str, np.ndarray]:
        r = self.rng
        simple = r.random() < 0.35
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>")
        before = [k for k in ("header", "nav", "notice", "ad", "form", "aside", "share") if r.random() < (0.4 if not simple else 0.5 if k in ("nav", "ad") else 0.05)]
        r.shuffle(before)
        for k in before:
            self.side(k)
        if r.random() < 0.97:
            self.article()
        after = [k for k in ("share", "ad", "comments", "aside", "form", "footer", "notice") if r.random() < (0.45 if not simple else 0.8 if k == "footer" else 0.05)]
        for k in after:
            self.side(k)
        self.out.append("</body></html>")
        return "".join(self.out), np.array(self.labels, np.float32)


def samples(n: int, seed: int) -> list[tuple[list, np.ndarray]]:
    out = []
    for i in range(n):
        text, labels = Writer(random.Random(seed * 1_000_003 + i)).page()
        page = blocks(text)
        if len(page) == len(labels) and page:
            out.append((page, labels))
    return out


def train(pages: int = 6000, rounds: int = 6, rate: float = 4e-3, seed: int = 1) -> Labeller:
    net, data = Labeller(), [(inputs(page), labels) for page, labels in samples(pages, seed)]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    step = 0
    for epoch in range(rounds):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 8, rng.random()))
        batches = [order[a : a + 32] for a in range(0, len(order), 32)]
        total = 0.0
        for at in rng.permutation(len(batches)):
            some = [data[i] for i in batches[at]]
            loss, g = net.gradients([x for x, _ in some], [y for _, y in some])
            total += loss
            step += 1
            lr = rate * (1 - epoch / rounds) ** 0.5
            for k in net.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.w[k] = (net.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"round {epoch}: loss {total / len(batches):.4f}", flush=True)
    return net


def accuracy(net: Labeller, data) -> tuple[float, float]:
    """Share of blocks, and of whole pages, that are labelled right."""
    p = net.probabilities([x for x, _ in data])
    right = [(q >= 0.5) == (y > 0.5) for q, (_, y) in zip(p, data)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    model = train()
    print("held out:", accuracy(model, samples(1000, 99)))
    model.save(WEIGHTS)
