"""Trains the block labeller on pages written here, and stores its weights: python -m sparkwright.llm.train_blocks

The pages mix the usual ways of marking up articles and what surrounds them, with words of random syllables as well as
the words that menus, notices and forms tend to have. Every leaf block carries its label while the page is written.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from sparkwright.llm.blocks import FIGURES, RUN, WIDTH, Labeller, _sigmoid, cut, run_lstm, vectors

UNITS = 24
#: Marks that tell the label of the words near them while training; cut() keeps them, and they are removed before vectors().
YES, NO = "␂", "␃"

MENU = "home about contact news blog products services login sign up search archive help privacy terms sitemap sports politics more menu next previous share print".split()
NOTICE = "we use cookies to improve your experience accept reject settings subscribe to our newsletter enter your email advertisement sponsored all rights reserved copyright follow us related posts read more leave a reply comments".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwzéñßüç") + self.r.choice("aeiouäêó") + self.r.choice(["", "n", "r", "s"]) for _ in range(self.r.choice([1, 1, 2]))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice([1, 1, 2, 2, 3])))

    def sentence(self, mark: str, low: int = 3, high: int = 22) -> str:
        ws = [self.word() for _ in range(self.r.randint(low, high))]
        if len(ws) > 6 and self.r.random() < 0.5:
            ws[self.r.randrange(2, len(ws) - 1)] += ","
        if self.r.random() < 0.15:
            i = self.r.randrange(len(ws))
            ws[i] = self.r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<code>{}</code>", "{} &amp;", "&quot;{}&quot;"]).format(ws[i])
        odd = self.r.random()
        if odd < 0.04:
            return mark + " | ".join(ws)
        if odd < 0.06:
            return mark + " ".join(w + self.r.choice(["###", "$$$", "%%%", "&&&", "!!"]) for w in ws)
        if odd < 0.08:
            return mark + " ".join(ws).upper() + self.r.choice(["!", "", " »", " ..."])
        if odd < 0.1:
            return mark + " ".join([ws[0]] * len(ws))
        if odd < 0.14:
            return mark + self.r.choice(["{0}.", "{0} of.", "Tel. +1 (555) 010-{1}", "{0}@{0}.example", "Licensed under {0} {1}.0.", "{1} {1} {1}"]).format(self.word(), self.r.randrange(1000, 9999))
        return mark + " ".join(ws).capitalize() + "."

    def prose(self, mark: str, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence(mark) for _ in range(self.r.randint(low, high)))

    def phrase(self, mark: str, stock: list[str], low: int = 1, high: int = 4) -> str:
        own = self.r.random() < 0.5
        return mark + " ".join(self.word() if own else self.r.choice(stock) for _ in range(self.r.randint(low, high))).capitalize()

    def inside(self, names: list[str], attributes: list[str], body: str) -> str:
        name = self.r.choice(names)
        given = self.r.choice(attributes)
        return f"<{name}{' ' + given if given else ''}>{body}</{name}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.phrase(YES, self.syllables, 3, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])):
            x = r.random()
            if x < 0.66:
                body = self.prose(YES)
                if r.random() < 0.25:
                    body = body + "<br>" + self.prose(YES, 1, 2)
                if r.random() < 0.1:
                    body = "<b>" + body
                out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", '<p class="lead">{}</p>']).format(body))
            elif x < 0.74:
                out.append(f"<h{r.choice('23')}>{self.phrase(YES, self.syllables, 1, 6)}</h2>")
            elif x < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.sentence(YES, 1, 12)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote><p>{self.prose(YES, 1, 2)}</p></blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.phrase(YES, self.syllables, 1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.96:
                out.append(f"<pre>{self.sentence(YES)}</pre>")
            else:
                out.append(self.boiler(r.choice(["ad", "share", "form"])))
        body = "\n".join(out) if r.random() < 0.3 else "".join(out)
        if r.random() < 0.72:
            body = self.inside(["article", "main", "article"], ["", "", 'class="post"', 'class="content"', 'id="main"'], body)
            if r.random() < 0.2:
                body = f"<main>{body}</main>"
        elif r.random() < 0.8:
            body = self.inside(["div", "section", "td"], ['class="content"', 'class="post-body"', 'class="entry-content"', 'id="content"', 'class="article-text"', 'id="main"', 'class="story"', 'class="body"', 'role="main"'], body)
        return body

    def boiler(self, kind: str) -> str:
        r = self.r
        links = lambda n, stock: "".join(r.choice(['<li><a href="/{0}">{1}</a></li>', '<li><a href="/{0}">{1}</a>']).format(self.word(), self.phrase(NO, stock)) for _ in range(n))
        text = lambda: self.prose(NO, 1, 3) if r.random() < 0.5 else self.phrase(NO, NOTICE, 3, 14)
        if kind == "nav":
            flat = r.random() < 0.3
            body = " ".join(f'<a href="/{self.word()}">{self.phrase(NO, MENU)}</a>' for _ in range(r.randint(2, 8))) if flat else f"<ul>{links(r.randint(2, 10), MENU)}</ul>"
            return self.inside(["nav", "nav", "div", "ul"], ["", 'class="menu"', 'id="nav"', 'class="breadcrumb"', 'class="navbar"', 'role="navigation"'], body) if r.random() < 0.8 else f"<nav>{body}</nav>"
        if kind == "header":
            return self.inside(["header", "div"], ['class="header"', 'id="header"', 'class="masthead site-header"'], f"<h{r.choice('12')}>{self.phrase(NO, MENU)}</h1>" * (r.random() < 0.5) + f"<p>{text()}</p>" + (self.boiler("nav") if r.random() < 0.5 else "")).replace("<div>", '<div class="header">')
        if kind == "footer":
            body = r.choice(["&copy; ", "&copy; 2024 ", ""]) + text() if r.random() < 0.6 else f"<p>{text()}</p>" * r.randint(1, 2) + f"<ul>{links(2, MENU)}</ul>"
            return self.inside(["footer"], ["", 'class="footer"'], NO + body) if r.random() < 0.7 else self.inside(["div", "section"], ['class="footer"', 'id="footer"', 'class="site-footer"', 'class="copyright"'], NO + body)
        if kind == "ad":
            body = text() if r.random() < 0.6 else f"<p>{text()}</p>"
            return self.inside(["div", "div", "aside", "section", "p"], ['class="ad"', 'class="ads"', 'class="advert"', 'class="advertisement"', 'class="sponsored"', 'class="promo"', 'class="banner"', 'id="ad-1"', 'class="ad-box"'], NO + body)
        if kind == "side":
            body = f"<h3>{self.phrase(NO, NOTICE)}</h3>" * (r.random() < 0.6) + (f"<ul>{links(r.randint(2, 8), NOTICE)}</ul>" if r.random() < 0.5 else f"<p>{self.prose(NO, 1, 4)}</p>" * r.randint(1, 3))
            return f"<aside>{body}</aside>" if r.random() < 0.5 else self.inside(["div", "section", "aside"], ['class="sidebar"', 'id="sidebar"', 'class="widget"', 'class="related"', 'class="side"', 'class="recommended"', 'class="popular"'], body)
        if kind == "cookie":
            return self.inside(["div", "section", "dialog"], ['class="cookie"', 'id="cookie-notice"', 'class="cookie-banner"', 'class="notice"', 'class="consent"', 'role="alert"', 'class="popup modal"', 'class="gdpr"'], f"<p>{text()}</p><button>{self.phrase(NO, NOTICE)}</button>")
        if kind == "form":
            return self.inside(["form"], ["", 'class="search"', 'class="newsletter"', 'action="/subscribe"', 'class="subscribe"'], f"<label>{self.phrase(NO, NOTICE)}</label><input name='q'><p>{text()}</p>" + f"<button>{self.phrase(NO, NOTICE)}</button>")
        if kind == "share":
            return self.inside(["div", "ul"], ['class="share"', 'class="social"', 'class="tags"', 'class="meta byline"'], links(3, NOTICE))
        one = lambda: self.inside(["div", "li", "article"], ['class="comment"', 'class="comment-body"', 'class="reply"'], f'<span class="author">{self.phrase(NO, MENU)}</span><p>{self.prose(NO, 1, 3)}</p>')
        return self.inside(["div", "section", "ol"], ['class="comments"', 'id="comments"', 'class="comment-list"', 'class="discussion responses"', 'class="reader-comments"'], f"<h{r.choice('23')}>{self.phrase(NO, NOTICE)}</h2>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6))))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return r.choice(["{}", "<p>{}</p>", "<body>{}"]).format(self.prose(YES, 1, 8))
        before = [k for k, p in (("cookie", 0.15), ("header", 0.35), ("nav", 0.75), ("form", 0.15), ("ad", 0.45), ("side", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.15), ("ad", 0.3), ("comments", 0.3), ("side", 0.4), ("form", 0.15), ("nav", 0.1), ("footer", 0.8), ("cookie", 0.15)) if r.random() < p]
        r.shuffle(before)
        main = self.article()
        parts = [self.boiler(k) for k in before], [self.boiler(k) for k in after]
        tail = parts[1]
        if r.random() < 0.3:
            cut_at = r.randint(0, len(tail))
            main, tail = f'<div class="{r.choice(["wrapper", "page", "container", "row", "layout"])}">{main}{"".join(tail[:cut_at])}</div>', tail[cut_at:]
        body = "".join(parts[0]) + f"<!-- {self.word()} -->" + main + "".join(tail)
        close = "</body></html>" if r.random() < 0.85 else ""
        return f'<!DOCTYPE html><html lang="xx"><head><title>{self.word()}</title><style>p{{a:b}}</style></head><body>{body}{close}'


def examples(seed: int, pages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for i in range(pages):
        blocks = cut(Writer(seed * 1_000_003 + i).page())
        labels = np.array([YES in b[1] for b in blocks], np.float32)
        known = [b for b in blocks]
        clean = [(p, t.replace(YES, "").replace(NO, "") or "x", n) for p, t, n in known]
        if clean:
            out.append((vectors(clean), labels))
    return out


def padded(batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in batch)
    x, y, m = np.zeros((steps, len(batch), WIDTH), np.float32), np.zeros((steps, len(batch)), np.float32), np.zeros((steps, len(batch)), bool)
    for j, (v, label) in enumerate(batch):
        x[: len(v), j], y[: len(v), j], m[: len(v), j] = v, label, True
    return x, y, m


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept = {d: run_lstm(x, m, w[f"wx{d}"], w[f"wh{d}"], w[f"b{d}"], d == "b", keep=True) for d in "fb"}
    h = np.concatenate([kept[d][0] for d in "fb"], axis=2)
    p = _sigmoid(h @ w["v"] + w["c"])
    n = m.sum()
    loss = -float((np.where(m, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0)).sum() / n)
    dz = np.where(m, p - y, 0) / n
    g = {"v": np.einsum("tbh,tb->h", h, dz), "c": np.array([dz.sum()], np.float32)}
    units = w["whf"].shape[0]
    for k, d in enumerate("fb"):
        dout = dz[:, :, None] * w["v"][k * units : (k + 1) * units]
        dh, dc = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
        dg_all, gwh = np.zeros((*x.shape[:2], 4 * units), np.float32), np.zeros_like(w[f"wh{d}"])
        for t, i, f, o, u, c, before, tc, mask in reversed(kept[d][1]):
            dh = dh + dout[t]
            dn, dcn = dh * mask, dc * mask + dh * mask * o * (1 - tc**2)
            dg = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), dn * tc * o * (1 - o), dcn * i * (1 - u**2)], axis=1)
            dg_all[t] = dg
            gwh += before.T @ dg
            dh, dc = dg @ w[f"wh{d}"].T + dh * ~mask, dcn * f + dc * ~mask
        flat = dg_all.reshape(-1, 4 * units)
        g |= {f"wx{d}": x.reshape(-1, WIDTH).T @ flat, f"wh{d}": gwh, f"b{d}": flat.sum(axis=0)}
    return loss, g


def train(pages: int = 6000, epochs: int = 14, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"v": rng.normal(0, 0.3, 2 * UNITS), "c": np.zeros(1)}
    for d in "fb":
        w |= {f"wx{d}": rng.normal(0, 0.1, (WIDTH, 4 * UNITS)), f"wh{d}": rng.normal(0, 0.15, (UNITS, 4 * UNITS)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], UNITS)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    data = sorted(examples(seed, pages), key=lambda e: len(e[0]))
    batches = [padded(data[i : i + 32]) for i in range(0, len(data), 32)]
    for epoch in range(epochs):
        losses = []
        for j in rng.permutation(len(batches)):
            x, y, m = batches[j]
            x = x.copy()
            x[:, :, : WIDTH - FIGURES] *= rng.random((1, x.shape[1], WIDTH - FIGURES)) > 0.1  # parts of paths and words go, so none is relied on alone
            loss, g = gradients(w, x, y, m)
            losses.append(loss)
            step += 1
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k in w:
                v = g[k] * min(1.0, 1 / size) + 1e-5 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                w[k] -= (rate * 0.5 ** (epoch / 4) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(epoch, round(float(np.mean(losses)), 4), flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], seed: int = 99, pages: int = 400) -> float:
    good = total = 0
    for x, y in examples(seed, pages):
        p = Labeller(w).probabilities(lambda a, b, x=x: (x[a:b, None, :], np.ones((b - a, 1), bool)), len(x), RUN)[:, 0]
        good += int(((p >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    return good / total


if __name__ == "__main__":
    weights = train()
    print("blocks right on pages not trained on:", round(accuracy(weights), 4))
    np.savez_compressed(Path(__file__).with_name("blocks.npz"), **{k: v.astype(np.float16) for k, v in weights.items()})
