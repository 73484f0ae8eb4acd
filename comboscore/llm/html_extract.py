"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a chain of leaf blocks. Each block has binary features of its open elements
(tag names, and words of their class, id and role) and of its text (length, share of linked
text, punctuation, place in the page). The field has a weight per feature and label (content or
not) and one per pair of neighbouring labels. It is trained by stochastic gradient steps with
AdaGrad rates on the exact gradient (forward and backward sums), and decoded by Viterbi.

Labelled pages are of two kinds, both bounded: ``LAYOUTS`` pages put together here from layout
rules (``layout_page``: articles in different containers among menus, banners, notices, forms,
related links and reader comments; select, template, noscript and object parts), and ``SAMPLE`` pages of the input, picked by a hash of the
id, that mark their parts with elements of fixed meaning (article or main; nav, header, footer,
aside, form). Every page is then decoded, over its whole html.

Defined results: null or empty html gives an empty text; blocks are joined by \\n, white space
inside a block (also <br>) is one blank; malformed markup is read to its end (an element that is
never closed hides nothing); the text of script, style, title, textarea, iframe, svg and formula
annotations is none of the page's; repeated rows and null ids are separate rows; other columns
are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm.html_blocks import Block, blocks
from comboscore.session import cut_lineage

LAYOUTS, SAMPLE, PASSES, RATE, L2 = 600, 200, 6, 0.3, 1e-4
SAMPLE_BYTES = 1 << 17          # largest page of the sample, so it is 25 MB at most
ARTICLE = {"article", "main"}
OTHER = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button"}
RESULT = "page_id long, url string, text string, blocks int, kept int"


def path_features(path) -> list[str]:
    out = [f"own={path[-1][0]}" if path else "own="]
    for k, (tag, words) in enumerate(path):
        out.append(f"in={tag}")
        near = len(path) - k <= 2
        for w in words:
            out.append(f"name={w}")
            if near:
                out.append(f"near={w}")
    return list(dict.fromkeys(out))


def text_features(block: Block, k: int, n: int) -> list[str]:
    t = block.text
    words = t.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 30 else 4
    share = 4 * block.link // len(t)
    out = ["bias", f"words={size}", f"links={share}", f"words={size},links={share}"]
    if t[-1] in ".!?:;\"”»…":
        out.append(f"stop,words={size}")
    if "©" in t or "|" in t and words < 12:
        out.append("mark")
    out.append("first" if k == 0 else "last" if k == n - 1 else "inside")
    return out


def label(block: Block) -> int:
    """1 for content, by elements of fixed meaning."""
    inside = 0
    for tag, words in block.path:
        if tag in ARTICLE:
            inside = 1
        elif tag in OTHER or "ad" in words or "comments" in words or "comment" in words:
            return 0
    return inside


# ---- labelled pages by rule -------------------------------------------------------------

_SITE = "menu navigation topbar breadcrumb breadcrumbs masthead banner"
_ASIDE = "sidebar widget related recommended trending popular share social tags toc rail"
_NOTICE = "cookie consent notice gdpr alert popup modal newsletter subscribe signup promo"
_ADS = "ad ads advert advertisement sponsored sponsor"
_COMMENTS = "comments comment reply replies discussion disqus respond"
_FOOT = "footer copyright legal bottom colophon"
_BODY = "content article post entry story body main text page prose"


def _words(rng, least, most):
    letters = "aeinorstulmdcp"
    w = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(least, most))]
    return " ".join(w).capitalize()


def _sentences(rng, count):
    return " ".join(_words(rng, 4, 18) + rng.choice("....!?") for _ in range(count))


def _named(rng, group, tags, inner):
    tag, name = rng.choice(tags.split()), rng.choice(group.split())
    if rng.random() < 0.25:
        name += "-" + rng.choice("area box wrap list section block inner".split())
    if rng.random() < 0.1:
        name = ""
    attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
    return f"<{tag}{attribute}>{inner}</{tag}>"


def _links(rng, most=8):
    items = [f'<a href="/x">{_words(rng, 1, 4)}</a>' for _ in range(rng.randint(2, most))]
    return rng.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])


def layout_page(seed: int) -> str:
    """A page put together by rule; content stands between the marks \x01 and \x02 of each block."""
    rng = random.Random(seed)

    def mark(x):
        return f"\x01{x}\x02"

    title = mark(_words(rng, 2, 12))
    body = [f"<h1>{title}</h1>"] if rng.random() < 0.9 else []
    if rng.random() < 0.2:
        body[:] = [f"<header>{''.join(body)}</header>"]
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.78:
            text = _sentences(rng, rng.choice([1, 1, 2, 4, 8])) if rng.random() < 0.9 else _words(rng, 1, 2) + "."
            if rng.random() < 0.15:
                text = text.replace(" ", f' <a href="/y">{_words(rng, 1, 2)}</a> ', 1)
            body.append(f"<p>{mark(text)}</p>")
        elif kind < 0.86:
            body.append(f"<h{rng.randint(2, 4)}>{mark(_words(rng, 2, 6))}</h{rng.randint(2, 4)}>")
        elif kind < 0.92:
            body.append("<ul>" + "".join(f"<li>{mark(_words(rng, 2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.96:
            body.append(f"<blockquote>{mark(_sentences(rng, 2))}</blockquote>")
        else:
            body.append("<table><tr>" + "".join(f"<td>{mark(_words(rng, 1, 3))}</td>" for _ in range(3)) + "</tr></table>")
        if rng.random() < 0.06:
            body.append(_named(rng, _ADS, "div aside", _sentences(rng, 1)))
    extra = random.Random(-1 - seed)          # numbers of its own: the rest of the page stays as it is
    if extra.random() < 0.1:
        options = "".join(f"<option>{_words(extra, 1, 3)}</option>" for _ in range(extra.randint(2, 5)))
        hidden = [f"<select>{options}</select>", f"<template><p>{_sentences(extra, 1)}</p></template>"]
        body.insert(extra.randint(0, len(body)), extra.choice(hidden))
    if extra.random() < 0.1:
        tag = extra.choice(["noscript", "object"])
        body.insert(extra.randint(0, len(body)), f"<{tag}><p>{mark(_sentences(extra, 2))}</p></{tag}>")
    notice = f"<noscript>{_sentences(extra, 1)}</noscript>" if extra.random() < 0.1 else ""
    inner = "".join(body)
    way = rng.random()
    if way < 0.4:
        inner = f"<article>{inner}</article>"
    elif way < 0.55:
        inner = f"<main>{inner}</main>"
    elif way < 0.95:
        inner = _named(rng, _BODY, "div section div", inner)
    for _ in range(rng.randint(0, 2)):
        inner = f'<div{rng.choice(["", " class=wrap", " class=container", " id=page", " class=row"])}>{inner}</div>'
    comments = ""
    if rng.random() < 0.4:
        said = "".join(f"<{t}>{_sentences(rng, rng.randint(1, 4))}</{t}>" for t in rng.choices(["p", "li", "div"], k=rng.randint(1, 5)))
        comments = _named(rng, _COMMENTS, "div section ul", f"<h3>{_words(rng, 1, 2)}</h3>{said}")
    top = [_named(rng, _SITE, "nav header div", _links(rng)), f"<header><a href='/'>{_words(rng, 1, 3)}</a></header>",
           _named(rng, _NOTICE, "div aside", _sentences(rng, rng.randint(1, 2)) + "<button>Ok</button>"),
           _named(rng, _ADS, "div aside", _sentences(rng, 1)), f"<form><p>{_words(rng, 1, 4)}</p></form>"]
    end = [_named(rng, _ASIDE, "aside div section", f"<h4>{_words(rng, 1, 3)}</h4>" + _links(rng)), comments,
           _named(rng, _NOTICE, "form div", f"<p>{_sentences(rng, 1)}</p>"), _named(rng, _ADS, "div", _sentences(rng, 1)),
           _named(rng, _FOOT, "footer footer div", f"&copy; {_words(rng, 1, 3)}. {_sentences(rng, 1)}")]
    top = [x for x in top if rng.random() < 0.5]
    end = [x for x in end if rng.random() < 0.6]
    if comments and comments not in end:
        end.insert(0, comments)
    return f"<html><head><title>x</title></head><body>{notice}{''.join(top)}{inner}{''.join(end)}</body></html>"


def labelled_layout(seed: int):
    out = blocks(layout_page(seed))
    labels = [int("\x01" in b.text) for b in out]
    for b in out:
        b.text = b.text.replace("\x01", "").replace("\x02", "") or "x"
    return out, labels


# ---- the field --------------------------------------------------------------------------

def train(pages) -> dict:
    """{feature: (weight of 0, weight of 1), 'transitions': 2 x 2} from (blocks, labels) pairs."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if page:
            rows = [[index.setdefault(f, len(index)) for f in path_features(b.path) + text_features(b, k, len(page))]
                    for k, b in enumerate(page)]
            data.append((rows, np.array(labels)))
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    rng = random.Random(1)
    for _ in range(PASSES):
        rng.shuffle(data)
        for rows, y in data:
            n = len(y)
            flat, sizes = np.concatenate(rows), [len(r) for r in rows]
            owner = np.repeat(np.arange(n), sizes)
            node = np.zeros((n, 2))
            np.add.at(node, owner, w[flat])
            forward, backward = node.copy(), np.zeros((n, 2))
            for k in range(1, n):
                forward[k] += np.logaddexp.reduce(forward[k - 1][:, None] + t, axis=0)
            for k in range(n - 2, -1, -1):
                backward[k] = np.logaddexp.reduce(t + (node[k + 1] + backward[k + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(forward[-1])
            error = np.exp(forward + backward - total)
            error[np.arange(n), y] -= 1
            step = np.zeros_like(w)
            np.add.at(step, flat, error[owner])
            used = np.unique(flat)
            g = step[used] + L2 * w[used]
            gw[used] += g * g
            w[used] -= RATE * g / np.sqrt(gw[used])
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + t[None] + (node[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
                gt += pair * pair
                t -= RATE * pair / np.sqrt(gt)
    model = {f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}
    return {"weights": model, "transitions": t.tolist()}


class Extractor:
    """Viterbi decoding; scores of element paths are kept, as sites repeat them."""

    KEEP = 50_000

    def __init__(self, model):
        self.weight = {f: b - a for f, (a, b) in model["weights"].items()}     # content over other
        (self.t00, self.t01), (self.t10, self.t11) = model["transitions"]
        self.paths: dict = {}

    def path_score(self, path) -> float:
        s = self.paths.get(path)
        if s is None:
            if len(self.paths) >= self.KEEP:
                self.paths.clear()
            s = self.paths[path] = sum(self.weight.get(f, 0.0) for f in path_features(path))
        return s

    def labels(self, page: list[Block]) -> list[int]:
        n = len(page)
        back = []
        a, b = 0.0, 0.0
        for k, block in enumerate(page):
            s = self.path_score(block.path) + sum(self.weight.get(f, 0.0) for f in text_features(block, k, n))
            if k:
                to0, to1 = a + self.t00 >= b + self.t10, a + self.t01 >= b + self.t11
                back.append((0 if to0 else 1, 0 if to1 else 1))
                a, b = (a + self.t00 if to0 else b + self.t10), (a + self.t01 if to1 else b + self.t11) + s
            else:
                b = s
        out = [int(b > a)] if n else []
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]

    def extract(self, page: str | None) -> tuple[str, int, int]:
        found = blocks(page or "")
        kept = [b.text for b, y in zip(found, self.labels(found)) if y]
        return "\n".join(kept), len(found), len(kept)


def extract_pages(model):
    def run(batches):
        field = Extractor(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sub = batch.slice(i, 256)
                rows = [field.extract(x) for x in sub.column("html").to_pylist()]
                yield pa.record_batch([sub.column("page_id"), sub.column("url"), pa.array([r[0] for r in rows], pa.string()),
                                       pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                                      names=[x.split()[0] for x in RESULT.split(", ")])
    return run


def sampled_pages(pages: DataFrame, sample: int, html_col: str, id_col: str) -> list:
    """At most ``sample`` pages with elements of fixed meaning, none over ``SAMPLE_BYTES``: those whose
    ids have the smallest hashes. Hashes alone are ranked, and only those below a bound that few
    pass; the driver gets the winners' pages, one for each id."""
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]") & (F.octet_length(html_col) <= SAMPLE_BYTES))
    marked = marked.select(F.xxhash64(F.col(id_col), F.lit(5)).alias("place"), F.col(html_col).alias("html"))
    places = cut_lineage(marked.select("place").distinct())
    n = places.count()
    # four times the share that is needed; the hashes are spread evenly over 64 bits
    bound = -(1 << 63) + min(1 << 64, (1 << 64) * 4 * sample // max(n, 1)) - 1
    winners = places.where(F.col("place") <= F.lit(bound).cast("long")).orderBy("place").limit(sample)
    return marked.join(F.broadcast(winners), "place").groupBy("place").agg(F.min("html").alias("html")).orderBy("place").collect()


def training_pages(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, html_col: str = "html", id_col: str = "page_id"):
    """(blocks, labels) of rule-made pages and of sampled pages with elements of fixed meaning."""
    out = [labelled_layout(seed) for seed in range(layouts)]
    for r in sampled_pages(pages, sample, html_col, id_col):
        page = blocks(r["html"])
        out.append((page, [label(b) for b in page]))
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """One row per page: page_id, url, text, blocks (number), kept (blocks of the text)."""
    model = pages.sparkSession.sparkContext.broadcast(train(training_pages(pages, html_col=html_col, id_col=id_col, **options)))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract_pages(model), RESULT)
