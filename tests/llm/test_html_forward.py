"""The labeller's whole answer (vectors, grouping of pages, padding, both directions) against one that goes block by block in plain Python."""

import math
import random

from groupwise.llm.html_extract import Labeller, blocks_of, main_texts, vectors


def plain_probabilities(model, rows):
    """Page by page, step by step, number by number."""
    n = model.hidden
    squash = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    states = {}
    for d in "fb":
        h, c, out = [0.0] * n, [0.0] * n, [None] * len(rows)
        for t in range(len(rows)) if d == "f" else reversed(range(len(rows))):
            z = [model.w["c" + d][j] + sum(x * model.w["x" + d][k, j] for k, x in enumerate(rows[t]) if x) + sum(h[k] * model.w["h" + d][k, j] for k in range(n)) for j in range(4 * n)]
            i, f, o, g = ([(math.tanh if p == 3 else squash)(v) for v in z[p * n : (p + 1) * n]] for p in range(4))
            c = [f[k] * c[k] + i[k] * g[k] for k in range(n)]
            h = [o[k] * math.tanh(c[k]) for k in range(n)]
            out[t] = h
        states[d] = out
    w = model.w["out"]
    return [squash(sum(a * b for a, b in zip([*states["f"][t], *states["b"][t]], w, strict=True)) + model.w["bias"][0]) for t in range(len(rows))]


def page(rnd, n):
    tags = ["p", "div", "h2", "li", "nav", "footer"]
    part = lambda t: f"<{t} class='c{rnd.randrange(3)}'>" + " ".join(rnd.choice(["one", "Two,", "three.", "<a href=x>four</a>", "&amp;"]) for _ in range(rnd.randrange(1, 9))) + f"</{t}>"
    return "<html><body>" + "".join(part(rnd.choice(tags)) for _ in range(n)) + "</body></html>"


def test_texts_of_many_pages():
    """Pages of 0 to 70 blocks, in one batch whose padding is cut into several groups."""
    rnd = random.Random(4)
    model = Labeller(hidden=5, seed=3)
    for k in ("out", "xf", "xb", "hf", "hb"):
        model.w[k] = model.w[k] * 6  # far from even odds
    pages = ["", "plain", *[page(rnd, n) for n in (1, 2, 3, 5, 9, 14, 30, 70, 2, 1)]]
    want, near = [], 0
    for html in pages:
        blocks = blocks_of(html)
        p = plain_probabilities(model, vectors(blocks, {}, {}).tolist()) if blocks else []
        near += sum(abs(x - 0.5) < 1e-5 for x in p)
        want.append(" ".join(b.text for b, x in zip(blocks, p, strict=True) if x > 0.5))
    assert near == 0 and len({bool(x) for x in want}) == 2
    for cells in (64, 4096):
        assert main_texts(pages, model, cells) == want
