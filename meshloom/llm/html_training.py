"""The labelled table that trains the block classifier: sketches of pages whose blocks are marked.

[+n] is a block of main text with n words, [-n] one of furniture; [=n] and [~n] are the same with
all words linked.  `labelled` turns the sketches into feature rows and labels.
"""

from __future__ import annotations

import re

import numpy as np

PAGES = (
    # Articles in their own container, with furniture around and inside.
    "<nav><ul><li><a>[~1]</a><li><a>[~2]</a><li><a>[~1]</a></ul></nav><div class=ad>[-9]</div><article><h1>[+8]</h1><p>[+40]<p>[+3]<p>[+1]<p>[+75]</article><footer>[-12]</footer>",
    "<header><div>[-4]</div><a>[~2]</a></header><main><h1>[+5]</h1><p>[+22]<div class=advert><p>[-31]</div><h2>[+2]</h2><p>[+64]<ul><li>[+4]<li>[+9]</ul></main><aside><h3>[-2]</h3><p>[-28]</aside>",
    "<div class=cookie-notice><p>[-26]</p></div><div class=content><h2>[+6]</h2><p>[+18]<blockquote>[+33]</blockquote><p>[+2]<a>[=3]</a></div><div id=comments><h3>[-2]</h3><p>[-45]<p>[-12]</div>",
    "<article><h1>[+4]</h1><p>[+55]<figure><figcaption>[+7]</figcaption></figure><p>[+90]<form><p>[-15]<button>[-1]</button></form><section class=comments><p>[-38]<p>[-3]</section></article><div class=sidebar><p>[-30]<a>[~4]</a></div>",
    "<article><header><h1>[+9]</h1></header><p>[+1]<p>[+12]<p>[+2]<p>[+150]<div class=related><h3>[-2]</h3><ul><li><a>[~7]</a><li><a>[~6]</a></ul></div><footer>[-10]</footer></article><footer><p>[-20]<a>[~2]</a></footer>",
    "<div class=post><p>[+5]<table><tr><td>[+2]<td>[+3]<tr><td>[+1]<td>[+8]</table><pre>[+25]</pre><dl><dt>[+2]<dd>[+11]</dl></div><div class=share><a>[~1]</a><a>[~1]</a></div>",
    "<article><p>[+6]<p><a>[=5]</a><p>[+17]<ol><li>[+1]<li><a>[=2]</a></ol></article><div class=newsletter><h2>[-4]</h2><p>[-24]</div><div role=banner>[-6]</div>",
    # Short passages beside links, inside a container.
    "<article><h2>[+3]</h2><p>[+4]<ul><li><a>[=1]</a><li><a>[=3]</a></ul><p>[+3]<p>[+5]<p><a>[=2]</a><p>[+1]</article><div>[-3]</div><div><a>[~1]</a></div>",
    "<main><p>[+5]<p><a>[=1]</a><p>[+2]<div><a>[=4]</a></div><p>[+4]<div><a>[=6]</a></div></main><div>[-4]</div><div><a>[~2]</a></div>",
    # Pages without a container: words and links decide.
    "<div><a>[~1]</a> <a>[~1]</a></div><ul><li><a>[~2]</a><li><a>[~2]</a><li><a>[~3]</a></ul><h1>[+7]</h1><p>[+48]<p>[+35]<p>[+8]<p>[+60]<p>[+11]<div>[-3]</div><div><a>[~5]</a></div>",
    "<table><tr><td><a>[~2]</a><td><a>[~2]</a></table><div>[+70]</div><div>[+20]</div><div>[+45]</div><div>[-4]</div><div><a>[~9]</a></div>",
    "<div>[-2]</div><div><a>[~3]</a></div><p>[+30]<h2>[+3]</h2><p>[+41]<p>[+26]<h2>[+4]</h2><p>[+37]<div><a>[~2]</a></div><div>[-5]</div>",
    "<h1>[+6]</h1><p>[+14]<p>[+25]<p>[+9]<p>[+33]<ul><li><a>[~4]</a><li><a>[~6]</a><li><a>[~5]</a></ul><div class=footer>[-14]</div>",
)
MARK = re.compile(r"\[([+\-=~])(\d+)\]")


def labelled(sketches: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    from .html_extract import blocks, features

    xs, ys = [], []
    for sketch in sketches:
        page = MARK.sub(lambda m: " ".join(["yes" if m[1] in "+=" else "no"] * int(m[2])), sketch)
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b.text.startswith("yes") for b in found], float))
    return np.concatenate(xs), np.concatenate(ys)
