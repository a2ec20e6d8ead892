"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: maximal runs of text between block-level tags, each with the open elements above it. A
block's features are its ancestors' tags, classes and ids and coarse properties of its text; the chain has two labels, main text and
the rest, and is trained by maximum likelihood (forward-backward, Adam, an L2 prior) on labelled pages, then decoded by
Viterbi. Labelled pages come from `labelled_pages`: layouts of many kinds with random words, whose labels are known
as they are written. Their number is the documented bound `n_pages`; training is deterministic and takes a second on the
driver; the weights, some hundred numbers, go to the tasks. Decoding is a map over pages: no shuffle.

Null or empty html: empty text. Broken markup: unclosed elements end where HTML lets them end; an unfinished tag at the end
is dropped. Repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

N_PAGES = 400
SEED = 7
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = "script|style|noscript|template|svg|textarea|iframe"
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ALONE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    steps: np.ndarray  # label before x label
    start: np.ndarray
    paths: dict[tuple, np.ndarray] = field(default_factory=dict)  # scores of paths met


def _element(name: str, attributes: str) -> str:
    """An element as the path has it: its name, then the words of its class, id and role."""
    if not attributes:
        return name
    words = [w.lower() for m in NAMES.finditer(attributes) for w in PARTS.findall("".join(m.groups("")))]
    return " ".join([name, *dict.fromkeys(words)])


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    found: list[Block] = []
    stack: list[str] = []  # element names
    path: list[str] = []
    parts: list[str] = []
    state = {"linked": 0}

    def flush() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            found.append(Block(tuple(x for x in path if x.split(" ", 1)[0] not in INLINE), text, state["linked"]))
        parts.clear()
        state["linked"] = 0

    def words(raw: str) -> None:
        if raw:
            parts.append(raw)
            if "a" in stack:
                state["linked"] += len(raw)

    def cut(k: int) -> None:
        del stack[k:], path[k:]

    at = 0
    for m in TOKEN.finditer(html):
        words(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                flush()
            continue
        if name not in INLINE:
            flush()
        if m[2]:
            if name in stack:
                cut(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name in ENDS_P and "p" in stack:
            cut(len(stack) - 1 - stack[::-1].index("p"))
        if name in ALONE and name in stack:
            k = len(stack) - 1 - stack[::-1].index(name)
            if not any(x in ALONE[name] for x in stack[k:]):
                cut(k)
        if name not in VOID and not m[4].rstrip().endswith("/"):
            stack.append(name)
            path.append(_element(name, m[4]))
    words(html[at:])
    flush()
    return found


def path_features(path: tuple[str, ...]) -> list[str]:
    own = ["bias"]
    for k, element in enumerate(reversed(path)):
        name, *words = element.split(" ")
        own += [f"in:{name}", *(f"in:.{w}" for w in words)]
        if k == 0:
            own += [f"leaf:{name}", *(f"leaf:.{w}" for w in words)]
        if k == 1:
            own.append(f"above:{name}")
    return list(dict.fromkeys(own))


def text_features(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    linked = block.linked / n
    return [
        f"size:{n.bit_length()}",
        "links:none" if linked == 0 else "links:some" if linked < 0.5 else "links:most",
        "ends" if text[-1] in ".!?…:;\"»" else "open",
        "mark" if text[0] in "©®·|›»•" else "plain",
    ]


# ---------------------------------------------------------------------------------------------------- labelled pages


def labelled_pages(n_pages: int = N_PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of pages of many layouts. Texts of the article carry a sign that is taken out again."""
    rng = random.Random(seed)
    sign = "\x01"

    def sentence(low: int, high: int) -> str:
        words = ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def some(*names: str) -> str:
        return rng.choice(names)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{sentence(1, 3)}</a></li>' for k in range(n))

    def box(names: str, inside: str, tags: str = "div section p aside") -> str:
        tag = some(*tags.split())
        return f'<{tag} {some("class", "id")}="{some(*names.split())}{some("", "-box", " wide")}">{inside}</{tag}>'

    def rest() -> str:
        """Something that isn't the article."""
        prose = f"<p>{sentence(3, 40)}</p>" if rng.random() < 0.5 else sentence(2, 30)
        return rng.choice(
            [
                lambda: f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>",
                lambda: box("menu navbar navigation breadcrumb breadcrumbs topnav tabs", f"<ul>{links(rng.randint(2, 8))}</ul>"),
                lambda: f"<aside>{prose}</aside>",
                lambda: box("sidebar side widget related recommended more popular trending", f"<h3>{sentence(1, 4)}</h3>{prose}<ul>{links(3)}</ul>"),
                lambda: box("ad ads advert advertisement sponsor sponsored promo banner promotion", prose),
                lambda: box("notice cookie cookies consent alert warning popup modal gdpr privacy message", prose + f"<button>{sentence(1, 2)}</button>"),
                lambda: f'<form action="/s"><label>{sentence(1, 3)}</label><input name="q"><select><option>{sentence(1, 2)}<option>{sentence(1, 2)}</select><button>{sentence(1, 2)}</button><p>{sentence(2, 12)}</p></form>',
                lambda: box("comments comment replies discussion responses", f"<h2>{sentence(1, 3)}</h2>" + "".join(f'<div class="comment"><b>{sentence(1, 2)}</b><p>{sentence(4, 60)}</p></div>' for _ in range(rng.randint(1, 4))), "div section"),
                lambda: box("newsletter subscribe signup login share social toolbar tags meta byline author", prose),
                lambda: f"<button>{sentence(1, 3)}</button>",
            ]
        )()

    def main() -> str:
        out = [f"<h1>{sign}{sentence(2, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            text = f"{sign}{sentence(1, 90)}"
            if rng.random() < 0.3:
                text += f' <a href="/x">{sentence(1, 3)}</a> {sentence(1, 9)}'
            out.append(
                rng.choices(
                    [f"<p>{text}</p>", f"<p>{text}", f"<h2>{text[:40]}</h2>", f"<ul><li>{text}</li><li>{sign}{sentence(1, 9)}</li></ul>", f"<blockquote>{text}</blockquote>", f"<p><b>{text}<br>{sign}{sentence(1, 20)}", f"<div>{text}</div>", f"<pre>{text}</pre>", f"<table><tr><td>{text}</td><td>{sign}{sentence(1, 5)}</td></tr></table>", rest()],
                    [12, 3, 2, 1, 1, 2, 1, 0.5, 0.5, 2],
                )[0]
            )
        return "".join(out)

    pages = []
    for k in range(n_pages):
        title = sentence(2, 9)
        frame = rng.choice(["article", "article", "main", "main><article", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry article"', 'section class="story text"', 'div class="article body"'])
        close = "".join(f"</{x.split()[0]}>" for x in reversed(frame.split("><")))
        top = f"<header>{rest() if rng.random() < 0.6 else sentence(1, 5)}</header>" if rng.random() < 0.5 else ""
        foot = rng.choice([f"<footer>&copy; {sentence(1, 9)}</footer>", f"<footer><p>{sentence(2, 20)}</p>{links(3)}</footer>", box("footer copyright legal", f"&copy; {sentence(1, 12)}"), ""])
        before = "".join(rest() for _ in range(rng.randint(0, 3)))
        after = "".join(rest() for _ in range(rng.randint(0, 3)))
        page = f"<html><head><title>{title}</title></head><body>{top}{before}<{frame}>{main()}{close}{after}{foot}</body></html>"
        if k % 9 == 0:
            page = page[: rng.randint(len(page) // 2, len(page))]
        own = blocks(page)
        labels = [int(sign in b.text) for b in own]
        for b in own:
            b.text = b.text.replace(sign, "") or "x"
        pages.append((own, labels))
    return pages


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, rate: float = 0.15, prior: float = 2e-4) -> Model:
    """Maximum likelihood of the label chains, all pages at once, padded to the longest."""
    index: dict[str, int] = {}
    rows, columns = [], []
    length = max(len(b) for b, _ in pages)
    n = len(pages)
    gold = np.full((n, length), -1)
    for i, (own, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
        for j, block in enumerate(own):
            for name in (*path_features(block.path), *text_features(block)):
                rows.append(i * length + j)
                columns.append(index.setdefault(name, len(index)))
    rows, columns = np.array(rows), np.array(columns)
    live = gold >= 0
    size = live.sum(1)
    w, steps, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, steps, start)]
    add = lambda values, at, m: np.stack([np.bincount(at, values[:, y], m) for y in (0, 1)], axis=1)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for t in range(1, rounds + 1):
        unary = add(w[columns], rows, n * length).reshape(n, length, 2)
        a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        a[:, 0] = unary[:, 0] + start
        for j in range(1, length):
            a[:, j] = np.where(live[:, j, None], logsum(a[:, j - 1, :, None] + steps, 1) + unary[:, j], a[:, j - 1])
        for j in range(length - 2, -1, -1):
            b[:, j] = np.where(live[:, j + 1, None], logsum(steps + (unary[:, j + 1] + b[:, j + 1])[:, None], 2), 0)
        z = logsum(a[np.arange(n), size - 1], 1)
        one = np.exp(a + b - z[:, None, None]) * live[..., None]
        two = np.exp(a[:, :-1, :, None] + steps + (unary[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None]) * live[:, 1:, None, None]
        truth = np.stack([gold == 0, gold == 1], axis=2).astype(float)
        both = truth[:, :-1, :, None] * truth[:, 1:, None]
        gradients = [add((truth - one).reshape(-1, 2)[rows], columns, len(index)) / n - prior * w, (both - two).sum((0, 1)) / n - prior * steps, (truth[:, 0] - one[:, 0]).sum(0) / n - prior * start]
        for x, g, (m, v) in zip((w, steps, start), gradients, memory, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(index, w, steps, start)


def decode(model: Model, own: list[Block]) -> list[int]:
    """The most probable labels."""
    if not own:
        return []
    unary = []
    for block in own:
        score = model.paths.get(block.path)
        if score is None:
            score = model.weights[[model.index[x] for x in path_features(block.path) if x in model.index]].sum(0)
            if len(model.paths) < 50_000:
                model.paths[block.path] = score
        unary.append(score + model.weights[[model.index[x] for x in text_features(block) if x in model.index]].sum(0))
    (s00, s01), (s10, s11) = model.steps.tolist()
    a0, a1 = (unary[0] + model.start).tolist()
    back = []
    for u0, u1 in map(np.ndarray.tolist, unary[1:]):
        from0, from1 = a0 + s00 >= a1 + s10, a0 + s01 >= a1 + s11
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a0, a1 = (a0 + s00 if from0 else a1 + s10) + u0, (a0 + s01 if from1 else a1 + s11) + u1
    label = 0 if a0 >= a1 else 1
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def extract(model: Model, html: str) -> str:
    """The main text of a page: its main blocks, joined by one space."""
    own = blocks(html)
    return " ".join(b.text for b, y in zip(own, decode(model, own), strict=True) if y)


def query(df: DataFrame, n_pages: int = N_PAGES) -> DataFrame:
    """Every page's main text."""
    model = train(labelled_pages(n_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "html"):
                texts = [extract(model, x) for x in c.column(part, "html").to_pylist()]
                yield c.named(SCHEMA, page_id=c.column(part, "page_id"), url=c.column(part, "url"), text=texts, n_chars=list(map(len, texts)))

    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
