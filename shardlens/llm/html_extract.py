"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import bounded_sample, map_batches

# Fixed values of the markup language: elements that begin a block, that hold no page text, that have no end tag, and
# those that end an open element of the same group.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("script style template noscript head title textarea select svg math iframe object audio video canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article aside nav main header footer form body html blockquote td th menu".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in HIDDEN_TAGS}
TOKEN_SPLIT = re.compile(r"[^a-z]+")
# What joins a container's kind to a block in training pages; never a feature.
MARK = "label"


class Block(NamedTuple):
    """A leaf block: its text, the tags above it with the words of their class, id and role, and its share of link text."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: float


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in order: character references decoded, white space as single blanks."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    anchor, link_chars = 0, 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), min(1.0, link_chars / len(text))))
            parts.clear()
        link_chars = 0

    def put(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if anchor:
                link_chars += len(" ".join(text.split()))

    at = 0
    while True:
        m = MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            flush()
            return out
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:-3]))
            continue
        if m[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            elif tag in BLOCK_TAGS:
                # An end tag without its element is ignored, but that of a paragraph, which stands for an empty one.
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None or tag == "p":
                    flush()
                    anchor = 0
                if depth is not None:
                    del stack[depth:]
            continue
        if tag in HIDDEN_TAGS and not m[3].rstrip().endswith("/"):
            end = HIDDEN_END[tag].search(page, at)
            # A head without its end would swallow the page: its body ends it.
            if tag == "head":
                body = page.lower().find("<body", at)
                if end is None or 0 <= body < end.start():
                    at = body if body >= 0 else at
                    continue
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchor += 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        anchor = 0
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS:
                    break
        if tag not in VOID_TAGS:
            names = " ".join(a[1] or a[2] or a[3] or "" for a in (x.groups(default="") for x in ATTRIBUTE.finditer(m[3])))
            stack.append((tag, tuple(dict.fromkeys(t for t in TOKEN_SPLIT.split(names.lower()) if t)) if names else ()))


@dataclass(frozen=True)
class CrfParams:
    """``pages``: labelled pages at most used to train, ``longest``: characters of each that are read for that; ``dims``:
    weights (features are hashed to them)."""

    pages: int = 400
    longest: int = 200_000
    dims: int = 1 << 14
    rounds: int = 80
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 3


@lru_cache(maxsize=1 << 17)
def _slot(feature: str, dims: int) -> int:
    return zlib.crc32(feature.encode()) % dims


@lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple, dims: int) -> tuple[int, ...]:
    names = {"leaf " + path[-1][0]} if path else {"leaf"}
    for depth, (tag, tokens) in enumerate(path):
        if tag not in ("html", "body", "div", "section"):
            names.add("in " + tag)
        names |= {"named " + t for t in tokens if t != MARK and not t.startswith("mark")}
        if depth == len(path) - 1:
            names |= {"own " + t for t in tokens if not t.startswith("mark")}
    return tuple(sorted({_slot(n, dims) for n in names}))


HINT_WORDS = re.compile(
    r"©|copyright|cookie|privacy|subscribe|newsletter|sign ?up|log ?in|share|comment|reply|advert|sponsor|related|read more|terms|rights reserved", re.I
)


def _text_features(b: Block) -> list[str]:
    text, n = b.text, len(b.text)
    hint = HINT_WORDS.search(text) if n < 400 else None
    return [
        "bias",
        f"chars {n.bit_length()}",
        f"linked {int(b.linked * 4)}",
        f"ends {text[-1] in '.!?:;…。'}",
        f"stops {min(3, text.count('. '))}",
        f"commas {min(3, text.count(','))}",
        f"sign {text[0] in '©®•|»'}",
        f"hint {hint is not None and n < 160}",
    ]


def featurize(page: list[Block], dims: int) -> list[list[int]]:
    """Feature slots of each block: tags and names above it, its text, and its neighbours' length and links."""
    own = [_text_features(b) for b in page]
    rows = []
    for i, b in enumerate(page):
        names = list(own[i])
        names += [f"before {x}" for x in own[i - 1][1:3]] if i else ["first"]
        names += [f"after {x}" for x in own[i + 1][1:3]] if i + 1 < len(page) else ["last"]
        rows.append([*(_slot(n, dims) for n in names), *_path_slots(b.path, dims)])
    return rows


@dataclass
class Crf:
    """Weights of a linear-chain field with two states (0 other, 1 main text)."""

    emit: np.ndarray
    move: np.ndarray
    dims: int

    def decode(self, page: list[Block]) -> list[int]:
        """The best states, by Viterbi."""
        rows = featurize(page, self.dims)
        if not rows:
            return []
        score = [self.emit[r].sum(axis=0).tolist() for r in rows]
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0]
        back = []
        for s0, s1 in score[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
            back.append((from0, from1))
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return states[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.decode(found)) if y)


def train(pages: list[tuple[list[Block], list[int]]], params: CrfParams = CrfParams()) -> Crf:
    """Weights that maximise the labels' conditional likelihood (forward-backward over all pages at once, AdaGrad)."""
    pages = [p for p in pages if p[0]]
    emit, move = np.zeros((params.dims, 2)), np.zeros((2, 2))
    if not pages:
        return Crf(emit, move, params.dims)
    slots, starts, cells, gold = [], [], [], []
    longest = max(len(b) for b, _ in pages)
    mask = np.zeros((len(pages), longest), dtype=bool)
    labels = np.zeros((len(pages), longest), dtype=np.int64)
    for n, (found, ys) in enumerate(pages):
        mask[n, : len(found)] = True
        labels[n, : len(found)] = ys
        for row in featurize(found, params.dims):
            starts.append(len(slots))
            slots += row
    slots_, starts_ = np.array(slots), np.array(starts)
    sizes = np.diff(np.append(starts_, len(slots_)))
    truth = np.zeros((len(starts_), 2))
    truth[np.arange(len(starts_)), labels[mask]] = 1
    inner = mask[:, 1:]
    true_moves = np.zeros((2, 2))
    np.add.at(true_moves, (labels[:, :-1][inner], labels[:, 1:][inner]), 1)
    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for _ in range(params.rounds):
        score = np.zeros((len(pages), longest, 2))
        score[mask] = np.add.reduceat(emit[slots_], starts_, axis=0)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + move[None], axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        each = np.exp(forward + backward - whole[:, None, None])[mask]
        pairs = forward[:, :-1, :, None] + move[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        grad_m = true_moves - np.exp(pairs[inner]).sum(axis=0)
        spread = np.repeat(truth - each, sizes, axis=0)
        grad_e = np.stack([np.bincount(slots_, spread[:, y], params.dims) for y in (0, 1)], axis=1)
        grad_e, grad_m = grad_e - params.decay * len(starts_) * emit, grad_m - params.decay * len(starts_) * move
        seen_e += grad_e**2
        seen_m += grad_m**2
        emit += params.rate * grad_e / np.sqrt(seen_e)
        move += params.rate * grad_m / np.sqrt(seen_m)
    return Crf(emit, move, params.dims)


# Layouts around main text, and what stands beside it, in labelled training pages.  Names of classes as sites use them.
MAIN_SHELLS = (
    "<article>{}</article>",
    "<main>{}</main>",
    "<main><article class='post'>{}</article></main>",
    "<div class='content'>{}</div>",
    "<div id='main-content'><div class='article-body'>{}</div></div>",
    "<div class='entry-content'>{}</div>",
    "<div class='post-body'>{}</div>",
    "<section class='story text'>{}</section>",
    "<article><div class='body'>{}</div></article>",
    "<div>{}</div>",
    "<div><div>{}</div></div>",
)
OTHER_SHELLS = (
    "<nav><ul><li><a href='/'>{}</a></li><li><a href='/x'>{}</a></li><li><a href='/y'>{}</a></li></ul></nav>",
    "<div class='menu navigation'><a href='/'>{}</a> <a href='/x'>{}</a></div>",
    "<header><p>{}</p><a href='/'>{}</a></header>",
    "<div class='header banner'><p>{}</p></div>",
    "<footer><p>&copy; {}</p><ul><li><a href='/'>{}</a></li></ul></footer>",
    "<div id='footer'>&copy; {}</div>",
    "<aside class='sidebar'><h3>{}</h3><p>{}</p><ul><li><a href='/z'>{}</a></li></ul></aside>",
    "<aside>{}</aside>",
    "<div class='sidebar widget'><h3>{}</h3><p>{}</p></div>",
    "<div class='cookie-notice'><p>{}</p><button>{}</button></div>",
    "<div id='cookie-banner' role='dialog'>{}</div>",
    "<div class='notice consent'><p>{}</p></div>",
    "<div class='ad'>{}</div>",
    "<div class='ads advert advertisement'><p>{}</p></div>",
    "<div class='sponsored promo'><p>{}</p><a href='/buy'>{}</a></div>",
    "<form><label>{}</label><input><p>{}</p><button>{}</button></form>",
    "<form class='newsletter subscribe'><p>{}</p></form>",
    "<section class='comments' id='comments'><h2>{}</h2><div class='comment'><p>{}</p></div><div class='comment reply'><p>{}</p></div></section>",
    "<div class='comment-list'><ol><li class='comment'><p>{}</p></li><li><p>{}</p></li></ol></div>",
    "<div class='related recommended'><h3>{}</h3><ul><li><a href='/r'>{}</a></li><li><a href='/s'>{}</a></li></ul></div>",
    "<div class='share social'><a href='/t'>{}</a></div>",
    "<div class='breadcrumb breadcrumbs'><a href='/'>{}</a></div>",
    "<div class='popup modal'><p>{}</p></div>",
)


# How a block of main text may be marked up, by share; short ones are cut to a few words.
MAIN_FORMS = (
    ("<p>{}</p>", 0.6, False),
    ("<ul><li>{}</li></ul>", 0.07, True),
    ("<ul><li><p>{}</p></li></ul>", 0.02, False),
    ("<ol><li>{}</li></ol>", 0.05, True),
    ("<h2>{}</h2>", 0.07, True),
    ("<h3>{}</h3>", 0.03, True),
    ("<blockquote>{}</blockquote>", 0.04, False),
    ("<table><tr><td>{}</td></tr></table>", 0.04, True),
    ("<dl><dt>{}</dt></dl>", 0.01, True),
    ("<dl><dd>{}</dd></dl>", 0.01, False),
    ("<figure><figcaption>{}</figcaption></figure>", 0.02, True),
    ("<pre>{}</pre>", 0.02, False),
    ("<div>{}</div>", 0.02, False),
)
TITLE_FORMS = ("<h1>{}</h1>", "<header><h1>{}</h1></header>", "<header class='entry-header'><h1>{}</h1></header>")


def _own_label(b: Block) -> int:
    """In training pages: 1 inside the article and outside what readers and site add to it."""
    y = 0
    for tag, tokens in b.path:
        if tag in ("article", "main"):
            y = 1
        if tag in ("nav", "aside", "footer", "header", "form", "button") or "comment" in tokens or "comments" in tokens:
            y = 0
    return y


def labelled_pages(pages: list[str], seed: int) -> list[tuple[list[Block], list[int]]]:
    """Each page as it is, labelled by its own article element, and laid out anew with blocks of known kind.

    The new layouts put the page's main text in other shells and other pages' sentences around and inside them, so that
    the field learns kinds of blocks which this collection marks in one way or not at all.
    """
    rng = np.random.default_rng(seed)
    read = [(found, [_own_label(b) for b in found]) for found in map(blocks, pages)]
    read = [(found, ys) for found, ys in read if any(ys)]
    if not read:
        return []
    stock = [b.text for found, _ in read for b in found]
    out = list(read)
    for found, ys in read:
        out.append(_laid_out(found, ys, stock, rng))
    return out


def _filled(shell: str, stock: list[str], rng: np.random.Generator) -> str:
    texts = []
    for _ in range(shell.count("{}")):
        text = stock[int(rng.integers(len(stock)))]
        texts.append(html.escape(text[: int(rng.choice([20, 60, 200, 600]))]))
    return shell.format(*texts)


def _laid_out(found: list[Block], ys: list[int], stock: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    main = [b for b, y in zip(found, ys) if y]
    inner, shares = [], np.cumsum([share for _, share, _ in MAIN_FORMS])
    for n, b in enumerate(main):
        form, _, short = MAIN_FORMS[min(int(np.searchsorted(shares, rng.random())), len(MAIN_FORMS) - 1)]
        text = b.text
        if n == 0:
            form, short = TITLE_FORMS[int(rng.integers(len(TITLE_FORMS)))], False
        if short:
            text = text[: int(rng.choice([10, 25, 60]))].strip() or text
        inner.append(f"<div class='markyes'>{form.format(html.escape(text))}</div>")
        if rng.random() < 0.15:
            inner.append(f"<div class='markno'>{_filled(OTHER_SHELLS[int(rng.integers(len(OTHER_SHELLS)))], stock, rng)}</div>")
    around = [
        f"<div class='markno'>{_filled(OTHER_SHELLS[int(rng.integers(len(OTHER_SHELLS)))], stock, rng)}</div>"
        for _ in range(int(rng.integers(2, 7)))
    ]
    cut = int(rng.integers(0, len(around) + 1))
    shell = MAIN_SHELLS[int(rng.integers(len(MAIN_SHELLS)))]
    page = f"<html><body>{''.join(around[:cut])}{shell.format(''.join(inner))}{''.join(around[cut:])}</body></html>"
    made, labels = [], []
    for b in blocks(page):
        marks = [t for _, tokens in b.path for t in tokens if t.startswith("mark")]
        labels.append(int(bool(marks) and marks[-1] == "markyes"))
        # The markers' own elements are taken out of the path again.
        made.append(b._replace(path=tuple(p for p in b.path if not any(t.startswith("mark") for t in p[1]))))
    return made, labels


# Labelled pages for collections that mark no article themselves; ``fit`` lays each out anew many times.
OWN_PAGES = tuple(
    f"<html><body><nav><a href='/'>{site}</a> <a href='/all'>All stories</a></nav><article><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in text)}</article>"
    f"<aside><h3>Most read</h3><a href='/1'>{site} in numbers</a></aside><footer>&copy; {site}. All rights reserved.</footer></body></html>"
    for site, title, text in (
        (
            "Harbour Post",
            "Ferry returns after a long winter",
            (
                "The ferry between the two islands sailed again on Monday, four months after ice had closed the northern channel. About ninety people were on board, most of them with shopping to do.",
                "Its captain said that the engine had been rebuilt over the winter, and that the crossing now takes eleven minutes less. \"Nobody will miss the noise,\" a passenger added.",
                "A ticket costs the same as last year; bicycles travel free until the end of May.",
            ),
        ),
        (
            "Kitchen Notes",
            "Bread with little work",
            (
                "Mix flour, water, salt and a pinch of yeast in the evening, and leave the bowl covered until the morning.",
                "Fold the dough twice, let it rest for an hour, and bake it in a closed pot. The crust gets dark if the lid comes off after thirty minutes.",
                "Those who like it sour wait a day longer, since time does what kneading would do.",
            ),
        ),
        (
            "Field Station",
            "What the frogs tell",
            (
                "For nine years we have counted frogs at the same forty ponds, always in the second week of April and always at night.",
                "Where the hedges were kept, numbers held; where they were cleared, two ponds of three fell silent. Rain explains a part of this, but not the most of it.",
                "We shall go on counting, and will put the tables where everyone can read them.",
                "Volunteers need boots, a lamp and some patience.",
            ),
        ),
        (
            "Stadtblatt",
            "Neue Brücke wird im Herbst fertig",
            (
                "Die Brücke über den Kanal soll im Oktober für den Verkehr geöffnet werden, teilte die Verwaltung am Dienstag mit. Bis dahin fahren die Busse weiter über den Ring.",
                "Teurer als geplant wird der Bau nicht, weil die Pfeiler der alten Brücke noch tragen.",
                "Radfahrer bekommen eine eigene Spur, die zum ersten Mal bis zum Bahnhof führt.",
            ),
        ),
        (
            "Le Relais",
            "Un marché plus tôt le matin",
            (
                "Le marché de la place ouvrira désormais à six heures, une heure plus tôt qu'avant. Les maraîchers le demandaient depuis longtemps.",
                "Pour les habitants, peu de choses changent : les étals restent en place jusqu'à midi, et le stationnement demeure gratuit.",
            ),
        ),
        (
            "El Faro",
            "La biblioteca abre los domingos",
            (
                "Desde este mes la biblioteca abre también los domingos por la tarde, con dos salas de lectura y una para niños.",
                "La directora cuenta que la idea vino de los propios lectores, que llenaron una libreta con firmas. Ahora faltan voluntarios para la sala pequeña.",
            ),
        ),
    )
)
LAYOUTS = 20


def fit(pages: DataFrame, params: CrfParams = CrfParams()) -> Crf:
    """Trains on a bounded sample (``params.pages`` pages) of those with an article element, each up to ``longest`` characters.

    A collection without any is extracted by what ``OWN_PAGES`` teach.
    """
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select(F.substring("html", 1, params.longest).alias("html"))
    sample = sorted(r.html for r in bounded_sample(marked, params.pages)) or list(OWN_PAGES) * LAYOUTS
    np.random.default_rng(params.seed).shuffle(sample)
    return train(labelled_pages(sample[: params.pages], params.seed), params)


def extract_main_text(pages: DataFrame, model: Crf) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points of the text).

    A null or empty page, and one without main text, gives an empty text.  Pages are read whole and stay where they
    are; repeated pages are extracted each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType(
        [T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()),
         T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return map_batches(pages.select("page_id", "url", "html"), run, schema)
