"""Page boilerplate mixed with main content (problem 4): a tree-structured graphical model of a page.

Nodes are the DOM's elements and the visible lines; flat text is a chain of lines, the degenerate tree. Each node is story or
furniture. Node potentials are logistic in hashed features (words, shape, own tags; tag, class and role of elements), edge
potentials are parent-child tables; both are trained on a bounded sample of labelled pages. Sum-product passes upward and downward,
computed level by level for all pages of an Arrow batch at once, give the marginal of every line. Pages never meet: no shuffle
but the one that drops second deliveries.

Labels: no table holds any, so ``label_page`` labels the sample by what editors of such pages know (the headline equals the title;
paragraphs end in a full stop and link to no other story; fixed phrases of notices). The trained model, not these rules, decides every line,
and it is all there is for flat text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yelken.llm.plain import folded
from yelken.session import table

TRAIN_PAGES = 1_000  # labelled pages, and as many labelled plain texts, the model is fitted on, at most
BITS = 16

# Folded phrases that name furniture on Turkish news pages, and headings of boxes with other stories.
NOTICES = (
    "tum haklari saklidir", "izinsiz alinti", "kaynak gosterilmeden", "yayincilik a s", "yazilim ve tasarim", "basin meslek ilkelerine", "kose yazilarinin sorumlulugu",
    "cerez", "teknik kayitlara izin", "tanimlama bilgileri saklar", "is ortaklarimizla birlikte", "gizliliginiz bizim icin", "kez okundu", "kampanyasinda", "hemen siparis ver",
    "yoresinin sesi", "abone olmak icin", "mesaj atin", "bultenimize kaydolun", "sosyal medya hesaplarimizdan", "uygulamasini telefonunuza", "anketimize katildiniz", "yorumlarinizi bekliyoruz",
    "hukuki uyari", "yatirim tavsiyesi", "ihbar ve sikayetleriniz", "isminiz gizli kalir", "haberi begendiyseniz", "bunu da okuyun", "icin kaydirin", "tusuna basin", "icin tiklayin", "haber agi",
    "sponsorlu icerik", "ilan alani", "paylas facebook", "tweetle", "katkilariyla hazirlanmistir", "guncelleme tarihi", "ilgili haber", "bildiriyor",
)
BOX_TITLES = (
    "populer", "son eklenenler", "editorun sectikleri", "benzer haberler", "cok okunanlar", "gunun mansetleri", "ilginizi cekebilir", "yorumlar", "okur gorusleri", "siz ne dersiniz",
)
_BYLINE = re.compile(r"^(haber|yazan|editor|muhabir|kaynak|fotograf|foto|kare|derleyen|gorsel)\s*:")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<![^>]*>|\n|[^<\n]+|<", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*["']?([^"'>]+)""", re.I)
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}
_SILENT = {"script", "style", "noscript", "template"}
_CLOSES = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_WORD = re.compile(r"[a-z]+|\d+|[#@©|>]")
_VISIBLE = re.compile(r"[^\W_]")
_TIME = re.compile(r"^\s*\d{1,2}[:.]\d{2}\s+\S")


def page_lines(page: str) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, list[str], str]]]:
    """(elements: (parent, features)), (lines: (line_no, parent, features, text)) of a page or fragment. Element 0 is the root.
    A line hangs under the innermost element opened on an earlier line; elements opened on the line itself become its features."""
    elements: list[tuple[int, list[str]]] = [(-1, ["root"])]
    stack: list[tuple[str, int, int]] = [("", 0, 1)]  # tag, element, line it was opened on
    lines: dict[int, list] = {}
    no, silent = 1, None
    for m in _TOKEN.finditer(page):
        s = m[0]
        if s == "\n":
            no += 1
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                if silent == tag:
                    silent = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif silent is None:
                if tag in _SILENT:
                    silent = tag
                elif tag not in _VOID:
                    ends = _CLOSES.get(tag)
                    if ends:
                        while len(stack) > 1 and stack[-1][0] in ends:
                            stack.pop()
                    names = [f"{tag}"] + [f"{k.lower()[0]}={w}" for k, v in _ATTR.findall(m[3]) for w in v.lower().split()]
                    if tag == "a":
                        href = re.search(r"""href\s*=\s*["']?/?([^"'/>\s]*)""", m[3], re.I)
                        names.append("to=" + (href[1].lower() if href else ""))
                    elements.append((stack[-1][1], names))
                    stack.append((tag, len(elements) - 1, no))
            no += s.count("\n")
        elif s[0] == "<" and len(s) > 1:
            no += s.count("\n")
        elif silent is None and not s.isspace():
            text = html.unescape(s) if "&" in s else s
            if text.strip(" \t\r\xa0"):
                line = lines.get(no)
                if line is None:
                    parent = next(e for _, e, opened in reversed(stack) if opened < no or e == 0)
                    line = lines[no] = [parent, [], [], stack[-1][0]]
                    line[1] += ["i:" + n for _, e, opened in stack if opened == no and e for n in elements[e][1]]
                elif len(stack) > 1 and stack[-1][2] == no:
                    line[1] += ["m:" + n for n in elements[stack[-1][1]][1]]
                line[2].append(text)
    made = ((n, x[0], x[1], " ".join(x[2])) for n, x in sorted(lines.items()))
    return elements, [x for x in made if _VISIBLE.search(x[3])]


def flat_lines(text: str) -> list[tuple[int, int, list[str], str]]:
    """The lines of plain text that hold a letter or digit."""
    return [(i, 0, [], line) for i, line in enumerate(text.split("\n"), 1) if _VISIBLE.search(line)]


def words_of_line(text: str) -> tuple[list[str], str]:
    """(folded words with digits as 0, folded text)."""
    low = folded(text)
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(low)], low


def text_features(text: str) -> list[str]:
    words, low = words_of_line(text)
    n = len(words)
    out = list(words)
    if n <= 8:
        out += [f"{a}_{b}" for a, b in zip(words, words[1:])]
        out.append(f"n={n}")
    else:
        out.append(f"n={8 + min(n, 60) // 8}")
    tail = low.rstrip(" \t\r")
    while tail and not tail[-1].isalnum() and tail[-1] not in ".!?\"”'’…:|>)":
        tail = tail[:-1].rstrip()
    out.append("end=" + (tail[-1] if tail and not tail[-1].isalnum() else "w"))
    if words:
        out += ["1=" + words[0], "9=" + words[-1], "12=" + "_".join(words[:2])]
    if _TIME.match(low):
        out.append("time")
    if n and not any(w.isalpha() for w in words):
        out.append("wordless")
    return out


def story_like(text: str) -> bool:
    """A paragraph or quotation: whole sentences."""
    tail = text.rstrip()
    while tail and not tail[-1].isalnum() and tail[-1] not in ".!?\"”'…":
        tail = tail[:-1].rstrip()
    return bool(tail) and tail[-1] in ".!?\"”…" and len(tail.split()) >= 4


def label_page(page: str, title: str | None) -> list[bool]:
    """True for the story's lines of a page, in the order of ``page_lines``."""
    elements, lines = page_lines(page)
    key = lambda s: re.sub(r"[^a-z0-9]", "", folded(s))
    head = key(title or "")
    out = []
    for _, parent, own, text in lines:
        above, p = [], parent
        while p > 0:
            above += elements[p][1]
            p = elements[p][0]
        words = " ".join(words_of_line(text)[0]).replace("0", "").replace("  ", " ").strip()
        k, tags = key(text), {x[2:] for x in own}
        box = {"aside", "nav", "footer", "r=navigation", "figure", "figcaption", "button"} & ({*above} | tags) or any(x.startswith("to=haber") for x in tags)
        notice = any(x in words for x in NOTICES) or words in BOX_TITLES or _BYLINE.match(folded(text).strip()) or re.match(r"^(#|©)", text.strip())
        comment = "i:p" in own and any(x in own for x in ("m:b", "i:b"))
        if box or notice or comment or _TIME.match(text):
            out.append(False)
        elif k and (k == head or ("h1" in tags or "b" in tags or "h2" in tags) and head.startswith(k) and len(k) > 15):
            out.append(True)
        elif "h1" in tags or "h3" in tags and "box" not in above:
            out.append(True)
        elif tags & {"li", "ul", "small", "span", "center", "h4", "strong", "b"} or "center" in above or {"a"} == tags:
            out.append(False)
        else:
            out.append(story_like(text))
    return out


def label_text(text: str) -> list[bool]:
    """True for the story's lines of a plain text, in the order of ``flat_lines``: whole sentences that are no notice."""
    out = []
    for _, _, _, line in flat_lines(text):
        words, low = words_of_line(line)
        joined = " ".join(words).replace("0", "").replace("  ", " ").strip()
        out.append(story_like(line) and not any(x in joined for x in NOTICES) and not _BYLINE.match(low.strip()) and line.strip()[0] not in "#©")
    return out


class Hasher:
    """Index of a feature; the same in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, names: list[str]) -> list[int]:
        known, out = self.known, []
        for n in names:
            i = known.get(n)
            if i is None:
                if len(known) > 500_000:
                    known.clear()
                i = known[n] = zlib.crc32(n.encode()) & ((1 << BITS) - 1)
            out.append(i)
        return out


def _sums(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    ends = np.cumsum([len(r) for r in rows])
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    return total[ends] - total[ends - np.array([len(r) for r in rows])]


def fit_logistic(rows: list[list[int]], labels: np.ndarray, rounds: int = 80, rate: float = 0.7, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on hashed features, by full-batch Adagrad; index 0 of the result's tail is the bias."""
    w = np.zeros((1 << BITS) + 1)
    if not rows:
        return w
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    sizes = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), sizes)
    g2 = np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = np.bincount(at, w[flat], len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        g = np.append(np.bincount(flat, e[at], 1 << BITS), e.sum()) + decay * w / len(rows)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def _table(counts: np.ndarray) -> np.ndarray:
    """Log potentials psi[parent][child] from counts: association only, the nodes' own potentials hold the rest."""
    c = counts + 1.0
    return np.log(c * c.sum() / (c.sum(1, keepdims=True) * c.sum(0, keepdims=True)))


def marginals(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """P(story) of every node of a forest by sum-product; unary are log odds, parent -1 at roots, parents before children."""
    def pass_on(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log odds that a table t[:, from, to] makes of log odds x at the other end."""
        return np.logaddexp(x + t[:, 1, 1], t[:, 0, 1]) - np.logaddexp(x + t[:, 1, 0], t[:, 0, 0])

    up, down = np.zeros_like(unary), np.zeros_like(unary)
    gathered = unary.astype(float).copy()
    levels = [np.where(depth == d)[0] for d in range(int(depth.max(initial=0)) + 1)]
    for nodes in reversed(levels[1:]):
        up[nodes] = pass_on(gathered[nodes], tables[kind[nodes]].transpose(0, 2, 1))
        np.add.at(gathered, parent[nodes], up[nodes])
    belief = gathered.copy()
    for nodes in levels[1:]:
        down[nodes] = pass_on(belief[parent[nodes]] - up[nodes], tables[kind[nodes]])
        belief[nodes] = gathered[nodes] + down[nodes]
    return 1 / (1 + np.exp(-np.clip(belief, -60, 60)))


class BodyModel:
    """Trained potentials. Edge kinds: 0 element-element, 1 element-line, 2 line-line of flat text."""

    def __init__(self, line_w: np.ndarray, element_w: np.ndarray, flat_w: np.ndarray, tables: np.ndarray):
        self.line_w, self.element_w, self.flat_w, self.tables = (x.astype(np.float32) for x in (line_w, element_w, flat_w, tables))

    @classmethod
    def fit(cls, pages: list[tuple[str, str | None]], plain_texts: list[str] = ()) -> BodyModel:
        h = Hasher()
        lines, labels, elements, element_labels = [], [], [], []
        counts = np.zeros((3, 2, 2))
        for page, title in pages:
            nodes, found = page_lines(page)
            truth = label_page(page, title)
            share = np.zeros((len(nodes), 2))
            for (_, parent, own, text), y in zip(found, truth):
                p = parent
                while p >= 0:
                    share[p, int(y)] += 1
                    p = nodes[p][0]
                lines.append(h(text_features(text) + own))
                labels.append(y)
            state = (share[:, 1] >= np.maximum(share[:, 0], 1)).astype(int)
            for i, (p, names) in enumerate(nodes):
                if share[i].sum():
                    elements.append(h(names))
                    element_labels.append(state[i])
                    if p >= 0:
                        counts[0, state[p], state[i]] += 1
            for (_, parent, _, _), y in zip(found, truth):
                counts[1, state[parent], int(y)] += 1
        texts, text_labels = [], []
        for text in plain_texts:
            truth = label_text(text)
            texts += [h(text_features(f[3])) for f in flat_lines(text)]
            text_labels += truth
            for a, b in zip(truth, truth[1:]):
                counts[2, int(a), int(b)] += 1
        fitted = [fit_logistic(r, np.array(y, float)) for r, y in ((lines, labels), (elements, element_labels), (texts, text_labels))]
        return cls(*fitted, np.stack([_table(c) for c in counts]))

    def pages(self, pages: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """(line numbers, P(story)) of the visible lines of each page."""
        h, elements, lines, numbers = Hasher(), [], [], []
        parent, depth, kind, own, line_parent, at = [], [], [], [], [], []
        for page in pages:
            nodes, found = page_lines(page)
            base = len(parent)
            for p, names in nodes:
                parent.append(base + p if p >= 0 else -1)
                depth.append(depth[base + p] + 1 if p >= 0 else 0)
                elements.append(h(names))
            line_parent += [base + f[1] for f in found]
            lines += [h(text_features(f[3]) + f[2]) for f in found]
            numbers.append([f[0] for f in found])
        n = len(parent)
        lp = np.array(line_parent, np.int64)
        dp = np.array(depth, np.int64)
        unary = np.concatenate([_sums(elements, self.element_w) + self.element_w[-1] if n else np.zeros(0), _sums(lines, self.line_w) + (self.line_w[-1] if lines else 0)])
        out = marginals(unary, np.concatenate([np.array(parent, np.int64), lp]), np.concatenate([dp, dp[lp] + 1]), np.concatenate([np.zeros(n, int), np.ones(len(lp), int)]), self.tables)[n:]
        cuts = np.cumsum([len(x) for x in numbers])
        return list(zip(numbers, np.split(out, cuts[:-1]) if numbers else []))

    def texts(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """The same for plain texts, each a chain of lines."""
        h, lines, numbers, parent, depth = Hasher(), [], [], [], []
        for text in texts:
            found = flat_lines(text)
            base = len(parent)
            parent += [base + i - 1 if i else -1 for i in range(len(found))]
            depth += range(len(found))
            lines += [h(text_features(f[3])) for f in found]
            numbers.append([f[0] for f in found])
        unary = _sums(lines, self.flat_w) + (self.flat_w[-1] if lines else 0)
        out = marginals(unary, np.array(parent, np.int64), np.array(depth, np.int64), np.full(len(parent), 2), self.tables)
        cuts = np.cumsum([len(x) for x in numbers])
        return list(zip(numbers, np.split(out, cuts[:-1]) if numbers else []))


def train_body_model(pages: DataFrame | None, texts: DataFrame, most: int = TRAIN_PAGES) -> BodyModel:
    """Fit on at most ``most`` rows each of ``pages`` (raw_id, title, body_html) and ``texts`` (id, content): those whose key has the
    smallest hash. Without any rows of a kind, every line of that kind counts as story. ``pages`` None: a model for plain text only."""
    sample = lambda df, key, *cols: df.where(F.col(cols[0]).isNotNull()).select(*cols).orderBy(F.xxhash64(F.col(key).cast("string")), cols[0]).limit(most).collect()
    chosen = [] if pages is None else [(r[0], r[1]) for r in sample(pages, "raw_id", "body_html", "title")]
    return BodyModel.fit(chosen, [r[0] for r in sample(texts, "id", "content")])


def main_body(df: DataFrame, model: BodyModel, key: str, text: str, markup: bool) -> DataFrame:
    """(key STRING, lines ARRAY<STRUCT<line_no, p>>): the visible lines of each distinct key with the marginal of being story.
    ``markup``: pages or fragments of HTML, else plain text. NULL keys and texts give no row, a text without visible lines an
    empty array; of several deliveries of one key the smallest by content counts."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                found = (model.pages if markup else model.texts)(list(part["text"]))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "lines": [[{"line_no": n, "p": float(x)} for n, x in zip(*f)] for f in found]})

    made = rows.mapInPandas(run, "key string, lines array<struct<line_no: int, p: double>>")
    return made.groupBy("key").agg(F.min("lines").alias("lines"))


def furniture_lines(df: DataFrame, model: BodyModel, key: str, text: str, markup: bool, threshold: float = 0.5) -> DataFrame:
    """(key, line_no) of the visible lines that are not story."""
    out = F.transform(F.filter("lines", lambda x: x["p"] < F.lit(threshold)), lambda x: x["line_no"])
    return main_body(df, model, key, text, markup).select("key", F.explode(out).alias("line_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, line_no) of the furniture lines of raw_articles.body_html and news.content."""
    raw = table(spark, sf_dir, "raw_articles")
    news = table(spark, sf_dir, "news")
    model = train_body_model(raw, news)
    parts = [furniture_lines(raw, model, "raw_id", "body_html", True).select(F.lit("raw").alias("src"), F.col("key").alias("rec_id"), "line_no")]
    parts.append(furniture_lines(news, model, "id", "content", False).select(F.lit("news").alias("src"), F.col("key").alias("rec_id"), "line_no"))
    return parts[0].unionByName(parts[1])
