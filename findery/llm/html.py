"""Main text of a web page as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words of content contexts score above zero, tags and words
of furniture below; one linear scan finds the contiguous stretch with the largest sum. The scores
are learned from the pages that mark their content with an article element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from findery.llm.common import fold_texts, map_texts

# Names from the HTML standard, and words by which pages name their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split())
FURNITURE_TAGS = frozenset(
    "head title nav footer aside form button select option textarea input label fieldset menu dialog object canvas "
    "audio video map".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer disqus foot footer gdpr login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar "
    "widget widgets alert contentinfo complementary search".split())
#: Words that say what shape a part has, not what it holds.
SHAPES = frozenset(
    "area bar block box card column container group holder inner item items list outer panel row section slot unit wrap "
    "wrapper zone".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 p".split())
NEGATIONS = frozenset("has no with without".split())
RAW = "script|style|noscript|template|iframe|svg|math|noembed|noframes|xmp"

TOKEN = re.compile(
    # bounds on the attributes keep tags that never end from being read again and again
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]{{0,2048}}>.*?(?:</(?P=raw)\s*>|\Z)"""
    # a quoted value may hold < or >, not both
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^<>"']*(?:(?:"[^"<]*"|'[^'<]*'"""
    r"""|"[^"<>]*<[^">]{0,2048}"|'[^'<>]*<[^'>]{0,2048}')[^<>"']*){0,64}|[^<>]*)>"""
    r"""|<[!?/][^<>]*>""", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NOT_NAME = re.compile(r"[^a-z]+")

#: Scores of contexts no labelled page holds: words by their zone, tags all alike.
UNSEEN_WORD = {"article": 1.0, "alone": 0.5, "beside": -1.0, "furniture": -0.01}
UNSEEN_TAG = -0.05
#: A tag that never stands in content takes off so much.
TAG_COST = 2.0
#: Share of its score that furniture keeps, because its words are left out anyway.
FURNITURE_SHARE = 0.01


def _named_furniture(name: str, rest: str, in_article: bool, strict: bool) -> bool:
    """Whether class, id or role name a part that is not content; "no-sidebar" and its like do not.

    Ids of titles and paragraphs are anchors and name nothing, inside an article those of sections
    too. Inside an article, for the id of a section, and when ``strict``, all parts of a name must be
    furniture but for those that tell a shape ("ad-slot").
    """
    for m in NAMED.finditer(rest):
        value, is_id = (m[2] or m[3] or m[4] or "").lower(), m[1].lower() == "id"
        if is_id and (name in TITLES or in_article and name == "section"):
            continue
        if strict or in_article or is_id and name == "section":
            parts = [[x for x in NOT_NAME.split(token) if x and x not in SHAPES] for token in value.split()]
            if any(x and FURNITURE_NAMES.issuperset(x) for x in parts):
                return True
            continue
        before = ""
        for part in NOT_NAME.split(value):
            if part in FURNITURE_NAMES and before not in NEGATIONS:
                return True
            before = part
    return False


def _furniture(name: str, rest: str, in_article: bool, strict: bool) -> bool:
    if name in ("html", "body", "article", "main"):
        return False
    if name == "header":
        return not in_article
    return name in FURNITURE_TAGS or (bool(rest) and _named_furniture(name, rest, in_article, strict))


class Walk:
    """The tokens of a page: (key, number of words or -1 for a tag, text or tag, furniture)."""

    def __init__(self, html: str, trust_article: bool = True, strict: bool = False):
        self.html, self.trust, self.strict = html, trust_article, strict
        self.has_article = trust_article and re.search(r"<(?:article|main)\b", html, re.IGNORECASE) is not None

    def __iter__(self) -> Iterator[tuple[str, int, str, bool]]:
        stack: list[tuple[str, bool, bool, str]] = []  # name, furniture, in article, block
        open_names: Counter = Counter()
        at, text, size = 0, self.html, len(self.html)
        furniture, article, block = False, False, "none"
        for m in TOKEN.finditer(text):
            if m.start() > at:
                yield self._run(text[at: m.start()], furniture, article, block)
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["close"]:
                yield self._tag(name, furniture, article)
                if open_names[name]:
                    while True:
                        top = stack.pop()
                        open_names[top[0]] -= 1
                        if top[0] == name:
                            break
            elif name not in VOID and not m["rest"].endswith("/"):
                if name in BLOCKS and open_names["p"]:
                    # a block ends an open paragraph, and what is open inside it
                    inner = next((n for n, x in enumerate(reversed(stack), 1) if x[0] in BLOCKS), 0)
                    if inner and stack[-inner][0] == "p":
                        for _ in range(inner):
                            open_names[stack.pop()[0]] -= 1
                if name in ("li", "option") and stack and stack[-1][0] == name:
                    open_names[stack.pop()[0]] -= 1
                furniture, article, block = stack[-1][1:] if stack else (False, False, "none")
                inside = article or (self.trust and name in ("article", "main"))
                stack.append((name, furniture or _furniture(name, m["rest"], article, self.strict), inside,
                              name if name in BLOCKS else block))
                open_names[name] += 1
                yield self._tag(name, *stack[-1][1:3])
            else:
                yield self._tag(name, furniture, article)
            furniture, article, block = stack[-1][1:] if stack else (False, False, "none")
        if at < size:
            yield self._run(text[at:], furniture, article, block)

    def _zone(self, furniture: bool, article: bool) -> str:
        return "furniture" if furniture else "article" if article else "beside" if self.has_article else "alone"

    def _tag(self, name: str, furniture: bool, article: bool) -> tuple[str, int, str, bool]:
        return f"tag {self._zone(furniture, article)} {name}", -1, name, furniture

    def _run(self, text: str, furniture: bool, article: bool, block: str) -> tuple[str, int, str, bool]:
        return f"{self._zone(furniture, article)} {block}", len(text.split()), text, furniture


class _Counts:
    """Words and tags of a task's labelled pages by context, inside and outside of content.

    A page is walked as it is and once more without trust in its article element, which teaches
    the contexts of pages that have none.
    """

    def __init__(self):
        self.inside, self.outside = Counter(), Counter()

    def add(self, batch: pa.RecordBatch) -> None:
        for html in batch.column("html").to_pylist():
            true_walk = list(Walk(html))
            if not any(key.startswith("article ") for key, *_ in true_walk):
                continue
            for (key, words, text, _), (blind, *_) in zip(true_walk, Walk(html, False)):
                if text in ("article", "main") and words < 0:
                    continue
                side = self.inside if key.removeprefix("tag ").startswith("article ") else self.outside
                for seen in (key, blind):
                    side[seen] += abs(words)

    def rows(self) -> dict:
        keys = sorted(self.inside.keys() | self.outside.keys())
        return {"key": keys, "inside": [self.inside[k] for k in keys], "outside": [self.outside[k] for k in keys]}


COUNTED = StructType([StructField("key", StringType()), StructField("inside", LongType()),
                      StructField("outside", LongType())])


def fit(pages: DataFrame) -> dict[str, float]:
    """Score of each context, from all pages that mark their content.

    Contexts are zones times block tags, and zones times the tag names of the standard; other tags
    are left to the default, so the table stays small. What is marked as furniture never enters a
    text; its score is scaled down so that it does not part an article it stands in.
    """
    sums = fold_texts(pages.select("html"), _Counts, COUNTED).groupBy("key").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    names = BLOCKS | VOID | FURNITURE_TAGS | frozenset("a b i em strong span u small sup sub code".split())
    known = [f"tag {zone} {x}" for zone in UNSEEN_WORD for x in sorted(names)]
    wanted = sums.where(~F.col("key").startswith("tag ") | F.col("key").isin(known))
    return {r["key"]: _score(r["key"], r["inside"], r["outside"]) for r in wanted.collect()}


def _score(key: str, inside: int, outside: int) -> float:
    if key.startswith("tag "):
        score = -TAG_COST * (outside + 0.02) / (inside + outside + 1.0) - 0.01
    else:
        score = (inside - outside) / (inside + outside + 1.0)
    return score * FURNITURE_SHARE if "furniture " in key else score


def main_text(html: str, scores: dict[str, float]) -> str:
    """Text of the best stretch of one page, block by block; empty when no word scores.

    Where no article is marked and names make most of the words furniture, a wrapper only mentions it
    ("sidebar-right"): then names count that are furniture as a whole.
    """
    walk = Walk(html)
    tokens = list(walk)
    if not walk.has_article and 2 * sum(t[1] for t in tokens if t[3] and t[1] > 0) > sum(t[1] for t in tokens if t[1] > 0):
        tokens = list(Walk(html, strict=True))
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, (key, words, _, _) in enumerate(tokens):
        if words == 0:
            continue
        if total <= 0.0:
            total, start = 0.0, i
        if words < 0:
            total += scores.get(key, UNSEEN_TAG)
        else:
            total += words * scores.get(key, UNSEEN_WORD[key.split(" ", 1)[0]])
        if total > best:
            best, best_range = total, (start, i + 1)
    blocks, run = [], []
    for key, words, text, furniture in tokens[best_range[0]: best_range[1]]:
        if words < 0:
            if text in BLOCKS:
                blocks.append("".join(run))
                run = []
            elif text == "br":
                run.append(" ")
        elif not furniture:
            run.append(text)
    blocks.append("".join(run))
    lines = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from its whole html.

    Null or empty html, and pages without a word of content, give an empty text. Broken markup is
    read leniently: an element ends where its parent does. Repeated rows give equal rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    scores = fit(rows)

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            made = [main_text(t or "", scores) for t in texts]
            return {"text": made, "n_chars": [len(t) for t in made]}

        return work

    return map_texts(rows, "html", make, [StructField("text", StringType()), StructField("n_chars", LongType())])
