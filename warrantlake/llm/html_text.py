"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into blocks at block-level tags. A block has its words, the share of them inside links ("link
density"), the same of its neighbours, and where it lies: in an article, elsewhere though the page has one, in
something marked as no part of the text, or in a heading. Neighbours are summed over the surrounding container, so
that short paragraphs, items of lists and captions are judged by the run of text that they belong to; where the
container has no other block on that side, the nearest block of the page counts. A decision tree, grown by Gini
impurity on the small labelled table below, keeps or drops each block.

Some elements and roles mark what is in them for good. Class names, forms and hidden elements mark it weakly: such a
mark is void on whatever holds the page's main article, the article or main element of the most unlinked words,
where unmarked ones count threefold. On a page of which nothing would be kept, it is void on what holds the
weakly marked element of the most unlinked words, unless its name is a whole word such as "comments". A short block
outside of articles that begins with a copyright notice, or holds "all rights reserved", is marked too.

Nulls: a null or empty html has the empty text. Unclosed and misnested tags are closed as far as they must be; a tag
that the page's end cuts off is dropped. A link lasts until its end, the next link, or the end of the block that it
began in. Character references are decoded once. Pages of equal id or html are rows of their own, an empty table
gives no rows, and columns of the table other than ``html`` are passed on or left as the caller selects. Parsing takes
time in proportion to the page, however long or broken it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "text string, n_chars long"
# Fixed values of HTML: elements that part text into blocks, that hold no text, and that have no content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html iframe label legend li main menu nav noframes noscript object ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = ("script", "style", "textarea", "template", "noscript", "iframe", "svg", "math", "object", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the second kind closes.
CLOSED_BY = {"p": BLOCKS - {"button", "label", "caption", "legend", "summary"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: What isn't main text, by element, role, and words of a class or id; elements and names that mark weakly.
OUTER = frozenset("nav aside footer dialog button select menu head title label search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar note".split())
WEAK = frozenset(["form", "fieldset"])
#: With one of these, a class name tells a state of the page, not what is in the element.
STATES = frozenset("has have with without no not is enabled disabled open closed on off".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall "
    "sidebar aside rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer topbar masthead comment comments commentlist reply replies respond discussion disqus related recommended share sharing social "
    "pagination pager login signin signup register search toolbar skip hidden feedback legal copyright disclaimer".split()
)
#: Of these, words that mark weakly even when they are a whole name, as they are said of pages' text as well.
VAGUE = frozenset("skip rail register search notice notices alert promo promotion widget widgets overlay modal legal feedback share social hidden".split())
INNER = frozenset(["article", "main"])
#: Elements that hold runs of blocks.
GROUPS = frozenset("div section article main td body form center details".split())
#: Notices of rights, in blocks of at most so many words.
_RIGHTS, RIGHTS_WORDS = re.compile(r"\s*(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))|.*\ball rights reserved\b", re.I | re.S), 40
#: Unlinked words from which on a weakly marked element may be the text of a page without any other.
LEAST_PLAIN = 25

#: The labelled table: words, link density, words and density before, words and density behind, unlinked words of the
#: container, their share of the fullest container's, in an article, elsewhere, marked as no text, heading; and whether such a block is main text.
LABELLED = """
1 1.0 0 0.0 1 1.0 0 0.3 0 1 1 0 0
2 1.0 1 1.0 2 1.0 0 0.3 0 1 1 0 0
12 0.9 9 1.0 14 0.8 4 0.3 0 1 0 0 0
12 0.0 1 1.0 9 0.0 21 0.3 0 1 1 0 0
45 0.0 2 1.0 60 0.0 105 0.3 0 1 1 0 0
30 0.0 3 1.0 30 0.0 60 0.3 0 0 1 0 0
150 0.0 90 0.0 120 0.0 360 0.3 0 0 1 0 0
150 0.0 90 0.0 120 0.0 360 0.3 1 0 1 0 0
14 0.0 80 0.0 9 0.0 103 0.3 1 0 1 0 0
3 0.0 120 0.0 0 0.0 123 0.3 1 0 1 0 0
6 0.0 20 0.0 30 0.0 56 0.3 1 0 1 1 0
25 0.2 80 0.0 10 0.5 105 0.3 0 1 1 0 0
5 0.0 100 0.0 0 0.0 105 0.3 0 1 1 0 0
5 0.0 100 0.0 0 0.0 105 0.3 0 1 0 0 0
8 0.3 60 0.0 2 1.0 66 0.3 0 1 0 0 0
60 0.0 5 1.0 8 0.0 68 0.3 0 1 0 0 0
35 0.0 2 1.0 8 0.0 43 0.3 0 1 0 0 0
5 0.0 2 1.0 40 0.0 45 0.3 0 1 0 1 0
7 0.0 30 0.0 80 0.0 117 1 1 0 0 1 1
1 0.0 12 0.0 40 0.0 53 1 1 0 0 1 1
9 0.0 1 1.0 5 0.0 14 1 1 0 0 1 1
4 1.0 3 0.0 70 0.0 73 1 1 0 0 1 1
80 0.0 7 0.0 90 0.0 177 1 1 0 0 0 1
200 0.0 7 0.0 3 0.0 210 1 1 0 0 0 1
2 0.0 90 0.0 70 0.0 162 1 1 0 0 0 1
1 0.0 90 0.0 5 0.0 96 1 1 0 0 0 1
1 0.0 1 0.0 1 0.0 3 1 1 0 0 0 1
4 0.0 4 0.0 0 0.0 8 1 1 0 0 0 1
12 0.0 30 0.0 2 1.0 42 1 1 0 0 0 1
40 0.3 70 0.1 60 0.0 151 1 1 0 0 0 1
25 0.5 70 0.0 60 0.0 142 1 1 0 0 0 1
14 0.6 50 0.0 60 0.0 116 1 1 0 0 0 1
20 1.0 60 0.0 70 0.0 130 1 1 0 0 0 1
11 1.0 60 0.0 70 0.0 130 1 1 0 0 0 1
10 0.0 5 1.0 20 0.0 30 1 1 0 0 0 1
4 0.0 2 1.0 60 0.0 64 1 1 0 0 0 1
30 0.0 2 1.0 0 0.0 30 1 1 0 0 0 1
60 0.0 2 1.0 80 0.0 140 0.3 0 0 1 0 0
60 0.0 2 1.0 80 0.0 140 0.3 0 1 0 0 0
3 0.0 0 0.0 0 0.0 3 1 1 0 0 0 1
300 0.0 0 0.0 0 0.0 300 1 1 0 0 0 1
15 0.0 0 0.0 12 0.0 27 1 1 0 0 0 1
25 0.0 2 0.0 0 0.0 27 1 1 0 0 0 1
50 0.0 25 0.0 14 0.0 89 1 1 0 0 0 1
5 0.0 22 0.0 30 0.0 57 1 1 0 0 0 1
18 0.0 4 0.0 21 0.0 43 1 1 0 0 0 1
33 0.0 18 0.0 5 0.0 56 1 1 0 0 0 1
7 0.0 7 0.0 7 0.0 21 1 1 0 0 0 1
110 0.0 300 0.0 1 0.0 411 1 1 0 0 0 1
60 0.1 20 0.0 0 0.0 74 1 1 0 0 0 1
9 0.2 15 0.0 33 0.0 55 1 1 0 0 0 1
6 0.0 40 0.0 0 0.0 46 1 1 0 0 0 1
2 0.0 9 0.0 45 0.0 56 1 1 0 0 1 1
3 0.0 40 0.0 5 1.0 43 1 1 0 0 0 1
8 0.0 20 0.0 2 1.0 28 1 1 0 0 0 1
5 0.0 0 0.0 3 1.0 5 1 1 0 0 1 1
1 0.0 10 0.0 1 1.0 11 1 1 0 0 0 1
30 0.1 60 0.0 4 1.0 87 1 1 0 0 0 1
6 0.3 12 0.5 6 0.5 13 1 1 0 0 0 1
4 0.0 4 1.0 4 1.0 4 1 1 0 0 0 1
2 0.0 5 1.0 0 0.0 2 1 1 0 0 0 1
7 0.0 3 0.0 40 1.0 10 1 1 0 0 0 1
40 0.0 60 0.0 5 1.0 100 0.3 0 1 0 0 0
12 0.0 5 0.0 9 1.0 17 0.3 0 1 0 0 0
100 0.0 50 0.0 5 1.0 150 0.3 0 1 0 0 0
25 0.0 3 1.0 2 0.5 26 0.3 0 1 0 0 0
2 1.0 1 1.0 90 0.0 90 0.3 0 0 1 0 0
12 1.0 9 1.0 90 0.0 90 0.3 0 0 1 0 0
3 1.0 2 1.0 150 0.0 150 1 1 0 0 0 0
2 1.0 2 1.0 3 1.0 0 1 1 0 0 0 0
1 1.0 80 0.0 1 1.0 80 1 1 0 0 0 0
3 1.0 2 1.0 0 0.0 0 1 1 0 0 0 0
1 1.0 1 1.0 60 0.0 60 1 1 0 0 0 0
60 0.0 3 1.0 3 0.0 63 1 0 0 0 0 1
80 0.0 4 1.0 20 0.0 100 1 0 0 0 0 1
90 0.0 8 0.0 80 0.0 178 1 0 0 0 0 1
45 0.1 5 1.0 60 0.0 105 1 0 0 0 0 1
30 0.0 60 0.0 20 0.0 110 1 0 0 0 0 1
25 0.3 60 0.0 50 0.0 130 1 0 0 0 0 1
22 0.0 25 0.0 3 1.0 47 1 0 0 0 0 1
18 0.0 30 0.0 40 0.1 84 1 0 0 0 0 1
60 0.0 40 0.0 5 1.0 60 1 0 0 0 0 1
30 0.0 20 0.0 3 1.0 50 1 0 0 0 0 1
40 0.0 0 0.0 0 0.0 40 1 0 0 0 0 1
300 0.0 2 1.0 3 1.0 300 1 0 0 0 0 1
5 0.0 25 0.0 30 0.0 60 1 0 0 0 0 1
5 0.0 55 0.0 0 0.0 60 1 0 0 0 0 1
5 0.0 0 0.0 55 0.0 60 1 0 0 0 0 1
5 0.0 55 0.0 4 1.0 60 1 0 0 0 0 1
5 0.0 3 1.0 55 0.0 60 1 0 0 0 0 1
10 0.0 60 0.0 50 0.0 120 1 0 0 0 0 1
10 0.0 110 0.0 2 1.0 120 1 0 0 0 0 1
10 0.0 2 1.0 110 0.0 120 1 0 0 0 0 1
10 0.0 110 0.0 0 0.0 120 1 0 0 0 0 1
15 0.0 165 0.0 0 0.0 180 1 0 0 0 0 1
15 0.0 2 1.0 165 0.0 180 1 0 0 0 0 1
3 0.0 20 0.0 25 0.0 48 1 0 0 0 0 1
1 0.0 30 0.0 25 0.0 56 1 0 0 0 0 1
1 0.0 12 0.0 12 0.0 25 1 0 0 0 0 1
2 0.0 21 0.0 20 0.0 43 1 0 0 0 0 1
12 0.0 21 0.0 0 0.0 33 1 0 0 0 0 1
8 0.0 45 0.0 2 1.0 53 1 0 0 0 0 1
8 0.0 45 0.0 30 0.0 83 1 0 0 0 0 1
2 0.0 38 0.0 0 0.0 40 1 0 0 0 0 1
11 1.0 60 0.0 70 0.0 130 1 0 0 0 0 1
6 0.4 40 0.0 40 0.0 84 1 0 0 0 0 1
7 0.0 0 0.0 0 0.0 7 1 0 0 0 0 1
3 0.0 0 0.0 0 0.0 3 1 0 0 0 0 1
1 0.0 0 0.0 0 0.0 1 1 0 0 0 0 1
6 0.0 0 0.0 7 0.0 13 1 0 0 0 0 1
7 0.0 6 0.0 0 0.0 13 1 0 0 0 0 1
3 0.0 4 0.0 4 0.0 11 1 0 0 0 0 1
3 0.0 0 0.0 21 0.0 24 1 0 0 0 1 1
4 0.0 0 0.0 60 0.0 64 1 0 0 0 1 1
6 0.0 2 1.0 70 0.0 76 1 0 0 0 1 1
5 0.0 2 1.0 40 0.0 45 1 0 0 0 1 1
4 0.0 60 0.0 45 0.0 109 1 0 0 0 1 1
3 0.0 0 0.0 60 0.0 3 0.05 0 0 0 1 1
6 0.0 2 1.0 70 0.0 6 0.05 0 0 0 1 1
4 0.0 0 0.0 9 0.0 13 1 0 0 0 1 1
2 0.0 4 0.0 5 0.0 11 1 0 0 0 1 1
1 1.0 1 1.0 1 1.0 0 0 0 0 0 0 0
2 1.0 2 1.0 1 1.0 0 0 0 0 0 0 0
4 1.0 3 1.0 5 1.0 0 0 0 0 0 0 0
9 1.0 8 1.0 9 1.0 0 0 0 0 0 0 0
3 0.7 2 1.0 2 1.0 1 0 0 0 0 0 0
2 1.0 2 1.0 80 0.0 0 0 0 0 0 0 0
2 1.0 2 1.0 80 0.0 80 1 0 0 0 0 0
1 1.0 0 0.0 120 0.0 0 0 0 0 0 0 0
1 1.0 0 0.0 120 0.0 120 1 0 0 0 0 0
4 1.0 3 1.0 200 0.0 0 0 0 0 0 0 0
4 1.0 200 0.0 0 0.0 200 1 0 0 0 0 0
8 0.8 2 1.0 90 0.0 2 0 0 0 0 0 0
20 0.8 40 0.0 30 0.0 74 1 0 0 0 0 0
40 0.7 30 0.9 30 0.9 18 0 0 0 0 0 0
12 1.0 0 0.0 0 0.0 0 0 0 0 0 0 0
3 1.0 0 0.0 0 0.0 0 0 0 0 0 0 0
6 0.0 60 0.0 0 0.0 6 0.05 0 0 0 0 0
12 0.0 200 0.0 0 0.0 12 0.06 0 0 0 0 0
8 0.0 30 0.0 0 0.0 8 0.05 0 0 0 0 0
7 0.0 40 0.0 2 1.0 7 0.05 0 0 0 0 0
6 0.0 60 0.0 4 1.0 6 0.05 0 0 0 0 0
3 0.0 2 1.0 2 1.0 3 0.1 0 0 0 0 0
4 0.0 3 1.0 5 0.0 4 0.1 0 0 0 0 0
2 0.0 0 0.0 60 0.0 2 0.05 0 0 0 0 0
5 0.0 0 0.0 40 0.0 5 0.05 0 0 0 0 0
8 0.0 3 1.0 60 0.0 8 0.05 0 0 0 0 0
3 0.0 2 1.0 2 1.0 3 0.1 0 0 0 1 0
5 0.0 60 0.0 3 1.0 5 0.05 0 0 0 1 0
60 0.0 300 0.0 360 0.0 720 1 0 0 0 0 1
60 0.0 660 0.0 2 1.0 720 1 0 0 0 0 1
60 0.0 3 1.0 660 0.0 720 1 0 0 0 0 1
50 0.0 250 0.0 0 0.0 300 1 0 0 0 0 1
50 0.0 0 0.0 250 0.0 300 1 0 0 0 0 1
50 0.0 100 0.0 150 0.0 300 1 0 0 0 0 1
150 0.0 600 0.0 600 0.0 1350 1 0 0 0 0 1
400 0.0 900 0.0 900 0.0 2200 1 0 0 0 0 1
5 0.0 600 0.0 600 0.0 1205 1 0 0 0 0 1
3 0.0 0 0.0 720 0.0 723 1 0 0 0 1 1
3 0.0 2 1.0 720 0.0 723 1 0 0 0 1 1
3 0.0 2 1.0 720 0.0 3 0.05 0 0 0 1 1
3 0.0 360 0.0 360 0.0 723 1 0 0 0 1 1
1 0.0 0 0.0 4 0.0 5 0.03 0 0 0 0 0
4 0.0 1 0.0 0 0.0 5 0.03 0 0 0 0 0
2 0.0 3 0.0 5 0.0 10 0.05 0 0 0 0 0
6 0.0 8 0.0 0 0.0 14 0.08 0 0 0 0 0
3 0.0 0 0.0 0 0.0 3 0.02 0 0 0 0 0
1 0.0 5 0.0 6 0.0 12 1 0 0 0 0 1
1 0.0 0 0.0 11 0.0 12 1 0 0 0 0 1
1 0.0 11 0.0 0 0.0 12 1 0 0 0 0 1
1 0.0 11 0.0 2 1.0 12 1 0 0 0 0 1
1 0.0 2 1.0 11 0.0 12 1 0 0 0 0 1
30 0.0 20 0.0 40 0.0 90 0.4 0 0 0 0 1
60 0.0 0 0.0 10 0.0 70 0.3 0 0 0 0 1
20 0.0 30 0.0 30 0.0 80 0.5 0 0 0 0 1
3 0.0 0 0.0 12 0.0 1 0.08 0 0 0 1 1
3 0.0 0 0.0 1 0.0 3 0.25 0 0 0 1 1
6 0.0 180 0.0 0 0.0 180 1 0 0 1 0 0
6 0.0 30 0.0 180 0.0 210 1 0 0 1 0 0
7 0.0 0 0.0 0 0.0 0 0 0 0 1 0 0
100 0.0 0 0.0 0 0.0 0 0 0 0 1 0 0
6 0.0 20 0.0 0 0.0 0 0 0 0 1 0 0
5 0.0 60 0.0 2 1.0 60 1 0 0 1 0 0
300 0.0 0 0.0 0 0.0 0 0 0 0 1 0 0
50 0.0 300 0.0 300 0.0 600 1 0 0 1 0 0
3 0.0 7 0.0 0 0.0 7 1 0 0 1 0 0
5 0.0 60 0.0 60 0.0 120 1 0 0 1 1 0
3 0.0 0 0.0 60 0.0 0 0 0 0 1 1 0
3 0.0 2 1.0 1 0.0 3 0.25 0 0 0 1 1
3 0.0 2 1.0 3 0.0 3 0.08 0 0 0 1 1
3 0.0 2 1.0 5 0.0 3 0.05 0 0 0 1 1
3 0.0 2 1.0 10 0.0 3 0.025 0 0 0 1 1
5 0.0 2 1.0 15 0.0 5 0.02 0 0 0 1 1
"""


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None

    def keeps(self, x: list[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.below if x[node.feature] <= node.cut else node.above
        return node.share >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14) -> Node:
    """A tree of least Gini impurity; of equal cuts, that of the last feature and the smallest value."""
    node = Node(float(y.mean()))
    best = len(y) * 2 * node.share * (1 - node.share) - 1e-9
    if depth == 0:
        return node
    for feature in reversed(range(x.shape[1])):
        values = np.unique(x[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            left = y[x[:, feature] <= cut]
            right = y[x[:, feature] > cut]
            impurity = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (left, right))
            if impurity < best:
                best, node.feature, node.cut = impurity, feature, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.below, node.above = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@lru_cache(maxsize=1)
def tree() -> Node:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


#: What begins with a "<": a comment, a declaration, or a tag; else it is text.
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>])", re.I)
NONE, MAYBE, NAMED, SURE = 0, 1, 2, 3


def _name_mark(value: str, inside: bool) -> int:
    """What a class or id says: nothing, something by a part of a name, or by a whole name."""
    best = NONE
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not STATES.isdisjoint(words):
            continue
        if not NAMES.isdisjoint(words) or "header" in words and not inside:
            best = max(best, NAMED if len(words) == 1 and VAGUE.isdisjoint(words) else MAYBE)
    return best


def _mark(name: str, tag: str, inside: bool) -> tuple[int, bool]:
    """How surely an opening tag says that what follows is no main text, and whether it says that it is."""
    if name in OUTER or name == "header" and not inside:
        return SURE, False
    best, main = MAYBE if name in WEAK else NONE, name in INNER
    for attribute, *values in _ATTRIBUTE.findall(tag[len(name) + 1 :]):
        attribute, value = attribute.lower(), html.unescape("".join(values)).lower()
        if attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            best = max(best, NAMED)
        elif attribute == "role":
            main = main or value == "main"
            best = max(best, SURE if value in ROLES else MAYBE if value == "form" else NONE)
        elif attribute in ("class", "id") and name not in ("html", "body"):
            best = max(best, _name_mark(value, inside))
    return best, main


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    heading: bool
    group: int
    marked: bool = False

    @property
    def plain(self) -> int:
        """Words outside links, where those prevail."""
        return self.words - self.linked if 2 * self.linked < self.words else 0


@dataclass
class Element:
    """An element that is marked or holds main text, and the blocks [first, last) in it."""

    mark: int
    main: bool
    first: int
    last: int = 0

    def holds(self, other: Element) -> bool:
        return self.first <= other.first and other.last <= self.last


@dataclass
class Group:
    """An element that holds runs of blocks: its parent, and the blocks [first, last) in it."""

    name: str
    parent: int
    first: int
    last: int = 0


class Page:
    """Blocks with a word, in page order, and the elements that bear on them."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self._parts: list[tuple[str, bool]] = []
        self.groups = [Group("body", 0, 0)]
        self._stack: list[tuple[str, bool, bool, Element | None, int]] = []  # name, inside, heading, element, group
        self._open: Counter = Counter()
        self._link = -1  # depth of the block that an open link began in
        self._read(page)
        while self._stack:
            self._leave()
        self.groups[0].last = len(self.blocks)
        self._gather()

    def _gather(self) -> None:
        """Gives each block its container: what wraps one block, or is a section of something, counts as what is around it."""
        whole: list[int] = []
        for at, g in enumerate(self.groups):
            around = whole[g.parent] if at else 0
            part = g.last - g.first == 1 or g.name == "section" and self.groups[around].name != "body"
            whole.append(around if at and (part or g.name == "body") else at)
        for block in self.blocks:
            block.group = whole[block.group]

    def _flush(self) -> None:
        text = " ".join("".join(t for t, _ in self._parts).split())
        if text:
            _, inside, heading, _, group = self._stack[-1] if self._stack else ("", False, False, None, 0)
            linked = sum(len(t.split()) for t, in_link in self._parts if in_link)
            words = len(text.split())
            self.blocks.append(Block(text, words, min(linked, words), inside, heading, group))
        self._parts.clear()

    def _enter(self, name: str, tag: str) -> None:
        _, inside, heading, _, group = self._stack[-1] if self._stack else ("", False, False, None, 0)
        mark, main = _mark(name, tag, inside or name in INNER)
        element = Element(mark, main, len(self.blocks)) if mark or main else None
        if element:
            self.elements.append(element)
        if name in GROUPS:
            self.groups.append(Group(name, group, len(self.blocks)))
            group = len(self.groups) - 1
        self._stack.append((name, inside or main, heading or name in ("h1", "h2", "h3", "h4", "h5", "h6"), element, group))
        self._open[name] += 1

    def _leave(self) -> str:
        name, _, _, element, group = self._stack.pop()
        self._open[name] -= 1
        if name in GROUPS:
            self.groups[group].last = len(self.blocks)
        if element:
            element.last = len(self.blocks)
        if self._link > len(self._stack):
            self._link = -1
        return name

    def _text(self, piece: str) -> None:
        if piece:
            self._parts.append((html.unescape(piece), self._link >= 0))

    def _read(self, page: str) -> None:
        part, at, end = _PART, 0, len(page)
        while at < end:
            begin = page.find("<", at)
            found = part.match(page, begin) if begin >= 0 else None
            if begin >= 0 and not found and _NAME.match(page, begin):
                # A quote that nothing closes: from here on tags end at the next ">".
                part = _UNQUOTED
                found = part.match(page, begin)
            if not found:
                stop = end if begin < 0 else begin + 1
                self._text(page[at:stop])
                at = stop
                continue
            self._text(page[at:begin])
            tag, at = found.group(), found.end()
            if tag[1] in "!?" or tag[-1] != ">":
                continue
            name = _NAME.match(tag)[1].lower()
            if tag[1] == "/":
                self._end(name)
            elif name in RAW and not tag.endswith("/>"):
                closing = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = (page.find(">", closing.end()) + 1 if closing else 0) or end
                if name in BLOCKS:
                    self._flush()
            else:
                self._begin(name, tag)
        self._flush()

    def _begin(self, name: str, tag: str) -> None:
        if name == "a":
            self._link = len(self._stack)
        elif name == "br":
            self._text(" ")
        elif name in BLOCKS:
            self._flush()
            while self._stack and name in CLOSED_BY.get(self._stack[-1][0], ()):
                self._leave()
            if name not in VOID:
                self._enter(name, tag)

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = -1
        elif name in BLOCKS:
            self._flush()
            while self._open[name] and self._leave() != name:
                pass

    def _cover(self, least: int, void: Element | None) -> list[bool]:
        """Which blocks lie in an element of that mark or a surer one; weak marks on what holds ``void`` don't count."""
        change = [0] * (len(self.blocks) + 1)
        for e in self.elements:
            if e.mark >= least and (e.mark == SURE or void is None or not e.holds(void)):
                change[e.first] += 1
                change[e.last] -= 1
        return [n > 0 for n in accumulate(change[:-1])]

    def mark(self, void: Element | None) -> None:
        for block, marked in zip(self.blocks, self._cover(MAYBE, void), strict=True):
            block.marked = marked or not block.inside and block.words <= RIGHTS_WORDS and bool(_RIGHTS.match(block.text))

    def _plain(self, least: int) -> Callable[[Element], int]:
        """Unlinked words of an element that lie in no mark as sure as ``least``."""
        sums = [0, *accumulate(0 if covered else b.plain for b, covered in zip(self.blocks, self._cover(least, None), strict=True))]
        return lambda e: sums[e.last] - sums[e.first]

    def article(self) -> Element | None:
        """The main article, and what in it is one that holds most of it."""
        inner = [e for e in self.elements if e.main]
        plain, free = self._plain(SURE), self._plain(MAYBE)
        best = max(inner, key=lambda e: plain(e) + 2 * free(e), default=None)
        if best is None or not plain(best):
            return None
        outside = sum(b.plain for b, covered in zip(self.blocks, self._cover(MAYBE, None), strict=True) if not covered and not b.inside)
        if not free(best) and outside > plain(best):
            return None  # remarks in elements of their own, beside a text that has none
        for e in inner:
            if best.holds(e) and plain(e) >= 0.6 * plain(best):
                best = e
        return best

    def weakly_marked(self) -> Element | None:
        plain = self._plain(NAMED)
        return max((e for e in self.elements if e.mark == MAYBE and plain(e) >= LEAST_PLAIN), key=plain, default=None)


def features(found: list[Block]) -> list[list[float]]:
    """One vector a block; neighbours are blocks that aren't marked as no text."""
    has_article = any(b.inside and not b.marked for b in found)

    def neighbours(order: range) -> list[tuple[float, float]]:
        """Words and link density of what comes before, in that order: of the container, else of the nearest block."""
        near, out = (0.0, 0.0), [(0.0, 0.0)] * len(found)
        sums: dict[int, tuple[int, int]] = {}
        for i in order:
            b = found[i]
            words, linked = sums.get(b.group, (0, 0))
            out[i] = (float(words), linked / words) if words else near
            if not b.marked:
                sums[b.group] = (words + b.words, linked + b.linked)
                near = (float(b.words), b.linked / b.words)
        return out

    before, behind = neighbours(range(len(found))), neighbours(range(len(found) - 1, -1, -1))
    held: Counter[int] = Counter()
    for b in found:
        held[b.group] += 0 if b.marked else b.words - b.linked
    fullest = max(held.values(), default=0) or 1
    return [[float(b.words), b.linked / b.words, *before[i], *behind[i], float(held[b.group]), held[b.group] / fullest, float(b.inside), float(has_article and not b.inside), float(b.marked), float(b.heading)] for i, b in enumerate(found)]


def main_text(page: str | None, judge: Node | None = None) -> str:
    read, keeps = Page(page or ""), (judge or tree()).keeps

    def kept(void: Element | None) -> list[str]:
        read.mark(void)
        return [b.text for b, x in zip(read.blocks, features(read.blocks), strict=True) if keeps(x)]

    texts = kept(read.article())
    if not texts and (holder := read.weakly_marked()):
        texts = kept(holder)
    return "\n\n".join(texts)


def main_text_column(page: Column) -> Column:
    """A struct (``RESULT``) for each html."""

    @F.pandas_udf(RESULT)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return extract(page)


def op9_blocks(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", main_text_column(F.col("html")).alias("r")).select("page_id", "url", "r.text", "r.n_chars")
