"""Paths are chosen by their scores: against the definition computed plainly, and on pages whose names tell nothing."""

import math
from collections import defaultdict

import pytest

from merchantry.llm import htmlpaths
from merchantry.llm.common import table


def brute_select(found, conf):
    """The definition, one block and one neighbour at a time."""
    inside = [b for b in found if not b.outside]
    paths = defaultdict(list)
    for b in inside:
        paths[b.path].append(b)
    length = {p: sum(len(b.text) for b in bs) / len(bs) for p, bs in paths.items()}
    points = {p: (sum(c in ".,;:!?…。，、；：！？" for b in bs for c in b.text) + 0.1) / len(bs) for p, bs in paths.items()}
    linked = {p: sum(b.linked for b in bs) / sum(len(b.text) for b in bs) for p, bs in paths.items()}

    def smooth(of, i):
        near = [(math.exp(-0.5 * ((j - i) / conf.spread) ** 2), of[inside[j].path]) for j in range(len(inside)) if abs(j - i) <= int(3 * conf.spread)]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    score = defaultdict(float)
    for i, b in enumerate(inside):
        weight = conf.article_weight if any(t.split(".")[0] in ("article", "main") for t in b.path) else 1
        weight *= conf.named_weight if b.named else 1
        score[b.path] = max(score[b.path], smooth(length, i) * smooth(points, i) * max(0, 1 - linked[b.path]) * weight)
    best = max(score.values(), default=0)
    chosen = {p for p, s in score.items() if s >= conf.least * best and s > 0}
    heads = {p[:-1] for p in chosen}
    return [b for b in inside if b.path in chosen or b.path and b.path[-1].split(".")[0] in htmlpaths.HEADINGS and b.path[:-1] in heads]


@pytest.mark.parametrize("conf", [htmlpaths.PathConfig(), htmlpaths.PathConfig(spread=2.0, least=0.2, article_weight=1.0, named_weight=0.7)])
def test_selection_equals_the_definition(spark, small, conf):
    for row in table(spark, small, "pages").collect():
        found = htmlpaths.blocks(row.html)
        assert [b.text for b in htmlpaths.select(found, conf)] == [b.text for b in brute_select(found, conf)]


SENTENCES = ["This is the first sentence of the story, and it goes on for a while.", "Another one follows, longer than the last; it has commas, too.", "Then it ends, as stories do, with a last long line of text."]
STORY = "".join(f"<p>{s}</p>" for s in SENTENCES)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='x1'><span>Home</span><div>News</div><div>Shop</div></div><div class='x2'>{STORY}</div><div class='x3'>Read on</div></body>",
        f"<body><div>Buy now</div><article>{STORY}</article><section><div>Ann</div><div>so true</div><div>Bob</div><div>no way</div></section></body>",
        f"<body><div class='x'>{STORY}</div><div class='y'>" + "".join(f"<div><a href='/{i}'>An article with a long title, number {i}, and more.</a></div>" for i in range(6)) + "</div></body>",
        f"<body><main>{STORY}</main><div class='c'><div>We use cookies.</div></div></body>",
    ],
)
def test_scores_reject_what_no_name_tells(page):
    found = htmlpaths.blocks(page)
    assert not any(b.outside or b.named for b in found)
    assert htmlpaths.main_text(page) == "\n\n".join(SENTENCES)


def test_names_weigh_and_do_not_decide():
    told = f"<body><article>{STORY}<div class='comments'><p>{SENTENCES[0]}</p></div></article></body>"
    assert htmlpaths.main_text(told) == "\n\n".join(SENTENCES)
    # a name that covers all of the page takes nothing away
    assert htmlpaths.main_text(f"<body><div class='social-page'>{STORY}</div></body>") == "\n\n".join(SENTENCES)
    assert htmlpaths.main_text("<body><p><a href='/'>All is linked.</a></p></body>") == ""
