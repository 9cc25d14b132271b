"""Each operator on small, awkward tables, against brute force, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchantry.llm import bpe, brown, cascade, exact, htmlpaths, lines, minhash, mixing, queries, toxicity, urls
from merchantry.llm.components import components

SPACES = " \t\n\x0b\x0c\r"
BASE = [f"w{i * 7919 % 997}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, `count` long, word string, keep_id long, comp long"


def messy_rows():
    near = BASE[:30] + ["changed"] + BASE[31:]
    texts = [
        " ".join(BASE), " ".join(near), " ".join(BASE).upper(), "\t".join(BASE), None, "", "  \n ", "one", "one", "two words",
        "This line is long enough to count.\nshort\nown line of the first", "x\n  THIS line is long enough to count. \nshort",
        "this line is long enough to count.\nthis line is long enough to count.", "Grüße, 東京 naïve 🙂 it's <|endoftext|> A1B2", "word " * 3000, "a" * 20000,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "k", 1, 2, "w", 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[9], (None, " ".join(BASE), None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def stripped(text):
    return (text or "").translate({ord(c): None for c in SPACES})


def words(text):
    return (text or "").encode().split()


def test_exact_duplicates(messy, nothing):
    groups = defaultdict(list)
    for row in messy_rows():
        groups[stripped(row[1])].append(row)
    want = []
    for text, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], keep, len(rows), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in rows]
    got = exact.exact_duplicates(messy, exact.ExactConfig(per_shard=3)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert exact.exact_duplicates(nothing).count() == 0
    left = exact.drop_exact_duplicates(messy)
    assert left.columns == messy.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({w[0] for w in want if w[3]})


def test_perfect_hash_is_minimal():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(777)), np.uint8).reshape(-1, 32)
    _, slots = exact.build_pilots(digests, 4)
    assert sorted(slots.tolist()) == list(range(777))


def shingles(text, k):
    w = words((text or "").encode().lower().decode())
    return ({tuple(w)} if w else set()) if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k):
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("copies", [0, 40])
def test_near_duplicates(spark, messy, nothing, copies):
    rng = np.random.default_rng(5)
    extra = []
    for i in range(copies):  # chains of edits: some links only go through others
        w = list(BASE)
        for j in rng.choice(60, i % 6, replace=False):
            w[j] = f"edit{i}-{j}"
        extra.append((100 + i, " ".join(w)))
    rows = [(r[0], r[1]) for r in messy_rows()] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string") if copies else messy
    want = brute_components(rows, 4)
    conf = minhash.NearConfig(words=4, members_per_task_group=4, held_block=3, streamed_block=5, leader_rounds=2)
    got = minhash.near_duplicates(docs, conf).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    if not copies:
        assert minhash.near_duplicates(nothing).count() == 0


def test_dropped_copies_are_told_apart_by_text(spark):
    far = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = far[5].replace("f30", "other")
    rows = [(None, far[0], "s"), (None, far[1], "s"), (None, far[1], "t"), (None, far[2] + " ", "s"), (None, far[2], "s"), (7, far[3], "s"), (7, far[4], "s"), (7, far[4], "s"), (7, far[5], "s"), (7, near, "s"), (9, near, "t"), (None, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    want = [(None, "")] + [(None, t) for t in (far[0], far[1], far[2] + " ")] + [(7, t) for t in (far[3], far[4], far[5], near)]
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter(want)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, r.text or "") for r in left.collect())
    assert got.pop((7, far[5]), 0) + got.pop((7, near), 0) == 1
    assert got == Counter([(None, t) for t in ("", far[0], far[1], far[2], far[2] + " ")] + [(7, far[3]), (7, far[4])])
    found = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs.where("doc_id is not null")).collect())
    assert found == Counter({(7, 7): 5, (9, 7): 1})
    twice = spark.createDataFrame([(5, far[0]), (5, far[1]), (6, far[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(twice).collect()) == [(5, far[0]), (5, far[1])]


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = base[:260], base[40:]
    same = np.mean([(minhash.fast_similarity_sketch(a ^ s, 125) == minhash.fast_similarity_sketch(b ^ s, 125)).mean() for s in rng.integers(0, 2**63, 30).astype(np.uint64)])
    assert abs(same - 220 / 300) < 0.03
    assert not (minhash.fast_similarity_sketch(base[:1], 125) == np.uint64(2**64 - 1)).any()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_line_dedup(messy, nothing):
    rows = messy_rows()
    holders = defaultdict(set)

    def key(line):
        return line.strip(SPACES).encode().lower().decode()

    for nr, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add((True, r[0]) if r[0] is not None else (False, nr))
    want = []
    for r in rows:
        mine = (True, r[0])
        all_ = (r[1] or "").split("\n")
        kept = [x for x in all_ if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)])[0] and max(holders[key(x)]) != mine)]
        want.append((r[0], "\n".join(kept), len(all_), len(all_) - len(kept)))
    for fanout in (2, 3):
        got = lines.drop_repeated_lines(messy, lines.LineConfig(batches=4, fanout=fanout))
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert lines.drop_repeated_lines(nothing).count() == 0


def test_lines_of_rows_without_ids(spark):
    line, only = "this line stands in many documents", "this one is in rows without an id alone"
    rows = [(None, line), (None, line), (None, f"{line}\n{only}"), (None, f"own\n{only}"), (None, f"{only}\n{line.upper()} "), (4, line), (-(2**63), f"x\n{line}")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(
        [(None, "", 1, 1), (None, "", 1, 1), (None, only, 2, 1), (None, f"own\n{only}", 2, 0), (None, only, 2, 1), (4, line, 1, 0), (-(2**63), "x", 2, 1)]
    )


def test_many_lines_take_time_in_proportion(spark):
    import time

    def took(n):
        text = "\n".join(f"a line that is long enough, number {i}" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
        start = time.perf_counter()
        assert sorted(r.n_dropped for r in lines.drop_repeated_lines(docs, lines.LineConfig(batches=1)).collect()) == [0, n, n]
        return time.perf_counter() - start

    took(100)
    assert took(20_000) < 4 * took(5_000) + 2



def test_mixing_meets_targets(spark, messy, nothing):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["x"] * int(n)), None if i % 40 == 7 else "abc"[min(2, i % 5)]) for i, n in enumerate(rng.integers(0, 60, 700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, mixing.MixConfig(block=8)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7), mixing.MixConfig(block=8)).collect()}
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=False))
    budget, target = 1.5 * sum(size.values()), {}
    while True:
        rest = (budget - sum(target.values())) / sum(w for s, w in weights.items() if s not in target)
        over = [s for s in weights if s not in target and weights[s] * rest > 2 * size[s]]
        if not over:
            break
        target |= {s: 2 * size[s] for s in over}
    target |= {s: weights[s] * rest for s in weights if s not in target}
    source = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in size)
    assert mixing.mix_sources(messy).count() == messy.count() and mixing.mixed_rows(messy).columns == messy.columns
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0


def test_bpe_round_trip(spark, messy, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.BpeConfig().path)
    want = []
    for r in messy_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert Counter(map(tuple, bpe.encoded_digests(messy).collect())) == Counter(want)
    decoded = bpe.decode(bpe.encode(messy), bpe.piece_table(spark)).collect()
    assert Counter((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in decoded) == Counter((w[0], w[3]) for w in want)
    assert bpe.encoded_digests(nothing).count() == 0


def test_cascade_counts_and_order(messy, nothing):
    got = cascade.judge(messy).collect()
    assert len(got) == messy.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    assert by_id[0].kept and by_id[0].n_words == 60 and by_id[0].n_repeat_words == 0
    assert by_id[14].n_repeat_words == 3000 and by_id[12].n_dup_lines == 1
    cheap, dear, idle = (cascade.Rule(n, lambda t: False) for n in ("cheap", "dear", "idle"))
    order = cascade.ordered((idle, dear, cheap), {"cheap": (1e-6, 0.2), "dear": (1e-4, 0.5), "idle": (1e-6, 0.0)})
    assert [r.name for r in order] == ["cheap", "dear", "idle"]
    assert cascade.judge(nothing).count() == 0
    assert sorted(r.doc_id for r in cascade.keep_good(messy).where("doc_id is not null").distinct().collect()) == sorted({r.doc_id for r in got if r.kept and r.doc_id is not None})


def test_toxicity_learns_from_bags(spark, messy, nothing):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(f"v{j}" for j in rng.integers(0, 400, 8)) for _ in range(rng.integers(1, 9))]
        bad = i % 4 == 0
        if bad:
            at = rng.integers(0, len(sentences))
            sentences[at] += f" slur{rng.integers(0, 5)}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 400"), marked)
    scored = {r.doc_id: r for r in toxicity.score(docs.where("doc_id >= 400"), model).collect()}
    right = sum((r.score >= 0.3) == (i % 4 == 0) for i, r in scored.items())
    assert right >= 190
    for i, r in scored.items():
        for spot in r.offending:
            if i % 4 == 0 and len(r.offending) == 1:
                assert "slur" in rows[i][1].split(". ")[spot.sentence]
    empty = toxicity.train(nothing, marked)
    got = toxicity.score(messy, empty).collect()
    assert len(got) == messy.count() and all(0 <= r.score < 0.01 for r in got)
    assert toxicity.drop_toxic(messy, model).columns == messy.columns
    assert toxicity.score(nothing, model).count() == 0


def test_brown_scores(spark, messy, nothing):
    rng = np.random.default_rng(2)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if j % 2 else b) for j in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = brown.score(docs, conf=brown.BrownConfig(classes=6)).collect()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in rows if i not in held for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = [*rows[r.doc_id][1].split(), None]
        assert r.held_out == (r.doc_id in held) and (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # words alternate between two classes
    odd = brown.score(messy).collect()
    assert len(odd) == messy.count() and all(r.score <= 0 and r.n_tokens == 1 + len(words(dict((x[0], x[1]) for x in messy_rows())[r.doc_id])) for r in odd)
    assert brown.score(nothing).count() == 0


URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://www.EXAMPLE.net/en/", "www.example.net", "/en/", "example.net/en/", "allow"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("http://m.example.com/de/q?x", "m.example.com", "/de/q", "example.com/de/", "block"), ("ftp://b.org/fr/z#f", "b.org", "/fr/z", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://net/", "net", "/", "net/", "block"),
]


def test_url_rules(spark, nothing):
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)] * 2, "page_id long, url string, rule string, needs string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        needs = sorted({f"t{i}" for i in rng.integers(0, 6, 3)})
        rows.append((needs, "block" if {"t1", "t2"} <= set(needs) else "allow"))
    conf = urls.UrlConfig(support=0.02, confidence=0.9)
    got = {(tuple(r.needs), r.says): r.confidence for r in urls.mine(spark.createDataFrame(rows, "needs array<string>, says string"), conf).collect()}
    from itertools import combinations

    found = {}
    for n in (1, 2, 3):
        for needs in combinations(sorted({t for r in rows for t in r[0]}), n):
            fits = [says for have, says in rows if set(needs) <= set(have)]
            for says in ("allow", "block"):
                c = fits.count(says)
                if c >= np.ceil(0.02 * len(rows)) and c / len(fits) >= 0.9:
                    found[needs, says] = c / len(fits)
    idle = {(n, s) for (n, s), c in found.items() if any((tuple(x for x in n if x != t), s) in found and found[tuple(x for x in n if x != t), s] >= c for t in n)}
    assert got == pytest.approx({k: c for k, c in found.items() if k not in idle})


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now.</div><!-- <p>hidden</p> -->
<div id="content"><h1>The &amp; title</h1><p><b>First  paragraph,
with a break<br>here. It goes on.<p>Second &copy; paragraph, which is also long enough. Yes.</p><p>Last.</p></div>
<div class="comments"><p>A reader says this, and that. Really.</p></div><form><p>Fill in, please.</p></form><footer>Foot, note.</footer></body></html>"""


def test_main_text(spark):
    want = "The & title\n\nFirst paragraph, with a break here. It goes on.\n\nSecond © paragraph, which is also long enough. Yes.\n\nLast."
    assert htmlpaths.main_text(PAGE) == want
    assert htmlpaths.main_text(PAGE.replace('<div id="content">', "<article>").replace("Last.</p></div>", "Last.</p></article>")) == want
    pages = spark.createDataFrame([(1, "u", PAGE, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "<p " * 5000, "z"), (1, "u", PAGE, "z")], "page_id long, url string, html string, text string")
    got = htmlpaths.extract(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got if r.page_id != 4) == Counter({(1, want, len(want)): 2, (2, "", 0): 1, (3, "", 0): 1})
    assert htmlpaths.extract(pages.limit(0)).count() == 0


def test_article_weighs_and_does_not_decide():
    body = "".join(f"<p>Paragraph {i}, of the text, is long enough. It goes on, and ends here.</p>" for i in range(8))
    beside = htmlpaths.main_text(f"<body><article><p>Teaser.</p></article><div class='text'>{body}</div></body>")
    assert beside.count("Paragraph") == 8
    short = htmlpaths.main_text(f"<body><article>{body}<p>Sh is.</p></article></body>")
    assert short.count("Paragraph") == 8 and short.endswith("Sh is.")
    found = htmlpaths.blocks(f"<body><article>{body}<ul>{'<li>x</li>' * 9}</ul></article></body>")
    chosen = [htmlpaths.select(found, htmlpaths.PathConfig(least=least)) for least in (0.0, 0.9)]
    assert len(chosen[0]) == 17 and len(chosen[1]) == 8


def test_words_are_split_alike():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x1fc d\x0be") == [w.decode() for w in words("a b\x1fc d\x0be")]
    assert set(queries.SQL) <= set(queries.QUERIES)
