"""Main text, leaks, quality and language-model scores."""

import html
import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablefit.llm import decontaminate, main_text, pseudo_likelihood, quality
from tests.llm.conftest import WORDS

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">The menu</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use the cookies and so on for the best of you all in the world of the web.</div>
<main><article><header><h1>Title &amp; more</h1></header><p><b>Short.<br><p>This is the   long paragraph of the text
with a <a href="#">link</a> in it and so on, that is for the test &lt;b&gt; of it.<ul><li>one<li>two</ul>
<form><input name=q>Search the site</form><div class=ad>Buy it now</div>
<section id="comments"><h2>Comments</h2><p>This is the best thing I have read in all of the time, and it was for me.</p>
</section></article></main><aside>side</aside><footer>&copy; c</footer></body></html>"""


def test_page():
    assert main_text.main_text(PAGE) == (
        "Title & more\nShort.\nThis is the long paragraph of the text with a link in it and so on, that is for the test "
        "<b> of it.\none\ntwo")
    assert main_text.main_text("<article><p>a<p>b &am c &amp</article>") == "a\nb &am c &"
    assert main_text.main_text(None) == main_text.main_text("<p></p>") == main_text.main_text("<<<>") == ""


def test_neighbours_label_open_blocks():
    long = "This is the text that is for the test of it and as long as it has to be for the rule. " * 3
    page = f"<div>Open here</div><div>{long}</div><div>Open after</div><div><a href=x>{long}</a></div><div>Open last</div>"
    assert main_text.main_text(page).split("\n") == ["Open here", long.strip(), "Open after"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3)],
                               "page_id long, url string, html string, text int")
    got = Counter(tuple(r) for r in main_text.extract(df).collect())
    text = main_text.main_text(PAGE)
    assert got == Counter({(1, "u", text, len(text)): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert main_text.extract(df.filter("false")).count() == 0


def test_leaks(spark, docs, none):
    item = "In 1998 the train from Paris covered 350 km in 4 hours, how fast was it going on the way to Lyon? Tell me."
    again = item.replace("1998", "2004").replace("Paris", "Turin").replace("350", "410").replace("4 hours", "5 hours")
    mixed = "the 3 men and 3 cats of the 3 towns by the 3 roads are in the 3 houses"
    benchmark = spark.createDataFrame([(1, item), (2, mixed), (3, None), (4, "one two"), (1, item)],
                                      "item_id long, text string")
    broken = mixed.replace("3 cats", "4 cats").replace("3 towns", "5 towns").replace("3 roads", "6 roads")
    prose = " ".join(WORDS)
    rows = [(1, prose + ". " + item + "\n" + prose), (2, prose + ".\n" + again.upper().lower().replace("turin", "Turin").replace(
        "lyon", "Lyon")), (3, broken), (4, mixed.replace("3", "17")), (5, "One, two!"), (6, prose), (7, None), (8, item[:50])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, w string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(df, benchmark).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (4, 2): 1, (5, 4): 1})
    left = decontaminate.clean(df, benchmark)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [3, 6, 7, 8]
    assert decontaminate.matches(none, benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.filter("false")).count() == 0


def test_leaks_of_short_and_changed_items(spark):
    """Verbatim copies of short items anywhere, the first word's two readings, and one changed word."""
    changed = "the old man went to the market with his dog and bought some bread for his wife"
    items = ["What is the capital of France?", "Blue whale song", "Rome 42", changed, "who wrote the long book of it"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [(1, "Question - What is the capital of France?"), (2, "so here is the blue whale song again"),
             (3, "it was the Blue whale song of it"), (4, "we saw Rome 42 of it"), (5, "we saw Rome 43 of it"),
             (6, "and so on " + changed.replace("dog", "cat")), (7, "of all - Rome is the capital of it"),
             (8, "as he said Who wrote the long book of it")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect())
    assert got == [(1, 0), (2, 1), (3, 1), (4, 2), (6, 3), (8, 4)]


LONG = "This is the text that is for the test of it and as long as it has to be for the rule. " * 4


def test_names_that_only_mention_a_part():
    for start in ("<div class='content has-sidebar'>", "<div id='page' class='fixed-header'>", "<section class='search-result-page'>",
                  "<div class='sidebar'>", "<div class='page sidebarLayout'>"):
        page = f"<body><ul class='main-menu'><li>{LONG}</ul>{start}<p>{LONG}</p><p>{LONG}</p></div></body>"
        assert main_text.main_text(page).endswith("\n".join([LONG.strip()] * 2)), start
    for name in ("sidebar", "site-footer", "post-comments", "commentBody", "ad box", "top_nav", "related-posts", "ad-slot"):
        page = f"<div><p>{LONG}</p></div><div class='{name}'><p>{LONG} Not this.</p></div>"
        assert main_text.main_text(page) == LONG.strip(), name


def test_scripts_without_listed_words():
    japanese = "これは日本語の長い段落であり、記事の本文として扱われるべきです。" * 4
    russian = "Это длинный абзац русского текста, который должен остаться в статье целиком. " * 4
    for text in (japanese, russian.strip()):
        menu = "".join(f"<li><a href=x>{text[:5]}</a>" for _ in range(8))
        assert main_text.main_text(f"<ul>{menu}</ul><div><p>{text}</p><p>{text}</p></div><div>{text[:4]}</div>").startswith(
            f"{text}\n{text}")


def test_hostile_pages_take_linear_time():
    for page in ("<a '" * 250_000, "<b>" * 120_000 + "</i>" * 120_000, "<!" * 500_000, "<a href='" * 110_000, "< " * 500_000,
                 "<i>" + "<div>" * 80_000 + "</i>" * 80_000, "<b>" * 80_000 + "x<hr>" * 80_000, "<script>" * 120_000,
                 "<b>" * 80_000 + "<div></div>" * 80_000, "<p " + "a " * 500_000 + ">", "<a =" * 250_000):
        begun = time.process_time()
        main_text.main_text(page)
        assert time.process_time() - begun < 6, page[:20]  # two readings at most; about a second here


class Plain(HTMLParser):
    """Blocks of well-formed pages by the library's parser: every text with the path of its open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.path, self.found, self.block = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.block += tag in main_text.BLOCK
        if tag == "br":
            self.handle_data(" ")
        if tag not in main_text.VOID:
            self.path.append((tag, self.block, dict(attrs)))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.path):
            while self.path.pop()[0] != tag:
                pass
        self.block += tag in main_text.BLOCK

    def handle_data(self, data):
        self.found.append((self.block, [(t, n) for t, n, _ in self.path], [a for _, _, a in self.path], data))

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def plain_main_text(page):
    """The rules said again: where a text stands, link density, stop words and length, then nearest neighbours."""
    parser = Plain()
    parser.feed(page)
    parser.close()
    blocks = {}
    for number, path, attributes, data in parser.found:
        tags = [t for t, _ in path]
        inside = False
        bad = False
        for (tag, _), own in zip(path, attributes):
            names = f"{own.get('class') or ''} {own.get('id') or ''}".split()
            bad |= tag in main_text.BAD_TAGS | main_text.RAW or (tag == "header" and not inside)
            bad |= tag not in ("html", "body", "article", "main") and any(map(main_text._named_bad, names))
            inside |= tag in ("article", "main")
        if not bad:
            entry = blocks.setdefault(number, [[], 0, next((t for t in reversed(tags) if t in main_text.BLOCK), "body"),
                                               next((n for t, n in path if t in ("article", "main")), 0)])
            entry[0].append(data)
            entry[1] += len(" ".join(data.split())) if "a" in tags else 0
    found = [(" ".join(html.unescape("".join(t)).split()), *rest) for t, *rest in blocks.values()]
    found = [f for f in found if f[0]]
    labels = []
    for text, linked, tag, part in found:
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
        share = sum(w in main_text.STOP_WORDS for w in words) / max(1, len(words))
        if linked > 0.5 * len(text):
            labels.append(False)
        elif tag in main_text.HEADINGS:
            labels.append(None)
        elif part:
            labels.append(True if len(text) >= 70 and (share >= 0.15 or len(text) >= 200) else None)
        elif len(text) < 70:
            labels.append(False if linked or "©" in text else None)
        else:
            labels.append(True if share >= 0.3 or share >= 0.15 and len(text) >= 200 else False if share < 0.15 else None)
    out = []
    for i, (text, _, _, part) in enumerate(found):
        good = labels[i]
        if good is None:
            sides = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(found) and (found[j][3] != part or labels[j] is None):
                    j += step
                if 0 <= j < len(found):
                    sides.append((abs(i - j), labels[j]))
            least = min((d for d, _ in sides), default=0)
            good = (not sides or any(g for _, g in sides)) if part else any(g for d, g in sides if d == least)
        if good:
            out.append(text)
    return "\n".join(out)


def test_given_pages_equal_plain_rules():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert [main_text.main_text(page) for page in pages] == [plain_main_text(page or "") for page in pages]


def readings(raw: str) -> tuple[list[tuple], list[tuple], bool]:
    """A raw word's (token, value) parts inside a sentence and as its first word, and whether it ends one.

    Placeholders have the value that they stand for, other tokens none.
    """
    inside, begins = [], []
    after_number = False
    ends = raw.rstrip("\"')»”*&#%$")[-1:] in (".", "!", "?", ":")
    for i, part in enumerate(re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£°]", raw)):
        low = part.lower()
        if part[0].isdigit():
            found = "<number>", part
        elif low in decontaminate.UNITS and (not low.isalpha() or after_number or len(low) > 2):
            found = "<unit>", low
        else:
            found = low, None
        after_number = found[0] == "<number>"
        named = ("<name>", low) if found[1] is None and part[0].isupper() and not part.isupper() else found
        inside.append(named)
        begins.append(named if i else found)
    return inside, begins, ends


def plain_tokens(text):
    """(token, value) of each token, read line by line."""
    out = []
    for line in (text or "").split("\n"):
        first = True
        for raw in line.split():
            inside, begins, ends = readings(raw)
            out += begins if first else inside
            first = ends
    return out


def plain_leaks(docs, items):
    """(doc_id, item_id) by comparing all template windows of all pairs, without hashes."""
    found = []
    for item_id, text in items:
        item = plain_tokens(text)
        size, n = len(item), max(len(item) - 4, 1)
        if not size:
            continue
        readings = [item]
        if item[0][1] is None and item[0][0].isalpha():
            readings.append([("<name>", item[0][0]), *item[1:]])
        for doc_id, text in docs:
            doc = plain_tokens(text)
            short = size < 5 and len(doc) != size
            matched, cover, sure = set(), 0, False
            for shift in range(-size, len(doc)):
                bases, places, pairs = set(), set(), set()
                for i in range(n):
                    for reading in readings if i == 0 else readings[:1]:
                        mine, theirs = reading[i:i + 5], doc[max(i + shift, 0):][:len(reading[i:i + 5])]
                        if i + shift < 0 or [t for t, _ in mine] != [t for t, _ in theirs]:
                            continue
                        exact = short or all(v is not None for _, v in mine)
                        if any(a != b for k, ((_, a), (_, b)) in enumerate(zip(mine, theirs))
                               if a is not None and (exact or reading is not item and k == 0)):
                            continue
                        bases.add(tuple(t for t, _ in item[i:i + 5]))
                        places |= {i + k for k in range(len(mine))}
                        pairs |= {(a, b) for (_, a), (_, b) in zip(mine, theirs) if a is not None}
                if not bases or len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
                    continue
                kinds = {tuple(t for t, _ in item[i:i + 5]) for i in range(n)}
                share = len(places) / size
                sure |= len(bases) == len(kinds) or len(bases) > 1 and share >= 0.8 and all(a == b for a, b in pairs)
                matched |= bases
                cover = max(cover, share)
            if matched and max(len(matched) / len(kinds), cover) >= 0.8 and (sure or size >= 12):
                found.append((doc_id, item_id))
    return found


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(12)
    names, units = ["Anna", "Ben", "Carla", "Emil", "Fred"], ["km", "kg", "hours"]
    plain = ["the", "of", "to", "was", "with", "train", "gave", "left"]

    def sentence(n):
        kinds = [lambda: rnd.choice(plain)] * 6 + [lambda: rnd.choice(names), lambda: str(rnd.randint(1, 4)),
                                                   lambda: rnd.choice(units)]
        return " ".join(rnd.choice(kinds)() for _ in range(n)) + rnd.choice([".", "", ",", "\n"])

    def changed(text):
        words = text.split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(plain + names + ["3", "4", "km"])
        swap = dict(zip(names, rnd.choice([names, names[::-1], [names[0]] * 5])))
        return " ".join(swap.get(w, w) for w in words)

    story = "Anna gave 3 apples to Ben and Ben gave 5 apples to Carla, how many apples are left over now?"
    items = [(i, sentence(rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 13, 20]))) for i in range(25)]
    items += [(100, story), (101, "What is the capital of France?"), (102, "1 2 3 4 5 6"), (103, None), (104, ""), (1, "Ben")]
    docs = [(i, sentence(rnd.randint(0, 6)) + " " + changed(rnd.choice(items[:26])[1]) + " " + sentence(rnd.randint(0, 6)))
            for i in range(120)]
    docs += [(200, story.replace("to Ben", "to Emil").replace("and Ben", "and Fred")),
             (201, story.replace("Ben", "Anna").replace("Carla", "Anna").replace("3", "7").replace("5", "7")),
             (202, "I like it. Berlin is the capital of Germany and it is large."), (203, None), (204, ""),
             (205, story.replace("Ben", "Otto").replace("3", "8")), (206, "so 9 8 7 6 5 4 it is"), (207, "so 1 2 3 4 5 6 it is"),
             (208, "Is it known? What is the capital of Spain? It is."), (209, "It said: what is the capital of France? Yes")]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.item_id) for r in decontaminate.matches(*frames).collect()]
    assert sorted(got) == sorted(plain_leaks(docs, items))
    hits = {g for g in got if g[0] >= 200}
    assert {(205, 100), (207, 102), (208, 101), (209, 101)} <= hits
    assert not {(200, 100), (201, 100), (202, 101), (206, 102)} & hits


def kneser_ney(texts, symbols):
    """Plain version of the trigram model."""
    counts = Counter()
    for t in texts:
        s = [0, 0, *(int(symbols[min(ord(c), quality.CODE_POINTS - 1)]) for c in t), 0]
        counts.update(tuple(s[i:i + 3]) for i in range(len(s) - 2))
    tables = {3: counts}
    for n in (2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / quality.ALPHABET
        table = tables[n]
        n1, n2, n3, n4 = (sum(v == k for v in table.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0
        d = [0, *(max(0, k - (k + 1) * y * b / a) if a else 0 for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1))]
        own = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        c = table.get(gram, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(v, 3)] for v in own.values()) / total * p(gram[1:])
    return p


def test_quality_model(spark):
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 60))).capitalize() + "." for _ in range(400)]
    junk = ["".join(rnd.choice("%&$#@!XQZ") for _ in range(80)) for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(good + junk)] + [
        (900, None, "en"), (901, "", None), (902, " \n", "en"), (None, good[0], "en"), (5, good[5], "fr")]
    docs = spark.createDataFrame([(d, t, g, 1) for d, t, g in rows], "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(400 + i, 0, 1) for i in range(20)] + [
        (None, 1, 0), (7, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert np.allclose(np.exp(model.logs.astype(float)).sum(axis=2), 1, atol=1e-4)
    held = {r.doc_id for r in docs.selectExpr("doc_id").distinct().filter(
        f"pmod(xxhash64(doc_id), {quality.HELD_OUT}) = 0").collect()}
    learn = [t for d, t, _ in rows if d is not None and d < 300 and d != 7 and d not in held]
    p = kneser_ney(learn, model.symbols)
    judged = quality.judge(docs, model)
    got = {(r["row"]["doc_id"], r["row"]["text"], r["row"]["lang"]): r for r in judged.collect()}
    assert len(got) == len(rows)
    for key in list(got)[::45]:
        if key[1] and key[1].strip():
            s = [0, 0, *(int(model.symbols[ord(c)]) for c in key[1]), 0]
            want = math.exp(-np.mean([math.log(max(p(tuple(s[i:i + 3])), 1e-12)) for i in range(len(s) - 2)]))
            assert got[key]["perplexity"] == pytest.approx(want, rel=1e-4)
    kept = {key[0] for key, r in got.items() if r["keep"]}
    assert len(kept & set(range(300))) >= 270 and not kept & set(range(400, 430)) and not kept & {900, 901, 902}
    assert quality.judge(docs.filter("false"), model).count() == 0
    empty = quality.fit(docs.filter("false"), labels)
    assert quality.judge(docs.filter("doc_id < 20"), empty).filter("keep").count() == 21


@pytest.mark.parametrize("near", [500_000, 60])
def test_quality_model_knows_every_character(spark, monkeypatch, near):
    """More characters than the array holds: rare ones have their own counts, broadcast or joined."""
    rnd = random.Random(21)
    rare = [chr(0x4E00 + i) for i in range(150)] + [chr(0x20000 + i) for i in range(30)]
    texts = [" ".join(rnd.choice(WORDS) + "".join(rnd.choices(rare, k=rnd.randint(0, 2))) for _ in range(rnd.randint(2, 9)))
             for _ in range(160)]
    texts += ["".join(rnd.choices(rare, k=30)), rare[0], "\u0416\u0417" + rare[1] + "\u0418", "plain words only", texts[0], texts[0]]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "NEAR_GRAMS", near)
    model = quality.fit(docs, labels)
    held = {r.doc_id for r in docs.select("doc_id").filter(f"pmod(xxhash64(doc_id), {quality.HELD_OUT}) = 0").collect()}
    learn = [t for d, t, _ in rows if d < 150 and d not in held]
    seen = set("".join(learn))
    assert model.size == len(seen) + 2 > quality.ALPHABET
    assert {int(model.symbols[ord(c)]) for c in seen} == set(range(2, model.size))
    got = {r["row"]["doc_id"]: r["perplexity"] for r in quality.judge(docs, model).collect()}
    assert len(got) == len(rows) and got[900] is None and got[901] is None
    assert got[0] == pytest.approx(got[164], rel=1e-12) and got[0] == pytest.approx(got[165], rel=1e-12)
    # The plain version starts from an equal share of every symbol.
    monkeypatch.setattr(quality, "ALPHABET", model.size)
    p = kneser_ney(learn, model.symbols)
    for d in (0, 155, 161, 162):
        s = [0, 0, *(int(model.symbols[ord(c)]) for c in texts[d]), 0]
        want = math.exp(-np.mean([math.log(max(p(tuple(s[i:i + 3])), 1e-12)) for i in range(len(s) - 2)]))
        assert got[d] == pytest.approx(want, rel=1e-4)


def test_lm_scores(spark, docs, rows, none):
    got = Counter((r.doc_id, r.n_words, round(r.log_likelihood, 3)) for r in pseudo_likelihood.score(docs, steps=20).collect())
    words = [(t or "").lower().split() for _, t in rows]
    bucket = pseudo_likelihood._Buckets()
    counts = np.bincount([bucket[w] for row in words for w in row], minlength=pseudo_likelihood.BUCKETS).astype(float)
    classes = pseudo_likelihood.class_of_buckets(counts)
    sums = np.bincount(classes, weights=counts, minlength=pseudo_likelihood.CLASSES)
    edge, table = pseudo_likelihood.EDGE, np.zeros((129, 129, 128))
    around = []
    for row in words:
        c = [int(classes[bucket[w]]) for w in row]
        around.append([(a, b, m) for a, m, b in zip([edge, *c], c, [*c[1:], edge])])
        for cell in around[-1]:
            table[cell] += 1
    logs = pseudo_likelihood.train(table, steps=20)
    want = []
    for (d, _), row, cells in zip(rows, words, around):
        total = sum(float(logs[cell]) + math.log(counts[bucket[w]] / sums[classes[bucket[w]]]) for w, cell in zip(row, cells))
        want.append((d, len(row), total))
    want, got = (sorted((d is None, d or 0, n, s) for d, n, s in x) for x in (want, got.elements()))
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert np.allclose([w[3] for w in want], [g[3] for g in got], rtol=1e-4, atol=0.05)
    assert pseudo_likelihood.score(none, steps=2).count() == 0


def test_lm_words_of_a_bucket(spark, monkeypatch):
    """Words that share a bucket have their own probabilities, whether their counts are sent or joined."""
    bucket, seen = pseudo_likelihood._Buckets(), {}
    for i in range(5000):
        other = seen.setdefault(bucket[f"w{i}"], f"w{i}")
        if other != f"w{i}":
            break
    frequent, rare = other, f"w{i}"
    rows = [(i, frequent) for i in range(30)] + [(30 + i, rare) for i in range(10)] + [(40, f"{rare} {rare} {frequent}")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for hot in (1 << 16, 1):
        monkeypatch.setattr(pseudo_likelihood, "HOT_WORDS", hot)
        got = pseudo_likelihood.score(df, steps=3).collect()
        assert len(got) == len(rows)
        by_id = {r.doc_id: r for r in got}
        assert by_id[0].log_likelihood - by_id[30].log_likelihood == pytest.approx(math.log(32 / 14), rel=1e-5)
        assert by_id[40].mean_log_likelihood == pytest.approx(by_id[40].log_likelihood / 3)
        scores.append(sorted((r.doc_id, round(r.log_likelihood, 6)) for r in got))
    assert scores[0] == scores[1]


def test_network_learns_context():
    counts = np.zeros((4, 4, 3))
    counts[0, 1, 0] = counts[1, 0, 1] = counts[2, 2, 2] = 100
    probability = np.exp(pseudo_likelihood.train(counts))
    assert probability[0, 1, 0] > 0.9 and probability[1, 0, 1] > 0.9 and probability[2, 2, 2] > 0.9
