"""Extraction, repeats, quality rules, PII and decontamination against brute force."""

import math
import re

import pytest
from fixtures import ALNUM_WORD, DOCUMENT, SPACE_WORD, corpus, lowered, rows_of, sha
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, html_text, perplexity, repeats, surrogates
from gridloom.llm.decontaminate import SuffixAutomaton


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(5)


PAGES = {
    None: "",
    "": "",
    "<nav>only menu": "",
    "<p>One.<p>Two.": "One. Two.",
    "<p>a<b>b</b>c &amp; &eacute;&#233; d\n\n e</p>": "abc & éé d e",
    "<div class='ad'>x<div>y</div></div><p>Text.</p><footer>f</footer>": "Text.",
    "<head><title>t</title></head><body><ul class=menu><li>m</ul><article><h1>H</h1><p>Body.</p><div id='comments'><p>c</p></div><p>x</p></article><aside>s</aside>": "H Body. x",
    "<article><p>A</p><form>f</form><script>var a='</p>';</script><style>p{}</style><p>B</p><!-- c -->": "A B",
    "<main>" + "<p>long text here.</p>" * 500 + "</main>": " ".join(["long text here."] * 500),
    "<div class=cookie-notice>no<article><p>Kept.</p></article>": "Kept.",
    "<p>x < y and a<b": "x < y and a<b",
}


def test_pages(spark):
    rows = [(i, f"u{i}", page, 1) for i, page in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}
    assert html_text.extract_pages(df.limit(0)).count() == 0
    assert html_text.extract_pages(df).count() == len(rows) + 1


def test_short_parts_of_a_long_page_stay():
    page = "<p>A short lead.</p><aside>ad</aside>" + "<p>Long middle part.</p>" * 200 + "<form>f</form><p>The end, <a href=x>linked</a>.</p><aside>s</aside><p><a href=y>only a link</a></p>"
    assert html_text.main_text(page) == "A short lead. " + "Long middle part. " * 200 + "The end, linked."


def test_stretches_surge_and_dive():
    import numpy as np

    plain = np.array([0, 0, 0, 5, 9, 0, 0, 7, 0, 0, 0, 0, 3])
    gap = np.zeros(13, bool)
    assert html_text.stretches(plain, gap) == [(3, 8), (12, 13)]
    assert html_text.stretches(plain, gap, 2) == [(3, 5), (7, 8), (12, 13)]
    gap[6] = True
    assert html_text.stretches(plain, gap) == [(3, 6), (7, 8), (12, 13)]
    assert html_text.stretches(np.array([], int), np.array([], bool)) == []


def test_windows_decide_inside_articles():
    """A list of links is a menu if it fills a window, and text if it is shorter."""
    links = "".join(f"<li><a href=x{i}>Link {i}</a>" for i in range(4))
    page = f"<article><p>First.</p><ul>{links}</ul><p>Last, <a href=y>linked</a>.</p><p><a href=z>A linked end</a></p></article>"
    with_links = "First. Link 0 Link 1 Link 2 Link 3 Last, linked. A linked end"
    assert html_text.main_text(page) == html_text.main_text(page, 4) == "First. Last, linked. A linked end"
    assert html_text.main_text(page, 5) == with_links
    bare = page.replace("article>", "div>").replace("First.", "First, and much more of it.")
    assert html_text.main_text(bare) == "First, and much more of it. Last, linked."
    assert html_text.main_text(bare, 5) == "First, and much more of it. Link 0 Link 1 Link 2 Link 3 Last, linked."


def test_class_names_count_as_wholes():
    kept = ("page-header", "related-work", "ad-hoc", "legal-analysis", "share-price", "search-engines", "layout no-sidebar")
    page = "<article><h1 class='page-header'>T</h1>" + "".join(f"<p class='{c}'>{c}.</p>" for c in kept) + "<div class='x comments'>gone</div><p role=search>gone</p></article>"
    assert html_text.main_text(page) == "T " + " ".join(f"{c}." for c in kept)
    assert html_text.main_text("<form>" + "<p>All of the page.</p>" * 3 + "</form><footer>f</footer>") == " ".join(["All of the page."] * 3)
    assert html_text.main_text("<p>Some text here.</p><form><label>Name</label></form>") == "Some text here."


def test_pages_against_brute_force(spark, sf_dir):
    """The tables' pages, by the standard library's parser: blocks of text in the article."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks, self.raw = 0, [""], 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.raw += tag in ("script", "style")
            if tag not in ("b", "i", "a", "em", "span"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.raw -= tag in ("script", "style")
            if tag not in ("b", "i", "a", "em", "span"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside and not self.raw:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        assert got[r.page_id] == " ".join(t for b in parser.blocks if (t := " ".join(b.split())))


def repeated(rows, window=50):
    words = {}
    for r in rows:
        words.setdefault(r[0], SPACE_WORD.findall(r[1] or ""))
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = []
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        out.append((i, len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k))))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes,salt_bytes", [(1 << 21, 1 << 23), (300, 2000)])
def test_repeats(spark, docs, rows, monkeypatch, shard_bytes, salt_bytes):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(repeats, "SALT_BYTES", salt_bytes)
    got = rows_of(repeats.repeat_report(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = repeated(rows)
    assert got == want and sum(r[2] > 0 for r in want) > 10
    texts = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    for i, _, removed, digest in want:
        original = next(r[1] for r in rows if r[0] == i)
        assert texts[i] == original if not removed else sha(texts[i]) == digest


def test_repeats_of_odd_tables(spark, docs):
    assert repeats.repeat_report(docs.limit(0)).count() == 0
    text = " ".join(f"v{i}" for i in range(70))
    odd = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.repeat_report(odd).collect())
    assert got == [("5", 0), ("5", 0), ("7", 70), ("None", 0)]


def base(text):
    words = SPACE_WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_base_rules(spark, rows):
    few = [r for r in rows if len(r[1] or "") < 3000] + [(900, "a b\nc\n\n a b\nc\na b\n*#", "en", "s", 0, "x")]
    df = spark.createDataFrame(few, DOCUMENT)
    got = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    assert len(got) == len(few)
    for i, text, *_ in few:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert not (r.kept and r.base_failed)
    assert perplexity.quality_rules(df.limit(0)).count() == 0


def test_perplexity_bands_reject_noise(spark):
    import random

    rng = random.Random(3)
    syllables = "the an ing ed ou st er re on at".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3])))
    good = [(i, " ".join(word() for _ in range(120)), "en") for i in range(200)]
    noisy = [(1000 + i, " ".join(word() + rng.choice(["***", "%%%", "$$$"]) for _ in range(120)), "en") for i in range(6)]
    flat = [(2000 + i, " ".join("theou" + rng.choice(["x", "q"]) * rng.choice([30, 40]) + word() for _ in range(120)), "en") for i in range(6)]
    # of few words in ever new orders: no 3-word window is found twice in half the text
    plain = [(3000 + i, " ".join(rng.choice("a b c d e f g h i j k l".split()) for _ in range(120)), "en") for i in range(6)]
    rows = spark.createDataFrame([*good, *noisy, *flat, *plain], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    assert sum(got[i].kept for i, *_ in good) >= 198 and not any(got[i].kept for i, *_ in noisy + flat + plain)
    assert all(got[i].log_perplexity < got[i].low and not got[i].base_failed for i, *_ in plain)
    assert all(got[i].log_perplexity > got[i].high for i, *_ in noisy + flat)


def kneser_ney(texts, order):
    """Modified Kneser-Ney over bytes, from its definition: a function of context and byte."""
    from collections import Counter

    counts = {order: Counter()}
    for t in texts:
        padded = b"\n" * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    discounts = {}
    for o, grams in counts.items():
        n = [sum(c == k for c in grams.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5)) for k in (1, 2, 3)]
        discounts[o] = lambda c, d=d: d[min(c, 3) - 1]

    def p(context, byte):
        o = len(context) + 1
        lower = p(context[1:], byte) if o > 1 else 1 / 256
        after = {g: c for g, c in counts[o].items() if g[:-1] == context}
        if not after:
            return lower
        total, own = sum(after.values()), after.get(context + bytes([byte]), 0)
        left = sum(map(discounts[o], after.values())) / total
        return (max(0, own - discounts[o](own)) / total if own else 0) + left * lower

    return p


@pytest.mark.parametrize("entries", [4_000_000, 60])
def test_scores_against_brute_force(spark, entries):
    """Every prediction, whether the model is one block or many, in and out of the corpus."""
    seen = [("en", "the cat sat on the mat. the dog sat"), ("en", "a cat, a dog"), ("ru", "кот и пёс и кот"), ("en", None), ("ja", "猫と犬")]
    model = perplexity.kneser_ney(perplexity.count_grams(spark.createDataFrame(seen, "lang string, text string")))
    new = [*seen, ("en", "the bat zzz на"), ("ru", "пёс the"), ("xx", "no model")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(new)], "doc_id int, lang string, text string")
    got = {r.doc_id: r.log_perplexity for r in perplexity.score(docs, model, entries).collect()}
    assert len(perplexity._blocks(model, entries)) > (1 if entries == 60 else 0)
    order = perplexity.ORDER
    p = {lang: kneser_ney([(t or "").encode() for x, t in seen if x == lang], order) for lang in ("en", "ru", "ja")}
    for i, (lang, text) in enumerate(new):
        if lang == "xx" or not text:
            assert got[i] is None
            continue
        padded = b"\n" * (order - 1) + text.encode()
        cost = -sum(math.log(p[lang](padded[k : k + order - 1], padded[k + order - 1])) for k in range(len(text.encode())))
        words = len([w for w in text.split() if re.search(r"[^\W_]", w)])
        assert got[i] == pytest.approx(cost / words, rel=1e-4)


def test_bands_and_verdicts_against_brute_force(spark):
    import random

    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choice("abcde"[: 2 + i % 4]) for _ in range(5)) for _ in range(60 + i % 9)), ("en", "de", None)[i % 3]) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, rows[0][1], "en"), (902, rows[0][1], "en")], "doc_id long, text string, lang string").withColumns({"low": F.lit(1), "n": F.lit(2), "kept": F.lit("x")})
    got = perplexity.quality_rules(df, (1.0, 1.5), (0.01, 0.01)).collect()
    assert len(got) == df.count()
    for lang in ("en", "de", ""):
        mine = [r for r in got if r.lang == lang]
        bins = sorted(math.floor(r.log_perplexity / perplexity.BIN) for r in mine if not r.base_failed)
        low_median = lambda v: sorted(v)[(len(v) - 1) // 2]
        centre = low_median(bins)
        below, above = low_median([centre - b for b in bins if b <= centre]), low_median([b - centre for b in bins if b >= centre])
        mid = (centre + 0.5) * perplexity.BIN
        low, high = mid - max(0.01, below * perplexity.BIN), mid + max(0.01, 1.5 * above * perplexity.BIN)
        for r in mine:
            assert r.low == pytest.approx(low) and r.high == pytest.approx(high)
            assert r.kept == (not r.base_failed and low <= r.log_perplexity <= high)
        assert {r.kept for r in mine} == {True, False}


def test_model_is_a_distribution(spark):
    """Seen and unseen continuations of any context sum to one."""
    import numpy as np

    df = spark.createDataFrame([("en", "the cat sat on the mat. the dog sat"), ("en", "a cat, a dog"), ("en", None)], "lang string, text string")
    rows = perplexity.kneser_ney(perplexity.count_grams(df)).toArrow()
    model = perplexity.Model.build(*[np.asarray(rows.column(c)) for c in ("kind", "gram", "value")])
    for context in ("the ", "zzzz", "a ca", "at o", " sat"):
        code = int.from_bytes(context.encode(), "big")
        codes = (code << 8) + np.arange(perplexity.SYMBOLS, dtype=np.int64)
        assert np.exp(model.log_p(codes)).sum() == pytest.approx(1, abs=1e-4)


def test_suffix_automaton_matches_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(30):
        items = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        a = SuffixAutomaton()
        for x in items:
            a.add(x)
        for i, x in enumerate(items):
            a.mark(str(i), x, min(3, len(x)))
        runs = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        stream = [rng.randrange(3) for _ in range(40)]
        for end, (state, length) in enumerate(a.walk(stream), 1):
            assert length == max((n for n in range(end + 1) if tuple(stream[end - n : end]) in runs), default=0)
            if length >= 3:
                window = stream[end - 3 : end]
                want = {str(i) for i, x in enumerate(items) if len(x) >= 3 and any(x[j : j + 3] == window for j in range(len(x) - 2))}
                assert a.windows.get((a.suffix(state, 3), 3), set()) == want


def contamination(rows, items):
    windows = {}
    for name, text in items:
        w = ALNUM_WORD.findall(lowered(text))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(name))
    out = []
    for r in rows:
        w = ALNUM_WORD.findall(lowered(r[1]))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if here := windows.get(tuple(w[j : j + n])):
                    found |= here
                    hit[j : j + n] = [True] * n
        out.append((r[0], len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [100_000, 40])
def test_contamination(spark, docs, rows, block):
    long = [r[1].split() for r in rows if r[1] and len(r[1].split()) > 100]
    items = [(2, " ".join(long[0][5:30])), (10, " ".join(long[1][:12]).upper()), (3, "w1 w2"), (4, "und UND, und"), (5, None), (6, "--"), (2, " ".join(long[2][50:80])), (7, "zq zq")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, benchmark, automaton_words=block)
    got = sorted((r.doc_id, r.n_words, len({i for s in r.spans or [] for i in range(s["first"], s["first"] + s["count"])}), len(r["items"]), sha(",".join(r["items"])), bool(r.spans)) for r in found.select("doc_id", "n_words", "spans", "items").collect())
    want = contamination(rows, items)
    assert got == want and sum(r[-1] for r in want) >= 4
    if block > 1000:
        report = decontaminate.contamination_report(docs, benchmark)
        assert rows_of(report, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_decontaminated_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rest = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"One, {item.upper()}! {rest}", 3), (2, item, 4), (3, "clean  text\n", 5), (4, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: (f"One, ! {rest}", len(rest) + 7), 3: ("clean  text\n", 5), 4: (None, None)}
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 4 and none.columns == docs.columns


def test_texts_without_spans(spark):
    text = "ä one ö two three ü four"
    raw = text.encode()
    cases = [[], [(0, 2)], [(3, 6), (5, 12)], [(3, 14), (5, 6), (9, 13)], [(len(raw) - 4, len(raw))], [(0, len(raw))]]
    rows = [(i, text, [{"start": a, "end": b} for a, b in spans]) for i, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start: bigint, end: bigint>>")
    got = {r.i: r.cut for r in df.select("i", decontaminate._without("text", "spans").alias("cut")).collect()}
    for i, spans in enumerate(cases):
        assert got[i].encode() == bytes(c for k, c in enumerate(raw) if not any(a <= k < b for a, b in spans))


def test_surrogates(spark):
    text = "Mail Anna.Lee@mail.example.com or +1 (743) 555-3824, 10.0.0.7, 4111 1111 1111 1111; token = \"%s\"." % ("0a1b" * 10)
    docs = spark.createDataFrame([(1, text, 1), (2, "again anna.lee@mail.example.com and Mr John Smith; Mrs Smith, JOHN", 2), (3, None, 3), (4, "", 4), (5, "no entity 123", 5)], "doc_id long, text string, n_entities int")
    out = {r.doc_id: r for r in surrogates.pseudonymise(docs, "k").collect()}
    assert out[1].n_entities == 5 and out[3].text is None and out[4].text == "" and out[5].text == "no entity 123"
    for secret in ("Anna", "example", "743", "10.0.0.7", "4111", "0a1b", "Smith", "John"):
        assert secret not in out[1].text and secret not in out[2].text
    kinds = [x[2] for x in surrogates.detect(out[1].text)]
    assert kinds == ["email", "phone", "ipv4", "card", "secret"]
    card = re.sub(r"\D", "", next(x[3] for x in surrogates.detect(out[1].text) if x[2] == "card"))
    assert surrogates._luhn(card[:-1]) == int(card[-1])
    mail = [next(x[3] for x in surrogates.detect(out[i].text) if x[2] == "email") for i in (1, 2)]
    assert mail[0].lower() == mail[1] and mail[0][0].isupper()
    names = re.search(r"Mr (\w+) (\w+); Mrs (\w+)", out[2].text)
    assert names[2] == names[3]
    assert {r.text for r in surrogates.pseudonymise(docs, "k").collect()} == {r.text for r in out.values()}
    assert {r.text for r in surrogates.pseudonymise(docs, "other").collect()} != {r.text for r in out.values()}
    assert surrogates.pseudonymise(docs.limit(0), "k").count() == 0


@pytest.mark.parametrize("kind,format_,n", [("ssn", "{:09d}", 300), ("phone", "{:07d}", 300), ("card", "4{:014d}", 300)])
def test_permutations_keep_values_apart(kind, format_, n):
    values = [format_.format(i) for i in range(n)]
    assert len({surrogates.surrogate(b"k", kind, v) for v in values}) == n


def test_small_formats_are_permuted_whole():
    values = [f"{i:02d}" for i in range(100)]
    assert sorted(surrogates.surrogate(b"k", "ssn", v) for v in values) == values


@pytest.mark.parametrize("limit", [100_000, 0])
def test_collisions_are_resolved(spark, monkeypatch, limit):
    """So many names that some draw the same surrogate: all stay apart, by either join."""
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", limit)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = spark.createDataFrame([(i, f"Dr. Q{letters[i // 676]}{letters[i // 26 % 26]}{letters[i % 26]} came") for i in range(4000)], "doc_id long, text string")
    key = surrogates.hashlib.sha256(b"k").digest()
    assert surrogates.assign(surrogates.entities(docs), key).count() > 0
    texts = {r.text for r in surrogates.pseudonymise(docs, "k").collect()}
    assert len(texts) == 4000 and not texts & {r.text for r in docs.collect()}


def pseudonyms(spark, *texts, key="example key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in surrogates.pseudonymise(df, key).orderBy("doc_id").collect()]


@pytest.mark.parametrize("text", ["write to g@u.com now", "g@u.com z@n.org g@s.io j@q.de y@b.de q@s.co", "İstanbul@mail.com", "иван@mail.com", "łukasz.żak@mail.com", "иван@почта.рф", "ΣΊΣΥΦΟΣ@mail.com"])
def test_odd_addresses_end_and_leave_nothing(spark, text):
    out = pseudonyms(spark, text)[0]
    for word in re.findall(r"\S+@\S+", text):
        local = word.partition("@")[0]
        assert word not in out and (len(local) == 1 or not set(re.findall(r"\w+", local)) & set(re.findall(r"\w+", out)))
    assert out.count("@") == text.count("@")


def test_a_format_that_the_corpus_fills(spark):
    """Every address of one letter is real: surrogates are longer, distinct and no one's."""
    mails = [f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    out = pseudonyms(spark, *mails)
    assert len(set(out)) == len(mails) and not set(out) & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.de", x) for x in out)


def test_names_corefer(spark):
    text = "Mr John Smith met Mrs Mary Smith. John said to SMITH and Mary's friend: smith is a trade, Johnson not. O'John-Smith"
    other = "Ms Anna came with Dr Mary Jones"
    out, second = pseudonyms(spark, text, other)
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)\. (\w+) said to (\w+) and (\w+)'s friend: smith is a trade, Johnson not\. O'(\w+)-(\w+)", out)
    john, smith, mary = m[1], m[2], m[3]
    assert (m[4], m[5], m[6], m[7], m[8], m[9]) == (smith, john, smith.upper(), mary, john, smith)
    assert john[-1] == "n" and mary[-1] == "a" and len({john, smith, mary}) == 3
    n = re.fullmatch(r"Ms (\w+) came with Dr (\w+) (\w+)", second)
    assert n[2] == mary and n[1][-1] == "a" and n[1] != "Anna"
    chinese = pseudonyms(spark, "Dr 王 小明 来了。后来小明走了。")[0]
    assert "小明" not in chinese and "王" not in chinese and len(chinese) == len("Dr 王 小明 来了。后来小明走了。")


def test_more_kinds(spark):
    text = "2001:db8::8a2e:370:7334 password: hunter2x! passport no. C01X00T47, born on 12.03.1985; 06 12 34 56 78 or +33 6 12 34 56 78 or 612 345 678; token = 'abcd1234efgh'"
    out = pseudonyms(spark, text)[0]
    for word in ("2001:db8", "hunter2x", "C01X00T47", "12.03.1985", "12 34 56", "345 678", "abcd1234"):
        assert word in text and word not in out
    assert re.search(r"born on \d\d\.\d\d\.(19|20)\d\d;", out)
    assert re.sub(r"\w", "x", out) == re.sub(r"\w", "x", text)
    plain = "At 12:34:56 std::vector a::b the secret: nothing, version 1.2.3, page 612 and 345"
    assert pseudonyms(spark, plain) == [plain]


def test_long_and_repeated_rows(spark):
    long = "word " * 200_000 + "a.b@c.de"
    out = pseudonyms(spark, long, "a.b@c.de", "a.b@c.de", None, "")
    assert out[0].split()[-1] == out[1] == out[2] != "a.b@c.de" and out[0].startswith("word word") and out[3:] == [None, ""]


def test_surrogates_against_brute_force(spark):
    """Over a whole corpus: one surrogate for each entity, no two alike, none a real value,
    the same format; and the texts are those with each mention replaced by it."""
    import random

    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{rng.choice('abcdefghijklm')}@{rng.choice('uvwxyz')}.com",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"+49 {digits(3)} {digits(6)}"[:14],
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
    ]
    texts = [" and ".join(rng.choice(makers)() for _ in range(4)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    key = surrogates.hashlib.sha256(b"key").digest()
    drawn = surrogates._drawn(surrogates.entities(df), key).collect()
    real = {(k, surrogates.canonical(k, m)) for t in texts for _, _, k, m, _ in surrogates.detect(t)}
    assert {(r.kind, r.value) for r in drawn} == real and len(drawn) == len(real)
    assert len({(r.kind, r.surrogate) for r in drawn}) == len(drawn)
    assert not {(r.kind, r.surrogate) for r in drawn} & real and any(r.attempt for r in drawn)
    given = {r.value: r.surrogate for r in drawn}
    want = [" and ".join(given[re.sub(r"[ -]", "", x) if re.fullmatch(r"[+\d -]+", x) else x] for x in t.split(" and ")) for t in texts]
    strip = lambda t: re.sub(r"(?<=\d)[ -](?=\d)", "", t)
    assert [strip(t) for t in pseudonyms(spark, *texts, key="key")] == want


def test_contamination_of_odd_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, f"{item} " + "more " * 30, 5, "x", "y", 1.5), (1, f"{item} " + "more " * 30, 5, "x", "y", 1.5), (None, None, None, None, None, None), (3, "fine " * 50_000, 1, "", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, items string, n_words string, longest_match double")
    benchmark = spark.createDataFrame([(None, item), ("b", None), ("c", "")], "item_id string, text string")
    out = decontaminate.decontaminate(docs, benchmark).collect()
    assert [(r.spans, r["items"], r.n_words, r.longest_match) for r in out] == [r[2:] for r in rows]
    assert [len(r.text or "") for r in out] == [len(" " + "more " * 30)] * 2 + [0, 250_000]
    found = decontaminate.find_contamination(docs, benchmark).collect()
    assert [(len(r.spans), r["items"], r.n_words) for r in found] == [(1, [""], 40), (1, [""], 40), (0, [], 0), (0, [], 50_000)]
    assert decontaminate.contamination_report(docs.limit(0), benchmark).count() == 0
