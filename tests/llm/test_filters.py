"""Quality rules, secret scans, mixing, extraction and embeddings."""

import math
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueforge.llm import quality, secret_scan
from cueforge.llm.embed_dedup import centre_count, embedding_duplicates
from cueforge.llm.html_extract import WINDOW, extract_text, main_text, regions
from cueforge.llm.mixing import entropy_exponent, mix_sources, repetition_exponent


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute_measures(text):
    text = text or ""
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen, again = {}, set()
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            again.update(p for k in at for p in range(k, k + 5))
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_measures(make_docs, corpus):
    rows = [*corpus, (900, "a b c d e f a b c d e g h i j k"), (901, "x " * 50), (902, "l1 a\nl1 a\n\n \nl1 a\nb # $"), (903, "a b c d e a b c d e a b c d e")]
    got = quality.quality_rules(make_docs(rows))
    assert native(got)
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert found == sorted((str(i), *brute_measures(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())
    assert quality.quality_rules(make_docs([])).count() == 0


def test_boilerplate_lines(make_docs):
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = "All rights reserved by the site owner, 2020 edition here"
    rows = [(k, f"{line.replace('2020', str(2000 + k))}\n{body(40)}", "a") for k in range(40)]
    rows += [(100 + k, f"{line}\n{body(3)}", "a") for k in range(3)]  # depleted
    rows += [(200 + k, f"{line}\n{body(3)}", "b") for k in range(3)]  # a host where the line is rare
    copied = f"{body(12)}\n{body(12)}"
    rows += [(300 + k, copied, "a") for k in range(60)]  # copies count once
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(rows)).collect()}
    assert all(got[k].kept and got[k].n_lost_words == 10 for k in range(40))
    assert not any(got[100 + k].kept for k in range(3)) and all(got[200 + k].kept for k in range(3)) and all(got[300 + k].kept for k in range(60))


def test_forest_is_held_out_accurate():
    x, y = secret_scan.labelled_findings(3000, seed=99)
    guess = np.array([np.mean([secret_scan.vote(t, r) for t in secret_scan.default_forest()]) for r in x]) >= 0.5
    assert (guess == y).mean() > 0.97 and guess[y].mean() > 0.96


def test_secret_scan(spark, make_docs):
    key, digest = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    rows = [(1, f'x token = "{key}" y {key} z'), (2, f'TOKEN = "{key.upper()}"!!'), (3, f"commit sha {digest} was merged"), (4, "card 9807915762804490 end"), (5, None), (6, ""), (7, "plain text"), (1, f'x token = "{key}" y {key} z'), (8, "a" * 100000)]
    got = secret_scan.secret_scan(make_docs(rows))
    assert native(got)
    found = [(r.doc_id, [c.value for c in r.findings], r.redacted) for r in got.select("doc_id", "findings", "redacted").collect() if r.doc_id != 8]
    one = (1, [key], f'x token = "{secret_scan.REDACTED}" y {secret_scan.REDACTED} z')
    want = [one, one, (2, [key.upper()], f'TOKEN = "{secret_scan.REDACTED}"!!'), (3, [], rows[2][1]), (4, [], rows[3][1]), (5, [], None), (6, [], ""), (7, [], "plain text")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    # the SQL form of the forest votes as the trees do
    for r in got.where("size(candidates) > 0").select(F.explode("candidates").alias("c")).select("c.*").collect():
        votes = [secret_scan.vote(t, r.features) for t in secret_scan.default_forest()]
        assert r.score == pytest.approx(100 * sum(votes) / len(votes))
    assert secret_scan.secret_scan(make_docs([])).count() == 0


def test_exponents(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    for target in (0.9, 1.0, 1.09):
        a = entropy_exponent(shares, target)
        w = np.array([0.7, 0.2, 0.1]) ** a
        w /= w.sum()
        assert -(w * np.log(w)).sum() == pytest.approx(target, abs=1e-4)
    assert entropy_exponent(shares, 2.0) == 0.0 and entropy_exponent(shares, 0.1) == 1.0
    a = repetition_exponent(10, 700, 2.0)
    assert 70 ** (1 - a) == pytest.approx(2.0) and repetition_exponent(5, 10, 2.0) == 0.0


def used(df, **options):
    times = {}
    for r in mix_sources(df, **options).collect():
        times.setdefault(r.source, []).append((r.mix_epoch, r.doc_id, len((r.text or "").split())))
    return times


def test_mixing(make_docs, monkeypatch):
    monkeypatch.setattr("cueforge.llm.mixing.BLOCK", 8)
    rng = random.Random(1)
    sizes = {"big": 300, "mid": 100, "small": 30}
    rows = [(k, " ".join(["w"] * rng.randint(1, 9)), s) for s, n in sizes.items() for k in range(n)] + [(1, None, "nothing"), (2, "a b", None)]
    docs = make_docs(rows)
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s and t) for s in sizes}
    got = used(docs, repetitions=2.0)
    assert {k: len([x for x in got["big"] if x[0] == k]) for k in (0, 1)} == {0: 300, 1: 0} and len(got["nothing"]) == 1
    assert all({d for e, d, _ in got[s] if e == 0} == set(range(n)) for s, n in sizes.items())
    p = {s: total[s] / (sum(total.values()) + 2) for s in sizes}
    spent = {s: sum(n for _, _, n in got[s]) for s in sizes}
    a = repetition_exponent(2, total["big"], 2.0)
    for s in sizes:
        budget = total["big"] * (p[s] / p["big"]) ** a
        assert budget - 9 <= spent[s] <= budget + 1
    small = used(docs, entropy=0.8, budget=500)
    assert 470 <= sum(n for x in small.values() for _, _, n in x) <= 501
    assert used(docs, repetitions=2.0) == got and mix_sources(make_docs([]), repetitions=2.0).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs)
    order = mix_sources(docs, repetitions=3.0).where("source = 'small'")
    runs = [[r.doc_id for r in order.where(f"mix_epoch = {e}").orderBy("mix_block", "mix_place").collect()] for e in (0, 1)]
    assert sorted(runs[0]) == list(range(30)) and [d for d in runs[0] if d in runs[1]] != runs[1] and 0 < len(runs[1]) < 30


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>First&nbsp; line<br>goes on.<p>Sec&eacute;nd</p><aside>Side</aside><form>Mail?</form><div id="comments"><p>Nice!</p></div></article><footer>F</footer>"""


def test_main_text():
    assert main_text(PAGE) == "A & B\nFirst line goes on.\nSecénd"
    for page, want in (
        (None, ""), ("", ""), ("<p></p>", ""), ("a &lt; b", "a < b"), ("<p>one<p>two", "one\ntwo"), ("<div>x <i>y</i>z</div>", "x yz"), ("<p>5 < 6 &amp;&amp; 7</p>", "5 < 6 && 7"),
        ("<ul><li><a href=x>Home</a><li><a href=y>About</a></ul>", ""), ("<article></article><p>Only this.</p>", "Only this."), ('<p class="advert">buy<p>stay', "stay"), ("<script>never closed", ""), ("<main>m</main><p>out</p>", "m"),
    ):
        assert main_text(page) == want


def test_text_of_pages_without_an_article():
    long = "A sentence that is long enough to count as text of a page, which menus never are, honestly. " * 2
    page = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><header>Top</header><div><p>{long}</p><p>Short.</p></div><nav>n</nav><div><a href=3>Three</a></div>"
    assert main_text(page) == f"{long.strip()}\nShort."


LONG = "A sentence that is long enough to count as text of a page, which menus never are, honestly."


@pytest.mark.parametrize("page, want", [
    (f'<div class="layout with-sidebar"><p>{LONG}</p></div>', LONG), (f'<div class="no-sidebar"><article><p>{LONG}</p></article></div>', LONG), (f'<div class="content"><div class="page-header"><p>{LONG}</p></div></div>', LONG),
    ("<article><header><h1>Head</h1></header><p>Body.</p></article>", "Head\nBody."), ('<article><h2 class="section-header">Sub</h2><p>Body.</p><p class="related-work">Rel.</p></article>', "Sub\nBody.\nRel."),
    (f'<article><p>One.</p><div class="comments-area"><p>{LONG}</p></div></article>', "One."), (f'<div><p>{LONG}</p></div><div id="disqus"><p>{LONG}{LONG}</p></div>', LONG),
    (f'<article class="teaser"><a href="x">Short</a></article><article><p>{LONG}</p></article>', LONG), (f"<main><p>In.</p><article><p>{LONG}</p></article></main>", f"In.\n{LONG}"),
])
def test_marks_are_hints(page, want):
    assert main_text(page) == want


def test_windows_find_the_article_without_its_mark(spark):
    """On every page of the smallest table, surge and dive bound the text that the article element marks."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert pages and all(main_text(re.sub(r"<(/?)article\\b", r"<\\1div", p)) == main_text(p) != "" for p in pages if p)


def test_regions_against_plain_python():
    rng = random.Random(4)
    for _ in range(300):
        size = [rng.choice((0, 0, 0, 5, 40, 200)) for _ in range(rng.randint(0, 25))]
        sums = [sum(size[k : k + WINDOW]) for k in range(len(size))]
        want, k = [], 0
        while k < len(size):
            if sums[k]:
                end = next((j for j in range(k, len(size)) if not sums[j]), len(size))
                want.append((k, end, max(sums[k:end])))
                k = end
            k += 1
        assert regions(size) == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "<p>é</p>", 7)], "page_id long, url string, html string, text int")
    got = sorted(map(repr, ((r.page_id, r.url, r.n_chars) for r in extract_text(pages).collect())))
    assert got == sorted(map(repr, [(1, "u", 32), (1, "u", 32), (2, None, 0), (None, "v", 1)])) and extract_text(pages.limit(0)).count() == 0


def brute_vectors(rows):
    good = {k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(rows[k][1]) for k in good}
    links = {k: {j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9} if k in good else set() for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        named = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), named, rows[k][0] == named))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr("cueforge.llm.embed_dedup.BLOCK", block)
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((12, 24))
    rows = [(k, (middle[k % 12] + rng.standard_normal(24) * rng.choice([0.05, 0.3, 1.0])).tolist()) for k in range(240)]
    rows += [(300 + k, rows[0][1]) for k in range(5)] + [(400, [0.0] * 24), (401, None), (402, [None] + [1.0] * 23), (403, [float("nan")] + [1.0] * 23), (404, [float("inf")] + [1.0] * 23), (405, []), (406, [1.0, 0.0]), (407, [2.0, 0.1]), (None, rows[3][1]), (7, rows[7][1])]
    rows += [(500, [-0.0, 1.0]), (501, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit(1)).withColumn("cells", F.lit(2))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_vectors(rows)))
    assert embedding_duplicates(table.limit(0)).count() == 0


def test_recall_of_the_index(spark, monkeypatch):
    """With many more centres than cells of a vector, links found are a part of all links, at least nine in ten, and never others."""
    assert [centre_count(n, 768) for n in (10, 10_000, 10**8, 10**9)] == [8, 78, 80_000, 252_976]
    monkeypatch.setattr("cueforge.llm.embed_dedup.PER_CENTRE", 4)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1200, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((600, 24))
    noise -= (noise * base[:600]).sum(1, keepdims=True) * base[:600]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.96, (600, 1))
    vectors = np.concatenate([base, c * base[:600] + np.sqrt(1 - c * c) * noise])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_duplicates(df).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert all(got[k] <= n for k, n in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum() > 1000


def test_long_boilerplate_lines(make_docs):
    rng = random.Random(6)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice = "This site uses cookies " + body(26)
    rows = [(k, f"{notice}\n{body(40)}", "a") for k in range(40)]
    rows += [(100 + k, f"{notice}\n{body(3)}", "a") for k in range(3)]  # depleted
    rows += [(200 + k, f"{notice}\n{body(3)}", "b") for k in range(3)]  # a host where the line is rare
    paragraphs = [body(30) for _ in range(5)]
    for k in range(60):  # near copies, each with another word in one paragraph
        own = list(paragraphs)
        own[k % 5] = own[k % 5].rsplit(" ", 1)[0] + f" x{k}"
        rows.append((300 + k, "\n".join(own), "a"))
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(rows)).collect()}
    assert all(got[k].kept and got[k].n_lost_words == 30 for k in range(40))
    assert not any(got[100 + k].kept for k in range(3)) and all(got[200 + k].kept for k in range(3)) and all(got[300 + k].kept and not got[300 + k].n_lost_words for k in range(60))


@pytest.mark.parametrize("most", [200_000, 0])
def test_boilerplate_lines_are_removed(make_docs, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_LINES", most)
    monkeypatch.setattr(quality, "BROADCAST_TEXTS", most)
    line = "All rights reserved, edition of 2020"
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    own = {k: " ".join(f"w{name(k)}x{name(j)}" for j in range(40)) for k in range(40)}
    rows = [(k, f" {line.upper()}\r\n{t}\n\nend {name(k)} x\n{line}", "a") for k, t in own.items()] + [(50, own[3], "a"), (51, None, "a")]
    got = quality.quality_rules(make_docs(rows), cleaned_col="text")
    assert native(got)
    found = {r.doc_id: (r.text, r.n_lost_words) for r in got.collect()}
    assert found == {k: (f"{t}\n\nend {name(k)} x", 12) for k, t in own.items()} | {50: (own[3], 0), 51: (None, 0)}


def test_secrets_after_an_equals_sign(make_docs):
    hexes, mixed, letters = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "wJalrXUtnFEMI4K7MDENGbPxRfiCYzEXAMqLEKEY", "qWmRzKxTbVnPLdHsYcGj"
    forms = ["TOKEN={}", "AWS_SECRET_ACCESS_KEY={}", "export API_TOKEN={}\nmore", "see https://x.io/cb?api_key={}&page=2 now", "password={};", "client_secret={}"]
    rows = [(10 * k + j, form.format(key)) for k, form in enumerate(forms) for j, key in enumerate((hexes, mixed, letters))]
    plain = ["the internationalization of bureaucratically", "token = my_secret_access_token_name", "AWS_SECRET_ACCESS_KEY= none", "=" * 40, "sha=da39a3ee5e6b4b0d3255bfef95601890afd80709", "https://x.io/a/b/c?page=12345678901234567890"]
    rows += [(900 + k, t) for k, t in enumerate(plain)]
    rows.append((999, f'secret = "{mixed}=="'))
    got = {r.doc_id: r.redacted for r in secret_scan.secret_scan(make_docs(rows)).collect()}
    assert {10 * k + j: got[10 * k + j] for k in range(len(forms)) for j in range(3)} == {10 * k + j: form.format(secret_scan.REDACTED) for k, form in enumerate(forms) for j in range(3)}
    assert [got[900 + k] for k in range(len(plain))] == plain and got[999] == f'secret = "{secret_scan.REDACTED}"'


def test_every_occurrence_of_a_secret_is_judged(make_docs):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    far = "some words of a text " * 20
    rows = [(1, f'commit sha {key} was merged. {far} token = "{key}" end'), (2, f"sha {key}0123456789abcdef {far} token = {key}"), (3, f"commit sha {key} {far} commit sha {key}"), (4, f"é😀 {key} {far}" * 300 + f'token = "{key}"')]
    scanned = secret_scan.secret_scan(make_docs(rows))
    assert native(scanned)
    got = {r.doc_id: (r.redacted, [c.value for c in r.candidates]) for r in scanned.collect()}
    assert all(got[i] == (t.replace(key, secret_scan.REDACTED), [key]) for i, t in rows if i in (1, 4)) and got[3][0] == rows[2][1]
    assert got[2][0].endswith(f"token = {secret_scan.REDACTED}")


def test_entropies_outside_the_sources_own(make_docs):
    sizes = {"a": 60, "b": 50, "c": 45, "d": 40}  # shares of an entropy of 1.376, near ln 4
    docs = make_docs([(k, "w w w w", s) for s, n in sizes.items() for k in range(n)])

    def entropy(**options):
        taken = np.array([sum(n for _, _, n in x) for x in used(docs, **options).values()], float)
        return -(taken / taken.sum() * np.log(taken / taken.sum())).sum()

    assert entropy(entropy=1.3) == pytest.approx(1.3, abs=0.01) and entropy(evenness=0.9) == pytest.approx(0.9 * math.log(4), abs=0.01)
    least = used(docs, entropy=1.3)
    assert all({d for e, d, _ in least[s] if e == 0} == set(range(n)) for s, n in sizes.items()) and {e for e, _, _ in least["d"]} == {0}
    with pytest.raises(ValueError, match="cannot be reached"):
        mix_sources(docs, entropy=1.5)
    assert mix_sources(make_docs([]), entropy=1.0).count() == 0


def scan_in_python(text):
    """The findings and redacted text of a plain scan: every candidate in order, its features, and the votes of the trees."""
    pattern = re.compile(secret_scan.CANDIDATE)
    found = [(m.start(), m.end(), m[0]) for m in pattern.finditer(text or "")]
    best = {}
    for a, b, value in found:
        if not re.search("[A-Za-z0-9]{8}", value):
            continue
        before, after = text[max(0, a - secret_scan.BESIDE) : a], text[b : b + secret_scan.BESIDE]
        size = len(value)
        classes = re.sub("[0-9]+", "0", re.sub("[a-z]+", "l", re.sub("[A-Z]+", "U", value)))
        has = lambda words: float(any(w in before.lower() for w in words))
        row = [
            size, sum(c in "0123456789" for c in value) / size, len(classes) / size, (size - len(re.sub("|".join(secret_scan.COMMON), "", value.lower()))) / size,
            float(bool(re.search(r"[/.].*[/.]", value) or re.search(r"(?:://|[@\\])[^\s?#]*$", before))), has(secret_scan.SECRET_WORDS), has(secret_scan.OTHER_WORDS),
            float(bool(re.search(r"[=:]\s*[\"']?$", before) and re.search(r"^(?:[\"',;\s!&#)}\]<`]|$)", after))),
        ]
        forest = secret_scan.default_forest()
        best[value] = max(best.get(value, 0.0), 100 * sum(secret_scan.vote(t, row) for t in forest) / len(forest))
    secrets = {v for v, score in best.items() if score >= secret_scan.VOTES - 1e-9}
    out, at = [], 0
    for a, b, value in found:
        out += [text[at:a], secret_scan.REDACTED if value in secrets else value]
        at = b
    return secrets, text and "".join([*out, text[at:]])


def test_secret_scan_against_plain_python(make_docs):
    rng = random.Random(5)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    full = string.ascii_letters + string.digits
    keys = [pick("0123456789abcdef", 40) for _ in range(6)] + [pick(full, rng.randint(16, 44)) for _ in range(6)]
    forms = ['token = "{}"', "API_KEY={}", "commit sha {} was", "https://u:{}@host/x", "see /usr/lib/{}/x.bin", "file {}.bin", "{}", "id={} checksum", "password: {};"]
    rows = [(k, " ".join(rng.choice(forms).format(rng.choice(keys)) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    # a longer key that begins with another, and a clean name that holds one
    rows += [(100, f'token = "{keys[0]}" and token = "{keys[0]}9c1d77aa" and file {keys[0]}.bin'), (101, None), (102, ""), (103, "plain")]
    scanned = secret_scan.secret_scan(make_docs(rows))
    assert native(scanned)
    got = {r.doc_id: ({c.value for c in r.findings}, r.redacted) for r in scanned.collect()}
    assert got == {i: scan_in_python(t) for i, t in rows}
    assert keys[0] + ".bin" in got[100][1] and "9c1d77aa" not in got[100][1]


def test_many_candidates_take_linear_time(make_docs):
    rng = random.Random(6)
    text = " ".join(f'token = "{"".join(rng.choices("0123456789abcdef", k=32))}"' for _ in range(20_000))
    docs = make_docs([(1, text)]).persist()
    secret_scan.secret_scan(make_docs([(1, text[:4000])])).select("redacted").collect()
    began = time.perf_counter()
    [row] = secret_scan.secret_scan(docs).select("redacted").collect()
    assert row.redacted.count(secret_scan.REDACTED) == 20_000 and time.perf_counter() - began < 60
