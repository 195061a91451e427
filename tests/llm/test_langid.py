import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import langid
from tests.llm.support import edge_docs, empty_docs

SCHEMA = "doc_id long, text string, markup string, address string"
WORDS = {"de": "und der die nicht werden über schön straße haus ich", "en": "the and with from house this that have would there", "es": "que los una por señor casa ción esto para donde", "fr": "les des une pour être maison cette avec où très"}


def bucket(a, b, c):
    value = ((a << 16) | (b << 8) | c) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    return value >> (64 - langid.BUCKET_BITS)


def trigrams(text):
    raw = (text or "").encode()
    fold = [32 if x in (9, 10, 11, 12, 13, 32) else x + 32 if 65 <= x <= 90 else x for x in raw]
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122 or x > 127
    fold = [32, *fold, 32]
    return [bucket(*fold[i:i + 3]) for i in range(len(raw)) if letter(raw[i])]


def parts(address):
    host = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", address or "").group(1).lower()
    bits = host.split(".")
    return host, ".".join(bits[-2:]) if len(bits) > 1 and all(bits[-2:]) else host, bits[-1] if len(bits) > 1 and bits[-1] else ""


def brute(rows, languages=langid.LANGUAGES):
    """The fusion with dictionaries, one row at a time."""
    names = [*languages, "und"]
    model = {x: Counter() for x in names}
    declared = []
    for _, text, markup, _ in rows:
        code = (re.match(r"[A-Za-z]+", (markup or "").strip()) or [""])[0].lower()
        declared.append(code if code in languages else "")
        if declared[-1]:
            model[declared[-1]].update(trigrams(text))
    size = {x: sum(model[x].values()) + 0.5 * 2**langid.BUCKET_BITS for x in names}
    fits, guesses = [], []
    for _, text, _, _ in rows:
        grams = trigrams(text)
        share = min(len(grams), langid.EVIDENCE) / max(1, len(grams))
        fit = [share * sum(math.log((model[x][g] + 0.5) / size[x]) for g in grams) for x in names]
        fits.append(fit)
        guesses.append("und" if not grams else names[int(np.argmax(fit))])
    levels = [defaultdict(Counter) for _ in range(3)]
    for (_, _, _, address), g in zip(rows, guesses):
        host, domain, suffix = parts(address)
        for level, key in zip(levels, (suffix, (domain, suffix), (host, domain, suffix))):
            level[key][g] += 1
    told, overall = defaultdict(Counter), Counter(guesses)
    for d, g in zip(declared, guesses):
        told[d][g] += 1
    known = sum(overall[x] for x in languages)
    out = []
    for (doc_id, text, _, address), d, g, fit in zip(rows, declared, guesses, fits):
        host, domain, suffix = parts(address)
        logs = []
        for x, f in zip(names, fit):
            own = g == x
            p = langid.UND_PRIOR if x == "und" else (overall[x] + 1) / (known + len(languages)) * (1 - langid.UND_PRIOR)
            for level, key, lean in zip(levels, (suffix, (domain, suffix), (host, domain, suffix)), (langid.LEAN_SUFFIX, langid.LEAN_DOMAIN, langid.LEAN_HOST)):
                p = (level[key][x] - own + lean * p) / (sum(level[key].values()) - 1 + lean)
            q = (told[d][x] - own + 0.5) / (sum(c[x] for c in told.values()) - own + 0.5 * (len(languages) + 1))
            logs.append(f + math.log(p) + math.log(q))
        top = max(logs)
        posterior = 1 / sum(math.exp(v - top) for v in logs)
        language = names[logs.index(top)] if trigrams(text) and posterior >= langid.ACCEPT else "und"
        out.append((doc_id, language, posterior, g, d, host, len(trigrams(text)), language != "und"))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[6], r[4])
    got, want = sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[3:] == w[3:] and abs(g[2] - w[2]) < 1e-9, (g, w)


def corpus(seed=1, n=200):
    rng = np.random.default_rng(seed)
    rows, hosts = [], [("http://Blog.Example.de:80/x", "de"), ("https://user@a.b.example.fr/?q", "fr"), ("example.com", "en"), ("src1", "es"), (None, "en")]
    for i in range(n):
        address, home = hosts[int(rng.integers(5))]
        x = home if rng.random() < 0.8 else str(rng.choice(list(WORDS)))
        text = " ".join(rng.choice(WORDS[x].split(), int(rng.integers(1, 12))))
        markup = [f"{x}-XX", x.upper(), None, "tlh", str(rng.choice(list(WORDS)))][int(rng.integers(5))]
        rows.append((i, text, markup, address))
    return rows


def test_against_dictionaries(spark):
    rows = [*corpus(), (900, None, "de", "x.de"), (901, "", None, None), (902, "12 34 !!", "en", "example.com"), (903, "zq" * 4000, None, "a..b"), (3, rows_text := "the and with", "en", "src1"), (3, rows_text, "en", "src1"), (None, "les des une", "fr", "http://x.fr")]
    same(langid.identify(spark.createDataFrame(rows, SCHEMA).repartition(5)), brute(rows))


def test_host_and_markup_decide_a_text_that_fits_two_languages(spark):
    rows = [(i, WORDS[x], x, f"http://www.site.{x}/") for i, x in enumerate(list(WORDS) * 20)]
    rows += [(500, "la", None, "http://www.site.fr/"), (501, "la", None, "http://www.site.es/"), (502, "la", "es", None), (503, "la", "fr", None)]
    got = {r["doc_id"]: r["language"] for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[500] == got[503] == "fr" and got[501] == got[502] == "es"


def test_real_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(langid.of_documents(docs)).collect()}
    long = [r for r in docs.collect() if len(r["text"]) > 60]
    assert sum(got[r["doc_id"]]["language"] == r["lang"] for r in long) > 0.99 * len(long)
    assert sum(got[r["doc_id"]]["text_language"] == r["lang"] for r in long) > 0.97 * len(long)


def test_random_bytes_are_no_language(spark):
    rng = np.random.default_rng(6)
    rows = [(-1 - i, "".join(chr(c) for c in rng.integers(33, 1200, 300)), None, "src1") for i in range(5)]
    docs = langid.of_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"]: r["accepted"] for r in langid.identify(docs.unionByName(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert not any(got[-1 - i] for i in range(5)) and sum(got.values()) > 0.98 * len(got)


def test_edges(spark):
    got = langid.identify(langid.of_documents(edge_docs(spark)))
    assert got.count() == edge_docs(spark).count()
    assert {r["doc_id"] for r in got.where("not accepted").collect()} >= {3, 4, 5}
    assert langid.identify(langid.of_documents(empty_docs(spark))).count() == 0


@pytest.mark.parametrize("html,markup,text", [('<html LANG="de-AT"><p>und</p>', "de-AT", " und "), ("<html><script>x</script><!-- y --><b>a", "", "  a"), (None, "", "")])
def test_page_evidence(spark, html, markup, text):
    row = langid.of_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert row["markup"] == markup and row["text"].split() == text.split()
