"""Phrases, spelling variants and URL filters against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stratalog.llm import phrases, spelling, url_filter

# --- phrases


def brute_phrases(rows, least, longest, inside, most):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= least}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        around = [f for (other, longer), f in frequent.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * f >= inside * a for f in around):
            continue
        cuts = [(phrases.MILLION * a * a // (frequent[lang, words[:k]] * frequent[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), frequent[lang, words[:k]], frequent[lang, words[k:]]))
    ranked, places = set(), Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        places[lang] += 1
        if places[lang] <= most:
            ranked.add((lang, places[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return ranked


def phrase_rows(frame):
    found = [tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(found) == len(set(found))
    return set(found)


def prose(seed, n, words="ab ba Ab é x, y. the of in\t! new york"):
    rng, known = random.Random(seed), words.split(" ")
    return " ".join(rng.choice(known) for _ in range(n))


@pytest.mark.parametrize(("bits", "slice_bytes", "longest"), [(1 << 20, 4 << 20, 3), (64, 50, 3), (1 << 12, 200, 4)])
def test_phrases(spark, monkeypatch, bits, slice_bytes, longest):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    rows = [(random.Random(k).choice(["en", "de", None, "und", ""]), prose(k, k * 3)) for k in range(60)] + [("en", None), (None, None), ("de", ""), ("en", " \t\n. ,")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute_phrases(rows, 10, longest, 50, 25)
    assert len(want) > 40
    assert phrase_rows(phrases.mine_phrases(docs, longest=longest, most=25, filter_bits=bits)) == want


def test_phrases_on_awkward_rows(awkward, nothing):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert phrase_rows(phrases.mine_phrases(awkward)) == brute_phrases(rows, 10, 3, 50, 2000)
    assert phrases.mine_phrases(nothing).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 10**13 + 9, 10**14 + 1), (3, 3, 3), (999_999_999_989, 10**12, 10**12), (10, 11, 13)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {tuple(r) for r in got} == {(a, x, y, phrases.MILLION * a * a // (x * y)) for a, x, y in rows}


# --- spelling variants


def brute_words(rows):
    found = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def variant_rows(frame):
    found = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found))
    return set(found)


def misspelt(seed, n):
    """Texts of few stems, mangled, with very different frequencies."""
    rng = random.Random(seed)
    stems = ["internal", "Interval", "aaaaaaa", "éclairée", "ÿÿÿÿÿÿ÷", "x" * 90, "colour", "internationalisation"]
    out = []
    for _ in range(n):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abxé") + w[at:], w[:at] + rng.choice("abxé") + w[at + 1 :]])
        out.append(w)
    return rng.choice([" ", "-", "1", "\n"]).join(out)


@pytest.mark.parametrize("block", [1, 3, 48])
def test_spelling_variants(spark, block):
    rows = [(k, misspelt(k, 400)) for k in range(60)] + [(None, misspelt(7, 300)), (61, None), (62, "")]
    rows += [(100 + k, "colour " * 30 * 5**k + "colourr " * 6 * 5**k) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] != r[2] for r in want if r[1]) and len(want) > 150
    assert variant_rows(spelling.group_variants(docs, block=block)) == want


def test_chains_of_forms(spark):
    """Each word's form is the next; roots are found in a logarithm of rounds."""
    chain = ["abcdefgh" + "z" * k for k in range(9)]
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {tuple(r) for r in spelling.roots(links, rounds=5).collect()} == {(w, chain[-1]) for w in chain[:-1]}


def test_blocks_are_bounded(spark):
    """A prefix that a third of all words share is divided until blocks are small."""
    rng = random.Random(3)
    words = {"common" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)} | {"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(600)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = spelling.blocks(table, 12).groupBy(*spelling.KEY).count()
    assert sizes.filter("count > 12 and hi - lo > 1").isEmpty() and sizes.agg(F.max("count")).first()[0] < 100
    want = {p for a, b in combinations(sorted(words), 2) if one_edit(a, b) for p in ((a, b), (b, a))}
    found = [(r["word"], r["near"]) for r in spelling.near_words(table, 12).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_variants_on_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert variant_rows(spelling.group_variants(awkward)) == brute_variants(rows)
    assert spelling.group_variants(nothing).count() == 0


# --- URL filters


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def brute_urls(urls, rules):
    u = url_filter
    known = [u.Rule.parse(r) for r in rules]
    rows = []
    for url in urls:
        host, path = parts_of(url)
        fits = [r for r in known if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = min(fits, key=lambda r: (-len(r.name), r.name, r.verdict), default=None)
        shape = [re.sub("[0-9]+", "#", s) for s in re.sub("^/", "", path).split("/")]
        shape = tuple(shape[: u.DEPTH] + ["**"] if len(shape) > u.DEPTH else shape)
        rows.append((host, path, rule, shape))

    def tree(keyed):
        names = dict.fromkeys(keyed, "")
        for level in range(u.DEPTH):
            seen, total = Counter(), Counter()
            for (root, shape), n in keyed.items():
                if len(shape) > level:
                    seen[root, names[root, shape], shape[level]] += n
                    total[root, names[root, shape]] += n
            for root, shape in keyed:
                if len(shape) > level:
                    n = seen[root, names[root, shape], shape[level]]
                    own = n >= u.LEAST_ADDRESSES and n >= u.LEAST_SHARE * total[root, names[root, shape]]
                    names[root, shape] = (names[root, shape], shape[level] if own else "*")
            names = {k: "/".join(v) if isinstance(v, tuple) else v for k, v in names.items()}
        return {k: v + "/**" if len(k[1]) > u.DEPTH else v for k, v in names.items()}

    own = tree(Counter((h, s) for h, _, _, s in rows))
    every = tree(Counter(("", s) for _, _, _, s in rows))
    hits, seen = Counter(), Counter()
    for host, _, rule, s in rows:
        for key in (("own", host, own[host, s]), ("host", host), ("every", every["", s]), ("all",)):
            hits[key] += rule is not None and rule.verdict == "block"
            seen[key] += rule is not None
    smooth = lambda b, n, prior: (b + u.PRIOR_WEIGHT * prior) / (n + u.PRIOR_WEIGHT)
    branch, pooled_hits, pooled_seen = {}, Counter(), Counter()
    for host, template in {(h, own[h, s]) for h, _, _, s in rows}:
        b, n, hb, hn = hits["own", host, template], seen["own", host, template], hits["host", host], seen["host", host]
        branch[host, template] = template if n == 0 or abs(b * hn - n * hb) > u.ERRORS * (n * hb * (hn - hb)) ** 0.5 else "*"
        pooled_hits[host, branch[host, template]] += b
        pooled_seen[host, branch[host, template]] += n
    overall = hits["all",] / seen["all",] if seen["all",] else 0.0
    out = []
    for host, path, rule, s in rows:
        key = host, branch[host, own[host, s]]
        prior = smooth(hits["every", every["", s]], seen["every", every["", s]], overall)
        score = smooth(pooled_hits[key], pooled_seen[key], prior)
        out.append((host, path, rule and rule.name, rule.verdict if rule else "block" if score > u.LIMIT else "allow", own[host, s]))
    return Counter(out)


ADDRESSES = [
    None, "", "no scheme", "http://", "://", "http://?q", "HTTP://EXAMPLE.ORG", "http://Example.ORG/es/1", "http://www.example.org/en/17?x://y", "http://notexample.org/en/1", "http://org/x", "http://a.org?z=/es/",
    "http://com/fr/", "http://x.com/de/9#y", "http://x.com/de", "http://ÄB.com/fr/é", "a://b://c/d", "http://h/a/b/c/d/e/f/g", "http://h/a//b/", "http://h/" + "x" * 20_000, "http://h/" + "a/" * 3_000, "http://u:p@h:80/a\nb",
]


@pytest.mark.parametrize("rules", [url_filter.RULES, (), ("block net/", "allow x.net/", "allow x.net/a", "block x.net/ab", "block example.com/en/9")])
def test_url_filter(spark, rules):
    rng = random.Random(11)
    hosts = ["hot.example.com"] * 6 + ["a.org", "x.example.org", "y.net", "x.net", "z.example.net", "q.com"]
    urls = ADDRESSES + [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr', 'a'])}/{rng.choice(['', 'p', 'tag/'])}{rng.randrange(2000)}{rng.choice(['', '', '/', '.html', '?q=1'])}" for _ in range(1500)]
    urls += [f"https://hot.example.com/blog/post-{'abcdefghij'[k % 10]}{chr(97 + k // 10)}" for k in range(200)] + urls[:30]
    pages = spark.createDataFrame([(k if k % 50 else None, x, "h", "v", "s", 1) for k, x in enumerate(urls)], "page_id long, url string, host string, verdict string, shape string, n long").repartition(3)
    found = url_filter.judge_urls(pages, rules)
    rows = found.collect()
    assert Counter((r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in rows) == brute_urls(urls, rules)
    assert sorted(filter(None, (r["page_id"] for r in rows))) == [k for k in range(len(urls)) if k % 50]


def test_pure_templates_are_rejected(spark):
    """Hosts without a rule follow what rules say of the same templates elsewhere."""
    urls = [f"http://{h}.example.org/es/{k}" for h in "abc" for k in range(20)] + [f"http://{h}.example.net/{lang}/{k}" for h in "de" for lang in ("es", "fr") for k in range(20)]
    found = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    verdicts = {(r["host"], r["path"].split("/")[1]): r["verdict"] for r in found.collect()}
    assert verdicts["d.example.net", "es"] == "block" and verdicts["d.example.net", "fr"] == "block"  # fr: nothing but the overall share is known


def test_url_filter_of_nothing(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.Rule.parse("deny org/")
