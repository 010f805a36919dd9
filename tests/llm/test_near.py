"""Near copies, leaks, lines and toxicity against brute force, and the pipeline's stages."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from test_shingles import brute_kept

from stratalog.llm import common, components, decontamination, line_dedup, packing, simhash, toxicity


def brute_simhash(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", folded)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def test_simhash_of_texts():
    rng = random.Random(1)
    texts = ["", " \t\n", "A b C", "É é ÉA x y", "one two three four five"] + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (3, 4, 5, 100, 40_000)]
    assert [simhash.simhash(t) for t in texts] == [brute_simhash(t) for t in texts[:-1]] + [simhash.simhash(texts[-1])]
    assert simhash.simhash(" ".join(["w"] * 5000)) == xxhash.xxh64_intdigest(b"w w w w", 42)


def test_near_groups_on_awkward_rows(spark, awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    prints = [brute_simhash(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min([i for i in (least.get(root), r["doc_id"]) if i is not None], default=None)
    want = sorted([(r["doc_id"], f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots)], key=repr)
    found = simhash.near_groups(awkward)
    assert sorted([tuple(r)[:3] for r in found.collect()], key=repr) == want
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(roots))
    assert simhash.near_groups(nothing).count() == 0 == simhash.keep_one(nothing).count()


def test_links_connect_all_that_are_near(spark):
    rng = np.random.default_rng(2)
    centres = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    prints = set(centres)
    for k, centre in enumerate(centres):
        for _ in range(2600 if k == 0 else int(rng.integers(0, 30))):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long").repartition(4)
    links = simhash.near_links(nodes)
    assert links.count() < 12 * len(prints), "no pairs within a group"
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = brute_components(prints)
    groups, wanted = {}, {}
    for p, w in zip(prints, want):
        groups.setdefault(roots.get(simhash._signed(p), simhash._signed(p)), set()).add(p)
        wanted.setdefault(w, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_schemes_hold_every_link():
    for n in (1, 10**4, 10**7, 10**12, 10**18):
        blocks, kept = simhash.scheme(n)
        assert blocks - kept >= simhash.MAX_BITS
        masks = simhash.block_masks(blocks, kept)
        rng = random.Random(n)
        for _ in range(50):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in masks)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)] + [(300, 300 + k) for k in range(1, 50)]
    edges = spark.createDataFrame([*chain, (None, 1)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, 41)}, 101: 100, **{300 + k: 300 for k in range(1, 50)}}
    assert components.connected_components(edges.limit(0)).count() == 0


# --- decontamination

ITEMS = [
    (1, "On a farm near Tom lives a cow, Sam has 12 apples and gives Joe 3 apples, how many apples does Sam have left"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards box"),
    (3, "tiny item"),
    (4, None),
    (5, ""),
]
LEAKS = {
    10: (ITEMS[0][1], {1}),
    11: ("intro words here. " + ITEMS[0][1].replace("Sam", "Mary").replace("Tom", "Bob").replace("Joe", "Anna").replace("12", "17.5").replace("3", "1,000") + " outro", {1}),
    12: (ITEMS[0][1].replace("Sam have", "Zed have").replace("Sam", "Mary"), set()),
    13: (ITEMS[1][1].upper().lower() + "! and more", {2}),
    14: ("The QUICK, brown fox jumps -- over the lazy dog; while seven wizards box", {2}),
    15: ("the quick brown fox jumps over", set()),
    16: ("a tiny item of text", {3}),
    17: ("tiny little item", set()),
    18: (None, set()),
    19: ("", set()),
    20: ("filler " * 20_000 + ITEMS[1][1], {2}),
}


def test_leaks(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in LEAKS.items()] + [(10, ITEMS[0][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find_leaks(docs, items).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == {k: s for k, (_, s) in LEAKS.items() if s}
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in found}
    assert kinds[10, 1] == "copy" and kinds[11, 1] == "template" and len(found) == len(kinds)


def test_leaks_match_brute_force_on_the_tables(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, items).collect()}
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    texts = {r["doc_id"]: runs(r["text"]) for r in docs.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, s in texts.items() if r["text"] and len(runs(r["text"]) & s) >= 0.8 * len(runs(r["text"]))}
    assert found == want and found


def test_leaks_on_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_leaks(awkward, items).count() == 0
    assert decontamination.find_leaks(nothing, items).count() == 0
    assert decontamination.find_leaks(awkward, items.limit(0)).count() == 0


def test_templates_keep_their_words_in_step(spark):
    texts = ["In 3.5kg of x, John Smith and Mary paid 1,000 dollars. Then 2 days, A9b 22 McDonald 7%.", "", "É Ü ñ 5 miles"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decontamination.template_words(F.col("t")).alias("a"), decontamination.raw_words(F.col("t")).alias("b")).collect()
    assert all(len(r["a"]) == len(r["b"]) for r in rows)
    assert rows[0]["a"][:6] == ["in", "0", "1", "of", "x", "2"] and rows[2]["a"][-2:] == ["0", "1"]


# --- lines


AROUND = " \t\x0b\x0c\r"


def brute_lines(rows, ratio, least):
    pages, seen = {}, {}
    for host, text in rows:
        pages[host or ""] = pages.get(host or "", 0) + 1
        for line in {x.strip(AROUND) for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] = seen.get((host or "", line), 0) + 1
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return ["\n".join(x for x in (t or "").split("\n") if (h or "", x.strip(AROUND)) not in gone) for h, t in rows]


@pytest.mark.parametrize("few", [True, False])
def test_lines(spark, awkward, nothing, monkeypatch, few):
    if not few:
        monkeypatch.setattr(line_dedup, "small", lambda df: False)
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", "menu\t", "\x0cmenu\r", "", "\t", "foot", f"own {k}", f"x{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(100, "c", "menu\nmenu"), (101, "a", None), (102, "a", "menu\n" + "long " * 100_000), (102, "a", "menu\n" + "long " * 100_000)]
    frame = spark.createDataFrame(rows, "k int, h string, t string").withColumns({c: F.lit(1) for c in ("mark", "__text", "__lines", "site__", "marks__", "part__", "pages")}).repartition(3)
    cut = line_dedup.drop_site_lines(frame, F.col("h"), F.col("t"), 0.3, 3)
    assert cut.columns == [*frame.columns, "kept_text", "n_lines", "n_dropped"] and cut.filter("__text = 1 and site__ = 1").count() == len(rows)
    assert sorted((r["k"], r["kept_text"]) for r in cut.collect()) == sorted(zip([r[0] for r in rows], brute_lines([r[1:] for r in rows], 0.3, 3)))
    with pytest.raises(ValueError):
        line_dedup.drop_site_lines(cut, F.col("h"), F.col("t"))
    cut = line_dedup.drop_site_lines(awkward, awkward["source"], awkward["text"], 0.3, 2, ("a", "b", "c"))
    assert cut.count() == awkward.count() and line_dedup.drop_site_lines(nothing, nothing["source"], nothing["text"], names=("a", "b", "c")).count() == 0


def test_pages(spark):
    page = "<html><title>T</title><script>var t='</p>';</script><nav><li>Home</li></nav><p>own {}</p></html>"
    rows = [(k, f"https://A.example/{k}?x", page.format(k)) for k in range(6)] + [(9, None, None)]
    found = {r["page_id"]: r for r in line_dedup.dedup_page_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3]["host"] == "a.example" and (found[3]["n_lines"], found[3]["n_dropped"]) == (3, 2)
    assert found[3]["text"].strip() == "own 3" and (found[9]["host"], found[9]["text"]) == ("", "")


def test_awkward_pages(spark):
    long = "<p>menu</p>" + "<p>w</p>" * 20_000
    rows = [(1, "https://a/1", long), (1, "https://a/1", long), *[(k, "https://a/x", "<p>menu\t</p><p>own</p>" + str(k)) for k in range(2, 6)], (None, None, None), (7, "", "")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, site long, mark long")
    found = line_dedup.dedup_page_lines(pages).collect()
    assert len(found) == len(rows) and all("menu" not in r["text"] for r in found)
    assert sorted(r["n_dropped"] for r in found if r["page_id"] == 1) == [1, 1] and line_dedup.dedup_page_lines(pages.limit(0)).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    ordinary = ["the", "river", "stone", "walking", "evening", "market", "under", "garden", "little", "bread", "window", "morning"]
    rows, labels = [], []
    for k in range(700):
        words = [rng.choice(ordinary) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 120))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["grobnik", "vexlor", "snarfle"]) + rng.choice(["", "en", "um"]))
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(labelled, awkward):
    docs, labels = labelled
    scored = toxicity.score_documents(docs, labels).join(labels.dropna(), "doc_id")
    held = scored.filter("held_out").collect()
    assert len(held) > 80 and sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_toxicity_never_sees_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_documents(docs, labels) == toxicity.fit_documents(docs, flipped)


def test_gains_match_plain_compression(labelled):
    docs, labels = labelled
    model = toxicity.fit_documents(docs, labels)
    ordinary, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    for text in ("the river and vexlor under stones", "one", "", "Bread!! " * 200_000):
        words = re.findall(rb'[^\s.,!?;:#$%&*|"()<>\[\]{}=+/\\]+', text.lower().encode())
        pairs = [words[k : k + 2] for k in range(max(1, len(words) - 1))] if words else []
        framed = [toxicity.CARRIER + b" " + b" ".join(p) + b" " + toxicity.TAIL for p in pairs[:50]]
        gauge = toxicity.Gauge(model.ordinary, model.toxic)
        assert gauge.gains(toxicity.windows(text)[:50]).tolist() == [len(ordinary.compress(f)) - len(toxic.compress(f)) for f in framed]
        gains = gauge.gains(toxicity.windows(text)[:500]).tolist()
        pairs = sorted((min(p), max(p)) for p in (zip(gains, gains[1:]) if len(gains) > 1 else zip(gains, gains)) if min(p) > 0)
        one, two = gauge.pairs(words[:501])
        assert sorted((min(p), max(p)) for p in zip(one.tolist(), two.tolist())) == pairs
        assert 0 <= toxicity.score_text(model, text) <= 1
    assert toxicity.score_text(model, "the river vexlor and grobnik walking") > toxicity.score_text(model, "the river stone and garden walking")


def test_toxicity_does_not_depend_on_the_order_of_rows(labelled):
    docs, labels = labelled
    twice = docs.unionByName(docs).orderBy(F.desc("doc_id")).repartition(5)
    assert toxicity.fit_documents(docs, labels) == toxicity.fit_documents(twice, labels.unionByName(labels))


def test_toxicity_on_awkward_rows(labelled, awkward, nothing):
    docs, labels = labelled
    assert toxicity.score_documents(awkward, labels).filter("score between 0 and 1").count() == awkward.count()
    assert toxicity.score_documents(nothing, labels).count() == 0
    one = toxicity.score_documents(awkward, labels.filter("toxic = 0"))
    assert one.select("score").distinct().count() == 1


# --- pipeline


def test_stages_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        after = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if name != "line_dedup":
            assert after <= before, name
        if name == "near_dedup":
            assert {k for k, _ in after} == brute_kept(sorted(before))
        sizes.append(docs.count())
    assert sizes[1] > 0.7 * sizes[0] and sizes[2] == sizes[1] >= sizes[3] >= sizes[4] > 0.5 * sizes[0]
    pieces = corpus_pipeline.pack_windows(spark, docs, small)
    ran = corpus_pipeline.run(spark, small)
    assert ran.columns == pieces.columns and ran.agg(F.sum("length")).first() == pieces.agg(F.sum("length")).first()


@pytest.mark.parametrize("which", ["awkward", "nothing"])
def test_stages_on_awkward_rows(spark, small, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.pack_windows(spark, docs, small).count() >= docs.select("doc_id").count()


def test_texts_go_to_python_in_short_batches(spark, small, monkeypatch):
    """What scores and tokenises texts is run within the stage, a few rows a batch."""
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def noted(df, table):
        held.append((table, int(spark.conf.get(name))))
        return common.stored(df, table)

    for module in (corpus_pipeline, toxicity, packing):
        monkeypatch.setattr(module, "stored", noted, raising=False)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, small)
    scores = toxicity.score_documents(docs, spark.read.parquet(f"{small}/labels.parquet"))
    packing.tokenise(docs, 1024, packing.default_vocabulary(), "doc_id", "text")
    assert [table for table, _ in held] == ["ordinary", "scores", "tokens"]
    assert all(rows <= common.BATCH_ROWS for _, rows in held) and spark.conf.get(name) == before
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (kept, scores)]
    assert not any("Python" in plan for plan in plans)
    assert kept.count() == scores.filter("score < 0.5").count()
