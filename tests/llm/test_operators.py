"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = r"[^\x20\x09-\x0D]+"
DDL = "doc_id long, text string, lang string, source string, n_chars long, size string, _lane int, shard int"
DICE = random.Random(5)
WORDS = ["".join(DICE.choice("abcdefgh") for _ in range(DICE.randrange(2, 7))) for _ in range(400)]


def prose(n, dice):
    return " ".join(dice.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(9)
    base = [prose(dice.randrange(5, 80), dice) for _ in range(60)]
    texts = list(base)
    for t in base[:15]:  # near copies, exact copies, case variants
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), t, t.upper()]
    shared = prose(12, dice)
    texts += [f"{prose(30, dice)} {shared}" for _ in range(12)]
    texts += ["", None, " \n\t ", "one", "one", "two words", prose(6000, dice), "é漢🙂 <|endoftext|> it's\n\n  they'll", "x" * 3000]
    out = [(i * 3, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), "s", 7, -1) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "no id here at all now", "en", "a", 0, "s", 7, -1), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def key(x):
    return tuple(str(v) for v in x)


def test_jaccard_components(docs, rows, nothing):
    from loomtype.llm.shingles import keep_one, near_duplicate_components

    up = {i: i + 32 for i in range(65, 91)}
    sets = []
    for r in rows:
        w = re.findall(WORD, (r[1] or "").translate(up))
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else []))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, s, r in zip(group, sets, rows):
        if s and r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    expected = [(r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group)]
    got = [tuple(r) for r in near_duplicate_components(docs).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    kept = keep_one(docs).collect()
    empty = sum(not s for s in sets)
    assert len(kept) == len({g for g, s in zip(group, sets) if s}) + empty
    assert near_duplicate_components(nothing).count() == 0


def test_shards_match_the_mixture(docs, rows, nothing):
    from loomtype.llm.sharding import interleave_shards

    got = interleave_shards(docs, 6, per_lane=10).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 6
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source in ("a", "b", "c", None):
        per = [sum(r["shard"] == s and r["source"] == source for r in got) for s in sizes]
        assert max(per) - min(per) <= 2
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert interleave_shards(nothing, 6).count() == 0


def test_mix_reaches_targets(docs, rows, nothing):
    from loomtype.llm.mixing import mix_sources

    mix = mix_sources(docs, block=8, keep_text=True)
    got = mix.taken().collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(re.findall(WORD, r[1] or ""))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # reshare what is above three times a source's size
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 8 + 0.01 * target[s]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    texts = mix.texts()
    assert texts.columns == docs.columns
    assert sum(len(re.findall(WORD, r["text"])) for r in texts.collect()) == sum(r["taken"] for r in got)
    counts = mix.shard_counts().groupBy("source").sum("count").collect()
    assert {r[0]: r[1] for r in counts} == {r["source"]: r["slots"] for r in mix.plan.collect() if r["slots"]}
    assert mix_sources(nothing).taken().count() == 0


def test_permutation_is_a_bijection(spark):
    from loomtype.llm.mixing import permuted

    for n in (1, 2, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).selectExpr("id", f"{n}L AS n", "3L AS k").select(permuted("id", "n", "k", 5).alias("x")).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    from loomtype.llm.packing import pack, sequences

    library = Tokenizer.from_file(tokenizer())
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows if r[0] is not None}
    got = pack(docs, tokenizer(), keep_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for doc, own in ids.items():
        parts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]})
        assert sum(p[2] for p in parts) == len(own) and all(p[2] == 1024 for p in parts[1:])
        for _, start, length, crc in parts:
            assert crc == zlib.crc32(np.array(own[start : start + length], "<u4").tobytes())
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) * 1.25 + 1
    assert sequences(pack(docs, tokenizer(), keep_ids=True)).count() == len(bins)
    assert pack(nothing, tokenizer()).count() == 0


def test_bin_plan_against_best_fit():
    from loomtype.llm.packing import bin_plan

    dice = random.Random(1)
    for _ in range(20):
        counts = collections.Counter(min(100, int(dice.expovariate(1 / 25)) + 1) for _ in range(500))
        plan = bin_plan(dict(counts), 100)
        used, seen = collections.defaultdict(int), collections.Counter()
        for length, lo, hi, first, offset, per in plan:
            for r in range(lo, hi):
                used[first + (r - lo) // per] += length
            seen[length] += hi - lo
        assert seen == counts and max(used.values()) <= 100
        assert len(used) <= sum(n * c for n, c in counts.items()) / 100 * 1.12 + 1


def test_token_counts(docs, rows, nothing):
    from tokenizers import Tokenizer

    from loomtype.llm.tokencounts import count_tokens

    library = Tokenizer.from_file(tokenizer())
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    got = count_tokens(docs, tokenizer(), turn_chars=500).collect()
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(nothing, tokenizer()).count() == 0


def test_token_counts_with_few_states(monkeypatch):
    from tokenizers import Tokenizer

    from loomtype.llm import tokencounts

    dice = random.Random(4)
    texts = [" ".join(dice.choice(WORDS) for _ in range(300)) + "<|endoftext|>" + "q" * 40, "it's <|endoftext|><|endoftext|> x", "", "z" * 300]
    want = [len(e.ids) for e in Tokenizer.from_file(tokenizer()).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokencounts, "STATE_LIMIT", 60)
    assert tokencounts.Counter(tokenizer()).counts(texts).tolist() == want
    parts, specials = tokencounts.Counter(tokenizer()).parts(texts[0], 50)
    assert specials == 1 and len(parts) > 20 and "<|endoftext|>".join(["".join(parts[:-1]), parts[-1]]) == texts[0]


def test_cutter_equals_library_on_odd_texts():
    from tokenizers import Tokenizer

    from loomtype.llm.tokencounts import Counter
    from loomtype.llm.wordcache import WordIds

    dice = random.Random(3)
    odd = ["".join(dice.choice("ab's  t\n\t'relv'mdé1²½ 9!-<|endoftext|>　\x85\x1c​漢🙂.") for _ in range(dice.randrange(40))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(tokenizer()).encode_batch(odd, add_special_tokens=False)]
    assert Counter(tokenizer()).counts(odd).tolist() == [len(x) for x in want]
    assert [list(x) for x in WordIds(tokenizer()).encode(odd)] == want


def test_fingerprints(docs, rows, nothing, spark):
    from loomtype.llm.fingerprints import edit_sensitivity, fingerprints

    plain = [r for r in rows if r[0] is not None]
    got = edit_sensitivity(docs, chunk_chars=300).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in plain}, key=lambda r: -r[0])
    single = [r for r in order if sum(x[0] == r[0] for x in rows) == 1]
    by = {r["doc_id"]: r for r in got}
    where = {r: i for i, r in enumerate(order)}
    for r in single:
        if where[r] + 1 < len(order):
            text, after = r[1], order[where[r] + 1][1]
            n = len(text)
            edited = text[: n - n // 3] + after[: n // 3]
            assert by[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by[r[0]]["n_chars"] == n
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {}
    texts = {r[0]: r[1] or "" for r in plain}
    for r in fingerprints(docs).collect():
        if r["doc_id"] is not None:
            assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert edit_sensitivity(nothing).count() == 0
    assert edit_sensitivity(spark.createDataFrame([rows[0]], DDL)).count() == 1


def test_quality_learns_from_labels(spark, nothing):
    from loomtype.llm.quality import classify

    dice = random.Random(4)
    data = []
    for i in range(240):
        bad = i % 4 == 0
        t = prose(dice.randrange(20, 150), dice)
        data.append((i, " ".join(f"{w.upper()}!!" if bad else w for w in t.split()), "en", "a", 0, "s", 1, 1))
    docs = spark.createDataFrame(data + [(999, None, "en", "a", 0, "s", 1, 1), (None, "", "en", "a", 0, "s", 1, 1)], DDL)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and not got[None]["held_out"]
    assert np.mean([got[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.95
    assert 0 <= got[999]["score"] <= 1
    no_labels = classify(docs, labels.where("false")).collect()
    assert len(no_labels) == 242 and all(r["predicted"] == 0 for r in no_labels)
    assert classify(nothing, labels).count() == 0


def test_quality_chooses_bags_before_encoding(spark):
    from pyspark.sql import functions as F

    from loomtype.llm.quality import _bags, train

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = [r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id")).collect()]
    big = order[0]  # first in the order of hashes, and larger than the bound
    docs = spark.createDataFrame([(i, "w " * (4000 if i == big else 400)) for i in ids] + [(order[1], "w " * 400)] * 50 + [(order[1], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    kept = _bags(docs, labels, 3000, 9).collect()
    assert {r["doc_id"] for r in kept} == set(order[1:5]) and len(kept) == 4 and all(len(r["text"]) == 800 for r in kept)
    assert train(docs, labels, passages_bound=9).weights["E"].any()
    with pytest.raises(ValueError, match="labelled documents"):
        train(docs.where(F.col("doc_id") == big), labels, passages_bound=9)


def test_chat_trees(spark):
    from loomtype.llm.chat import escape, mark_test_rows, prefix_trees, read_back, unescape

    for t in ("<|im_end|>", "<\\|x", "a<<\\\\|b|", "", "<|" * 3, "\\<|"):
        assert unescape(escape(t)) == t and "<|" not in escape(t)
    talks = {1: [("system", "s"), ("user", "hi"), ("assistant", "yo")], 2: [("system", "s"), ("user", "hi"), ("assistant", "other")], 3: [("system", "s"), ("user", "bye")],
             4: [("user", "a\nb % <|im_end|>"), ("assistant", "é漢 <|endoftext|>"), ("assistant", "")], 5: [("as%\nsist", "x")]}
    talks |= {9: [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(60)]}
    talks |= {100 + i: [*talks[9][:i], ("user", f"leaves at {i}"), ("assistant", f"ok {i % 3}")] for i in range(0, 40, 3)}
    talks |= {200 + i: [*talks[9][:30], ("user", "other"), ("assistant", f"x{i // 2}")] for i in range(7)}
    data = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)] + [(6, 0, None, None), (None, 1, "user", "no id")]
    rows = mark_test_rows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), -1, "<|im_end|><|im_start|>assistant ok")
    talks |= {6: [("", "")], None: [("user", "no id")], -1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    rows = rows.selectExpr("*", "'c' AS node", "1 AS part", "2 AS depth")
    trees = prefix_trees(rows, tokenizer(), parts=7)  # so that long conversations are chained across partitions
    got = {r["conv_id"]: r for r in read_back(trees, tokenizer()).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = trees.nodes.collect()
    assert len(nodes) == len({tuple(turns[: i + 1]) for turns in talks.values() for i in range(len(turns))})
    for tree in {n["tree"] for n in nodes}:
        own = sorted((n["start"], n["stop"]) for n in nodes if n["tree"] == tree)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    at = {n["node"]: n for n in nodes}
    paths = collections.defaultdict(list)
    for t in sorted(trees.turns.collect(), key=lambda t: t["depth"]):
        assert (t["tree"], t["start"]) == (at[t["node"]]["tree"], at[t["node"]]["start"]) and t["depth"] == len(paths[t["conv_id"]])
        paths[t["conv_id"]].append(at[t["node"]])
    assert {c: len(x) for c, x in paths.items()} == {c: len(x) for c, x in talks.items()}
    for path in paths.values():
        for depth, n in enumerate(path):
            seen = [i for a, b in n["attends"] for i in range(a, b)]
            assert seen == [i for p in path[:depth] for i in range(p["start"], p["stop"])] and len(seen) == n["position"]
            assert len(n["attends"]) <= 6
    for n in nodes:  # depth first: all below a node follows it at once
        below = [p["stop"] for path in paths.values() if n in path for p in path[path.index(n) :]]
        size = sum(m["stop"] - m["start"] for m in {m["node"]: m for path in paths.values() if n in path for m in path[path.index(n) :]}.values())
        assert max(below) == n["start"] + size
    empty = rows.where("false")
    assert read_back(prefix_trees(empty, tokenizer()), tokenizer()).count() == 0


def test_pages(spark):
    from loomtype.llm.wrappers import extract_text

    def page(i, body):
        return (i, f"https://h.example/{i}", f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><h2>Site</h2></header><nav><a>m{i}</a></nav>"
                   f"<div class=\"ad\">buy {i}</div>{body}<div id='cookie-notice'>ok?</div><footer>f{i}</footer></body></html>", "x")

    pages = [page(i, f"<article><h1>T{i} &amp; u</h1><p>One  <b>two</b><br>three {i}.<p>Four<ul><li>a<li>b</ul><form>q</form><div class='comments'><p>nice</div></article>") for i in range(5)]
    pages += [page(7, "<div class='x'><p>plain body seven</p></div>"), (8, None, None, "x"), (9, "nothing", "", "x"), (10, "https://h.example/x", "<article><p>cut of", "x"),
              (11, "https://o.example/", "<p>" + "long text " * 20000 + "</p>", "x"), (None, "https://o.example/", "<p>a &lt; b</p>", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, tree string")
    got = {r["page_id"]: r for r in extract_text(frame).collect()}
    for i in range(5):
        assert got[i]["text"] == f"T{i} & u\nOne two three {i}.\nFour\na\nb"
    assert got[7]["text"] == "plain body seven" and got[8]["text"] == "" and got[9]["text"] == "" and got[10]["text"] == "cut of"
    assert got[11]["text"] == ("long text " * 20000).strip() and got[None]["text"] == "a < b"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_text(frame.where("false")).count() == 0


def test_pages_follow_the_template(spark):
    from loomtype.llm.wrappers import Page, extract_text, group_tree, main_text

    box = "<div class='x9'>Ask our shop <b>for a quote</b></div><p>Call us any day at noon.</p>"

    def page(i, host="t.example"):
        return (i, f"https://{host}/{i}", f"<body><article><h1>Facts</h1><p>Text number {i} is here.</p>{box}<p>It ends after {i}.</p></article>"
                                          f"<article><p>Second part of {i} is also here.</p></article></body>")

    # "copy" holds one article nine times, which makes no template of it; "few" has too few pages for one
    pages = [page(i) for i in range(6)] + [(100 + i, f"https://copy.example/{i}", page(0)[2]) for i in range(9)] + [page(200, "few.example"), page(201, "few.example")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Facts\nText number {i} is here.\nIt ends after {i}.\nSecond part of {i} is also here."
    whole = "Facts\nText number {0} is here.\nAsk our shop for a quote\nCall us any day at noon.\nIt ends after {0}.\nSecond part of {0} is also here."
    assert got[100] == got[108] == whole.format(0) and got[200] == whole.format(200)
    one = Page(page(3)[2])
    assert main_text(one, set(), set()) == whole.format(3) != got[3] and len(group_tree(one)[1]) == len(one.tags)


def test_page_ids_made_from_titles(spark):
    from loomtype.llm.wrappers import extract_text

    body = ("<article><section id='related-work'><h2 id='search-algorithms'>Search {0}</h2><p class='share-price'>Price {0}.</p></section><div id='menu-planning'>Plan {0}.</div>"
            "<div id='social-history'>Past {0}.</div><p id='notice-period'>Notice {0}.</p><div class='share-box'>tell {0}</div><div class='related-offers'>buy {0}</div></article>"
            "<div class='related-offers'>more {0}</div>")
    pages = [(i, f"https://ids.example/{i}", body.format(i)) for i in range(4)]
    for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert r["text"] == "Search {0}\nPrice {0}.\nPlan {0}.\nPast {0}.\nNotice {0}.".format(r["page_id"])


def test_long_and_deep_pages(spark):
    from loomtype.llm.wrappers import extract_text

    long = "".join(f"<h2>Head {i}</h2><p class='c{i % 3000}'>Text {i}.</p>" for i in range(10_000))
    deep = "<font>" * 2500 + "<div>" * 2500 + "bottom of "
    pages = [(i, f"https://deep.example/{i}", f"<article><p>Page {i} of it.</p>{x}{i}</article>") for i in range(3) for x in (long, deep)]
    got = [r["text"] for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(t.count("\n") for t in got) == [1] * 3 + [20_001] * 3


def test_tags_that_match_nothing_cost_little():
    import time

    from loomtype.llm.wrappers import Page, main_text

    for mark, end in (("<b>", "</i>"), ("<b>", "<hr>"), ("<b>", "</i><dt></dt>")):
        n = 1_000_000 // len(mark + end)
        began = time.monotonic()
        page = Page("<article><p>Begin.</p>" + mark * n + end * n + "The end.</article>")
        assert time.monotonic() - began < 20 and page.tags.count("b") == n and page.tags[page.stack[-1]] == "#root"
        assert main_text(page, set(), set()).split() == ["Begin.", "The", "end."]
    # open elements are counted through implied ends: of the list items, cells and paragraphs all are closed but the first list's
    page = Page("<ul><li>a<li>b<ul><li>c</ul></i><li>d</ul><p>e<p>f<div>g</p>h</div><table><tr><td>i<td>j<tr><td>k</table></b>l")
    assert {k: v for k, v in page.open.items() if v} == {} and page.tags.count("li") == 4 and page.parents.count(0) >= 4


def test_tree_match_against_brute_force():
    from functools import cache

    from loomtype.llm.wrappers import tree_match

    dice = random.Random(6)

    def tree(n):
        return [["a", -1, 0]] + [[dice.choice("ab"), dice.randrange(i), 0] for i in range(1, n)]

    for _ in range(40):
        one, two = tree(dice.randrange(1, 9)), tree(dice.randrange(1, 9))
        below = lambda t, i: tuple(j for j in range(1, len(t)) if t[j][1] == i)

        @cache
        def best(a, b):
            return 0 if one[a][0] != two[b][0] else 1 + align(below(one, a), below(two, b))

        @cache
        def align(x, y):
            return 0 if not x or not y else max(align(x[1:], y), align(x, y[1:]), best(x[0], y[0]) + align(x[1:], y[1:]) if best(x[0], y[0]) else 0)

        pairs = tree_match(one, two)
        assert len(pairs) == best(0, 0) and len({i for i, _ in pairs}) == len(pairs)


def test_neighbours(spark):
    from loomtype.llm.neighbours import nearest

    dice = np.random.default_rng(3)
    x = dice.normal(size=(1500, 16)).astype(np.float32) * dice.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest(frame).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - y[q] @ y[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score = y @ y[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -score))[:20].tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) > 0.9
    assert nearest(frame.where("vec_id < 0")).count() == 0
    # the same from several shards, a table of doubles beyond the range of floats, and columns of clashing names
    wide = frame.selectExpr("vec_id", "transform(embedding, v -> v * 1e100D) AS embedding", "1 AS shard", "true AS query", "0 AS rank", "vec_id AS query_id")
    more = collections.defaultdict(list)
    for r in nearest(wide, shards=5).orderBy("query_id", "rank").collect():
        more[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(more) == set(got)
    for q, found in more.items():
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s / 1e100 / 1e100 - y[q] @ y[v]) < 1e-6 for _, v, s in found)
    assert sum(len({v for _, v, _ in more[q]} & {v for _, v, _ in got[q]}) for q in got) / (20 * len(got)) > 0.9
    assert nearest(frame.where("vec_id IN (0, 1, 2)")).count() == 2


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_repetitive_texts_keep_apart(spark):
    from tokenizers import Tokenizer

    from loomtype.llm.packing import pack
    from loomtype.llm.shingles import near_duplicate_components
    from loomtype.llm.wordcache import WordIds

    library, words = Tokenizer.from_file(tokenizer()), WordIds(tokenizer())
    texts = [w for n in (1024, 2048, 4096) for w in thue_morse(n)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in words.encode(texts)] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {r["doc_id"]: r["ids_crc32"] for r in pack(frame, tokenizer()).where("piece = 0").collect()}
    for i, ids in enumerate(want):
        ids = [*ids, 2]
        assert first[i] == zlib.crc32(np.array(ids[: (len(ids) - 1) % 1024 + 1], "<u4").tobytes())
    assert all(r["component_id"] == r["doc_id"] for r in near_duplicate_components(frame).collect())


def test_pieces_with_a_taken_hash_go_to_the_library():
    from loomtype.llm import wordcache

    texts = ["a longerwordthaneight byte", "longerwordthanseven", "longerwordthanninet longerwordthanseven", "x", "yy", ""]
    want = [list(x) for x in wordcache.WordIds(tokenizer()).encode(texts)]
    good = wordcache.span_hashes
    wordcache.span_hashes = lambda data, starts, ends: np.where(ends - starts > 8, np.uint64(7), good(data, starts, ends))
    try:
        assert [list(x) for x in wordcache.WordIds(tokenizer()).encode(texts * 4, per_turn=30)] == want * 4
    finally:
        wordcache.span_hashes = good


@pytest.mark.parametrize("per_turn", [1, 7, 60])
def test_cutting_long_texts_changes_no_ids(per_turn):
    from tokenizers import Tokenizer

    from loomtype.llm.wordcache import WordIds

    dice = random.Random(8)
    odd = ["".join(dice.choice("ab's  t\n\t'relv'mdé1²½ 9!-<|endoftext|>　\x85\x1c​漢🙂.") for _ in range(dice.randrange(90))) for _ in range(400)]
    odd += ["a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "", "q" * 500]
    want = [e.ids for e in Tokenizer.from_file(tokenizer()).encode_batch(odd, add_special_tokens=False)]
    assert [list(x) for x in WordIds(tokenizer()).encode(odd, per_turn)] == want


@pytest.mark.parametrize("size", [7, 40, 500_000])
def test_shingle_sets_read_in_parts(size):
    import pyarrow as pa

    from loomtype.llm.shingles import shingle_sets
    from loomtype.llm.textbytes import slices

    dice = random.Random(2)
    texts = [" ".join(dice.choice(["a", "B", "b", "word" * dice.randrange(1, 30), "é漢", "x9"]) for _ in range(dice.randrange(30))) for _ in range(150)]
    texts += ["", None, " \n ", " a", "a ", "a b c d\n", "q" * 900]
    names, seen = {}, 0
    for rows, data, offsets in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text", size):
        hashes, at = shingle_sets(data, offsets, 5, size)
        for i in range(rows.num_rows):
            w = re.findall(WORD, (texts[seen] or "").translate({c: c + 32 for c in range(65, 91)}))
            want = frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])
            own = hashes[at[i] : at[i + 1]].tolist()
            assert own == sorted(set(own)) and len(own) == len(want) and names.setdefault(want, own) == own
            seen += 1
    assert seen == len(texts) and len({tuple(v) for v in names.values()}) == len(names)


def test_a_very_long_text_needs_little_memory():
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from loomtype.llm.shingles import shingle_sets
from loomtype.llm.textbytes import slices
from loomtype.llm.wordcache import WordIds
words = WordIds({path!r})
words.encode(["warm up " * 100000])
dice = np.random.default_rng(1)
raw = dice.integers(97, 123, 30_000_000, np.uint8)
raw[::6] = 32
text = pa.array([raw.tobytes().decode()], pa.string())
del raw
batch = pa.record_batch({{"text": text}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for rows, data, offsets in slices(batch, "text"):
    n = len(shingle_sets(data, offsets, 5)[0])
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code.format(root=root, path=tokenizer())], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 4_900_000 and int(out[1]) < 110  # the set itself is 40 MB


def test_mixture_stages_allow_any_column_names(spark, docs, rows, nothing):
    from loomtype.llm.quality import keep_good
    from loomtype.llm.shingles import keep_one

    odd = ["_class", "_of", "_id", "_copy", "_score", "class", "of", "id", "copy", "score"]
    wide = docs.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(odd)])
    labels = spark.createDataFrame([(i * 3, 1, 0) for i in range(40)] + [(i * 3, 0, 0) for i in range(40, 60)], "doc_id long, quality int, toxic int")
    one, good = keep_one(wide), keep_good(wide, labels)
    assert one.columns == good.columns == wide.columns
    assert one.count() == keep_one(docs).count() and good.count() == keep_good(docs, labels).count()
    assert keep_one(nothing).count() == 0 and keep_good(nothing, labels).count() == 0


def test_another_seed_draws_other_shard_counts(docs):
    from pyspark.sql import functions as F

    from loomtype.llm.mixing import mix_sources

    drawn, near = [], []
    for seed in (1, 2):
        mix = mix_sources(docs, block=8, shard_slots=128, seed=seed)
        counts = {(r["shard"], r["source"]): r["count"] for r in mix.shard_counts().collect()}
        shards = {s for s, _ in counts}
        assert len(shards) > 3 and all(sum(n for (s, _), n in counts.items() if s == shard) == 128 for shard in shards - {max(shards)})
        taken = mix.taken()
        drawn.append(counts)
        near.append({r["source"]: r["share"] for r in taken.groupBy("source").agg((F.sum("taken") / F.max("target")).alias("share")).collect()})
        # what a document's row says of shards is what the slots say of its blocks
        used = mix.slots.groupBy("_i", "block").agg(F.min("shard").alias("lo"))
        pieces = mix.pieces().join(used, ["_i", "block"])
        assert pieces.where("first_shard <> lo").isEmpty() and taken.where("taken > 0 AND first_shard IS NULL").isEmpty()
    assert drawn[0] != drawn[1] and all(abs(v - 1) < 0.1 for n in near for v in n.values())


def test_frequent_shingles_take_the_other_way_to_the_same_links(spark, docs):
    from loomtype.llm.shingles import saved, shingle_classes, similar_classes

    dice = random.Random(12)
    base = [dice.choice(WORDS) for _ in range(60)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)] + [" ".join(base[:50] + [f"t{i}"]) for i in range(30)]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    classes = saved(shingle_classes(more, 5))
    found = [sorted(map(tuple, similar_classes(more, classes, frequent=2, hot=hot).collect())) for hot in (50_000, 3, 1)]
    group = [collections.defaultdict(set) for _ in found]
    for rows_, by in zip(found, group):
        for c, component in rows_:
            by[component].add(c)
    assert sorted(map(sorted, group[0].values())) == sorted(map(sorted, group[1].values())) == sorted(map(sorted, group[2].values())) and len(found[0]) > 80


def plain_digest(raw):
    """The fingerprint, a byte at a time: counts of hashed triplets, quartiles of the counts, and the length's class."""
    from loomtype.llm import fingerprints as P

    counts = [0] * 128
    data = raw if len(raw) >= 5 or not raw else raw + bytes(5 - len(raw))
    for end in range(4, len(data)):
        for k, (a, b, c) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))):
            h = (int(P._TABLES[0][data[end - a]]) + int(P._TABLES[1][data[end - b]]) + int(P._TABLES[2][data[end - c]]) + int(P._SALTS[k])) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            counts[h >> 25] += 1
    ordered = sorted(counts)
    code = [sum(n > ordered[q * 32 - 1] for q in (1, 2, 3)) for n in counts]
    length = 0 if not raw else min(255, 1 + int(np.floor(np.log(len(raw)) / np.log(1.1))))
    return code, length


def plain_likeness(x, y):
    if (x[1] == 0) != (y[1] == 0):
        return 0.0
    cost = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(x[0], y[0])) + max(abs(x[1] - y[1]) - 1, 0)
    return 1 - min(cost, 180) / 180


def test_fingerprints_against_brute_force(spark):
    from loomtype.llm.fingerprints import edit_sensitivity

    dice = random.Random(7)
    texts = [prose(dice.randrange(0, 60), dice) for _ in range(25)] + ["", None, "abc", "é漢🙂", "x" * 400, "abc"]
    data = [(i * 2, t) for i, t in enumerate(texts)] + [(None, "last a"), (None, "last b")]
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        own, changed, following = (plain_digest(t.encode()) for t in (text, edited, after))
        name = lambda d: f"{d[1]:02x}" + bytes(sum(q << s for q, s in zip(d[0][j : j + 4], (6, 4, 2, 0))) for j in range(0, 128, 4)).hex()
        want[doc, n, hashlib.sha256(edited.encode()).hexdigest(), name(own), name(changed), round(plain_likeness(own, changed), 9), round(plain_likeness(own, following), 9)] += 1
    for parts in (1, 6):
        frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS kind", "'c' AS after").repartition(parts)
        got = edit_sensitivity(frame, chunk_chars=200).collect()
        assert collections.Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want


def test_attention_model_against_brute_force():
    import math

    from loomtype.llm.quality import FEATURES, Model, fit, passages

    dice = np.random.default_rng(2)
    raw = [("Word word, 12%\n" * k).encode() for k in (0, 1, 40, 200)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    owner, features = passages(data, offsets)
    assert [int((owner == i).sum()) for i in range(4)] == [max(1, (len(t) + 200) // 400) for t in raw] and features.shape[1] == FEATURES
    assert np.allclose(features[0, : FEATURES - 4], 0, atol=1e-6) and abs(features[owner == 2][:, :16].sum(axis=1) - 1).max() < 1e-5
    model = fit(np.repeat(np.arange(30), 3), dice.normal(size=(90, FEATURES)).astype(np.float32), dice.integers(0, 2, 30).astype(float), steps=5)
    got, attention = model.scores(owner, features, 4)
    w = model.weights
    for i in range(4):
        hidden, raw_weights = [], []
        for x in features[owner == i]:
            z = [min(6, max(-6, (float(v) - float(m)) / float(s))) for v, m, s in zip(x, model.mean, model.scale)]
            h = [math.tanh(sum(z[a] * w["E"][a, b] for a in range(FEATURES)) + w["e"][b]) for b in range(w["E"].shape[1])]
            hidden.append(h)
            raw_weights.append(sum(math.tanh(sum(h[a] * w["V"][a, b] for a in range(len(h)))) / (1 + math.exp(-sum(h[a] * w["U"][a, b] for a in range(len(h))))) * w["a"][b]
                                   for b in range(w["V"].shape[1])))
        top = max(raw_weights)
        part = [math.exp(v - top) for v in raw_weights]
        bag = [sum(p * h[b] for p, h in zip(part, hidden)) / sum(part) for b in range(len(hidden[0]))]
        expected = 1 / (1 + math.exp(-(sum(v * c for v, c in zip(bag, w["c"])) + w["b"][0])))
        assert abs(expected - got[i]) < 1e-5 and np.allclose(attention[owner == i], np.array(part) / sum(part), atol=1e-5)
    assert isinstance(model, Model)


def test_attention_learning_follows_the_gradient():
    """One step of the learner goes down every weight's slope, as finite differences of the loss see it."""
    from loomtype.llm import quality

    dice = np.random.default_rng(5)
    owner, labels = np.repeat(np.arange(12), 2), dice.integers(0, 2, 12).astype(float)
    features = dice.normal(size=(24, quality.FEATURES)).astype(np.float32)
    before, after = (quality.fit(owner, features, labels, steps=n, rate=1e-3, decay=0.0, batch=12) for n in (0, 1))

    def loss(weights):
        p, _ = quality.Model(before.mean, before.scale, weights).scores(owner, features, 12)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, value in before.weights.items():
        for at in [np.unravel_index(int(i), value.shape) for i in dice.integers(0, value.size, 6)]:
            slope = 0.0
            for sign in (1, -1):
                moved = {k: v.astype(np.float64).copy() for k, v in before.weights.items()}
                moved[name][at] += sign * 1e-4
                slope += sign * loss(moved) / 2e-4
            step = after.weights[name][at] - value[at]
            if abs(slope) > 1e-6:  # the first step of Adam is the rate, against the gradient's sign
                assert np.sign(step) == -np.sign(slope) and abs(abs(step) - 1e-3) < 2e-4, (name, at)


def test_wrappers_need_no_names(spark):
    """Meaningless tags and classes: only the alignment of a host's pages tells the article from its frame."""
    from loomtype.llm.wrappers import Page, extract_text, main_text

    dice = random.Random(3)
    frame = [" ".join(dice.choice(WORDS) for _ in range(dice.randrange(3, 9))) for _ in range(8)]

    def page(i):
        own = [f"{prose(14, random.Random(100 * i + k))} {i}-{k}." for k in range(2 + i % 4)]
        body = "".join(f"<div class='k3'>{t}</div>" for t in own[:1]) + "".join(f"<p class='k{4 + k % 2}'>{t}</p>" for k, t in enumerate(own[1:]))
        html = (f"<body><div class='a1'><div class='b7'>{frame[0]}</div><div class='b8'>{frame[1]}</div></div><div class='q2'>{body}<div class='z5'>{frame[2]}</div></div>"
                f"<div class='w9'><p>{frame[3]}</p><p>{frame[4]}</p><ul><li>{frame[5]}</li><li>{frame[6]}</li></ul></div><div class='w4'>{frame[7]}</div></body>")
        return html, "\n".join(own)

    pages = {i: page(i) for i in range(12)}
    table = spark.createDataFrame([(i, f"https://plain.example/{i}", html) for i, (html, _) in pages.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_text(table).collect()}
    for i, (html, want) in pages.items():
        assert got[i] == want
        assert main_text(Page(html), set(), set()) != want  # without the template the frame stays


def test_pipeline_against_brute_force(spark, tmp_path, docs, rows):
    """The stages one after the other, each held against a plain computation on what the one before it kept."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as C
    from loomtype.llm.common import saved
    from loomtype.llm.quality import classify

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    good = [r[0] for r in rows if r[0] is not None]
    labels = spark.createDataFrame([(d, int(i % 5 > 0), 0) for i, d in enumerate(sorted(set(good)))], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    start = spark.read.parquet(f"{sf}/documents.parquet")
    held = []
    frame = start
    for name, stage in C.STAGES[:-1]:
        frame = saved(stage(spark, frame, sf))
        assert frame.columns == start.columns, name
        held.append([tuple(r) for r in frame.collect()])
    accepted = collections.Counter((r["doc_id"]) for r in classify(start, labels).collect() if r["predicted"])
    assert collections.Counter(r[0] for r in held[0]) == accepted
    up = {i: i + 32 for i in range(65, 91)}
    sets, leaders = [], 0
    for r in held[0]:
        w = re.findall(WORD, (r[1] or "").translate(up))
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else []))
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    by = collections.defaultdict(list)
    for g, s, r in zip(group, sets, held[0]):
        by[g if s else ("empty", leaders := leaders + 1)].append(r)
    least = lambda own: min((r[0] is None, r[0] or 0) for r in own)
    assert sorted(map(str, (least([r]) for r in held[1]))) == sorted(map(str, (least(own) for own in by.values())))
    words = lambda t: len(re.findall(WORD, t or ""))
    size = collections.Counter()
    for r in held[1]:
        size[r[3]] += words(r[1])
    taken = collections.Counter()
    uses = collections.Counter()
    for r in held[2]:
        taken[r[3]] += words(r[1])
        uses[r[0]] += words(r[1])
    assert abs(sum(taken.values()) - sum(size.values())) <= 64 * 4 + 0.01 * sum(size.values())
    own = collections.Counter()
    for r in held[1]:
        own[r[0]] += words(r[1])
    assert all(n <= 3 * own[d] for d, n in uses.items()) and all(r[4] == len(r[1]) for r in held[2])
    packed = C.STAGES[-1][1](spark, frame, sf).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 1024
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r[0] for r in held[2])
    assert collections.Counter(r["doc_id"] for r in C.run(spark, sf).collect()) == collections.Counter(r["doc_id"] for r in packed)
    empty = start.where("false")
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0
