"""The corpus operators against plain versions of their rules."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import chunks, components, decontaminate, html, lines, packing, quality, queries, rollup, sharding, simhash, tokens, warc
from lineloom.llm.common import scratch

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 token counts


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))


TRICKY = ["It's 3,14 DON'T!", "<|endoftext|> a<|startoftext|>b", "naïve ÉCOLE ß ﬁ İ ſ", "a  b   c\n d \n  e ", "漢字かな😀👍🏽", "é ́x", " nbsp x", "  lead", "tail  ", "\x1c\x1d", ""]


def test_cached_tokens_are_those_of_the_library(corpus, word_tokenizer):
    import base64

    import public_tokenizers
    import tiktoken

    path = tokens.vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, two = tokens.WordBpe(tokens.vocabulary("word_bpe_49k.json")), tokens.ByteBpe(path)
    for text in TRICKY + [t for _, t in corpus if t]:
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert one.ids(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), text
        assert two.count(text.encode()) == len(plain.encode_ordinary(text)), text


CHANGE = "op string, source string, lang string, version string, n_tokens long, old_source string, old_lang string, old_version string, old_n_tokens long"


def test_rollup(spark):
    store = rollup.TokenRollup(spark, scratch(spark, "test"))
    none = (None,) * 4
    batch = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    first = batch(("insert", "a", "en", "v1", 10, *none), ("insert", "a", "en", "v1", 5, *none), ("insert", None, None, None, None, *none), ("?", "a", "en", "v1", 9, *none), (None, *none, *none))
    assert store.totals().count() == 0
    assert store.commit("one", first) and not store.commit("one", first)
    assert store.commit("two", batch(("delete", *none, "a", "en", "v1", 5), ("revise", "a", "en", "v2", 12, "a", "en", "v1", 10)))
    expected = {("a", "en", "v2"): (1, 12), (None, None, None): (1, 0)}
    totals = lambda: {tuple(r[:3]): tuple(r[3:]) for r in store.totals().collect()}
    assert totals() == expected
    assert store.compact() and totals() == expected
    assert not store.commit("two", first) and store.commit("three", batch()) and totals() == expected
    assert store.commit("four", batch(("delete", *none, None, None, None, None))) and totals() == {("a", "en", "v2"): (1, 12)}
    # A writer that was lost before its marker leaves nothing that counts, and that goes when it is old enough.
    rollup.signed(first).write.parquet(f"{store.root}/deltas/{store._name('five')}-lost")
    assert totals() == {("a", "en", "v2"): (1, 12)} and not store.committed("five")
    assert store.sweep() == []
    gone = store.sweep(0)
    assert any("-lost" in g for g in gone) and totals() == {("a", "en", "v2"): (1, 12)}
    assert not store.commit("one", first) and store.commit("", first) and store.committed("")


def test_rollup_compaction_takes_one_list(spark):
    """A batch committed while a snapshot is made counts once, and so does one that two writers send."""
    none = (None,) * 4
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n, *none)], CHANGE)
    store = rollup.TokenRollup(spark, scratch(spark, "race"))
    store.commit("one", batch(5))
    state = store._state

    def between():
        found = state()
        other.commit("two", batch(10))
        return found

    other = rollup.TokenRollup(spark, store.root)
    store._state = between
    assert store.compact()
    store._state = state
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 2, 15)]
    # Both see no marker, write, and then only one marks.
    store.committed = lambda b: False
    assert other.commit("three", batch(1)) and not store.commit("three", batch(1))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 3, 16)]
    other._state = lambda: (0, *state()[1:])  # a snapshot of a number that is taken
    assert not other.compact() and store.compact()
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 3, 16)]


def test_token_counts(docs, odd, empty, corpus, word_tokenizer):
    got = by_id(rollup.token_counts(docs, F.col("lang") == "de"), "id")
    for i, text in corpus:
        assert got[i]["first"] == len(word_tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["second"] is None) == (i % 3 != 0)
    assert rollup.token_counts(odd, F.lit(True)).count() == 8
    assert rollup.token_counts(empty, F.lit(True)).count() == 0


# --- 2 line dedup


def plain_line_dedup(rows, least):
    """Every repeated run of enough words, one by one."""
    split = [(i, t.split("\n")) for i, t in rows if t is not None]
    weight = lambda x: x.count(" ") + 1 if x else 0
    first, out = set(), {}
    for i, own in split:
        gone = set()
        for a in range(len(own)):
            n = 0
            for z in range(a, len(own)):
                n += weight(own[z])
                if n >= least:
                    run = tuple(own[a : z + 1])
                    if run in first:
                        gone.update(range(a, z + 1))
                    first.add(run)
        out[i] = (len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


@pytest.mark.parametrize("least", [50, 5])
def test_line_dedup(docs, corpus, least):
    got = by_id(lines.line_dedup(docs, min_words=least))
    expected = plain_line_dedup([(i, t) for i, t in corpus if t is None or len(t) < 100_000], least)
    for i, text in corpus:
        if text is None:
            assert tuple(got[i])[1:] == (0, 0, None)
        elif i in expected:
            assert tuple(got[i])[1:] == expected[i], i
    assert sum(r["n_removed"] for r in got.values()) > 30


def test_line_dedup_odd(odd, empty, docs):
    got = sorted(tuple(r) for r in lines.line_dedup(odd).na.fill({"doc_id": -1, "text": "null"}).collect())
    text = "the quick brown fox jumps over the lazy dog " * 15
    # Without an id it comes first; the two equal rows are one document, and copies of it.
    assert got == [(-1, 0, 0, "null"), (-1, 0, 0, "null"), (-1, 1, 0, text), (1, 1, 0, "other words"), (1, 1, 1, ""), (1, 1, 1, ""), (2, 0, 0, "null"), (3, 1, 0, "")]
    assert lines.line_dedup(empty).count() == 0
    kept = lines.drop_copies(docs)
    assert kept.columns == docs.columns
    assert lines.drop_copies(odd).count() == 6 and lines.drop_copies(empty).count() == 0


def test_intervals_are_those_of_the_suffix_array(spark):
    """Runs of one interval are adjacent in the array, share a prefix of w lines, and nothing else does."""
    import random

    rng = random.Random(5)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(12)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, th long, body string")
    array, depth = lines.suffix_array(rows, 3)
    runs = lines.shortest_runs(array, depth)
    own = {(r["id"], r["a"], r["z"]): (r["w"], r["x"], r["y"]) for r in runs.collect()}
    split = [t.split("\n") for t in texts]
    # Lines are of one word, so shortest runs are of three lines; all of them are there.
    expected = {(i, a, a + 2) for i, t in enumerate(split) for a in range(len(t) - 2)}
    assert {k for k in own if k in expected} == set(own) and set(own) <= expected
    by_text = collections.defaultdict(set)
    for (i, a, z) in own:
        by_text[tuple(split[i][a : z + 1])].add((i, a, z))
    found = {(r["w"], r["x"], r["y"]): (r["n"], tuple(r["origin"])[::2]) for r in lines.intervals(runs).collect()}
    assert found == {own[min(v)]: (len(v), min(v)[:2]) for v in by_text.values() if len(v) > 1}
    # Adjacent in the array, by the suffixes' own order (a line before the end of a text is above that end).
    suffixes = sorted((tuple(t[p:]), i, p) for i, t in enumerate(split) for p in range(len(t)))
    place = {(i, p): k for k, (_, i, p) in enumerate(suffixes)}
    for group in by_text.values():
        places = sorted(place[i, a] for i, a, _ in group)
        assert places == list(range(places[0], places[0] + len(places)))


def test_suffix_array_is_in_order(spark):
    """Ranks at depth k order the suffixes by their first 2^k lines."""
    texts = ["a\nb\na\nb\nc\na\nb", "b\na\nb\nc\nx1", "a\na\na\na\na\na"]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, th long, body string")
    array, depth = lines.suffix_array(rows, 5)
    assert depth == 2
    ids = {}
    for r in array.select("id", "pos", "segment", *[f"r{k}" for k in range(depth + 1)]).collect():
        ids[r["id"], r["pos"]] = r
    order = {v: r["r0"] for (i, p), r in ids.items() for v in [texts[i].split("\n")[p]]}
    for k in range(depth + 1):
        def prefix(place, k=k):
            i, p = place
            out, own = [], texts[i].split("\n")
            while p < len(own) and (i, p) in ids and len(out) < 1 << k:
                out.append(order[own[p]])
                p += 1
            return out
        by_rank = sorted(ids, key=lambda x: ids[x][f"r{k}"])
        prefixes = [prefix(x) for x in by_rank]
        assert prefixes == sorted(prefixes)
        for x, p in zip(by_rank, prefixes, strict=True):
            assert ids[x][f"r{k}"] == 1 + sum(q < p for q in prefixes)


# --- 3 html


def accuracy(tree, rows, labels):
    return np.mean([html.decide(tree, r) for r in rows.tolist()] == labels)


def test_tree_and_held_out_pages():
    x, y = html.training_table()
    assert accuracy(html.trained(), x, y) > 0.999
    held, labels = html.training_table(html.labelled_pages(400, seed=77))
    full = accuracy(html.trained(), held, labels)
    assert full > 0.99

    def without(*names):
        keep = [f not in names for f in html.FEATURES]
        return accuracy(html.grow(x * keep, y), held * keep, labels)

    # The verdict needs link density, the neighbours, and what containers say.
    assert without("links", "links_before", "links_after") < full - 0.04
    assert without("words_before", "links_before", "words_after", "links_after") < full - 0.01
    assert without("container", "has_article") < full - 0.05

    def used(tree):
        return set() if isinstance(tree, int) else {html.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert {"words", "links", "words_after", "links_after"} <= used(html.trained())


TEASERS = "<div>" + "".join(f"<p><a href=x>{'teaser words here now ' * 8}</a></p>" for _ in range(3)) + "</div>"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<aside><h3>Related stories</h3><p>One</p></aside><article><p>Main text.</p></article>", "Main text."),
        ("<article><p>Main text.</p></article><footer><h2>Contact us</h2></footer>", "Main text."),
        ("<article><p>Main text.</p></article><div class='comments'><h3>12 reader comments</h3><p>I do not agree with any of it at all.</p></div>", "Main text."),
        ("<div class='cookie-notice'><h2>We value your privacy</h2></div><p>A short prose of ten words or so after it.</p>", "A short prose of ten words or so after it."),
        ("<div id='header'><h1>The Site</h1></div><article><header><h1>Title</h1></header><p>Text.</p></article>", "Title Text."),
        (TEASERS, ""),
        (TEASERS + "<article><h1>Title</h1><p>Text.</p></article>", "Title Text."),
        ("<article><p>Before the list.</p><p><a href=1>One</a></p><p><a href=2>Two</a></p><p><a href=3>Three</a></p><p>" + "prose " * 30 + "</p></article>", "Before the list. " + ("prose " * 30).strip()),
        ("<article><p>" + "prose " * 30 + "</p><p><a href=1>A line that is a link</a></p><p>" + "prose " * 30 + "</p></article>", ("prose " * 30) + "A line that is a link " + ("prose " * 30).strip()),
        (TEASERS + "<div><h1>A title of it</h1><p>" + "prose " * 60 + "</p><h2>Part two</h2><p>" + "prose " * 40 + "</p></div><div>Copyright 2024</div>", "A title of it " + "prose " * 60 + "Part two " + ("prose " * 40).strip()),
    ],
)
def test_page_layouts(page, text):
    assert html.main_text(page.encode(), html.trained())[0] == text


PAGES = [
    ("<html><head><title>No</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>One <b>bold</b>\n two.<br><p>Caf&eacute;&nbsp;x</article><footer>No</footer>", "A & B One bold two. Café x"),
    ("<body><header><p>Site name and slogan of this site</p></header><main><header><h1>Title</h1></header><p>Text of it.</p><aside>Aside</aside><section id='comments'><p>A reader wrote this</p></section></main>", "Title Text of it."),
    ("<article><p>In</p><div class='ad banner'>Buy it</div><form><label>Name</label></form><script>var a='</p>';</script><p>Out</p><!-- <p>no</p> --></article>", "In Out"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<div class=cookie-notice>We use cookies and more cookies on this site for all of you</div>", ""),
    ("<div><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></div><div>" + "<p>" + "some words of prose " * 12 + "</p>" + "<p>" + "more words of it " * 12 + "</p></div>", ("some words of prose " * 12 + "more words of it " * 12).strip()),
    ("a < b", ""),
    ("", ""),
    (None, ""),
    ("<article><p>5 < 6 &lt; 7 & so</article>", "5 < 6 < 7 & so"),
    ("<ARTICLE><P CLASS='x>y'>Upper</P></ARTICLE><unknown", "Upper"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", p, "z") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, body string")
    got = by_id(html.extract(df), "page_id")
    for i, (_, text) in enumerate(PAGES):
        assert got[i]["text"] == text, PAGES[i]
        assert got[i]["n_chars"] == len(text)
    assert html.extract(df.limit(0)).count() == 0
    # Rows without id or address, and repeated ones, get their own result.
    odd = spark.createDataFrame([(None, None, PAGES[0][0]), (1, "u", PAGES[0][0]), (1, "u", PAGES[0][0]), (1, "u", None), (2, "v", "<article><p>" + "word " * 300_000 + "</p></article>")], "page_id long, url string, html string")
    rows = sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in html.extract(odd).collect())
    assert rows == [(0, "", 26), (1, "u", 0), (1, "u", 26), (1, "u", 26), (2, "v", 1_499_999)]


# --- 4 simhash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(docs, corpus, odd, empty):
    got = by_id(simhash.near_duplicates(docs))
    prints = {i: plain_fingerprint(t) for i, t in corpus}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    expected = plain_components(prints)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 8 and {r["component_id"] for r in found} == {1, 2}
    assert simhash.near_duplicates(empty).count() == 0


def plain_similar(texts, width=5, least=0.8):
    """The least id of the component of each text, all pairs compared; texts by id."""
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(ASCII)) if w]
    sets = {}
    for i, t in texts.items():
        w = cut(t)
        sets[i] = {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                continue
            common = len(a & b)
            union = len(a) + len(b) - common
            if union == 0 or common / union >= least:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_keep_one_by_similarity(docs, corpus, odd, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_similar(dict(corpus)).values()))
    long = odd.first()["text"]
    # Null and empty texts are alike; of rows of one id the one with the least hash stays; an id goes before none.
    rows = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(odd).collect()), key=repr)
    assert rows == sorted([(1, "other words"), (1, long), (2, None)], key=repr)
    assert simhash.keep_one(empty).count() == 0


def test_near_copies_are_found(spark):
    """Texts with so many words changed that the similarity is 0.8 to 0.95: at least 97 of 100 pairs, and no other."""
    import random

    rng = random.Random(9)
    texts, pairs, n = {}, [], 0
    for k in range(200):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 400))]
        near = list(words)
        for _ in range(max(1, round(len(words) * (0.005 + 0.015 * rng.random())))):
            near[rng.randrange(len(near))] = f"x{rng.randrange(5_000)}"
        far = list(words)
        for j in range(0, len(far), 12):
            far[j] = f"y{rng.randrange(5_000)}"
        texts |= {n: " ".join(words), n + 1: " ".join(near), n + 2: " ".join(far)}
        n += 3
    expected = plain_similar(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r[0] for r in simhash.keep_one(df).select("doc_id").collect()}
    gone = {i for i, r in expected.items() if i != r}
    pairs = set(texts) - kept
    assert pairs <= gone and len(gone) > 100 and len(pairs) >= 0.97 * len(gone)


def test_table_anchors_cover():
    rng = np.random.default_rng(3)
    prints = rng.integers(-(2**63), 2**63 - 1, (200, simhash.LANES), dtype=np.int64)
    at, home = simhash.table_anchors(prints, 0)
    tables = len(simhash._tables())
    assert len(home) == 200 * tables and tables == 21
    homes = {(i, k >> (simhash.EXACT + simhash.WIDTH)): k for i, k in zip(at.tolist(), home.tolist(), strict=True)}
    # A bit of a table's 23 changed: the other's home is among the guest's anchors there.
    for table, places in enumerate(simhash._tables()):
        other = prints.copy().view(np.uint64)
        bit = int(places[7])
        other[:, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        at, keys = simhash.table_anchors(other.view(np.int64), 1)
        guests = set(zip(at.tolist(), keys.tolist(), strict=True))
        assert all((i, homes[i, table]) in guests for i in range(200))


def test_anchors_cover():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    at, home = simhash.anchors(prints, 0)
    assert sorted(at) == list(range(300))  # a perfect code: one home each
    home = dict(zip(at.tolist(), home.tolist(), strict=True))
    for flips in ((0,), (5, 40), (22, 23), (63, 1), (45, 46), (3, 4), (50, 60)):
        other = prints.copy()
        for b in flips:
            other ^= np.int64(1) << np.int64(b)
        at, guest = simhash.anchors(other, 2)
        seen = collections.defaultdict(list)
        for i, a in zip(at.tolist(), guest.tolist(), strict=True):
            seen[i].append(a)
        assert all(seen[i].count(home[i]) == 1 for i in range(300))


def test_links_find_every_pair(spark):
    import itertools
    import random

    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = sorted(tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect())
    assert got == sorted((a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 105), (105, 103), (200, 200), (7, 3)] + [(300, 300 + k) for k in range(1, 20)]
    stars = [(1, 9), (8, 1), (20, 21)]
    for written in (False, True):
        roots = lambda rows: sorted(tuple(r) for r in components.components(spark.createDataFrame(rows, "a long, b long"), written).collect())  # noqa: B023, E731
        assert roots(edges + edges[:5]) == sorted(({i: 0 for i in range(31)} | {i: 100 for i in (100, 103, 105)} | {300 + k: 300 for k in range(20)}).items())
        assert roots(stars) == [(1, 1), (8, 1), (9, 1), (20, 20), (21, 20)] == roots(stars * 2)
        assert roots([]) == []


# --- 5 substring dedup


def test_chunks_are_those_of_the_rule(corpus):
    gear = chunks.gear().tolist()
    reach = chunks.REACH
    for _, text in corpus[:40]:
        data = (text or "").encode()
        h, hashes, ends, start = 0, [], [], 0
        for b in data:
            h = ((h << 1) + gear[b]) & 0xFFFF
            hashes.append(h)
        for i, h in enumerate(hashes[:-1]):
            before, after = hashes[max(0, i - reach) : i], hashes[i + 1 : i + 1 + reach]
            if h < min([*before, 0xFFFF]) and h <= min([*after, 0xFFFF]):
                ends.append(i + 1)
        ends.append(len(data))
        wanted = []
        for e in ends if data else []:
            wanted += [*range(start + chunks.MOST, e, chunks.MOST), e]
            start = e
        assert chunks.cuts(data).tolist() == wanted


def plain_substring_dedup(rows):
    """Spans of (id, text) rows by the rule: chunks compared as bytes, in order of documents."""

    def places(data):
        ends, a = chunks.cuts(data).tolist(), 0  # held to the rule above
        for e in ends:
            yield a, e, data[a:e]
            a = e

    # Of one id, and without any, the text's hash decides; tests have those from Spark.
    seen, out = {}, {}
    for key, (i, text) in sorted(rows.items()):
        data, here, runs = (text or "").encode(), set(), []
        for a, e, piece in places(data):
            if seen.setdefault(piece, key) != key or piece in here:
                began = sum(1 for k in range(a, e) if data[k : k + 1] not in b" \t\n\r\x0b\x0c" and (k == 0 or data[k - 1 : k] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
                if runs and runs[-1][1] == a:
                    runs[-1][1:] = [e, runs[-1][2] + began, runs[-1][3] | {seen[piece]}]
                else:
                    runs.append([a, e, began, {seen[piece]}])
            here.add(piece)
        runs = [r for r in runs if r[2] >= chunks.WORDS or r[1] - r[0] >= chunks.BYTES]
        out[key] = [(a, e) for a, e, _, _ in runs], {k[1] for r in runs for k in r[3]}
    return out


def test_substring_dedup(docs, corpus, odd, empty):
    got = by_id(chunks.substring_dedup(docs))
    expected = plain_substring_dedup({(0, i): (i, t) for i, t in corpus})
    assert {i: ([tuple(s) for s in r["spans"]], set(r["copies_of"])) for i, r in got.items()} == {k[1]: v for k, v in expected.items()}
    passage = collections.Counter(line for _, t in corpus if t for line in t.split("\n") if len(line.split()) == 60).most_common(1)[0][0]
    holders = [i for i, t in corpus if t and passage in t]
    assert len(holders) > 10 and all(got[i]["n_removed"] >= 150 and holders[0] in got[i]["copies_of"] for i in holders[1:])
    cut = by_id(chunks.without_copies(docs))
    for i, text in corpus:
        spans = expected[0, i][0]
        if text and not spans:
            assert cut[i]["text"] == text
        elif text:
            data, at, kept = text.encode(), 0, b""
            for a, b in spans:
                kept, at = kept + data[at:a], b
            assert cut[i]["text"] == (kept + data[at:]).decode("utf-8", "ignore")
    assert chunks.substring_dedup(odd).count() == 8 and chunks.substring_dedup(empty).count() == 0
    assert chunks.without_copies(odd).count() == 8 and chunks.without_copies(empty).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_substring_dedup_tells_documents_by_id_and_text(spark, kind):
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    same, other = prose(80), prose(80)
    rows = [(1, f"{prose(30)} {same} {prose(30)}"), (1, f"{prose(40)} {same} {prose(20)}"), (None, f"{prose(20)} {other} {prose(9)}"), (None, f"{prose(25)} {other} {prose(30)}"), (2, f"{prose(30)} {other} {prose(9)}"), (None, None), (3, "")]
    rows += [rows[1], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) AS doc_id", "text")
    found = chunks.substring_dedup(df).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).collect()
    assert len(found) == 9
    spans = collections.defaultdict(set)
    for r in found:
        spans[r["key"], r["n_bytes"]].add((r["n_removed"], tuple(map(str, r["copies_of"]))))
    assert all(len(v) == 1 for v in spans.values())  # repeated rows get the same
    one = sorted(next(iter(v)) for (k, _), v in spans.items() if k == "1")
    assert one[0] == (0, ()) and one[1][0] > 300 and one[1][1] == ("1",)
    # Document 2 is first; those without id are copies of it.
    assert all(next(iter(v))[0] > 300 and next(iter(v))[1] == ("2",) for (k, n), v in spans.items() if k == "none" and n)
    alone = chunks.substring_dedup(df.where("doc_id IS NULL")).collect()
    assert sorted(r["n_removed"] > 300 for r in alone) in ([False, False, False, True], [False, False, True, True])


def test_passages_of_51_words_are_found(spark):
    """Of passages of over 50 words, of short words too, in the later of two texts."""
    import random

    rng = random.Random(6)
    word = lambda most: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, most)))
    rows, later = [], {}
    for k in range(300):
        passage = " ".join(word((2, 3, 9)[k % 3]) for _ in range(51))
        for c in range(2):
            rows.append((2 * k + c, " ".join(word(9) for _ in range(rng.randint(9, 99))) + f" {passage} " + " ".join(word(9) for _ in range(rng.randint(9, 99)))))
        later[2 * k + 1] = k % 3
    got = {r["doc_id"]: r["n_removed"] for r in chunks.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = [np.mean([got[i] > 0 for i, kind in later.items() if kind == n]) for n in range(3)]
    assert share[0] >= 0.9 and share[1] >= 0.97 and share[2] == 1
    assert not any(got[i - 1] for i in later)


def test_insertions_move_few_cuts():
    import random

    rng = random.Random(2)
    data = " ".join(f"w{rng.randrange(900)}" for _ in range(3000)).encode()
    moved = data[:5000] + b"inserted words" + data[5000:]
    _, a = chunks.chunked(data)
    _, b = chunks.chunked(moved)
    assert len(set(a) - set(b)) <= 4


# --- 6 packing


def check_packing(rows, expected, capacity):
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert got == expected
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(docs, corpus, word_tokenizer, odd, empty):
    expected, total = {}, 0
    for i, text in corpus:
        ids = [*word_tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 2048)):
            cut = ids[a : a + 2048]
            expected[i, k] = (a, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut)))
    n = check_packing(packing.pack(docs).collect(), expected, 2048)
    assert n <= math.ceil(total / 2048) * 1.02 + 1
    rows = packing.pack(odd).collect()
    assert len(rows) == 8 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 8
    assert packing.pack(empty).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [(b, k) for k, b in enumerate(bins) if b >= n]
        if room:
            b, k = min(room)
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit(seed):
    import random

    rng = random.Random(seed)
    capacity = rng.choice([50, 100, 2048])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(math.log(capacity / 3), rng.choice([0.2, 0.6, 1]))))) for _ in range(rng.choice([1, 7, 300, 3000]))]
    histogram = dict(collections.Counter(lengths))
    planned = packing.plan(histogram, capacity)
    table = planned.table
    used = collections.Counter()
    count = 0
    fill = collections.Counter()
    rows = [dict(zip(table, r, strict=True)) for r in zip(*[table[k].tolist() for k in table], strict=True)]
    for k, r in enumerate(rows):
        later = [x["first"] for x in rows[k + 1 :] if x["length"] == r["length"]]
        n = (later[0] if later else histogram[r["length"]]) - r["first"]
        assert n % r["each"] == 0
        used[r["length"]] += n
        for s in range(n // r["each"]):
            fill[r["sequence"] + s] += r["each"] * r["length"]
    count = len(fill)
    assert used == histogram and max(fill.values()) <= capacity
    assert count == planned.sequences and math.ceil(sum(lengths) / capacity) <= planned.bound <= count
    assert count <= best_fit(lengths, capacity)


@pytest.mark.parametrize("median, spread", [(200, 0.8), (700, 0.5), (900, 0.5), (300, 0.3)])
def test_program_beats_best_fit(median, spread):
    import random

    rng = random.Random(0)
    histogram = dict(collections.Counter(min(2048, max(1, int(rng.lognormvariate(math.log(median), spread)))) for _ in range(20_000)))
    planned, plain = packing.plan(histogram), packing.plan(histogram, rounds=0, again=0)
    assert planned.bound <= planned.sequences < plain.sequences
    assert planned.sequences <= 1.007 * planned.bound


def test_program_converges():
    """More rounds bring the cover to the optimum, which is known here: 3 bins hold 2 of 700 and 5 of 500 and so on."""
    lengths, counts = np.array([300, 500, 700]), np.array([4_000, 10_000, 4_000])
    # 2 x 500, 700 + 300: all bins are full, so the optimum is the sum.
    values = [packing.program(lengths, counts, 1000, rounds=r) for r in (10, 100, 1000)]
    best = (lengths * counts).sum() / 1000
    assert all(v.bound == pytest.approx(best) for v in values)
    assert values[0].value >= values[1].value >= values[2].value >= best and values[2].value <= 1.01 * best
    # Items over half of a bin: the sum is no bound, and neither is the dual far from it.
    assert packing.plan({600: 100, 500: 3}, 1000).sequences == 102


def test_bound_is_one(spark):
    """No packing beats the dual bound: small cases, all packings tried."""
    import functools
    import random

    rng = random.Random(2)

    def fewest(items, capacity):
        @functools.cache
        def go(left):
            if not left:
                return 0
            first, best = left[0], len(left)

            def fill(k, chosen, room):
                nonlocal best
                rest = list(left[1:])
                for c in chosen:
                    rest.remove(c)
                best = min(best, 1 + go(tuple(rest)))
                for j in range(k, len(left)):
                    if left[j] <= room:
                        fill(j + 1, [*chosen, left[j]], room - left[j])

            fill(1, [], capacity - first)
            return best

        return go(tuple(sorted(items, reverse=True)))

    for _ in range(20):
        items = [rng.randint(3, 20) for _ in range(8)]
        planned = packing.plan(dict(collections.Counter(items)), 20)
        assert planned.bound <= fewest(items, 20) <= planned.sequences


# --- 7 decontamination


def plain_decontaminate(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    out = {}
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_decontamination(spark, docs, corpus, odd, empty, most):
    texts = dict(corpus)
    long = [t for _, t in corpus if t and 100 < len(t.split()) < 300]
    items = [(1, " ".join(long[0].split()[5:40])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(long[1].split()[:13]).upper()), (6, "Spam, eggs; spam"), (6, "漢字"), (None, "漢字 one two"), (None, "two one"), (10, " ".join(long[0].split()[20:50]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, benchmark, max_bytes=most))
    expected = plain_decontaminate(corpus, items)
    for i, row in expected.items():
        assert tuple(got[i])[1:6] == row, i
    for i, r in got.items():
        covered = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[i][s["start"] : s["end"]])) for s in r["spans"])
        assert covered == r["n_hit"]
    assert sum(r["contaminated"] for r in got.values()) >= 3
    kept = decontaminate.drop_contaminated(docs, benchmark, max_bytes=most)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, r in expected.items() if not r[4]] and kept.columns == docs.columns
    words = lambda t: plain_decontaminate([(0, t)], items)[0]
    assert sorted(tuple(r)[1:6] for r in decontaminate.decontaminate(odd, benchmark, max_bytes=most).collect()) == sorted(words(r["text"]) for r in odd.collect())
    assert decontaminate.drop_contaminated(odd, benchmark, max_bytes=most).count() == 8 and decontaminate.drop_contaminated(empty, benchmark, max_bytes=most).count() == 0
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    none = decontaminate.decontaminate(docs, benchmark.limit(0)).collect()
    assert not any(r["contaminated"] for r in none)


# --- 8 sharding


@pytest.mark.parametrize("shards", [16, 3, 1])
def test_sharding(docs, corpus, shards):
    rows = sharding.kd_shards(docs, shards=shards).collect()
    texts = dict(corpus)
    weight = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_sharding_is_even_and_keeps_copies(spark, empty, odd):
    rows = [(i, f"text {i % 4000} " * (1 + i % 7), "en" if i % 2 else "de", f"s{i % 9}", i % 50) for i in range(5000)] + [(5000 + i, "hot " * 50, "en", "s0", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sharding.kd_shards(df).collect()
    weight = collections.Counter()
    for r in got:
        weight[r["shard"]] += r["size"]
    mean = sum(weight.values()) / 16
    assert len(weight) == 16 and max(weight.values()) < 1.08 * mean and min(weight.values()) > 0.92 * mean
    texts, where = {r[0]: r[1] for r in rows}, collections.defaultdict(set)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("hot"))
    by_bytes = sharding.kd_shards(df, shards=None, target_bytes=int(mean)).collect()
    assert len({r["shard"] for r in by_bytes}) == 16
    assert sharding.kd_shards(empty).count() == 0 and sharding.kd_shards(odd).count() == 8


@pytest.mark.parametrize("leaves", [7, 2, 16])
def test_cuts_are_weighted_medians_of_the_widest_dimension(spark, leaves):
    import random

    rng = random.Random(leaves)
    own = []
    for i in range(400):
        q = (rng.choice([0, 5, 1 << 20, sharding.TOP - 1]), rng.randrange(1 << 22))
        own.append((1, i, 0, rng.getrandbits(60) if i % 3 else 77, 1 + int(rng.expovariate(0.01)), *q))
    total = sum(p[4] for p in own)
    df = spark.createDataFrame(own, "node long, h long, part long, u long, w long, q0 long, q1 long").repartition(3)
    from lineloom.llm.common import stash

    found, levels = sharding.kd_tree(stash(df, "points"), leaves, 2, total / leaves)
    shard = {r["h"]: r["shard"] for r in found.collect()}
    cuts = [{r["node"]: r for r in level.collect()} for level in levels]
    assert len(shard) == 400 and set(shard.values()) <= set(range(leaves))

    def go(points, node, depth, first, count):
        if depth == len(cuts):
            assert count == 1 and all(shard[p[1]] == first for p in points)
            return
        cut = cuts[depth][node]
        half = count // 2
        left = points
        if count > 1 and points:
            spans = [max(p[5 + d] for p in points) - min(p[5 + d] for p in points) for d in range(2)]
            assert cut["dim"] == spans.index(max(spans))
            keys = sorted((p[5 + cut["dim"]], p[3]) for p in points)
            weight = lambda key: sum(p[4] for p in points if (p[5 + cut["dim"]], p[3]) < key)
            goal = sum(p[4] for p in points) * half / count
            reached = weight((cut["cq"], cut["cu"]))
            nearest = min(abs(weight(k) - goal) for k in [*keys, (sharding.TOP, 0)])
            assert abs(reached - goal) <= max(sharding.CLOSE * total / leaves, nearest) + 1e-6
            left = [p for p in points if (p[5 + cut["dim"]], p[3]) < (cut["cq"], cut["cu"])]
        go(left, 2 * node, depth + 1, first, half if count > 1 else 1)
        if count > 1:
            gone = {p[1] for p in left}
            go([p for p in points if p[1] not in gone], 2 * node + 1, depth + 1, first + half, count - half)

    go(own, 1, 0, 0, leaves)


def test_text_dimensions_go_by_rank(spark):
    """Values that share their beginning are as far apart as others."""
    import datetime

    day = lambda i: datetime.datetime(2024, 1, 1 + i % 28)
    rows = [(i, f"text {i} " * 20, f"https://example.org/the/same/path/{i % 16:02d}", None if i % 5 else "x", float("nan") if i % 7 == 0 else i / 3, day(i), i % 2 == 0) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double, day timestamp, flag boolean")
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(df, dims=("source",)).collect()}
    where = collections.defaultdict(set)
    for i, _, source, *_ in rows:
        where[source].add(got[i])
    # 16 sources of equal bytes are 16 shards, but for a text or two at their borders.
    assert sum(len(s) for s in where.values()) <= 32
    more = sharding.kd_shards(df, dims=("lang", "score", "day", "flag")).collect()
    assert len(more) == 800 and len({r["shard"] for r in more}) == 16


# --- 9 quality


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    again = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    own = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality(docs, corpus, odd, empty, spark):
    got = by_id(quality.quality(docs))
    for i, text in corpus:
        assert tuple(got[i])[1:8] == (*(base := plain_quality(text)), not base[-1] and plain_verdict(text)), i
    assert list(got[0].asDict())[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sum(r["kept"] for r in got.values()) > 20
    kept = quality.keep_good(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, r in sorted(got.items()) if r["kept"]] and kept.columns == docs.columns
    assert quality.quality(odd).count() == 8 and quality.quality(empty).count() == 0
    assert {r["n_words"] for r in quality.quality(odd).collect()} == {0, 2, 135} and quality.keep_good(odd).count() == 0 and quality.keep_good(empty).count() == 0
    nobody = spark.createDataFrame([(None, None, 1), (None, 1, 0), (999, 1, 0), (1, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, nobody) == quality.FIXED and quality.fit(empty, nobody) == quality.FIXED and quality.fit(odd, nobody.limit(0)) == quality.FIXED


def plain_limits(limits, size):
    low, high = [b[1:] for b in limits.bands if size >= b[0]][-1] if size >= limits.bands[0][0] else limits.bands[0][1:]
    octave = math.floor(math.log2(size)) + 1
    own = limits.beside[octave] if octave < len(limits.beside) else None
    if own:
        curve = sum(c * math.log2(size) ** k for k, c in enumerate(limits.curve))
        low, high = max(low, curve + own[0]), min(high, curve + own[1])
    return low, high


def plain_verdict(text, limits=quality.FIXED):
    """The rule of the bands, for one text."""
    import zstandard

    data = (text or "").encode()
    if not data:
        return False

    def good(part, own):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
        low, high = plain_limits(own, len(part))
        noise = [n[1:] for n in quality.NOISE if len(part) >= n[0]]
        share = [c / len(part) for c in collections.Counter(part).values()]
        entropy = -sum(p * math.log2(p) for p in share) / 8
        return low <= ratio <= high and not (noise and ratio > noise[-1][0] and ratio > noise[-1][1] * entropy)

    parts = [data[k : k + 4096] for k in range(0, len(data), 4096)]
    if len(parts) > 1 and len(parts[-1]) < 512:
        parts[-2:] = [parts[-2] + parts[-1]]
    bad = sum(not good(p, limits[1]) for p in parts) if len(parts) > 1 else 0
    return good(data, limits[0]) and bad <= len(parts) / 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_fitted_bands_tell_good_from_bad(spark):
    """Fitted on half of the labelled documents, judged on the others that pass the base rules."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    limits = quality.fit(docs, labels.where(half))
    assert limits == quality.fit(docs.repartition(7), labels.where(half).union(labels.where(half))) and limits[0].curve and limits[1].curve
    fewer = quality.fit(docs, labels.where(half), sample=300)
    assert fewer != limits and fewer[0].curve
    judged = quality.quality(docs, limits=limits).join(labels.where(~half), "doc_id").where("not base_failed")
    share = {r["quality"]: (r["n"], r["kept"]) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1][0] > 1_000 and share[1][1] >= 0.985
    assert share[0][0] > 100 and share[0][1] <= 0.3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_limits_are_those_of_all_good_documents(spark):
    """Against numpy on the driver, with one text of more than 64 chunks."""
    import numpy as np
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    long = " ".join(r[1] for r in docs.where("doc_id < 400 AND text IS NOT NULL").collect())
    docs = docs.union(spark.createDataFrame([(9_999_999, long)], docs.schema))
    got = quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    pack, found = zstandard.ZstdCompressor(level=3).compress, ([], [])
    for text in (r[0].encode() for r in docs.select("text").collect() if r[0] and not plain_quality(r[0])[-1]):
        found[0].append((len(text), len(pack(text)) / len(text)))
        own = quality.pieces(text)
        found[1].extend((len(x), len(pack(x)) / len(x)) for x in own if len(own) > 1)
    assert max(n for n, _ in found[0]) > 65 * 4096 and len(found[1]) > 200
    for limits, examples in zip(got, found, strict=True):
        sizes, ratios = np.array(examples).T
        logs, octaves = np.log2(sizes), np.frexp(sizes)[1]
        curve = np.polynomial.polynomial.polyfit(logs, ratios, min(2, len(set(octaves)) - 1))
        assert np.allclose(limits.curve, curve, atol=1e-6)
        for octave in set(octaves.tolist()):
            rest = (ratios - np.polynomial.polynomial.polyval(logs, curve))[octaves == octave]
            if len(rest) < quality.LEAST_OCTAVE:
                assert octave >= len(limits.beside) or limits.beside[octave] is None
                continue
            low, middle, high = np.quantile(rest, [quality.BEYOND, 0.5, 1 - quality.BEYOND])
            assert np.allclose(limits.beside[octave], (middle + 1.1 * (low - middle), middle + 1.5 * (high - middle)), atol=1e-6)


def test_compression_bands(spark):
    import base64
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "st", "ing", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    noise = base64.b64encode(rng.randbytes(9_000)).decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    cycle = " ".join(f"{a} {b}" for a, b in [(f"x{i % 211}", f"y{i % 199}") for i in range(6_000)])
    rows = [(1, prose(120)), (2, prose(3_000)), (3, noise), (4, cycle), (5, prose(400) + " " + cycle)]
    got = by_id(quality.quality(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_short_rests_do_not_decide():
    import random

    import zstandard

    rng = random.Random(4)
    compress = zstandard.ZstdCompressor(level=quality.ZSTD_LEVEL).compress
    prose = " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "st", "ing", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(4_000)).encode()
    for full in (1, 2, 3):
        for rest in (*range(1, 21), 511, 512, 513, 4095):
            text = prose[: 4096 * full + rest]
            chunks, bad, passes = quality.judge(text, compress)[1:]
            assert (chunks, bad, passes) == (full + (rest >= 512), 0, True), (full, rest)


@pytest.mark.parametrize("size", [1024, 1279, 1280, 1535, 1536, 2047, 2048, 3071, 3072, 4095, 4096, 8192, 16384, 30000])
def test_random_symbols_are_noise(size):
    import random

    import zstandard

    rng = random.Random(size)
    compress = zstandard.ZstdCompressor(level=quality.ZSTD_LEVEL).compress
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))]
    if size >= 3072:  # shorter, hexadecimal cannot be told from prose
        kinds += [lambda: f"{rng.getrandbits(32):08x}", lambda: f"{rng.getrandbits(16):04x}", lambda: f"{rng.getrandbits(8):02x}"]
    for k, word in enumerate(kinds):
        for _ in range(10):
            text = " ".join(word() for _ in range(size // 2)).encode()[:size]
            assert not quality.measure(text, compress)[6], (k, size)


# --- 10 warc


def test_canonical(spark):
    given = ["http://WWW.Example.com:80/a//b/?b=2&utm_source=x&a=1#top", "https://user@example.com/a/b?a=1&b=2", "example.com/", "https://example.com", "http://example.com?", None]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    assert [r[0] for r in df.select(warc.canonical(F.col("u"))).collect()] == ["example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2", "example.com", "example.com", "example.com", None]


RECORD = "record_id long, kind string, url string, at timestamp, status int, headers array<struct<name:string,value:string>>, body string, address string"


def test_revisits(spark):
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1 + h // 24, h % 24)
    h = lambda **k: [(n.replace("_", "-"), v) for n, v in k.items()]
    rows = [
        (1, "response", "http://a.com/x", at(1), 200, h(ETag='"1"', Content_Type="text/html", Cache_Control="a", Set_Cookie="s"), "one", "z"),
        (2, "response", "https://A.com/x/#f", at(40), 200, h(ETag='"2"', Last_Modified="m"), "two", "z"),
        (3, "response", "http://a.com/x", at(41), 404, h(ETag='"3"'), "gone", "z"),
        (4, "revisit", "http://a.com/x", at(2), 304, h(ETag='W/"1"', Content_Type="no", cache_control="b", Connection="close, X-Drop", X_Drop="d", X_New="n"), None, "z"),
        (5, "revisit", "http://a.com/x", at(50), 304, h(ETag='"2"'), None, "z"),
        (6, "revisit", "http://a.com/x", at(50), 304, h(ETag='"1"'), None, "z"),
        (7, "revisit", "http://a.com/x", at(1), 304, h(ETag='"1"'), None, "z"),
        (8, "revisit", None, at(60), 304, None, None, "z"),
        (9, "revisit", "http://a.com/x", at(60), 304, None, None, "z"),
        (10, "revisit", "http://a.com/x", None, 304, h(ETag='"2"'), None, "z"),
        (11, "revisit", "http://a.com/x", at(60), 304, h(Last_Modified="m"), None, "z"),
        (12, "revisit", "http://a.com/x", at(60), 304, h(Last_Modified="n", ETag='"2"'), None, "z"),
        (12, "revisit", "http://a.com/x", at(60), 304, h(Last_Modified="n", ETag='"2"'), None, "z"),
    ]
    found = warc.resolve(spark.createDataFrame(rows, RECORD)).collect()
    assert len(found) == 10
    got = {r["record_id"]: r for r in found}
    assert {i: (r["resolution"], r["response_id"], r["body"]) for i, r in got.items()} == {
        4: ("resolved", 1, "one"), 5: ("resolved", 2, "two"), 6: ("validator_mismatch", 2, None), 7: ("no_earlier_response", None, None), 8: ("no_address", None, None),
        9: ("no_validator", 2, None), 10: ("no_earlier_response", None, None), 11: ("resolved", 2, "two"), 12: ("validator_mismatch", 2, None),
    }
    assert [tuple(x) for x in got[4]["headers"]] == [("content-type", "text/html"), ("set-cookie", "s"), ("etag", 'W/"1"'), ("cache-control", "b"), ("x-new", "n")]
    assert warc.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    def record(kind, name, date, block, *fields):
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", "WARC-Target-URI: http://a.com/x", f"WARC-Date: {date}", *fields, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = "H\u00e9llo\r\n\r\nWARC/1.1\r\n".encode()
    parts = [
        record("warcinfo", "i", "2024-01-01T00:00:00Z", b"x: y"),
        record("response", "r", "2024-01-01T00:00:01Z", b'HTTP/1.1 200 OK\r\nETag: "1"\r\nX-Long: a\r\n b\r\n\r\n' + page),
        record("revisit", "v", "2024-01-02T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\n\r\n', "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
        record("revisit", "w", "2024-01-02T00:00:00Z", b"", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "c.warc").write_bytes(b"")
    for name, n in (("a.warc", 3), ("b.warc.gz", 3), ("c.warc", 0)):
        assert warc.read(spark, str(tmp_path / name)).count() == n
    # A body that holds what is between records, and one cut off at the end of its file.
    odd = record("response", "s", "2024-01-01T00:00:02Z", b"HTTP/1.1 200 OK\r\n\r\nab\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\ncd\xff")
    (tmp_path / "d.warc").write_bytes(parts[1] + odd + parts[2])
    (tmp_path / "e.warc").write_bytes(parts[1] + odd[:-9])
    for name, bodies in (("d.warc", 3), ("e.warc", 2)):
        got = sorted((r["record_id"], r["body"]) for r in warc.read(spark, str(tmp_path / name)).collect())
        assert [r[0] for r in got] == ["<urn:r>", "<urn:s>", "<urn:v>"][:bodies]
        assert bytes(got[0][1]) == page and bytes(got[1][1]).startswith(b"ab\r\n\r\nWARC/1.1")
    assert warc.read(spark, str(tmp_path)).count() == 3 + 3 + 3 + 2
    # In many splits each record is read once.
    (tmp_path / "many.warc").write_bytes(b"".join(record("response", f"n{k}", "2024-01-01T00:00:01Z", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (k % 50)) for k in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        many = warc.read(spark, str(tmp_path / "many.warc"))
        assert many.rdd.getNumPartitions() > 10
        assert sorted((r["record_id"], len(r["body"])) for r in many.collect()) == sorted((f"<urn:n{k}>", k % 50) for k in range(200))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (found,) = warc.resolve(warc.read(spark, str(tmp_path / "b.warc.gz"))).collect()
    assert (found["record_id"], found["resolution"], found["response_id"], bytes(found["body"])) == ("<urn:v>", "resolved", "<urn:r>", page)
    assert [tuple(h) for h in found["headers"]] == [("x-long", "a b"), ("etag", '"1"')]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    for table in ("documents", "pages", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    expected = duckdb.sql(queries.oracle_sql()[name])
    order = [expected.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
