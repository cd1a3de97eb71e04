"""The training-data operators against plain versions, over rows with nulls, ties, repeats, empty and long texts."""

import hashlib
import io
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import attention, components, decontaminate, edit_counts, mixing, ngram_join, quality_rules, queries, substrings, templates, token_files, tokens, warc
from factloom.llm.html import parse

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def rows():
    """Small documents: copies, near copies, shared passages, repeated doc_ids, nulls, junk and one long text."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Élan", "über", "mer", "x1", "a&b", "语", "stone,", "river.", "42"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ed"]) for _ in range(n))
    passage, base = text(30), text(120)
    words = base.split(" ")
    found = [(1, base), (2, base), (3, base + " tail"), (4, " ".join(["new", *words[1:]])), (5, text(40) + "\n" + passage + "\t " + text(25)), (6, passage), (7, text(15) + " " + passage), (8, ""), (9, None), (10, "two words"), (11, "two words"), (12, "a\na\na\nb"),
             (13, "no " * 60), (14, text(4_000)), (15, " \n\t "), (16, "<|endoftext|> # * $ &&& | <b>"), (None, text(30)), (17, text(30) + " me@x.example 123-456-7890 end"), (17, "other text of one id"), (1, base)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), 0 if t is None else len(t), 0.5) for i, t in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_pieces_keep_ids(tokenizer):
    rng = random.Random(1)
    parts = ["a", " ", "\n", "  ", "é", " ", "　", "1", "'s", "!", "<|endoftext|>", "語", "\t", "\r\n", "😀", "the ", " of", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3_000)] + [None, ""]
    encode = tokens.Encoder(queries.tokenizer_path(), limit=500)  # small, so that pieces are forgotten
    got = []
    for a, b, x in tokens.steps(pa.array(texts), 2_000):
        ids, first = encode(x)
        got += [ids[first[i]:first[i + 1]].tolist() for i in range(b - a)]
    assert got == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_like_the_pattern():
    texts = [r[1] for r in rows()]
    x = tokens.Texts.of(texts)
    starts, ends, first = x.words()
    data = x.buffer.tobytes()
    for i, t in enumerate(texts):
        assert [data[a:b].decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)] == WORD.findall(t or "")


def test_op1_counts_follow_edits(docs, empty, tokenizer):
    path = queries.tokenizer_path()
    trees = edit_counts.with_trees(docs, path)
    for r in collected(trees):
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) == r["token_sums"][1]
    for r in collected(edit_counts.edited(trees.withColumn("edits", edit_counts.redactions("text")), path)):
        assert r["n_tokens_after"] == len(tokenizer.encode(r["edited_text"], add_special_tokens=False).ids)
        if r["doc_id"] == 17 and r["n_edits"]:
            assert r["n_edits"] == 2 and r["edited_text"].endswith("<removed> <removed> end")
    assert edit_counts.edited(edit_counts.with_trees(empty, path).withColumn("edits", edit_counts.redactions("text")), path).count() == 0
    rng = random.Random(3)
    encode = tokens.encoder(path)
    for text in ("", "one two  three\n\nfour " * 300, "词" * 2_000, "a b" * 900):
        (chars, sums), = edit_counts._plant(tokens.Texts.of([text]), encode)
        document = edit_counts.Document(text, chars, sums, encode)
        for _ in range(25):
            start, new = rng.randint(0, len(text) + 3), rng.choice(["", " ", "x", " new words", "\n\n", "é 1"])
            end = start + rng.choice([0, 1, 5, 700])
            document.edit(start, end, new)
            text = text[:start] + new + text[max(start, end):]
            assert document.result() == text and document.tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_op2_budget_and_repeats(docs, empty):
    slim = mixing.counted(docs)
    weighed = {r["source"]: r for r in collected(mixing.weights(slim, max_repeats=1.25))}
    total = sum(r["total"] for r in weighed.values())
    assert abs(sum(r["quota"] for r in weighed.values()) - total) <= len(weighed)
    assert all(r["quota"] <= 1.2501 * r["total"] + 1 for r in weighed.values())
    even = collected(mixing.weights(slim, max_repeats=None, min_entropy=0.99 * np.log(3)))
    assert -sum(r["weight"] * np.log(r["weight"]) for r in even) >= 0.99 * np.log(3) - 1e-6
    placed = collected(mixing.blocks(docs, max_repeats=1.25, block_tokens=500))
    for source, r in weighed.items():
        got = sum(p["n_tokens"] for p in placed if (p["source"] or mixing.NONE) == source)
        assert got >= r["quota"]  # up to the document that reaches it
    for _, block in itertools.groupby(sorted(placed, key=lambda p: (p["block"], p["place"])), key=lambda p: p["block"]):
        held = [p["place"] for p in block]
        assert held == list(range(len(held)))
    assert sorted((str(r.doc_id), str(r.source)) for r in mixing.mixed(docs, max_repeats=1.25).collect()) == sorted((str(p["doc_id"]), str(p["source"])) for p in placed)
    assert mixing.blocks(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns


def test_op2_orders_crowded_blocks_by_ranges(spark):
    """A source without tokens has all its rows in one block; the places are those of one window, whose groups stay bounded."""
    rows = [(i, None if i % 2 else "", "empty", "en", 0, 0.5) for i in range(400)] + [(400 + i, "word " * 9, "en", "full", 45, 0.5) for i in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "none" if i < 400 else "full", n, x) for i, t, _, _, n, x in rows], DOCS)
    whole, cut = (sorted(map(tuple, mixing.blocks(frame, block_tokens=90, block_rows=n).collect()), key=str) for n in (1 << 16, 20))
    assert whole == cut and max(sum(r[4] == block for r in cut) for block in {r[4] for r in cut}) >= 400
    for block in {r[4] for r in cut}:
        assert sorted(r[5] for r in cut if r[4] == block) == list(range(sum(r[4] == block for r in cut)))
    keys = spark.range(400).select(F.lit(0).cast("long").alias("block"), F.expr("cast(conv(substr(md5(string(id)), 1, 15), 16, 10) as bigint)").alias("order_key"))
    dealt, _ = mixing.in_ranges(keys, 20)
    assert max(r["count"] for r in dealt.groupBy("range").count().collect()) <= 60


def test_op3_round_trip(docs, empty, tokenizer):
    got = sorted(collected(token_files.tokenized(docs, queries.tokenizer_path(), with_ids=True)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows()), key=lambda i: (i is not None, i))
    want = sorted((str(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows())
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    assert token_files.tokenized(empty, queries.tokenizer_path()).count() == 0


def test_words_and_marks_are_pieces_of_their_own(tokenizer):
    """One piece for a word, whatever mark follows; such pieces need the merges alone, and the ids stay those of the whole tokenizer."""
    encode = tokens.Encoder(queries.tokenizer_path())
    whole, encode.tokenizer = encode.tokenizer, None  # not to be asked for words, numbers and marks
    texts = [f"stone{mark} über{mark} 42{mark} www.stone{mark}42" for mark in ("", ",", ".", "!?", ";", ")")]
    ids, first = encode(tokens.Texts.of(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(first.tolist())] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert {p.decode() for p in encode.known} == {"stone", " über", " 42", " www", "42", ",", ".", "!?", ";", ")"}
    encode.tokenizer = whole
    sides = ["a", "é", "×", "7", "²", ".", "'", "''", ",'", "'s", "'ll", " ", "\n", "\xa0", "中", "ʰ", "\u0301", "_"]
    texts = [f"{x}{y}{z}" for x, y, z in itertools.product(sides, repeat=3)]
    for limit in (40, 300_000):
        ids, first = tokens.Encoder(queries.tokenizer_path(), limit)(tokens.Texts.of(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(first.tolist())] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_simple8b_words_and_escapes():
    rng = np.random.default_rng(0)
    for values in ([], [0], [1] * 7, [0] * 500, [2**63, 2**60 - 1, 2**60 - 2, 5], rng.integers(0, 50_000, 5_000), np.concatenate([np.zeros(300), rng.integers(0, 3, 1_000), rng.integers(0, 2**62, 50)])):
        values = np.array(values, dtype=np.uint64)
        assert np.array_equal(token_files.unpack(*token_files.pack(values)), values)
    data = bytearray(token_files.block(np.array([1]), np.array([0]), np.array([3]), np.array([5, 6, 7])))
    data[-6] ^= 1
    with pytest.raises(ValueError):
        token_files.read_block(io.BytesIO(bytes(data)))


def test_op4_learns_and_scores_everything(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_quality_attention(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == queries.table(spark, sf, "documents").count() and all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.95
    none = attention.fit(docs, spark.createDataFrame([(None, 1), (3, 7)], "doc_id long, quality int"))
    scored = attention.score(docs, none)
    assert scored.count() == len(rows()) and scored.columns.count("score") == 1 and {r.score for r in scored.collect()} == {0.5}
    assert attention.score(empty, none).count() == 0


def test_op5_against_all_pairs(docs, empty):
    sets = []
    for i, t, *_ in rows():
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    linked = [[k for k, o in enumerate(sets) if k != j and s and o and len(s & o) >= 0.8 * len(s | o)] for j, s in enumerate(sets)]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min([label[j], *(label[k] for k in linked[j])]) for j in range(len(sets))]
    ids = [r[0] for r in rows()]
    want = [(ids[j], min((ids[k] for k in range(len(sets)) if label[k] == label[j] and ids[k] is not None), default=None), len(linked[j])) for j in range(len(sets))]
    got = ngram_join.similar(docs).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.class_id, r.n_links)) for r in got)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect() if r.text) == sorted(str(ids[j]) for j in {label[j]: j for j in reversed(range(len(sets)))}.values() if rows()[j][1])
    assert ngram_join.similar(empty).count() == 0


def test_verified_chunks_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(words[:j] + [f"c{j}"] + words[j + 1:]) for j in range(0, 20, 2)]
    got = {r.doc_id: r for r in ngram_join.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(76)} for t in texts]
    for j, s in enumerate(sets):
        assert got[j].n_links == sum(k != j and len(s & o) >= 0.8 * len(s | o) for k, o in enumerate(sets)) and got[j].class_id == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (3, 1), *((k, k + 1) for k in range(20, 60))]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, **{k: 20 for k in range(20, 61)}}


def brute_substrings(found, window):
    places = {}
    for i, t in found:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            at = (-(1 << 63) if i is None else i, k)
            key = tuple(w[k:k + window])
            places[key] = min(places.get(key, at), at)
    out = []
    for i, t in found:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - window + 1) if places[tuple(w[k:k + window])] < (-(1 << 63) if i is None else i, k) for j in range(k, k + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [3, 20])
def test_op6_against_brute_force(docs, empty, window):
    got = substrings.parsed(docs, window=window, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings([r[:2] for r in rows()], window)
    for r in got:
        assert all(f.length >= window for f in r.factors) and len(WORD.findall(r.kept_text)) == r.n_words - r.n_removed
    assert substrings.parsed(empty).count() == 0


def test_op7_measures_and_sketches(spark, docs, empty):
    for r in collected(quality_rules.measures(docs)):
        text = next(t or "" for i, t, *_ in rows() if i == r["doc_id"] and len(WORD.findall(t or "")) == r["n_words"])
        w = WORD.findall(text)
        spans = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        hit = {j for k, s in enumerate(spans) if spans.count(s) > 1 for j in range(k, k + 5)} if len(w) < 1_000 else None
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert hit is None or r["n_repeat_words"] == len(hit)
    judged = collected(quality_rules.judged(docs))
    assert len(judged) == len(rows()) and all(not (r["base_failed"] and r["kept"]) for r in judged)
    assert quality_rules.judged(empty).count() == 0


def test_op8_round_trip(spark):
    html = "<p>é</p>" * 200
    pages = [(1, "http://a/x%20y", html), (2, "http://a/2", html), (3, None, None), (None, "http://b/", html), (5, "http://c/", "small"), (6, "http://c/6", "small"), (7, "http://d/", "z" * 300_000), (2, "http://a/2", html)]
    got = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    data = lambda h: (h or "").encode()
    big = lambda i, h: len(data(h)) >= 1_000 and h == html and i != 2
    want = [(i, u, len(data(h)), hashlib.sha1(data(h)).hexdigest(), "revisit" if big(i, h) else "response", 2 if big(i, h) else None) for i, u, h in pages]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    good = warc.record(1, "u", b"x" * 5_000, None, False)
    for bad in (good[:-9], good[:40]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_op9_against_windows(spark, docs, empty):
    by_id = {i: t for i, t, *_ in rows()}
    items = [(1, by_id[6]), (2, "Two WORDS"), (3, None), (4, "..."), (5, by_id[1][50:300]), (5, by_id[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    normal = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [(i, {tuple(w[k:k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)}) for i, t in items if (w := normal(t))]
    want = []
    for i, t, *_ in rows():
        w, hit, ids = normal(t), set(), []
        for item, windows in grams:
            n = len(next(iter(windows)))
            at = [k for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows]
            hit |= {j for k in at for j in range(k, k + n)}
            ids += [item] * bool(at)
        names = ",".join(sorted({str(x) for x in ids}))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    for limit in (50_000, 3):  # as sets in the plan, and joined
        got = decontaminate.contamination(docs, bench, max_grams=limit).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div>%s<aside>Side</aside><form>Go<input></form><div id="comments"><p>me too</div><footer>&copy; x</footer>"""


def test_op10_main_text(spark):
    article = "<article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Four &lt;x&gt;</p><div class=ad>Buy</div><!-- no <p> --><p>The same</p></article>"
    plain = "<div class=content><p>Body %d of some length</p><p>and its end</p></div><div class=box>the same box</div>"
    pages = [(1, "http://a/1", PAGE % article), (1, "http://a/1", PAGE % article), (2, None, None), (3, "http://a/3", (PAGE % article)[:-30])] + [(10 + k, f"http://b/{k}", PAGE % (plain % k)) for k in range(5)]
    got = templates.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = "Head & more\n\nOne two three\n\nFour <x>\n\nThe same"
    assert sorted((r.page_id, r.text) for r in got) == sorted([(1, text), (1, text), (2, ""), (3, text)] + [(10 + k, f"Body {k} of some length\n\nand its end") for k in range(5)])
    assert all(r.n_chars == len(r.text) for r in got)
    assert templates.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op10_template_from_classes(spark):
    """Tokens of valid, nested classes only; text of all pages of a host is dropped inside an article as well."""
    page = "<body><article><div class=text>%s</div><div class=box>Read it all</div>%s</article><div class=foot-line>Site</div></body>"
    pages = [(k, f"http://c/{k}", page % ("".join(f"<p>Text {k} part {i}</p>" for i in range(1 + k % 3)), "<div class=extra>Extra</div>" if k % 2 else "")) for k in range(8)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    [found] = templates.templates(frame).collect()
    even = [("body",), ("body", "article"), ("body", "article", "div.text"), ("body", "article", "div.box"), ("body", "div.foot-line")]
    assert set(found.template) == {templates.path_id(p) for p in even}  # p repeats unevenly, div.extra shares its vector with no other token
    assert templates.path_id(even[3]) in found.constant
    assert templates.nested([(1, 0), (2, 1), (4, 3)]) == {1, 2}
    for r in templates.extracted(frame).collect():
        k = r.page_id
        assert r.text == "\n\n".join([f"Text {k} part {i}" for i in range(1 + k % 3)] + ["Extra"] * (k % 2))


def test_op10_keeps_text_without_article(spark):
    """Copies count once, rare layouts and all unlinked slots are kept, and so are variants of one page."""
    body = lambda *parts: "<body>" + "".join(f"<div class={name}><p>{text}</p></div>" for name, text in parts) + "</body>"
    copies = [(k, f"http://d/{k}", body(("story", "All of the story"), ("box", "a box"))) for k in range(4)]
    mixed = [(10 + k, f"http://e/{k}", body(("content", f"Content {k}"), ("more", f"More {k}"), ("box", "same box"))) for k in range(5)]
    mixed += [(20 + k, f"http://e/c{k}", body(("rare", "Copied thrice"))) for k in range(3)] + [(30, "http://e/r", body(("other", "Rare layout"), ("more", "More of it")))]
    variants = [(40 + k, f"http://f/{k}", body(("story", "A long story that is told again"), ("seen", f"{k} views"))) for k in range(3)]
    got = {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(copies + mixed + variants, "page_id long, url string, html string")).collect()}
    want = {k: "All of the story\n\na box" for k in range(4)} | {20 + k: "Copied thrice" for k in range(3)} | {30: "Rare layout\n\nMore of it"}
    want |= {10 + k: f"Content {k}\n\nMore {k}\n\nsame box" for k in range(5)} | {40 + k: f"A long story that is told again\n\n{k} views" for k in range(3)}
    assert got == want  # same box stands in 5 of 7 different pages only


def test_parse_stands_broken_markup():
    for text in ("<", "<p", "a < b", "</p></div>", "<div><p>x</div>y", "<script>never closed", "<!-- open", "<p class='a>b</p>", "&#xD800; &am &bogus;"):
        parse(text)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_pipeline_by_plain_steps(spark, tokenizer):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        stages[name] = [r.asDict() for r in docs.collect()]
    assert [len(stages[k]) for k in ("quality", "near_duplicates", "decontamination")] == sorted((len(stages[k]) for k in ("quality", "near_duplicates", "decontamination")), reverse=True)
    bench = [r.text for r in queries.table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[k:k + 10]) for t in bench for w in [re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))] for k in range(max(0, len(w) - 9))}
    for r in stages["near_duplicates"]:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        assert (r["doc_id"] in {d["doc_id"] for d in stages["decontamination"]}) == (not any(tuple(w[k:k + 10]) in grams for k in range(len(w) - 9)))
    by_id = {d["doc_id"]: d["text"] for d in stages["mixing"]}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in stages["token_ids"]) == sorted((d["doc_id"], len(tokenizer.encode(by_id[d["doc_id"]], add_special_tokens=False).ids) + 1) for d in stages["mixing"])
