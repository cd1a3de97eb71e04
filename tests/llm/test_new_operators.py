"""Joined BPE, the lexical scan and the Merkle manifest against plain versions."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, joined_bpe, lexical_scan, merkle, warc
from factloom.llm.files import new_folder
from factloom.llm.queries import tokenizer_path
from factloom.llm.tokens import Texts

WORDS = tokenizer_path("word_bpe_49k.json")
ALPHABETS = ("ab", "abcdefghijklmnopqrstuvwxyz", "the ing", "äöüß日本語中文é", "0123456789", "!?.-=_", "aA  \n\t'sȩ́́", "tion")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def some_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(rng.choice(ALPHABETS[:1] if k % 3 else ALPHABETS)) for _ in range(rng.choice([1, 5, 80, 700]))) for k in range(n)]
    texts += ["".join(rng.choices(a, k=600)) for a in ALPHABETS]
    return [*texts, None, "", " \n\t", "<|endoftext|>", "a<|startoftext|>B<|endoftext|>", " x y", "퟿\U0001f600" * 40, "e" + "́" * 200]


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_joined_parts_are_the_librarys_ids(leaf):
    want, codec = library(), joined_bpe.Codec(WORDS, leaf, known=50)
    texts = some_texts(60, leaf)
    ids, first = codec(Texts.of(texts))
    decoded = codec.texts(ids, first)
    for k, text in enumerate(texts):
        exact = want.encode(text or "", add_special_tokens=False).ids
        assert ids[first[k]:first[k + 1]].tolist() == exact
        assert decoded[k] == want.decode(exact, skip_special_tokens=False)


def test_windows_grow_until_both_sides_agree():
    codec = joined_bpe.Codec(WORDS)
    codec.models
    rng = random.Random(5)
    for _ in range(300):
        run = "".join(rng.choices(rng.choice(["ab", "aeinrst", "the", "xyzzy"]), k=rng.randrange(2, 60)))
        cut = rng.randrange(1, len(run))
        left, right = codec._encoded([run[:cut], run[cut:]], [False, True])
        assert codec.join([(left, right, True)])[0] == codec._encoded([run], [True])[0]


def test_long_texts_are_dealt_over_rows_and_joined(spark):
    texts = [*some_texts(20, 9), "ab" * 3_000 + " c", "word " * 900 + "x" * 2_500 + "<|endoftext|>" + "é" * 800, "日本語" * 700]
    rows = [(k if k % 7 else None, t, "clash") for k, t in enumerate(texts)] + [(1, texts[-1], "clash")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = library()
    expected = sorted((str(i), want.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    for spread in (300, 1 << 22):
        got = joined_bpe.encoded(docs, WORDS, leaf=16, spread=spread).collect()
        assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), dtype="<u4").tolist()) for r in got) == expected
    assert joined_bpe.round_trip(docs.limit(0), WORDS).count() == 0


def test_decoding_leaves_out_unknown_ids_and_null_rows(spark):
    ids = [343, 1 << 30, 49407]
    coded = spark.createDataFrame([(1, bytearray(np.array(ids, dtype="<u4").tobytes())), (2, None), (None, bytearray())], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in joined_bpe.decoded(coded, WORDS).collect()}
    assert got == {1: library().decode([343, 49407], skip_special_tokens=False), 2: "", None: ""}


def test_a_run_of_megabytes(spark):
    run = "".join(random.Random(3).choices("abcdefghij", k=3_000_000))
    docs = spark.createDataFrame([(1, run), (2, "word " * 600_000)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.ids) for r in joined_bpe.encoded(docs, WORDS, spread=400_000).collect()}
    want = library()
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id], dtype="<u4").tolist() == want.encode(r.text, add_special_tokens=False).ids


# --- lexical scan ---------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VOCABULARY = ["a", "B", "ab", "Abc", "é", "É", "日本", "x1", "1", "the", "THE", "-", "!!", "_", "\n"]


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    counted = [(i, Counter(terms_of(x))) for i, x in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    documents, length = len(counted), sum(n for *_, n in counted)
    holding = Counter(w for _, c, _ in counted for w in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, Counter()).update(terms_of(x))
    out = []
    for i, query in asked.items():
        scored = []
        for d, c, n in counted:
            m = 100 - 75 + 75 * n * documents // length
            score = sum(r * math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w, r in query.items() if w in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def scan_rows(seed):
    rng = random.Random(seed)
    docs = [(rng.choice([None, i, i, i // 3]), rng.choice([None, "", " ".join(rng.choices(VOCABULARY, k=rng.choice([1, 3, 30]))), " ".join(rng.choices(VOCABULARY[:4], k=9))])) for i in range(200)]
    docs += [(1_000 + i, "ab the ab") for i in range(60)]  # ties
    items = [(f"q{i * 3 // 4}" if i else None, " ".join(rng.choices(VOCABULARY, k=rng.choice([0, 1, 4, 12])))) for i in range(30)] + [("n", None)]
    return docs, items


@pytest.mark.parametrize("block_bytes, size", [(8 << 20, 1 << 20), (900, 1 << 20), (8 << 20, 9)])
def test_scan_ranks_as_plain_counting(spark, monkeypatch, block_bytes, size):
    docs, items = scan_rows(block_bytes + size)
    monkeypatch.setattr(lexical_scan, "HELD", 50)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(4)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, doc_id int")
    got = lexical_scan.ranked(table, asked, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items)


def test_scan_of_slices_and_of_large_sums():
    rng = random.Random(4)
    text = " ".join(rng.choices(VOCABULARY[:9], k=4_000))
    rewritten = next(lexical_scan._rewritten(__import__("pyarrow").array([text])))[1].buffer.tobytes()
    terms = sorted(set(terms_of(text)))[:-1]
    block = lexical_scan.Block.of([(0, t, 1) for t in terms] + [(1, terms[0], 1 << 30)], 2).weighed(10, 1_000, {0: 3})
    whole = lexical_scan.occurrences(lexical_scan.scanner(block), rewritten, len(terms))
    counts = Counter(terms_of(text))
    assert dict(zip([terms[t] for t in whole[0]], whole[1].tolist())) == {t: counts[t] for t in terms}
    lexical_scan.SLICE, kept = 64, lexical_scan.SLICE
    try:
        parts = lexical_scan.occurrences(lexical_scan.scanner(block), rewritten, len(terms))
    finally:
        lexical_scan.SLICE = kept
    assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()
    assert not block.exact_in_doubles
    tf, m = counts[terms[0]], 25 + 75 * 4_000 * 10 // 1_000
    assert block.scores(*whole, 4_000)[1] == (1 << 30) * int(block.weights[0]) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))


def test_scan_of_empty_tables(spark):
    docs, items = scan_rows(1)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert lexical_scan.ranked(table.limit(0), asked).count() == 0
    assert lexical_scan.ranked(table, asked.limit(0)).count() == 0
    assert lexical_scan.ranked(table, asked).schema.simpleString() == lexical_scan.ranked(table, asked.limit(0)).schema.simpleString()


# --- Merkle manifest ------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    proofs, members, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        above, over = [], []
        for a in range(0, len(level), 3):
            run = level[a:a + 3]
            for k in range(len(run)):
                for i in members[a + k]:
                    proofs[i] += run[:k] + run[k + 1:]
            above.append(digest(*run))
            over.append(sum(members[a:a + 3], []))
        level, members = above, over
    return level[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0], digest(*map(field, r))))
    trees = {}
    for name, leaves in sources.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = (leaves, *plain_tree([d for _, d in leaves]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, ends = plain_tree([trees[s][1] for s in order])
    return [(i, d, trees[s][1], root, digest(*proof, *end)) for s, end in zip(order, ends) for (i, d), proof in zip(trees[s][0], trees[s][2])]


def merkle_rows():
    rng = random.Random(8)
    rows = [(rng.choice([None, i, i, i, i // 2]), rng.choice([None, "a", "a", "a", "b", "é", "", " c", "Z", "\U0001f600", "￿"]), "en", i, rng.choice([None, "", "x\ny", "word\n" * 5])) for i in range(900)]
    return rows + [rows[5]] * 40 + [(7, "solo", "x", 1, "t")]


@pytest.mark.parametrize("round_nodes", [100_000, 5])
def test_manifest_is_the_plain_trees(spark, round_nodes):
    rows = merkle_rows()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, proof int, tree string").repartition(5)
    got = merkle.manifest(docs, round_nodes=round_nodes)
    root = merkle.folded(F.col("leaf"), F.col("proof"))
    found = got.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("p"), root.alias("folded"), merkle.folded(F.lit("0" * 64), F.col("proof")).alias("wrong")).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, plain_manifest(rows)))
    assert all(r.folded == r.root != r.wrong for r in found)


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame(merkle_rows()[:1], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs.limit(0)).count() == 0
    only = merkle.manifest(docs).first()
    assert only.leaf == only.subroot == only.root and only.proof == ""


def test_nodes_wait_for_children_in_other_ranges(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "'s' AS source", "'l' AS lang", "id AS n_chars", "cast(id AS string) AS text")
    rows = merkle._leaves(merkle.placed(docs.select(F.col("source").alias("tree"), "doc_id", F.sha2("text", 256).alias("digest"), F.lit(None).cast("string").alias("other")), ("doc_id",)))
    rounds = merkle.swept(rows, 40)
    assert len(rounds) > 1
    assert sum(r.where(F.col("kind") == merkle.ROOT).count() for r, _ in rounds) == 1
    runs = sum(r.where(F.col("kind") == merkle.RUN).count() for r, _ in rounds)
    assert runs == 1_000 + 334 + 112 + 38 + 13 + 5 + 2 + 1


def test_bounds_of_rules_follow_their_sources(spark):
    """Sources of different texts get different bounds, and a text of single letters is an outlier on the low side."""
    from factloom.llm import quality_rules

    rng = random.Random(6)
    word = lambda low, high: "".join(rng.choices("abcdefgh", k=rng.randrange(low, high)))
    rows = [(k, "en", "short", " ".join(word(3, 6) for _ in range(40))) for k in range(120)] + [(200 + k, "en", "long", " ".join(word(7, 12) for _ in range(40))) for k in range(120)]
    rows += [(400 + k, "de", "marks", " ".join(word(3, 6) + "#" * (k % 3) for _ in range(40))) for k in range(120)]
    rows += [(900, "en", "short", " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40))), (901, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    judged = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert not judged[900].kept and not judged[900].base_failed and not judged[901].kept
    assert judged[0].high_word_length == judged[200].high_word_length > judged[400].high_word_length  # the language's own is wider than that of its short source
    assert judged[400].high_symbols > judged[0].high_symbols == 0
    assert sum(r.kept for r in judged.values()) >= 350


def test_long_labelled_documents_are_learned_whole(spark):
    from factloom.llm import attention

    text = " ".join(f"word{k}" for k in range(96 * 70))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "a plain line of text", "y"), (3, None, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, quality int")
    model, again = attention.fit(docs, labels), attention.fit(docs.repartition(3), labels)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights) if hasattr(model, "weights") else True
    scored = attention.score(docs, model, name="_score", predicted="_predicted")
    assert scored.columns == ["doc_id", "text", "score", "_score", "_predicted"] and scored.where("score IN ('x', 'y', 'z')").count() == 4


def test_archives_have_dates_and_ids_and_hand_payloads_on_by_bytes(spark, monkeypatch):
    named, unnamed = warc.record(7, "http://a/", b"x" * 10, None, False, 86_400.0), warc.record(None, None, b"x" * 10, None, False)
    head = zlib.decompress(named, 31).split(b"\r\n\r\n")[0]
    assert b"WARC-Date: 1970-01-02T00:00:00Z" in head and b"WARC-Record-ID: <urn:page:7>" in head
    assert b"WARC-Record-ID: <urn:sha1:" in zlib.decompress(unnamed, 31)
    first, second = warc.read_records(io.BytesIO(named + unnamed))
    assert first["page_id"] == 7 and second["page_id"] is None and second["payload"] == b"x" * 10
    assert [r["payload"] for r in warc.read_records(io.BytesIO(named + unnamed), with_payload=False)] == [None, None]
    html = [chr(97 + i) * 40_000 for i in range(9)]
    pages = spark.createDataFrame([(i, "http://a/", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "HELD_BYTES", 100_000)
    manifest = warc.write_archives(pages, new_folder(spark, "warc"))
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert got == dict(enumerate(html))


def test_long_items_are_joined_and_clean_documents_keep_their_rows(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(i, "a " + item if i % 10 == 0 else "nothing of it " * 4) for i in range(60)] + [(60, None), (60, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", item), ("x", item), (None, "w" * 5_000)], "item_id string, text string")
    sets = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 1_000)
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == sets
    assert len(sets) == 62 and sum("contaminated=True" in r and "n_items=2" in r for r in sets) == 6
