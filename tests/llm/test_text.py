"""Language, toxicity, HTML, personal data, SentencePiece and packing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from feathergrid.llm import html_text, lang_id, packing, pii, queries, spm_fst, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _held_out(table, mod, hit):
    return table["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod == hit)


# Language


def test_language_of_held_out_documents(spark, sf_dir):
    got = queries.QUERIES["op2_language_id"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got["held_out"] == _held_out(got, 3, 1)).all()
    assert (both["lang"] == both["lang_pred"])[both["held_out"]].mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_edges(edge, nothing, edge_rows):
    model = lang_id.fit(edge)
    rows = lang_id.predict(edge.select("doc_id", "text", "fold"), model).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    kept = lang_id.keep_recognised(edge, model)
    assert kept.columns == edge.columns
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _ in edge_rows)
    assert lang_id.predict(nothing, lang_id.fit(nothing)).count() == 0
    unlearned = lang_id.predict(edge, lang_id.fit(nothing)).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlearned] == ["und"]


def test_presence_kernel_equals_sets():
    texts = ["abcab", "bca xyz", "é abc"]
    points = [lang_id.code_points(t) for t in texts]
    grams = [{t[i : i + n] for n in lang_id.ORDERS for i in range(len(t) - n + 1)} for t in texts]
    codes, counts = np.unique(np.concatenate([lang_id._grams(p, n) for p in points for n in lang_id.ORDERS]), return_counts=True)
    flags = lang_id.Dictionary(codes, counts).presence(points)
    assert (flags @ flags.T == [[len(a & b) for b in grams] for a in grams]).all()


# Toxicity


def test_toxicity_of_held_out_documents():
    """Labels of the tables are partly noise; the classifier still ranks nearly all toxic documents first."""
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    aside = _held_out(docs, 5, 0)
    model = toxicity.fit_texts(list(docs["text"][~aside]), list(docs["toxic"][~aside]))
    score = toxicity.Scorer(model).scores(list(docs["text"][aside]))
    truth = docs["toxic"][aside].to_numpy()
    ranks = pd.Series(score).rank().to_numpy()
    n = truth.sum()
    assert (ranks[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n)) > 0.93
    assert ((score >= 0.5) == truth).mean() > 0.95


def test_toxicity_edges(spark, edge, nothing, edge_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (8, 0), (None, 1), (99, 0), (10, None), (11, 7)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == len(edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_toxicity_pieces_equal_whole(monkeypatch):
    texts = [f"good w{i} day" for i in range(40)] + [f"vile w{i} scum" for i in range(40)]
    model = toxicity.fit_texts(texts, [0] * 40 + [1] * 40)
    long = " ".join(texts * 5)
    whole = toxicity.Scorer(model).scores([long, "", "vile scum", "good day"])
    assert whole[2] > whole[3]
    monkeypatch.setattr(toxicity, "_BATCH_WORDS", 37)
    assert np.allclose(toxicity.Scorer(model).scores([long, "", "vile scum", "good day"]), whole)


# HTML


def _page(title, body, side="", start="", end=""):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<div id='top-nav'><a href='/'>Home</a></div>{start}<div class='wrap'><div class='content'><h1>{title}</h1>{body}</div>{side}</div>{end}</body></html>"
    )


def test_main_text_without_semantic_tags(spark):
    noise = "<div class='sidebar'><p>Side words that are rather many here</p></div>"
    end = "<div id='comments'><p>First!</p></div><form><label>Name</label><input></form><div class='foot-note'>&copy; Us</div>"
    pages = [
        (i, f"https://X.example.com/p/{i}", _page(f"T{i} &amp; more", f"<p>Some <b>text</b>\n  of {i}.<p>Second &nbsp;line {i}<ul><li>one {i}<li>two</ul>", noise, "<div class='cookie-bar'>Cookies</div>", end))
        for i in range(8)
    ]
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in got:
        i = r.page_id
        assert r.text == f"T{i} & more\nSome text of {i}.\nSecond line {i}\none {i}\ntwo"
        assert r.n_chars == len(r.text)


def test_main_text_edges(spark):
    rows = [
        (1, "http://a.example/1", None, "h"),
        (2, "http://a.example/2", "", "h"),
        (3, None, "<p>no host</p>", "h"),
        (3, None, "<p>no host</p>", "h"),
        (None, "not a url", "plain &lt;text", "h"),
        (4, "http://b.example/1", "<article><p>open <b>never closed", "h"),
        (5, "http://b.example/2", "<article>" + "<div>" * 300 + "<p>deep</p>", "h"),
        (6, "http://c.example/1", "<article><p>" + "word " * 200_000 + "</p></article><footer>f</footer>", "h"),
        (7, "http://c.example/2", "<script>only()</script><!-- and a comment", "h"),
        (8, "http://d.example/1", "a < b & c > d &eacute;&#33; </nothing>", "h"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert html_text.main_text(frame).count() == len(rows)
    assert (got[1], got[2], got[3], got[None], got[4], got[5], got[7]) == ("", "", "no host", "plain <text", "open never closed", "deep", "")
    assert got[6] == ("word " * 200_000).strip()
    assert got[8] == "a < b & c > d é!"
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_copies_of_a_page_make_no_phrase_of_the_host(spark):
    def page(title, body):
        return f"<html><body><article><h1>{title}</h1>{body}<div class='end'>Thank you for reading</div></article></body></html>"

    copied = page("Copied", "<p>Some words.</p><blockquote>A quoted saying.</blockquote><pre>x = 1</pre>")
    rows = [(i, f"http://a.example/{i}", copied) for i in range(6)]
    rows += [(10 + i, f"http://a.example/{10 + i}", page(f"T{i}", f"<p>Other words {i}.</p>")) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {got[i] for i in range(6)} == {"Copied\nSome words.\nA quoted saying.\nx = 1"}
    assert [got[10 + i] for i in range(8)] == [f"T{i}\nOther words {i}." for i in range(8)]


@pytest.mark.parametrize("count", [1, 8])
def test_text_beside_the_body_is_kept(spark, count):
    """No article or main: titles, intros and what few pages have stand beside the heaviest block."""
    def page(i):
        extra = "<div class='box'><p>Only here.</p></div>" if i == 3 else ""
        menu = "<div class='top-nav'><a href='/'>Home</a></div><div class='links'><a href='/x'>More</a></div>"
        body = f"<div class='body'><p>{f'long text {i} ' * 40}</p><p>end {i}</p></div>"
        site = "<div class='site'><p>Our site</p></div>" if count > 1 else ""
        return f"<html><body>{menu}{site}<div class='post'><h1>Title {i}</h1><div class='intro'>Intro {i}</div>{extra}{body}</div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(count)]
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r.page_id
        want = [f"Title {i}", f"Intro {i}", *["Only here."] * (i == 3), (f"long text {i} " * 40).strip(), f"end {i}"]
        assert r.text == "\n".join(want)


def test_wrappers_find_optional_and_repeated_groups():
    def wrap(html):
        return html_text.wrapper_of(html_text.parse(html))

    whole = wrap("<div><h2>a</h2><p>x</p><h2>b</h2><p>y</p></div><span>same</span>")
    whole = html_text._merge(whole, wrap("<div><h2>a</h2><p>x</p></div><table><tr><td>t</table><span>same</span>"))
    div, table, text = whole[html_text._KIDS]
    assert [k[html_text._SIG] for k in div[html_text._KIDS]] == ["h2", "p"] and all(k[html_text._REP] for k in div[html_text._KIDS])
    assert table[html_text._OPT] and text[html_text._CONST] is not None
    assert div[html_text._KIDS][0][html_text._KIDS][0][html_text._CONST] is None  # different headings: a slot


def test_pages_of_the_tables(spark, sf_dir):
    """All given pages have an article element, so plain patterns can say what its text is."""
    from html import unescape

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = queries.QUERIES["op1_html_text"](spark, sf_dir).toPandas().set_index("page_id")["text"]
    for page, html in zip(pages["page_id"], pages["html"]):
        inner = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
        parts = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("<(p|h1|/p|/h1)>", "\0", inner))).split("\0")
        assert got[page] == "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)


# Personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in RULES for m in re.finditer(RULES[k], text or "") if _passes(k, m.group()))


def test_base_spans_equal_the_patterns(spark, edge_rows):
    rng = random.Random(4)
    bits = "a b9 @ . .com - 1 22 255 256 4111 1111111111111111 + ( ) \n é 😀 x@y.z 1.2.3.4 % _ 4111-1111-1111-1111 +1(555)".split(" ")
    texts = ["".join(rng.choice(bits + [" "]) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["x" * 100_000, "1" * 100_000, "1 " * 50_000, "1." * 50_000, "+1" + "(" * 50_000, "a@" * 20_000, "@@a@b.co@c.de", "1.2.3.4.5.6.7.8"]
    texts += [t for _, t, _ in edge_rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(4)
    got = pii.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = _spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and (r.spans == want or r.spans.startswith(want + "," if want else "term"))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in RULES]


def test_disclosing_terms_are_generalised(spark):
    lines = [f"note {i} by Quandle mail quandle@corp.example about the plan" for i in range(3)]
    rows = [(i, t, "k") for i, t in enumerate(lines)] + [(10 + i, f"the plan and the note about mail number {'abcdefgh'[i % 8] * 3}", "k") for i in range(60)]
    rows += [(100, "Quandle alone, and no address", "k"), (101, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[0] == "note 0 by [Word] mail [email] about the plan"
    assert got[10] == rows[3][1] and got[100] == rows[-2][1] and got[101] is None
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[1] == "email:23:43,term:10:17"


def test_disclosing_terms_are_marked_in_every_document(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"note {i} by Quandle mail quandle@corp.example about the plan") for i in range(3)]
    rows += [(10 + i, f"the plan and the note about mail number {'abcdefgh'[i % 8] * 3}") for i in range(600)]
    rows += [(1000, "Quandle alone, and no address"), (1001, None), (1002, "Quandles and aQuandle are other words"), (1003, "to x.Quandle@corp.example, plan"), (1004, "")]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    spans = {r.doc_id: r.spans for r in queries.QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    assert spans[1] == "email:23:43,term:10:17" and spans[1000] == "term:0:7" and spans[1003] == "email:3:25"
    assert spans[10] == spans[1001] == spans[1002] == spans[1004] == ""
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_personal_data(spark, docs, str(tmp_path)).collect()}
    assert got[0] == "note 0 by [Word] mail [email] about the plan" and got[1000] == "[Word] alone, and no address"
    assert got[1003] == "to [email], plan" and all(got[i] == t for i, t in rows if i in (10, 1001, 1002, 1004))


def test_repeated_lines_count_on_all_sides(spark):
    twice = "\n".join(["Quandle mail quandle@corp.example"] * 10 + ["or Quandle at quandle@corp.example"])
    rows = [(1, twice)] + [(2 + i, f"mail or at {'abcdefgh'[i % 8] * 3}") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].count("term:") == 11 and not any(got[2 + i] for i in range(60))


def test_personal_data_edges(edge, nothing):
    assert pii.sanitise(edge).columns == edge.columns
    assert sorted(map(str, pii.sanitise(edge).collect())) == sorted(map(str, edge.collect()))  # nothing personal in it
    assert pii.report(nothing).count() == 0


def test_personal_data_stays_in_the_jvm(edge):
    plan = pii.find(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SentencePiece


def test_encoding_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    made = spm_fst.machine(PIECES)
    rng = random.Random(6)
    bits = list("abcdeé \n▁.,123ABC日́") + ["th", "ing", " the", "  ", "😀", "<s>", "\0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(2000)]
    texts += [" " * 40, "a" * 3000, "ab" * 2000, "=" * 500, "\n\n", "</s>", "<0x41>"]
    for text in texts:
        ids = made.encode(text)
        assert ids.tolist() == library.encode(text)
        assert made.decode(ids) == library.decode(ids.tolist())


def test_cheapest_path_is_the_best_of_all():
    """With costs instead of merges the lattice gives the cheapest of all ways to cut a string."""
    made = spm_fst.Transducer(open(PIECES, "rb").read())
    made.model.kind = spm_fst._UNIGRAM
    made.cost = [1.0 + (i * 7919 % 100) / 50 for i in range(len(made.cost))]

    def cheapest(text):
        best = [0.0] + [float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = made.ids.get(text[start:end])
                if piece is not None:
                    best[end] = min(best[end], best[start] + made.cost[piece])
        return best[-1]

    for text in ("▁theater", "▁internationalisation", "ababab"):
        assert sum(made.cost[i] for i in made.path(text)) == pytest.approx(cheapest(text))


def test_encoding_edges(edge, nothing, edge_rows):
    encoded = spm_fst.encode(edge, PIECES)
    rows = encoded.collect()
    assert len(rows) == len(edge_rows) and all(r.n_ids == len(r.ids) for r in rows)
    back = spm_fst.decode(encoded, PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, _ in edge_rows)
    assert spm_fst.encode(nothing, PIECES).count() == 0


# Packing


def _check_packing(rows, texts):
    """``texts``: all texts as a list; every id in one piece, sequences within capacity and gapless."""
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,) for t in texts)
    docs, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    got = []
    for (_, n), pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        copies = len([r for r in pieces if r.start == 0])
        assert sum(r.length for r in pieces) == n * copies
        if copies == 1:
            got.append(tuple(np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()))
    assert set(got) <= set(want) and len(rows) >= len(want)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(r.length for r in rows) / (len(sequences) * packing.CAPACITY)


def test_packing_of_the_tables(spark, sf_dir):
    from feathergrid.session import table

    docs = table(spark, sf_dir, "documents")
    rows = packing.pack(docs, WORDS, with_ids=True).collect()
    assert _check_packing(rows, [r.text for r in docs.collect()]) > 0.9


def test_packing_edges(edge, nothing, edge_rows):
    _check_packing(packing.pack(edge, WORDS, with_ids=True).collect(), [t for _, t, _ in edge_rows])
    assert packing.pack(nothing, WORDS).count() == 0


def test_small_chunk_tables_take_the_place_of_large_ones():
    words = [f"{a}x{b}é" for a in range(40) for b in "abcdefgh"]
    want = [packing.chunk_ids(WORDS)[w] for w in words]
    few = packing.chunk_ids(WORDS, (50, 70))
    assert [few[w] for w in words] == want and len(few) <= 51 and len(few.pretokens) <= 70
    assert list(packing._CHUNKS.values()) == [few] and packing.chunk_ids(WORDS, (50, 70)) is few
    assert corpus_pipeline.KNOWN < packing.KNOWN


def test_chunk_ids_equal_the_tokenizer():
    tokenizer, chunks = Tokenizer.from_file(WORDS), packing.chunk_ids(WORDS)
    rng = random.Random(8)
    bits = list("abcXYZéÉßİıſΣσç'’.,!0123 \n\t\r\x0b\x1c\xa0日😀ﬁ́") + ["'s", "'LL", "<|endoftext|>", "<|", "%%%", " "]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))
        ids = b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing_is_near_equal_and_complete():
    rng = random.Random(9)
    for windows in (1, 2, 7, 40):
        lengths = [rng.randrange(1, 513) for _ in range(windows * 6)]
        found = packing.difference(lengths, windows)
        assert sorted(i for w in found for i in w) == list(range(len(lengths))) and len(found) == windows
        sums = [sum(lengths[i] for i in w) for w in found]
        assert max(sums) - min(sums) <= 60 or windows == 1
    assert [sorted(w) for w in packing.fill([3, 3, 3], 5)] and len(packing.fill([3, 3, 3], 5)) == 3  # the count rises
    assert packing.difference([], 3) == []


@pytest.mark.parametrize("depth", [100, 900, 50_000])
def test_html_nested_to_any_depth(depth):
    page = "<article>" + "<div>" * depth + "<p>deep  text</p>tail" + "</div>more</article>"
    assert html_text.extract(page, None) == "deep text\ntail\nmore"
    every = html_text.extract("<article>" + "".join(f"<div>x{i}" for i in range(depth)) + "</div>y" * depth + "</article>", None)
    assert every.split("\n") == [*[f"x{i}" for i in range(depth)], *["y"] * depth]
    gone = "<article>" + "<nav>" * depth + "gone<div>gone" + "</nav>" * depth + "<p>stays</p></article>"
    assert html_text.extract(gone, None) == "stays"


def test_html_deep_pages_through_spark(spark):
    deep = ["".join(f"<div>w{i} of {k}" for i in range(1200)) for k in range(6)]  # never closed
    pages = [(k, "https://deep.example/x", f"<main><p>page {k}</p>{deep[k]}") for k in range(6)]
    rows = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 6 and all(f"page {r['page_id']}" in r["text"] and f"w1199 of {r['page_id']}" in r["text"] for r in rows)


def test_html_alignment_keeps_a_longest_common_order():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (["abcdef"[rng.randrange(6)] for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        steps = html_text._common([[x] for x in a], [[x] for x in b])
        assert [[(steps[i] >> j).bit_count() for j in range(len(b) + 1)] for i in range(len(a) + 1)] == best
