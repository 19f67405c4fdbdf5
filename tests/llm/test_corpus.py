"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontam, html_extract, jaccard_join, licenses, line_dedup, pieces, quality, substring_dedup, token_counts, token_store, words
from factloom.llm.queries import oracle_sql, queries, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words int, kept string, digest string, _w int, key int, start int"


def _say(r, n, words=None):
    words = words or ["the", "of", "and", "thnd", "ersh", "ouble", "èvi", "reaux", "über", "ñdo", "and,", "ation."]
    return " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [_say(r, 60) for _ in range(12)]
    out = [None, "", "   ", "\n\n", "one", "a b c d", "a b c d e", "x" * 20000, _say(r, 6000), "日本語 テキスト 🙂", "A\tB\x0bC\x0cD\rE F", "Σίσυφος ΟΔΟΣ", "<s> </s> ▁ <|endoftext|>", " lead and trail ", "a  b   c"]
    out += ["word " * 50, "same line of five words\n" * 8 + _say(r, 40), "Thes*** eswh.### Thhend$$$ " * 20, "THES!! REWH!! ST!! ONST!! " * 10]
    for b in base:
        w = b.split()
        out += [b, b, " ".join(w[:30] + ["changed"] + w[31:]), " ".join(w[:-1]), b + "\n" + "boiler plate line of this very site"]
    return out


def _docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"s{i % 3}" if i % 7 else None, 7, "x", "d", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _docs(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _measure(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, texts):
    got = {r.doc_id: r for r in quality.quality_cascade(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _measure(t), i
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert got[8].kept and not got[17].kept and not got[18].kept


def test_filters_keep_clashing_columns(docs):
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {(r.n_words, r._w, r.kept) for r in kept.collect()} == {(7, 1, "x")}
    assert {r._w for r in line_dedup.line_dedup(docs).collect()} == {1}


def test_quality_order_does_not_change_the_verdict(docs):
    rules = quality.default_rules()
    some = [sorted((r.doc_id, r.kept) for r in quality.quality_cascade(docs, x).select("doc_id", "kept").collect()) for x in (rules, rules[::-1])]
    assert some[0] == some[1]


def test_quality_ranks_by_rejection_per_cost(docs):
    rows = quality.measures(docs.select("doc_id", "text"))
    t = F.coalesce("text", F.lit(""))
    slow = F.length(F.regexp_replace(F.concat(*[t] * 20), r"\p{L}+\d", "")) < 0
    some = [quality.Rule("slow", slow | (F.col("n_words") > 0)), quality.Rule("never", F.lit(False)), quality.Rule("cheap", F.col("n_words") > 0)]
    ranked = quality.profile(rows, [*quality.default_rules(), *some])
    assert [p.rank for p in ranked] == sorted((p.rank for p in ranked), reverse=True)
    at = {p.rule.name: p for p in ranked}
    assert at["cheap"].rejected == at["slow"].rejected > 0 == at["never"].rank and at["slow"].seconds > at["cheap"].seconds and at["cheap"].rank > at["slow"].rank


def test_line_dedup(spark):
    texts = [f"common line\nown {i}\n\ncommon line" for i in range(20)] + ["", None, "common line"]
    rows = [(i, t, "a" if i < 20 else "b") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].text == "own 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[22].text == "common line" and got[20].text == "" and got[21].text is None


def _dedup(rows, width):
    """Brute force over distinct (id, text): words of repeated units, then of repeated windows of the words left."""
    order = lambda key: (key[0] is None, key[0] or 0, _row_key(key))
    keys = sorted(dict.fromkeys(rows), key=order)
    words = {k: [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(k[1] or "")] for k in keys}
    gone = {k: set() for k in keys}
    seen = {}
    for k in keys:
        w = words[k]
        between = [k[1][w[i - 1][1] : w[i][0]] if i else "" for i in range(len(w))]
        lines = [i for i in range(len(w)) if i == 0 or "\n" in between[i]]
        paragraphs = [i for i in range(len(w)) if i == 0 or re.search(r"\n[\x20\x09-\x0D]*\n", between[i])]
        spans = {(0, len(w))} | {(a, b) for cuts in (lines, paragraphs) for a, b in zip(cuts, [*cuts[1:], len(w)], strict=False)}
        for a, b in sorted(x for x in spans if x[1] - x[0] >= width):
            if seen.setdefault(tuple(x[2] for x in w[a:b]), (k, a)) != (k, a):
                gone[k] |= set(range(a, b))
    first, more = {}, {k: set() for k in keys}
    for k in keys:
        left = [i for i in range(len(words[k])) if i not in gone[k]]
        for a in range(len(left) - width + 1):
            at = first.setdefault(tuple(words[k][i][2] for i in left[a : a + width]), (k, a))
            if at != (k, a):
                more[k] |= {left[j] for j in range(a, a + width) if not (at[0] == k and j < at[1] + width)}
    out, met = [], set()
    for k in rows:
        late = gone[k] | more[k]
        if k in met and len(words[k]) >= width:
            late = set(range(len(words[k])))
        met.add(k)
        runs = [i for i in sorted(late) if i - 1 not in late]
        ends = [i for i in sorted(late) if i + 1 not in late]
        spans = [(words[k][a][0], words[k][b][1]) for a, b in zip(runs, ends, strict=True)]
        text = k[1]
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        out.append((k[0], text, len(spans), sum(b - a for a, b in spans), ",".join(f"{a}-{b}" for a, b in spans)))
    return sorted(map(repr, out))


def _row_key(key):
    return hashlib.md5(f"{'' if key[0] is None else key[0]}:{key[1] or ''}".encode()).digest()


def _deduped(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(repr(tuple(r)) for r in substring_dedup.substring_dedup(docs, width).collect())


@pytest.mark.parametrize("width", [5, 50])
def test_substring_dedup(spark, texts, width):
    rows = list(enumerate(texts))
    assert _deduped(spark, rows, width) == _dedup(rows, width)


def test_substring_dedup_decides_by_row(spark):
    line = "one line of exactly six words"
    own = [f"a{k} line{k} of{k} row{k} {k}" for k in range(6)]
    rows = [(None, f"{own[0]}\n{line}\nend"), (None, f"{own[1]}\n{own[2]}"), (None, f"top\n{line}"), (3, line), (3, f"x\n{own[3]}"), (-1, f"{own[4]}\n{own[5]}"), (9, "same row of five words\nend"), (9, "same row of five words\nend"), (9, "same row of five words\nend"), (None, None), (None, None), (None, ""), (None, " \n "), (7, "few words"), (7, "few words")]
    got = _deduped(spark, rows, 5)
    assert got == _dedup(rows, 5)
    assert repr((None, rows[1][1], 0, 0, "")) in got and repr((None, "top\n", 1, 29, "4-33")) in got and sum("same row" in x for x in got) == 1


@pytest.mark.parametrize("width", [10, 50])
def test_passages_inside_lines(spark, width):
    r = random.Random(8)
    fresh = iter(range(10**6))
    own = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    said = own(width + 3)
    rows = [(4, f"{own(7)} {said.upper()} {own(30)}"), (2, f"{own(40)}  {said}\n{own(3)}"), (None, f"{said} {own(60)}"), (None, own(70)), (6, " ".join(said.split()[: width - 1]) + " " + own(60)), (7, "again " * (3 * width)), (8, own(80)), (1, None), (5, "")]
    rows += [(100 + k, " ".join(r.choice("abc") + r.choice(["", "\n", "\n\n"]) for _ in range(r.randint(0, 3 * width)))) for k in range(30)]
    rows += [rows[6], (9, f"{own(3)}\n\n{said}\n\n{own(2)}"), (10, said.replace(" ", "\n", 9))]
    got = _deduped(spark, rows, width)
    assert got == _dedup(rows, width)
    assert repr((2, rows[1][1], 0, 0, "")) in got and any(x.startswith("(4, ") and rows[0][1].replace(said.upper(), "") in x for x in got)


def test_window_hashes_are_those_of_each_window():
    r = np.random.default_rng(3)
    coded = r.integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 5, 13, 25, 50):
        h = words.window_hashes(coded, width, 0x9E3779B97F4A7C15)
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(coded[i : i + width].tolist()), x) == x
        assert len(h) == 201 - width and len(set(h.tolist())) == len(seen)
        for best in (np.minimum, np.maximum):
            assert words.sliding(coded, width, best).tolist() == [best.reduce(coded[i : i + width]) for i in range(201 - width)]


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (10, 5000, 3, 3, 0)] + [None, "b" * 90]})
    parts = list(words.slices(batch, limit=100))
    assert [p.num_rows for p in parts] == [1, 1, 5] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def _shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("bucket", [1024, 4])
def test_jaccard_join(docs, texts, bucket):
    sets = [_shingles(t) for t in texts]
    near = [[j for j in range(len(sets)) if j != i and s and sets[j] and 10 * len(s & sets[j]) >= 8 * len(s | sets[j])] for i, s in enumerate(sets)]
    group = list(range(len(sets)))
    for _ in sets:
        group = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(sets))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs, jaccard_join.Paths(bucket=bucket)).collect()}
    assert got == {i: (group[i], len(near[i])) for i in range(len(sets))}


def test_one_of_each_keeps_columns(docs, texts):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {19, 24}.issubset(ids) and not {20, 21, 22, 25}.intersection(ids) and {0, 1, 2, 3}.issubset(ids)


def test_decontamination(spark):
    r = random.Random(3)
    item = _say(r, 30, [f"w{i}" for i in range(400)])
    w = item.split()
    near = " ".join(w[:15] + ["zzz"] + w[15:])
    texts = [_say(r, 50) + " " + item.upper() + ". " + _say(r, 10), "pre " + near, item, _say(r, 200), " ".join(w[:12]) + " " + _say(r, 40), None, "", "a b", _say(r, 20) + " " + " ".join(w[:-1])]
    bench = spark.createDataFrame([(1, item, 9), (2, "few words", 9), (3, None, 9)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x for x in decontam.leaks(_docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (2, 1), (8, 1)}
    before = len(re.findall(r"[^\W_]+", texts[0][: texts[0].index(item.upper())]))
    assert got[0, 1].similarity == 1.0 and got[0, 1].start == before
    assert {r.doc_id for r in decontam.clean_documents(_docs(spark, texts), bench).collect()} == {1, 3, 4, 5, 6, 7}


def test_fingerprints_within_radius_meet_in_a_block():
    r = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in r.sample(range(64), decontam.RADIUS))
        assert any(bin(flips >> 8 * b & 255).count("1") <= decontam.BLOCK_RADIUS for b in range(8))


def test_pieces_are_those_of_the_library(docs, texts):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(docs, path, decode=True).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == library.encode(t) and r.n_tokens == len(r.ids) and r.decoded == t.replace("▁", " ")
    for r in pieces.round_trip(docs, path).collect():
        assert r.round_trip and r.ids_crc32 == zlib.crc32(np.array(library.encode(texts[r.doc_id] or ""), "<u4").tobytes())


def test_pieces_at_the_bounds_of_the_caches(texts, monkeypatch):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "WORDS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    model = pieces.Pieces(path)
    r = random.Random(4)
    parts = ["a", "th", "e", ".", ",", "\n", " ", "  ", "▁", "é", "’", "“", "1", "23", "日", "!", "...", "-", "_", "(", "'", "\t", "ß", "И", "🙂", "the", "ing", "'s", "{", "=="]
    some = [t or "" for t in texts] + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(2000)] + [" " * 5000 + "x"]
    for k in range(0, len(some), 50):
        assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(some[k : k + 50])] == library.encode(some[k : k + 50])
    model.forget()
    assert not model.words.young and not model.parts.old


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    import sentencepiece

    path, cache = tokenizer("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path, cache).collect()}
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    r = random.Random(1)
    parts = ["a", "th", "\n", " ", ".", "▁", "é", "\t", "the ", "\n\n", "  ", "日", "<0x0A>"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    assert token_counts.counter(path)(some) == [len(x) for x in library.encode(some)]


def test_token_counts_without_ids(spark):
    rows = [(None, f"text {k % 30} without an id") for k in range(90)] + [(4, "text 3 without an id"), (4, "of its own"), (None, None), (None, "")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("piece_bpe_32k.model")).collect()
    count = token_counts.counter(tokenizer("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), count([t or ""])[0], False) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    got = {r.doc_id: r for r in token_store.token_files(_docs(spark, texts, ids), path).collect()}
    start = 0
    for i in sorted(ids):
        want = [*library.encode(texts[ids.index(i)] or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_token_files_place_equal_ids_the_same_way(spark, monkeypatch):
    texts = [f"text number {k} of the shared id" for k in range(40)] + ["same", "same", None, ""]
    rows = [(None if k % 3 == 0 else 5, t) for k, t in enumerate(texts)]
    runs = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(5)
        got = token_store.token_files(docs, tokenizer("word_bpe_49k.json")).collect()
        runs.append(sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in got))
        monkeypatch.setattr(token_store, "BROADCAST_FILES", 0)
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    places = sorted((start, n) for _, start, n, _ in runs[0])
    assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]


def test_token_files_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    from factloom import scratch

    path = scratch.new_path(spark, "layout")
    token_store.write(docs, path, tokenizer("word_bpe_49k.json"))
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(1)
    assert column.has_offset_index and any("DICT" in e or "DELTA" in e for e in column.encodings)


def _license(text):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    texts = ["Released under the MIT License.", None, "", "the GNU General\nPublic, License v3 or apache-license MIT license", "submit license", "MIT licenses", "x " * 3000 + "Apache License, Version 2.0", "SPDX-License-Identifier: BSD-3-Clause", "CC-BY-SA-4.0 é mit é license", "no law here"]
    got = {r.doc_id: r for r in licenses.license_scan(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _license(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "apache,apache-2.0" and got[9].labels == "" and "bsd-3-clause" in got[7].labels and len(licenses.rules()) > 300


def test_contained_detections_go():
    kept = licenses.scanner().detections("licensed under the apache license, version 2.0")
    assert all(not (a <= c and d <= b) for a, b, x in kept for c, d, y in kept if (a, b, x) != (c, d, y))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
        ("SPDX-License-Identifier: MIT OR GPL-2.0-or-later WITH x", "gpl-2.0,mit"),
        ("spdx-license-identifier: LGPL-2.1-only", "lgpl-2.1"),
        ("Do What The Fuck You Want To Public License", "wtfpl"),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED', "mit"),
        ("# under the Mozilla\n# Public License 2.0", "mpl-2.0"),
        (" * Redistribution and use in source and\n * binary forms, with or without modification", "bsd"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("the Eclipse  Public\tLicense", "epl"),
        ("a license to thrill and the public good", ""),
    ],
)
def test_license_labels(text, labels):
    got = licenses.scanner().scan(text)
    assert got["labels"] == labels
    for s in got["spans"]:
        assert 0 <= s["start"] < s["stop"] <= len(text)


def _samples(pattern, r):
    """A text that ``pattern`` matches, with one choice of each alternative."""
    import re._constants as c
    import re._parser as parser

    def made(items):
        out = []
        for op, value in items:
            if op is c.LITERAL:
                out.append(chr(value))
            elif op is c.SUBPATTERN:
                out.append(made(value[3]))
            elif op is c.BRANCH:
                out.append(made(r.choice(value[1])))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out.append("".join(made(value[2]) for _ in range(r.randint(value[0], min(value[1], value[0] + 1)))))
            elif op is c.IN:
                kind, first = value[0]
                out.append({c.LITERAL: lambda: chr(first), c.RANGE: lambda: chr(first[0]), c.CATEGORY: lambda: {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "1", c.CATEGORY_WORD: "a"}[first], c.NEGATE: lambda: "("}[kind]())
            elif op is c.ANY:
                out.append("x")
        return "".join(out)

    return made(parser.parse(pattern))


def test_every_rule_finds_what_it_names_behind_its_keyword():
    r, scan = random.Random(2), licenses.scanner()
    for k, (rule, pattern) in enumerate(scan.rules):
        hits = 0
        for _ in range(12):
            text = _samples(rule.pattern, r)
            for x in (text, text.replace(" ", "\n * "), text.replace(" ", "  ")):
                if pattern.search(x):
                    hits += 1
                    assert rule.keyword in licenses._SPACES.sub(" ", x), (rule, x)
                    assert k in {j for _, of in scan.gate.iter(licenses._SPACES.sub(" ", x)) for j in of}
        assert hits, rule


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to serve you</p></div><article><h1>Head &amp; tail</h1><p>First   <b>bold</b>
 words &eacute;<p>Second &lt;p&gt; words that run on for a while so that they look like prose<div class="ad">Buy now</div><p>Third and last words of it</article>
<section class="comments"><div class="comment"><p>I liked it a lot</p></div></section><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    pages = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>", "x"), (5, "u", "plain words only", "x"), (6, "u", "<div" * 50, "x")]
    got = {r.page_id: r for r in html_extract.html_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "Head & tail\nFirst bold words é\nSecond <p> words that run on for a while so that they look like prose\nThird and last words of it"
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text) and len(got) == 6


def test_html_trees_on_held_out_pages():
    r = random.Random(99)
    pages = [html_extract._sample_page(r) for _ in range(150)]
    got = html_extract.extract([p for p, _ in pages])
    assert sum(g == "\n".join(m) for g, (_, m) in zip(got, pages, strict=True)) > 120


def _labellings(nodes, odds):
    """Brute force: the score and kept nodes of the best labelling without contradictions."""
    main, other = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = None
    for labels in itertools.product(range(3), repeat=len(nodes)):
        if any((labels[x.parent], lab) in ((1, 0), (2, 0), (2, 1)) for x, lab in zip(nodes[1:], labels[1:], strict=True)):
            continue
        if any(lab < 2 and odds[k] < html_extract.REJECTED and nodes[k].tag not in ("html", "body") for k, lab in enumerate(labels)):
            continue
        score = sum((1.0 if x.texts else 0.25) * (np.log(0.5) * (4 if x.texts else 1), main[k], other[k])[lab] for k, (x, lab) in enumerate(zip(nodes, labels, strict=True)))
        if best is None or score > best[0] + 1e-12:
            best = score, [lab == 1 or (lab == 0 and bool(nodes[k].texts) and odds[k] > 0) for k, lab in enumerate(labels)]
    return best[1]


def test_no_contradictions_between_ancestors():
    nodes, _ = html_extract.parse("<nav><div class='content article'><p>" + "words " * 50 + "</p></div></nav><article><p>text of it</p></article>")
    odds = np.array([-9.0 if n.tag == "nav" else 3.0 for n in nodes])
    keep = html_extract.decode(nodes, odds)
    other = {k for k, n in enumerate(nodes) if n.tag == "nav"}
    for k, n in enumerate(nodes):
        if n.parent in other:
            other.add(k)
    assert len(other) == 3 and not any(keep[k] for k in other) and any(keep)
    r = random.Random(6)
    pages = ["<div><p>a b c</p><nav><p>d</p></nav></div><p>e</p>", "<body>own<div>x<p>y</p></div></body>", "<ul><li>a</li><li><p>b</p></li></ul><footer><p>c</p></footer>"]
    for _ in range(60):
        nodes, _ = html_extract.parse(r.choice(pages))
        odds = np.array([r.uniform(-7, 5) for _ in nodes])
        assert html_extract.decode(nodes, odds) == _labellings(nodes, odds)


UNSEEN = """<html><body><div class="zq1"><a href=/>{0}</a> <a href=/b>{1}</a> <a href=/c>{2}</a></div><article class="k7"><h1>{3}</h1><p>{4}</p><p>{5}</p></article>
<footer class="w9"><p>{6}</p></footer></body></html>"""


def test_html_layout_with_unseen_names():
    r = random.Random(12)
    got = 0
    for _ in range(40):
        say = [_say(r, n) for n in (1, 2, 1, 6, 40, 55, 9)]
        got += html_extract.extract([UNSEEN.format(*say)]) == ["\n".join(say[3:6])]
    assert got >= 36


def test_html_repeated_empty_and_long_pages(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.html_text(spark.createDataFrame([], schema)).count() == 0
    body = "".join(f"<p>paragraph {k} of a very long article with many words in it</p>" for k in range(5000))
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE), (2, "v", f"<article>{body}</article>")]
    got = html_extract.html_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and len({r.text for r in got}) == 2
    assert [r.text.count("\n") for r in got if r.page_id == 2] == [4999]


def test_empty_tables(spark, empty):
    path = tokenizer("piece_bpe_32k.model")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    made = [quality.quality_cascade(empty), line_dedup.line_dedup(empty), substring_dedup.substring_dedup(empty), licenses.license_scan(empty), decontam.leaks(empty, bench), token_counts.token_counts(empty, path), jaccard_join.jaccard_join(empty), pieces.encode(empty, path), token_store.token_files(empty, tokenizer("word_bpe_49k.json"))]
    assert [df.count() for df in made] == [0] * len(made)
    assert decontam.leaks(_docs(spark, ["a b c d e f g"]), bench.limit(0)).count() == 0


def test_null_and_repeated_ids(spark, texts):
    some = ["a b c d e f g h i j k l", "a b c d e f g h i j k l", None, "other words that stand here on their own and alone"]
    docs = _docs(spark, some, [None, 1, None, 1])
    path = tokenizer("piece_bpe_32k.model")
    for df in (quality.quality_cascade(docs), line_dedup.line_dedup(docs), substring_dedup.substring_dedup(docs), licenses.license_scan(docs), token_counts.token_counts(docs, path), jaccard_join.jaccard_join(docs), pieces.encode(docs, path), token_store.token_files(docs, tokenizer("word_bpe_49k.json"))):
        assert df.count() == 4


def test_one_of_each_decides_by_row(spark):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = one.replace("a39", "zz")
    rows = [(None, one), (None, near), (None, two), (7, three), (7, three), (8, three), (8, four), (-1, "alone " + four.replace("d", "e")), (None, ""), (None, None), (5, two), (None, "v w x y z"), (None, "v w x y z")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _row int, row int")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(repr, (x for x in got if x[1] not in (one, near)))) == sorted(map(repr, [(7, three), (8, four), (-1, "alone " + four.replace("d", "e")), (None, ""), (None, None), (5, two), (None, "v w x y z")]))
    assert sum(x[1] in (one, near) for x in got) == 1


def test_clean_documents_decides_by_row(spark):
    item = " ".join(f"i{k}" for k in range(30))
    clean = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    half = [" ".join(item.split()[:16] + clean[0].split()), " ".join(clean[1].split()[:14] + item.split()[14:])]
    rows = [(None, "pre " + item), (None, clean[0]), (-1, clean[1]), (4, item), (4, item), (4, clean[2]), (None, half[0]), (None, half[1]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [(r.doc_id, r.text) for r in decontam.clean_documents(docs, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [x for x in rows if item not in (x[1] or "")]))
    assert sorted((r.doc_id or 0, r.start) for r in decontam.leaks(docs, bench).collect()) == [(0, 1), (4, 0)]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(oracle_sql()[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from factloom import scratch

        rows = scratch.stored(stage(spark, rows, SF), "stage")
        assert rows.columns == docs.columns
        seen.append({r.doc_id: r.text for r in rows.collect()})
    kept = {i for i, t in before.items() if not quality_fails(t)}
    assert set(seen[0]) == kept and all(seen[0][i] == before[i] for i in kept)
    assert set(seen[1]) == kept
    sets = {i: _shingles(t) for i, t in seen[1].items()}
    for i in seen[2]:
        assert not any(j < i and s and 10 * len(s & sets[i]) >= 8 * len(s | sets[i]) for j, s in sets.items() if j in seen[2])
    bad = {r.doc_id for r in decontam.leaks(spark.createDataFrame(list(seen[2].items()), "doc_id long, text string"), bench).collect()}
    assert set(seen[3]) == set(seen[2]) - bad
    last = {r.doc_id: r.decoded for r in corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()}
    assert last == seen[3]


def quality_fails(text):
    n, chars, symbols, dup, repeat = _measure(text)
    if n < 10 or 100 * repeat > 20 * n:
        return True
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(c.isalpha() for c in text)
    upper = sum(c.isupper() for c in text)
    shout = sum(c in "!?" for c in text)
    return 10 * symbols > 3 * n or (dup >= 3 and 10 * dup > 3 * len(lines)) or chars < 2 * n or chars > 20 * n or 10 * shout > 4 * n or 10 * upper > 6 * letters or 2 * letters < chars
