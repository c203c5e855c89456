"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("surety.llm")
from pyspark.sql import functions as F  # noqa: E402

from surety.llm import byte_bpe, connected, contracts, cover_tree, merge_automaton, merkle, ngram_join, packing, pii, token_files, url_filter  # noqa: E402
from surety.llm import textbytes as tb  # noqa: E402

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
TEXTS = [
    None, "", "   ", "word", "Two Words", " ".join(BASE), " ".join(BASE), " ".join(BASE).upper(), " ".join([*BASE, "extra"]),
    "It's don't 'RE we'll\n\n  x  \t end ", "<|endoftext|> inside <|startoftext|>", "naïve café ÉCOLE Ωmega 中文 ½ ２ é", "1 2 3 " * 700, "long " * 30_000, "a.b@c.de, 1.2.3.4 and 999.1.1.1; 4111 1111 1111 1111 +1 (212) 555-0100 DE89370400440532013000",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", i * 7) for i, t in enumerate(TEXTS)] + [(3, "word", "xx", 0), (None, "no id here", "xx", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def encoded(name, docs, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(contracts.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t, [(i, t.encode(x or "", add_special_tokens=False).ids + ([end] if end else [])) for i, x in texts(docs)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, empty):
    path = contracts.tokenizer_path(BYTE_BPE)
    folder = token_files.write_token_files(docs, path, end_id=2)
    got = [tuple(r)[:4] for r in token_files.token_file_digest(spark, folder).orderBy("start").collect()]
    want, start = [], 0
    for i, ids in encoded(BYTE_BPE, docs, 2)[1]:
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert [(i is None) for i, *_ in got] == [i is None for i, *_ in want]
    assert token_files.read_tokens(folder, 5).tolist() == encoded(BYTE_BPE, docs, 2)[1][5][1]
    assert token_files.token_file_digest(spark, token_files.write_token_files(empty, path, end_id=2)).count() == 0


def test_token_files_of_extreme_and_hot_ids(spark, monkeypatch):
    rows = [(-(1 << 63), "least"), (None, "none"), ((1 << 63) - 1, "most"), (7, None)] + [(5, f"text {i % 40}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(token_files, "READ_DOCS", 16)
    folder = token_files.write_token_files(frame, contracts.tokenizer_path(BYTE_BPE), end_id=2, segments=6)
    got = [tuple(r) for r in token_files.token_file_digest(spark, folder).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, -(1 << 63)] + [5] * 400 + [7, (1 << 63) - 1]
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])))[:-1].tolist()
    assert sorted((i is None, i or 0, crc(x)) for i, x in encoded(BYTE_BPE, frame, 2)[1]) == sorted((r[0] is None, r[0] or 0, r[3]) for r in got)
    assert len({r[4] for r in got if r[0] == 5}) > 1  # a hot doc_id is not one task's


def test_packing_covers_every_id_once(spark, docs, empty):
    path = contracts.tokenizer_path(BYTE_BPE)
    rows = [r.asDict() for r in packing.pack(docs, path, end_id=1).collect()]
    ids = {}
    for i, x in encoded(BYTE_BPE, docs, 1)[1]:
        ids.setdefault(i, []).append(x)
    seen = {}
    for r in rows:
        whole = next(x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert crc(whole[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["length"] > 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: sum(map(len, x)) for i, x in ids.items()}
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    waste = sum(2048 - n for n in by.values() if n & (n - 1))
    assert waste < 2048 + 0.02 * sum(by.values())
    assert packing.pack(empty, path, end_id=1).count() == 0


def test_pattern_program_packs_tightly():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 512, 20_000), return_counts=True)
    plan = packing.plan_patterns(dict(zip(lengths.tolist(), counts.tolist())), 512)
    held = {}
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 512
        for k, n in pattern.items():
            held[k] = held.get(k, 0) + n * times
    assert held == dict(zip(lengths.tolist(), counts.tolist()))
    assert sum(t for _, t in plan) * 512 <= 1.01 * float((lengths * counts).sum())


def test_pattern_program_reaches_its_bound():
    """Three pieces of 172 to a sequence of 512 are too long, so two: the dual bound proves it, the volume does not."""
    for lengths, counts, least in (([172], [10], 5), ([200, 300, 12], [7, 7, 7], 7), ([130, 172, 200, 257], [1255, 1229, 1247, 1269], 2090)):
        weights, demand = np.array(sorted(lengths)), np.array([n for _, n in sorted(zip(lengths, counts))], float)
        columns, x = packing.solve_patterns(demand, weights, 512, gap=0)
        assert np.allclose(columns @ x, demand) and (weights @ columns <= 512).all() and np.ceil(x.sum() - 1e-6) <= least


def test_priced_column_is_the_best_multiset():
    rng = np.random.default_rng(6)
    for _ in range(20):
        weights = np.unique(rng.integers(2, 20, 4))
        values = rng.random(len(weights))
        best = {0: 0.0}
        for room in range(1, 31):
            best[room] = max([best[room - 1]] + [values[k] + best[room - w] for k, w in enumerate(weights) if w <= room])
        value, column = packing.price_column(values, weights, 30)
        assert abs(value - best[30]) < 1e-9 and weights @ column <= 30 and abs(values @ column - value) < 1e-9


def test_merge_automaton_matches_library(docs, empty):
    path = contracts.tokenizer_path(WORD_BPE)
    t, want = encoded(WORD_BPE, docs)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in merge_automaton.encode_decode(docs, path).collect()), key=repr)
    assert got == sorted(((i, ids, t.decode(ids, skip_special_tokens=False)) for i, ids in want), key=repr)
    digest = sorted((tuple(r) for r in merge_automaton.coding_digest(docs, path).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digest == sorted(((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())) for i, ids in want), key=repr)
    assert merge_automaton.coding_digest(empty, path).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_spans_that_hashes_could_mix_up(spark, monkeypatch):
    """Two words that a polynomial modulo 2**64 cannot tell apart, and a table whose hashes collide all the time."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + other).encode(), np.uint8)
    assert len(set(tb.span_hash(raw, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2
    rows = [(1, word), (2, other), (3, f"{word} {other} x"), (4, "short ab ba aab"), (5, " ".join(f"w{i}" for i in range(300)))]
    own = tb.span_hash
    for name, coder in ((BYTE_BPE, byte_bpe.ByteBpe), (WORD_BPE, merge_automaton.WordBpe)):
        library, _ = encoded(name, spark.createDataFrame(rows, "doc_id long, text string"))
        for weak in (False, True):
            monkeypatch.setattr(tb, "span_hash", (lambda *x: own(*x) % np.uint64(7) + np.uint64(1)) if weak else own)
            made = coder(open(contracts.tokenizer_path(name)).read())
            for _ in range(2):  # the second time from the table
                data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
                ids, upto = made.encode(data, np.concatenate(([0], np.cumsum([len(t) for _, t in rows]))))
                assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [library.encode(t, add_special_tokens=False).ids for _, t in rows]


def test_span_table_starts_anew_beyond_its_limits():
    table = tb.SpanTable(np.uint32, limit=50, room=400)
    for k in range(6):
        words = [f"{k}-{i}".encode() for i in range(40)] + [b"y" * 3000, b"", b"same"]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        row = table.rows_of(data, ends - [len(w) for w in words], ends, lambda s: (np.ones(len(s), np.int64), np.array([sum(x) for x in s], np.uint32)))
        assert table.values[table.start[row]].tolist() == [sum(w) for w in words]


def test_merge_automaton_walks_words_together_as_one_by_one():
    rng = np.random.default_rng(9)
    _, machine = encoded_words()
    words = ["".join(rng.choice(list("abcdetns'é1"), rng.integers(1, 26))).encode() for _ in range(2000)] + [b"x" * 5000, b""]
    sizes, tokens = machine.accept_all(words, np.uint32)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    assert [tokens[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [machine.accept(w) for w in words]


def encoded_words():
    coder = merge_automaton.WordBpe(open(contracts.tokenizer_path(WORD_BPE)).read())
    return coder, coder.automaton


def test_merge_automaton_leaves_out_letters_without_a_symbol():
    from tokenizers import Tokenizer, models

    letters = merge_automaton.byte_letters()
    vocab = {c: i for i, c in enumerate("abc")} | {c + "$": 3 + i for i, c in enumerate("ab")} | {"ab": 5, "ab$": 6, "aab$": 7}
    merges = [("a", "b"), ("a", "b$"), ("a", "ab$")]
    machine = merge_automaton.MergeAutomaton(vocab, merges, "$")
    library = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix="$"))
    words = ["ab", "axb", "abx", "aab", "aaxb", "xx", "abc", "cab", "xab", "c", "x", "aabab"]
    assert letters[ord("x")] not in vocab
    assert [machine.accept(w.encode()) for w in words] == [library.encode(w).ids for w in words]
    sizes, tokens = machine.accept_all([w.encode() for w in words], np.uint32)
    assert tokens.tolist() == [i for w in words for i in library.encode(w).ids] and sizes.sum() == len(tokens)


def test_merge_automaton_of_repeated_symbols():
    letters = merge_automaton.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {c + "$": 256 + i for i, c in enumerate(letters)}
    merges = [("a", "a"), ("aa", "b"), ("aa", "a$")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    machine = merge_automaton.MergeAutomaton(vocab, merges, "$")
    names = lambda w: [machine.label[t] for t in machine.accept(w)]
    assert names(b"aaab") == ["aa", "a", "b$"] and names(b"aaba") == ["aab", "a$"] and names(b"aaaa") == ["aa", "a", "a$"] and names(b"aaa") == ["aaa$"]


def brute_components(rows):
    word, low = re.compile("[^\x20\x09-\x0d]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, x in rows:
        w = word.findall((x or "").translate(low))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and sets[a][0] is not None and sets[b][0] is not None and 100 * n >= 80 * len(sets[a][1] | sets[b][1]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((s[0] for s, h in zip(sets, group) if h == g and s[0] is not None), default=None) for g in group}
    return sorted(((i, len(s), least[g] if i is not None else None) for (i, s), g in zip(sets, group)), key=repr)


def test_ngram_join_components(spark, docs, empty):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(texts(docs))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_near_copies_and_split_regions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base) if i % 4 else [f"u{i}_{k}" for k in range(90)] + base[:60]
        for k in rng.integers(0, len(words), int(rng.integers(0, 7))):
            words[k] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(frame).collect()), key=repr) == want
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 3_000)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(frame).collect()), key=repr) == want
    monkeypatch.setattr(ngram_join, "TREE_POINTS", 30)  # coordinates of very many points, found while they are read
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(frame).collect()), key=repr) == want
    monkeypatch.setattr(ngram_join, "COMMON", 5)  # or known from the counts
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(frame.withColumn("text_key", F.lit("clash"))).collect()), key=repr) == want


def test_ngram_join_of_several_families_in_one_region(spark, monkeypatch):
    """Families that share a passage but no link, chains across sizes, all in one region that is joined in two rounds."""
    rng = np.random.default_rng(14)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(5):
        own = [f"f{family}_{k}" for k in range(10)]
        for i in range(30):
            words = passage[: 30 + family * 2] + own[: int(rng.integers(0, 10))]
            for k in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[k] = f"x{rng.integers(50)}"
            rows.append((len(rows), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    for points, shingles, common in ((4_096, 2_000_000, 64), (20, 300, 64), (20, 300, 3)):
        monkeypatch.setattr(ngram_join, "TREE_POINTS", points)
        monkeypatch.setattr(ngram_join, "TREE_SHINGLES", shingles)
        monkeypatch.setattr(ngram_join, "COMMON", common)
        monkeypatch.setattr(ngram_join, "REPORTED", 1)
        assert sorted((tuple(r) for r in ngram_join.near_duplicates(frame).collect()), key=repr) == want


def test_ngram_join_tells_words_apart_that_polynomials_mix_up(spark):
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two three four {word}"), (2, f"one two three four {other}"), (3, f"one two three four {word}")]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_tiles_fill_leaves():
    rng = np.random.default_rng(15)
    for n in (1, 16, 17, 200, 1000):
        points, sizes = rng.integers(0, 9, (n, 8)), rng.integers(5, 50, n)
        order = ngram_join.tiles(points, sizes)
        assert sorted(order.tolist()) == list(range(n))
        spread = lambda o: sum(points[o[k : k + 16]].max(axis=0).sum() for k in range(0, n, 16))
        assert spread(order) <= spread(np.arange(n))


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_urls(spark, empty):
    rows = [
        (0, "https://a.example.com/en/1?q#f", ""), (1, "https://a.example.com/en/7/x", ""), (2, "http://x.NET/de/1", None), (3, "no scheme", ""), (4, None, ""), (5, "http://y.org/es/", ""), (6, "http://www.y.org/es", '<link rel=canonical href=http://y.org/es/>'), (12, "http://m.y.org/es", ""),
        (7, "http://alias.test/p", '<link href="http://z.org/es/q" rel="canonical">'), (8, "http://other.test/p", "<META http-equiv=refresh content='0; url=http://alias.test/p'>"), (9, "http://z.org/es/q", ""),
        (10, "http://both.test/", '<link rel=canonical href=http://example.com/en/7>'), (11, "http://example.com/en/7", '<link rel="canonical" href="http://z.org/es/q">'), (0, "https://a.example.com/en/1?q#f", ""),
    ]
    pages = spark.createDataFrame(rows[:11] + rows[13:], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, contracts.URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow") and got[2] == ("x.net", "/de/1", "net/de/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("org/es/", "block") and got[6][2:] == (None, "block") and got[12][2:] == (None, "allow")  # an address is no alias of another without a link
    assert got[7][3] == got[8][3] == "block"
    more = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, pages.schema), contracts.URL_RULES).collect()}
    assert more[7] == more[8] == more[10] == "allow" and more[9] == "block"  # an allowed alias takes precedence
    assert url_filter.judge(pages.where("false"), contracts.URL_RULES).count() == 0


def test_urls_rules_judge_link_targets(spark):
    rows = [
        (0, "http://one.test/p", '<link rel="canonical" href="http://z.org/es/q">'), (1, "http://two.test/p", "<meta http-equiv=refresh content='0; url=http://www.z.org/es/r'>"), 
        (2, "http://three.test/p", '<link rel="canonical" href="http://z.org/es/q"><meta http-equiv=refresh content="0; url=http://example.com/en/7/x">'), (3, "http://four.test/p", '<link rel="canonical" href="http://z.org/fr/q">'),
        (4, "http://y.org/es", '<link rel="canonical" href="http://y.org/es/">'), (5, "http://five.test/p", '<meta http-equiv="refresh" content="0; url=http://three.test/p">'),
    ]
    frame = spark.createDataFrame(rows[:2] + rows[3:5], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame, contracts.URL_RULES).collect()}
    assert got == {0: "block", 1: "block", 3: "allow", 4: "block"}
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, frame.schema), contracts.URL_RULES).collect()}
    assert got == {0: "allow", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}  # an allowed target takes precedence


def test_urls_forms_of_links(spark):
    blocked = [
        '<meta http-equiv="Refresh" content="0; url=http://z.org/es/q">', '<LINK REL="CANONICAL" HREF="http://z.org/es/q">', '<link rel=canonical href="//z.org/es/q">', '<link rel=canonical href=" http://z.org/es/q ">',
        """<meta http-equiv="refresh" content="0; url='http://z.org/es/q'">""", """<meta http-equiv='refresh' content='0; URL="http://z.org/es/q"'>""", "<meta http-equiv=refresh content=0;url=http://z.org/es/q>",
        '<link rel=canonical href="http://a.test/"><link rel=canonical href="http://z.org/es/q">', '<meta http-equiv=refresh content="9; url=http://a.test/"><meta http-equiv=refresh content="0; url=http://z.org/es/q">',
        '<link rel="alternate canonical" href="http://z.org/es/q">', '<link rel=canonical href="http:&#x2F;&#47;z.org&#x2f;es/q?a=1&amp;b=2">', "<LINK\nREL='canonical'\nHREF='http://z.org/es/q'/>",
        '<base href="http://z.org/es/"><link rel=canonical href="q">', '<base href="//z.org/fr/x"><meta http-equiv=refresh content="0; url=../es/q">',
    ]
    free = ['<link rel=canonical href="/go?u=http://z.org/es/q">', '<meta http-equiv="refresh" content="0; url="/>', '<meta http-equiv=refresh content="5">', '<link rel=canonical href="mailto:x@z.org">', "<link rel=canonical href='http://z.org/fr/q'>", None]
    pages = [(k, f"http://p{k}.test/a/b", h) for k, h in enumerate(blocked)] + [(100 + k, f"http://f{k}.test/a/b", h) for k, h in enumerate(free)]
    # Relative links from pages that no rule fits, to paths of their own host that one does.
    pages += [(200, "http://s.org/a/b", '<link rel=canonical href="/es/q">'), (201, "http://t.org/a/b/c", '<link rel=canonical href="../../es/q#x">'), (202, "http://u.org", '<link rel=canonical href="es/q">'), (203, "http://v.org/a/b", '<link rel=canonical href="./es/q">'), (204, "http://w.org/a/b", '<link rel=canonical href="?es/q">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), contracts.URL_RULES).collect()}
    assert [k for k in range(len(blocked)) if got[k] != "block"] == [] and [k for k in range(len(free)) if got[100 + k] != "allow"] == []
    assert [got[k] for k in range(200, 205)] == ["block", "block", "block", "allow", "allow"]
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert {r[0]: r[4] for r in con.execute(contracts.SQL["op2_redirects"]).fetchall()} == got


def test_urls_of_a_table_with_chains_and_cycles(spark):
    """A generated table against a union-find, and the query's SQL on the same rows."""
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(21)
    hosts, langs = ["a.example.com", "example.net", "b.org", "c.test", "d.test", "example.com", "x.example.org"], ["en", "de", "es", "fr"]
    urls = [f"http://{hosts[rng.integers(7)]}/{langs[rng.integers(4)]}/{rng.integers(100)}" + ["", "?p=1", "#top"][rng.integers(3)] for _ in range(300)]
    address = lambda u: u.split("://", 1)[1].split("#")[0]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    rows = []
    for i, u in enumerate(urls):
        html, kind = "<html>" + "x" * (200_000 if i == 7 else 3), int(rng.integers(5))
        to = urls[(i + 1) % 40] if i < 40 else urls[rng.integers(300)] if kind else None  # a cycle, then chains
        if i < 40 or kind in (1, 2):
            target = to if i % 2 else "//" + to.split("://", 1)[1]
            html += f'<link rel="canonical" href="{target}">' if i % 3 else f"<meta http-equiv=refresh content='0;url={target}'>"
            root[find(address(u))] = find(address(to))
        rows.append((i, u, html, "clash"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, key string")

    def ruled(a):
        host, path = a.split("?")[0].split("/", 1)
        fits = [r for r in contracts.URL_RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path)).verdict if fits else None

    groups = {}
    for a in {address(u) for u in urls}:
        groups.setdefault(find(a), set()).add(ruled(a))
    want = {}
    for i, u in enumerate(urls):
        group = groups[find(address(u))]
        want[i] = ruled(address(u)) or ("block" if "block" in group and "allow" not in group else "allow")
    found = url_filter.judge(frame, contracts.URL_RULES)
    got = found.collect()
    assert {r["page_id"]: r["verdict"] for r in got} == want and any(r["by_alias"] for r in got)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "key"]))
    assert sorted(con.execute(contracts.SQL["op2_redirects"]).fetchall()) == sorted(tuple(r) for r in got)


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0]))


def brute_added(t):
    """The method's own spans and all scores, from the text and no state."""
    def mod97(m):
        m = m.replace(" ", "")
        return 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1

    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_spans(t).split(",") if x)]
    out = []
    for kind in (*pii.BASE, *pii.ADDED):
        found = [(a, b) for k, a, b in base if k == kind.name] if kind in pii.BASE else [m.span() for m in re.finditer(kind.plain, t)]
        for a, b in found:
            before, after = t[max(0, a - 40) : a], t[b : b + 40]
            near = any(re.search(rf"(?:^|[^a-z0-9])(?:{'|'.join(kind.context)})(?:[^a-z0-9]|$)", x.lower()) for x in (before, after))
            score = kind.raised if near else kind.score
            if kind in pii.ADDED:
                if score < 60 or (kind.name == "iban" and not mod97(t[a:b])) or any(x < b and a < y for _, x, y in base):
                    continue
                if re.search(f"[{kind.not_before}]$", before) or re.search(f"^[{kind.not_after}]", after):
                    continue
            out.append((f"{kind.name}:{a}:{b}", str(score)))
    return ",".join(x for x, _ in out), ",".join(y for _, y in out)


PII_TEXTS = [
    "a@b.c@d.e_x@y.zz", "a@b.com_x@y.zz x@y", "1.2.3.4.5.6.7.8 0001.002.3.256 1.2.3", "4111-1111-1111-1111-1 4111111111111111", "+1-2 +49 (30) 1234.5678 + 1 +12345678901234567", "é ü 中 j.d@x.org 😀 8.8.8.8", "7 " * 9_000, "SSN: 123-45-6789; call 212 555-0100", "x" * 50_000 + "@",
    "IBAN DE89370400440532013000, konto DE89 3704 0044 0532 0130 00. XDE89370400440532013000 DE89370400440532013001", "Visa 4111 1111 1111 1111! server 10.0.0.1, mail a@b.cc", "tel 212-555-0100 +212-555-0100 1212 555-0100", "ssn 123-45-6789-1 9123-45-6789 (123-45-6789)",
    "a@b.cc, " * 2_500 + "ssn 123-45-6789", "ip 1.1.1.1 " * 900 + "é", "ssnx 123-45-6789 assn", "call (212) 555-0100 or (212)555-0100",
]


def test_pii(spark, docs, empty):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(100 + i if i is not None else None, t) for i, t in texts(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digest(frame).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"], r["spans"], r["scores"]) for r in found)
    assert got == sorted((i is None, i or 0, hashlib.sha256(brute_spans(t or "").encode()).hexdigest(), *brute_added(t or "")) for i, t in rows)
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert "ssn:5:16" in spans[7] and "local_phone:23:35" in spans[7] and "iban" in spans[114]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame.where("doc_id is not null").withColumn("base", F.lit(1)).withColumn("Added", F.lit(2))).collect()}
    for i, t in rows:
        if i is None:
            continue
        at, want = 0, []
        for a, b, kind in sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)):
            if a >= at:
                want.append(t[at:a] + f"<{kind.upper()}>")
                at = -b
        assert clean[i] == (None if t is None else "".join(want) + t[at:])
    kept = pii.redact(frame.withColumn("base", F.lit(1)).withColumn("added", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "base", "added"] and {(r["base"], r["added"]) for r in kept.collect()} == {(1, "x")}
    assert pii.digest(empty).count() == 0 and pii.redact(empty).count() == 0
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r for r in rows if r[0] is not None and r[0] != 103], columns=["doc_id", "text"]))
    columns = pii.digest(empty).columns
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({contracts.SQL['op9_pii']})").fetchall()) == sorted(tuple(r) for r in found if r["doc_id"] is not None and r["doc_id"] != 103)


def test_pii_context_is_the_text_around_a_span(spark):
    rows = [
        (0, "SSN: 123-45-6789, 987-65-4321"), (1, "Tel 212 555-0100, 212 555-0101 or 212 555-0102"), (2, "123-45-6789 (SSN)"), (3, "212 555-0100 (mobile)"), (4, "123-45-6789, 987-65-4321"),
        (5, "SSN " + "x" * 40 + " 123-45-6789 " + "y" * 40 + " SSN"), (6, "é 😀 SSN: 123-45-6789, 987-65-4321"), (7, "SSN 123-45-6789" + " 987-65-4321" * 4),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(frame).collect()}
    assert got[0] == "ssn:5:16,ssn:18:29" and got[1] == "local_phone:4:16,local_phone:18:30,local_phone:34:46" and got[2] == "ssn:0:11" and got[3] == "local_phone:0:12"
    assert got[4] == got[5] == "" and got[6] == "ssn:9:20,ssn:22:33" and got[7] == "ssn:4:15,ssn:16:27,ssn:28:39,ssn:40:51"
    assert {r["text"] for r in pii.redact(frame.where("doc_id = 0")).collect()} == {"SSN: <SSN>, <SSN>"}


def brute_tree(t):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    paragraphs = [[sha("p" + p) for p in s.split("\n")] for s in t.split("\n\n")]
    root = sha("r" + ",".join(sha("s" + ",".join(s)) for s in paragraphs))
    return root + "|" + ";".join("/".join(p[:8] for p in s) for s in paragraphs)


def brute_likeness(a, b):
    if a == b:
        return 1.0

    def leaves(p):
        words = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]{1,32}|[ \t\n\x0b\f\r]+", p)
        return {(words[k - 1] if k else "", w) for k, w in enumerate(words)}

    size = lambda xs: sum(map(len, xs))
    x, y = set(a.split("\n\n")), set(b.split("\n\n"))
    both = size(x & y)
    x, y = ({p for s in z for p in s.split("\n")} for z in (x - y, y - x))
    both += size(x & y)
    x, y = (set().union(*map(leaves, z)) for z in (x - y, y - x))
    weight = lambda z: sum(min(63, len(w)) for _, w in z)
    shared, total = 2 * (both + weight(x & y)), 2 * both + weight(x) + weight(y)
    return 0.0 if not total else 1 - 1 / (total + 1) if shared == total else shared / total


def brute_edits(rows):
    """Rows in the order of doc_ids, which differ or have equal texts."""
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_tree(t), brute_tree(edited), brute_likeness(t, edited), brute_likeness(t, following)))
    return sorted(out, key=repr)


def test_merkle(spark, docs, empty):
    rows = [(i, t or "") for i, t in texts(docs)]
    got = sorted((tuple(r) for r in merkle.edit_digest(docs.withColumn("h", F.lit("clash")).withColumn("key", F.lit(1))).collect()), key=repr)
    assert got == brute_edits(rows)
    prints = {}
    for r in got:
        prints.setdefault(r[0], set()).add(r[3])
    assert prints[5] == prints[6] != prints[7] and prints[0] == prints[1] != prints[2]
    assert merkle.edit_digest(empty).count() == 0 and merkle.edit_digest(docs.where("doc_id = 5")).first()["near_next"] == 1.0


def test_merkle_of_edited_texts(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(60):
        lines = [" ".join(BASE[k] for k in rng.integers(0, len(BASE), int(rng.integers(0, 9)))) for _ in range(int(rng.integers(1, 7)))]
        rows.append((i, "".join(x + ["\n", "\n\n", "\n\n\n"][int(rng.integers(3))] for x in lines)))
        if i % 3 == 0:  # a near copy of the row before it
            rows[-1] = (i, rows[-2][1].replace("beta", "delta", 1) if i else "x" * 200)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in merkle.edit_digest(frame).collect()), key=repr) == brute_edits(rows)


def test_merkle_of_repeated_rows(spark, monkeypatch):
    rows = [(1, "one two")] * 7 + [(2, "two three")] + [(None, "none")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_edits(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((tuple(r) for r in merkle.edit_digest(frame).collect()), key=repr) == want
    monkeypatch.setattr(merkle, "SPREAD", 2)
    assert sorted((tuple(r) for r in merkle.edit_digest(frame).collect()), key=repr) == want


def test_merkle_locates_an_edit(spark):
    frame = spark.createDataFrame([("one.\ntwo.\n\nthree\nfour", "one.\ntwo.\n\nthree\nFOUR"), ("same", "same"), ("one two three four\n" + "x" * 80, "one two three four\n" + "x" * 70)], "a string, b string")
    found = frame.select(merkle.changed_paragraphs(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in found] == [[(1, 1)], [], [(0, 1)]]


def test_merkle_has_one_rule_for_all_lengths(spark):
    """A word put into a text leaves all other leaves alone, whatever the lengths on either side."""
    words = " ".join(f"{a}{b}" for a in BASE for b in BASE[:9])
    pairs = [(words[:n], "extra " + words[:n]) for n in (20, 90, 100, 150, 900)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r["x"] for r in frame.select(merkle.likeness(F.col("a"), merkle.tree(F.col("a")), F.col("b"), merkle.tree(F.col("b"))).alias("x")).collect()]
    assert got == [brute_likeness(a, b) for a, b in pairs] and got[2] > 0.75 and got == sorted(got)


def test_cover_tree_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(700)]
    rows += [(700 + i, [0.5] * 8, 0) for i in range(300)] + [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 8, 0), (2003, [1.0] * 3, 0), (2050, [2.0] * 3, 0), (None, [1.0] * 8, 0), (50, rows[50][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in cover_tree.top_k(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q in [0, 50, 700, 950, 2050]:
        x = next(v for i, v in good if i == q)
        want = sorted(((i, int(v @ x)) for i, v in good if i != q and len(v) == len(x)), key=lambda p: (-p[1], p[0]))[:5]
        assert got[q][:5] == want
    assert cover_tree.top_k(frame.where("false"), frame.where("false")).count() == 0


def brute_top(rows, asked, k=5):
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    fits = lambda i, v: i is not None and v is not None and None not in v and np.isfinite(v).all()
    points = [(i, whole(v)) for i, v in rows if fits(i, v)]
    out = []
    for q, v in {(q, tuple(v)) for q, v in asked if fits(q, v)}:
        v = whole(v)
        clipped = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        best = sorted((-clipped(sum(a * b for a, b in zip(v, p))), i) for i, p in points if i != q and len(p) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_cover_tree_in_many_cells(spark, monkeypatch):
    """Clusters in cells and parts of cells, several query blocks, a small sample, lengths that it lacks, and long vectors."""
    monkeypatch.setattr(cover_tree, "LEAST_ROWS", 60)
    monkeypatch.setattr(cover_tree, "SAMPLE", 200)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in middle[i % 12] + 0.05 * rng.normal(size=6)]) for i in range(900)]
    rows += [(2000 + i, [0.25] * 6) for i in range(150)] + [(3000 + i, [float(x) for x in rng.normal(size=2)]) for i in range(7)]
    rows += [(4000, [3e5, 1.0, -2e5, 7.0, 0.5, 1e6]), (4050, [-3e5, 1e7, 2e5, 7.0, 0.5, 1e6]), (4100, [3e17, -1e18, 2e5, 7.0, 0.5, 1e6])]
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    asked = [r for r in rows if r[0] % 10 == 0]
    got = sorted(tuple(r) for r in cover_tree.top_k(frame, spark.createDataFrame(asked, schema)).collect())
    assert got == brute_top(rows, asked)


def test_cover_tree_asks_with_each_vector_of_a_vec_id(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(1, 60)]
    asked = [(50, [1.0, 2.0, 3.0]), (50, [0.5, None, 1.0]), (1000, [1.0, -2.0, 0.5]), (1000, [-1.0, 3.0, 0.25]), (1000, [-1.0, 3.0, 0.25]), (1000, [None, 1.0, 1.0]), (1001, [1.0, 1.0, 1.0]), (1001, None), (1002, [float("-inf"), 0.0, 0.0]), (1002, [0.0, 2.0, 1.0])]
    schema = "vec_id long, embedding array<float>"
    got = sorted(tuple(r) for r in cover_tree.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)).collect())
    assert got == brute_top(rows, asked)
