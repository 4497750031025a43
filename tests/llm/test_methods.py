"""Hashes, lexer, page reader and the methods' own verdicts against brute force; odd tables for every operator."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codegraph.llm import common, decontam, html_extract, jaccard, linededup, mixing, quality, queries, secrets, tokencounts, tokenids, transducer, vectext, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
tokenizers = pytest.importorskip("tokenizers")


def thue_morse(n: int, one: str = "a", two: str = "b") -> str:
    """The sequence whose complement has the same polynomial hash modulo 2**64 for every odd base."""
    return "".join(one if bin(i).count("1") % 2 == 0 else two for i in range(n))


TM = (thue_morse(4096), thue_morse(4096, "b", "a"))


def test_byte_hashes():
    r = random.Random(3)
    strings = [bytes(r.choices(b"ab\0\xff", k=r.randint(0, 9))) for _ in range(3000)] + [t.encode() for t in TM] * 2 + [b"", b"\0", b"\0\0"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    for family in (0, 1):
        found = vectext.byte_hashes(data, starts, ends, family).tolist()
        assert len(set(zip(strings, found))) == len(set(strings)) == len(set(found))
    long = np.full((9 << 20) + 5, 97, np.uint8)
    n = 9 << 19
    assert len(set(vectext.byte_hashes(long, np.array([0, 3, 5]), np.array([n, n + 3, n + 5])).tolist())) == 1


def test_no_false_copies(spark):
    """Lines, words and texts that collide under weak hashes are told apart by operators 3, 4, 5 and 7."""
    common.shared_dir(spark)
    line = lambda t: "\n".join([t] * 1 + ["x"])
    filler = lambda s: " ".join(f"{s}{i}" for i in range(60))
    texts = [TM[0] + "\n" + TM[1], line(TM[0]), line(TM[1]), " ".join([TM[0]] + [f"w{i}" for i in range(9)]), " ".join([TM[1]] + [f"w{i}" for i in range(9)]), filler("q") + "\n" + TM[0], filler("q") + "\n" + TM[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert quality.repetition_quality(docs).agg(F.sum("n_dup_lines")).first()[0] == 0
    item = spark.createDataFrame([(1, " ".join([TM[0]] + [f"w{i}" for i in range(7)]))], "item_id long, text string")
    for most in (1 << 24, 1):
        assert {r["doc_id"] for r in decontam.contamination(docs, item, broadcast_bytes=most).filter("n_hit > 0").collect()} == {3}
    gone = linededup.without_repeats(docs, min_words=2).filter("n_deleted > 0").collect()
    assert [(r["doc_id"], r["text"]) for r in gone] == [(6, TM[1])]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs.filter("doc_id < 5")).collect()} == {i: i for i in range(5)}


# -- operator 1 -------------------------------------------------------------------------------


def plain_pairs(text: str):
    """The lexer's grammar over a naive scan, with values expanded: (name, list of (start, end, value, quoted))."""
    tokens, i = [], 0
    while i < len(text):
        rest = text[i:]
        if m := re.match(r"[ \t\r]+", rest):
            pass
        elif rest.startswith("//") and not (i and re.match(r"[\w:]", text[i - 1], re.A)):
            m = re.match(r"[^\n]*", rest)
        elif rest[0] == "#" and not (i and not text[i - 1].isspace()):
            m = re.match(r"[^\n]*", rest)
        elif rest.startswith("/*") and "*/" in rest[2:]:
            i += 2 + rest[2:].index("*/") + 2
            continue
        else:
            for kind, pattern in (("line", r"\n"), ("string", r""""(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'"""), ("name", r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*"), ("bare", r"[0-9+/_=.\-]*[0-9][\w+/=.\-]*"), ("op", r":=|=>|==|!=|<=|>=|\+=|[=:+,;(){}\[\]]"), ("other", r"/\*|[\s\S]")):
                if m := re.match(pattern, rest, re.A):
                    tokens.append((kind, m[0], i, i + m.end()))
                    break
        i += m.end()
    known, out, target, value, want, joined, before = {}, [], None, [], False, False, None

    def close():
        nonlocal target, value, want
        if target is not None and value:
            known[target] = list(value)
            out.append((target, list(value)))
        target, value, want = None, [], False

    single = []  # whether each part of the value is one quoted literal
    for kind, word, a, b in tokens:
        if kind in ("string", "name", "bare"):
            if target is not None and (want or joined or kind == "string" and value and single[-1] and before is None):
                if not value:
                    single = []
                if kind == "string":
                    value.append((a + 1, b - 1, word[1:-1], True))
                    single.append(True)
                elif kind == "name" and word in known:
                    value += known[word]
                    single.append(False)
                else:
                    value.append((a, b, word, False))
                    single.append(False)
                want = joined = False
                before = word if kind == "name" else None
                continue
            close()
            before = word[1:-1] if kind == "string" else word
        elif kind == "op" and word in ("=", ":", ":=", "=>") and before is not None and before != "":
            name = before
            if target is not None and word == "=" and len(single) == 1 and value and not single[0]:
                name, value = target, []
            else:
                close()
            target, want, before, joined = name, True, None, False
        elif kind == "op" and word == "+" and value:
            joined = True
        elif kind == "op" and (word == "]" and before or word == "(" and target is not None and (joined or want)):
            continue
        else:
            close()
            before, joined = None, False
    close()
    return out


def test_lexer_against_plain_scan():
    r = random.Random(7)
    parts = ["api_key", "x", "y", "secret_a", "=", ":", " ", " ", "\n", "+", '"Xk93kd8sLq02mZpT"', "'ab12cd34ef56gh78'", "abc123def456ghi7", "/*", "*/", '"', "'", "\\", "(", ")", ",", "=>", ":=", "[", "]", " # ", " // ", "pwd"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        want = []
        for name, literals in plain_pairs(text):
            whole = "".join(x[2] for x in literals)
            strength = secrets.name_score(name) * secrets.literal_score(whole)
            if strength >= secrets.MIN_SCORE:
                want += [(a, b) for a, b, v, quoted in literals if b > a and (quoted or len(v) >= 12 and any(c.isdigit() for c in v))]
        found = secrets.findings(text)
        base = [(a, b) for kind, a, b, *_ in found if kind != "literal"]
        want = {w for w in want if not any(a <= w[0] and w[1] <= b for a, b in base)}
        assert {(a, b) for kind, a, b, *_ in found if kind == "literal"} == want, text


def test_lexer_is_linear_and_bounded():
    strong = "Xk93kd8sLq02mZpT"
    lines = f"secret_a = '{strong}'\n" + "secret_a = secret_a + secret_a\n" * 300
    assert [f[:3] for f in secrets.findings(lines) if f[0] == "literal"] == [("literal", 12, 28)]
    for text in ("pwd = x " + "/*" * 500_000, 'pwd = "' + '\\"' * 300_000, "pwd = " + "*/ /* " * 200_000, "/* " + "key = " * 100_000):
        assert secrets.findings(text) == []
    name = "n" * 70 + "_credential"
    for text in (f'{name} = "{strong}"', f'url = "http://x"; credential          = "{strong}" // end', f"pwd\t/* a */ = '{strong}'"):
        assert [text[a:b] for kind, a, b, *_ in secrets.findings(text)] == [strong]
    # a literal inside a base span gives that span its target's name
    kind, _, _, score, target = secrets.findings(f'client_secret = "{strong}"')[0]
    assert (kind, target) == ("assign", "client_secret") and score >= 1


# -- operator 3 -------------------------------------------------------------------------------


def test_quality_verdict(spark):
    r = random.Random(8)
    texts = [None, "", " ".join(r.choice("abcdefgh") * 3 for _ in range(200))]
    texts.append("\n".join(f"alpha beta gamma delta\nu{i}" for i in range(40)))  # repeated lines without repeated windows
    for share in (0, 10, 30, 60, 100):
        run = " ".join(f"r{i}" for i in range(16))
        texts.append(" ".join(run if r.randrange(100) < share else " ".join(f"u{r.random()}" for _ in range(16)) for _ in range(30)))
        texts.append("\n".join("same line here" if r.randrange(100) < share else f"line {r.random()} of text" for _ in range(40)))
    rows = {x["doc_id"]: x for x in quality.repetition_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    verdicts = set()
    for i, text in enumerate(texts):
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        bad = False
        for n, most in quality.MAX_NGRAM_SHARE.items():
            grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            count = collections.Counter(grams)
            inside = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + n)}
            share = sum(len(words[p]) for p in inside) / max(1, sum(map(len, words)))
            assert abs(rows[i][f"dup_{n}gram_share"] - share) < 1e-12
            bad |= share > most
        seen, again = set(), 0
        for x in lines:
            again += len(x) if x in seen else 0
            seen.add(x)
        share = again / max(1, sum(map(len, lines)))
        assert abs(rows[i]["dup_line_share"] - share) < 1e-12
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and not bad and share <= quality.MAX_LINE_SHARE)
        verdicts.add((rows[i]["base_failed"], rows[i]["kept"]))
    assert verdicts == {(True, False), (False, False), (False, True)}


# -- operator 7 -------------------------------------------------------------------------------


def test_jaccard_hot_groups(spark):
    """Near copies around the limit, and unlike texts that share a passage, against all pairs; with many targets and cells."""
    r = random.Random(11)
    make = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    base, passage = make(120), make(60)
    texts = [[w if r.random() > rate else f"z{r.random()}" for w in base] for rate in (0.01, 0.02, 0.03, 0.04) for _ in range(25)]
    texts += [make(70) + passage + make(r.randrange(60)) for _ in range(60)] + [make(r.randrange(3, 40)) for _ in range(20)] + [base] * 5
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    old = jaccard._CELL, jaccard._FEW
    try:
        jaccard._CELL, jaccard._FEW = 16, 1
        got = {x["doc_id"]: x["component_id"] for x in jaccard.classes(docs, part_keys=3000).collect()}
    finally:
        jaccard._CELL, jaccard._FEW = old
    assert got == {i: find(i) for i in range(len(sets))}
    assert 10 < len(set(got.values())) < len(sets) - 60


def test_spare_buckets():
    """Two similar sets agree in more buckets of a band than either may leave."""
    r, bands = random.Random(5), jaccard.Bands(75)
    for n in (1, 3, 8, 30, 90, 200, 333):
        common_, own = [f"c{r.random()}" for _ in range(n + 4)], [f"o{r.random()}" for _ in range(max(1, n // 8))]
        for x, y in ((common_, common_ + own), (common_ + own, common_ + [f"p{r.random()}" for _ in range(n // 9)])):
            s = jaccard.Sets(pa.array([" ".join(x), " ".join(y)]), 5)
            a, b = (set(s.hash[s.at[i] : s.at[i + 1]].tolist()) for i in (0, 1))
            if 100 * len(a & b) < 75 * len(a | b):
                continue
            keys = [collections.defaultdict(set), collections.defaultdict(set)]
            for band, texts, limit in jaccard.roles(s, np.array([0, 1]), bands):
                for key, text in zip(*jaccard._part_keys(s, texts, band, bands, limit)):
                    keys[text][band].add(int(key))
            spare = jaccard.spare(s, bands)
            both = {band: keys[0][band] & keys[1][band] for band in keys[0] if band in keys[1]}
            assert any(len(k) > max(spare[band & 1]) for band, k in both.items())


# -- operator 8 -------------------------------------------------------------------------------


def test_transducer_forgets():
    path = queries.tokenizer_path()
    library, counter = tokenizers.Tokenizer.from_file(path), transducer.Counter(path)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdeéß日 '1") for _ in range(300)) for _ in range(60)] + ["abc" * 900]
    counter.transducer.limit = 1 << 16
    for chunk in (1 << 16, 40):
        assert counter.count(texts, chunk).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# -- operator 9 -------------------------------------------------------------------------------


def plain_texts(pages: list[tuple[str, list[tuple[str, str]]]], least: int) -> list[str]:
    """Pages are (host, blocks (tag, text) of the body); a block that recurs with `least` contents goes, but for paragraphs."""
    contents = [" ".join(t for tag, t in blocks if tag != "nav") for _, blocks in pages]
    seen = collections.defaultdict(set)
    for (host, blocks), content in zip(pages, contents):
        for block in blocks:
            seen[host, block].add(content)
    return [" ".join(b[1] for b in blocks if b[0] != "nav" and (b[0] == "p" or len(seen[host, b]) < least)) for host, blocks in pages]


def test_templates_against_plain_count(spark):
    r = random.Random(6)
    pages = []
    for i in range(160):
        host = f"h{r.randrange(3)}"
        blocks = [("div", f"menu of {host}")] * (r.random() < 0.8) + [("p", f"text {r.randrange(60)}")] + [("div", f"advert {r.randrange(12)}")] + [("p", "quoted by all")] * (r.random() < 0.5) + [("nav", "n")]
        pages.append((host, blocks))
    pages += [pages[0]] * 9
    rows = [(i, f"https://{host}/{i}", "<body>" + "".join(f"<{tag}>{t}</{tag}>" for tag, t in blocks) + "</body>") for i, (host, blocks) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain_texts(pages, html_extract.MIN_PAGES)
    for most in (1 << 20, 1):
        got = {x["page_id"]: x for x in html_extract.main_text(df, broadcast_bytes=most).collect()}
        assert [got[i]["text"] for i in range(len(pages))] == want
        assert sum(x["n_deleted"] for x in got.values()) > 100


def test_comment_articles():
    text = lambda page: " ".join(html_extract.read(page).blocks)
    for inner in ('<article class="comment"><p>reader says</p></article>', '<article class="advert">Buy now</article>', '<div class="comments"><article>reader</article></div>'):
        assert text(f"<article><p>one</p>{inner}</article>") == "one"
        assert text(f"<article><p>one</p></article>{inner}") == "one"
    assert text('<article class="sponsored"><p>one</p></article>') == "one"  # the only text there is


# -- operator 10 ------------------------------------------------------------------------------


def test_mix_positions(spark):
    common.shared_dir(spark)
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "abc"[min(2, r.randrange(6))]) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_digits=1).collect()
    import hashlib

    key = lambda d, e: hashlib.md5(f"mix:{e}:{d}".encode()).hexdigest()
    blocks = collections.defaultdict(list)
    for x in got:
        blocks[x["_epoch"], key(x["doc_id"], x["_epoch"])[0]].append(x["doc_id"])
    for x in got:
        mine = blocks[x["_epoch"], x["_block"]]
        assert sorted(mine, key=lambda d: key(d, x["_epoch"]))[x["_position"] - 1] == x["doc_id"]
    # the last pass of a source takes documents in the order of their keys, until its budget is met
    for s in "abc":
        own = [x for x in rows if x[2] == s]
        last = max(x["_epoch"] for x in got if x["source"] == s)
        taken = {x["doc_id"] for x in got if x["source"] == s and x["_epoch"] == last}
        ordered = sorted((d for d, _, _ in own), key=lambda d: key(d, last))
        assert taken == set(ordered[: len(taken)])


# -- odd tables for all -----------------------------------------------------------------------

CLASH = ["row", "key", "gone", "lines", "name", "whole", "cut", "hits", "_doc", "_row", "_gone", "_lines", "_kept", "_source", "_whole", "_cut", "findings", "n_words", "kept", "items", "n_hit", "n_lines", "_epoch", "templates", "head", "payload"]


def operators(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (None, "u v")], "item_id long, text string")
    path = queries.tokenizer_path()
    return {
        "secrets": lambda d: secrets.secret_findings(d), "token_ids": lambda d: tokenids.token_ids(d, path), "quality": lambda d: quality.repetition_quality(d),
        "contamination": lambda d: decontam.contamination(d, items), "contamination by join": lambda d: decontam.contamination(d, items, broadcast_bytes=1),
        "line_dedup": lambda d: linededup.without_repeats(d), "jaccard": lambda d: jaccard.classes(d), "token_counts": lambda d: tokencounts.token_counts(d, path), "mixing": lambda d: mixing.mix(d),
    }


def test_clashing_and_empty_tables(spark):
    common.shared_dir(spark)
    text = "one two three four five six seven eight nine"
    rows = [(1, text, "s"), (1, text, "s"), (2, None, None), (None, "", "s"), (None, text + " x", "s"), (3, "u v", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = docs.select("*", *(F.lit("mine").alias(c) for c in CLASH))
    for name, f in operators(spark).items():
        out = f(odd)
        n = out.count()
        assert n >= len(rows) if name == "mixing" else n == len(rows), name
        if name not in ("token_ids", "jaccard", "contamination", "contamination by join", "quality"):
            assert out.filter("row = 'mine' AND key = 'mine' AND whole = 'mine' AND _doc = 'mine'").count() == n, name
        assert f(odd.limit(0)).count() == 0, name
    hit = {(x["doc_id"], x["n_hit"], tuple(x["items"])) for x in operators(spark)["contamination by join"](docs).collect()}
    assert hit == {(1, 9, ("1",)), (2, 0, ()), (None, 0, ()), (None, 9, ("1",)), (3, 2, ())}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), *(F.lit("mine").alias(c) for c in CLASH))
    for df, n in ((pages, len(rows)), (pages.limit(0), 0)):
        assert html_extract.main_text(df).count() == n
        path = common.fresh_path(spark, "warc")
        warc.write_archive(df, path)
        assert warc.read_archive(spark, path).count() == n


def test_pipeline_odd_tables(spark, tmp_path):
    common.shared_dir(spark)
    r = random.Random(9)
    make = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(40))
    a, b, c, d = make(), make(), make(), make()
    rows = [(1, a, "s"), (1, a, "s"), (1, b, "s"), (2, a + " end", "s"), (None, c, None), (None, c, None), (4, None, "s"), (5, d, None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit("mine").alias(x) for x in CLASH))
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    docs.write.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == ["doc_id", "text", "source", *CLASH] and docs.filter(" OR ".join(f"{x} <> 'mine'" for x in CLASH)).count() == 0
        if name == "near_duplicates":
            key = lambda x: (x[0] or 0, x[1])
            assert sorted(((x["doc_id"], x["text"]) for x in docs.collect()), key=key) == sorted([(1, a), (1, b), (None, c), (5, d)], key=key)
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == docs.count() and sorted(x["start"] for x in out)[0] == 0
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(empty + "/documents.parquet")
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(empty + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_keeps_the_order_of_the_mix(spark):
    common.shared_dir(spark)
    docs = spark.createDataFrame([(i % 20, f"text {i % 20}", "s") for i in range(30)], "doc_id long, text string, source string")
    got = [(x["doc_id"], x["start"]) for x in corpus_pipeline.token_output(spark, docs, "").orderBy("start").collect()]
    import hashlib

    key = lambda x: (x[1], hashlib.md5(f"mix:{x[1]}:{x[0]}".encode()).hexdigest())
    want = sorted([(i, 1) for i in range(20)] + [(i, 2) for i in range(10)], key=key)
    assert [d for d, _ in got] == [d for d, _ in want]
