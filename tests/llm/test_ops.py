"""Every operator against a brute-force version on small tables with odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegraph.llm import decontam, html_extract, jaccard, linededup, mixing, quality, queries, secrets, tokencounts, tokenids, transducer, vectext, warc, wavelet
from codegraph.llm.common import fresh_path, shared_dir

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, items int, n_hit int, _weight int"
tokenizers = pytest.importorskip("tokenizers")


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "日本", "Straße", "the", "The", "#", "a|b", "***"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [make(r.randint(1, 120)) for _ in range(25)]
    near = [" ".join(w if r.random() > 0.03 else "zz" for w in base[i].split()) for i in range(8) for _ in range(3)]
    lines = ["\n".join(r.choice(base[:3] + ["short", "", "  "]) for _ in range(6)) for _ in range(6)]
    odd = [None, "", " \n\t ", "x", "a b c d", "a b c d e", "A B C D E", "\n\n", "word " * 30, make(30) + " " + make(5) * 8, "x" * 5000, make(3000), "nul\0byte", "😀 " * 12, "last\n"]
    return base + near + lines + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    shared_dir(spark)
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, None, "clash", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def rows_of(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


def test_quality(docs, texts):
    got = rows_of(quality.repetition_quality(docs))
    for i, t in enumerate(texts):
        words, t = SPACE_WORD.findall(t or ""), t or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACE_WORD.search(line):
                dup += line in seen
                seen.add(line)
        counts = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {p for k in range(len(words) - 7) if counts[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed), repr(t[:60])
        assert not (failed and r["kept"])
    assert got[len(texts) - 8 + 1]["lang"] == "en"


def test_contamination_both_ways(spark, docs, texts):
    r = random.Random(9)
    items = []
    for i in range(30):
        words = ALNUM_WORD.findall(lower(r.choice([t for t in texts if t])))
        k = r.randint(0, max(0, len(words) - 12))
        items.append((i, " ".join(words[k : k + r.randint(1, 20)])))
    items += [(90, None), (91, "..."), (92, items[0][1]), (93, items[1][1].upper())]
    table = spark.createDataFrame(items, "item_id long, text string")
    windows: dict = {}
    for i, t in items:
        words = ALNUM_WORD.findall(lower(t))
        for k in range(max(1, len(words) - 7) if words else 0):
            windows.setdefault(tuple(words[k : k + 8]), set()).add(str(i))
    ways = [rows_of(decontam.contamination(docs, table, broadcast_bytes=n)) for n in (1 << 24, 1)]
    for i, t in enumerate(texts):
        words, hit, found = ALNUM_WORD.findall(lower(t)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (g := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        for got in ways:
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(words), len(hit), sorted(found)), (i, t and t[:50])
    assert decontam.contamination(docs, table.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_secrets(spark):
    hexed = "0123456789abcdef" * 2
    texts = [
        None, "", f'token = "{hexed}" end', "PASSWORD: hunter22, x", "token: token: abcdefgh", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16 + " t", "secret=token=abcdef", "ſecret = abcdefgh", "api-key none",
        'KEY_PART = "9f8Qz71LmPx0"\nclient_credential = KEY_PART + "Zz81kQpW22"\n', 'settings["privateKey"] = "q8Zr51Lm20Pxy7"', "the key: a plain sentence here", 'auth_token = "changeme"', "pass" * 2000, "é" * 10 + f" passwd={hexed[:8]}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(secrets.secret_findings(df))
    patterns = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for i, t in enumerate(texts):
        want = [("assign", m.start(), m.end()) for m in re.finditer(patterns["assign"], t or "", re.A) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer(patterns["access"], t or "") if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer(patterns["hex"], t or "") if len(m[0]) >= 24]
        base = [(f["kind"], f["start"], f["end"]) for f in got[i]["findings"] if f["kind"] != "literal"]
        assert base == sorted(want, key=lambda f: (f[1], secrets.KINDS.index(f[0]))), t
    literals = lambda i: [texts[i][f["start"] : f["end"]] for f in got[i]["findings"] if f["kind"] == "literal"]
    assert literals(10) == ["9f8Qz71LmPx0", "Zz81kQpW22"]  # a constant that reaches a sensitive name
    assert literals(11) == ["q8Zr51Lm20Pxy7"] and literals(12) == [] and literals(13) == []


def test_secrets_gate(monkeypatch):
    value = "Xk93kd8sLq02mZpT"
    for t in (f'private_key         = "{value}"', f'passphrase          : "{value}"', f'pwd /* prod */ = "{value}"'):
        assert [t[a:b] for kind, a, b, *_ in secrets.findings(t) if kind == "literal"] == [value]
    names = ["private_key", "passphrase", "pwd", "MY.Credential", "clientAuthKey", "accessKey", "pass_phrase", "creds", "k" * 80 + "_pwd", "pwd_" + "k" * 80]
    gaps = ["", " ", " " * 9, "\t" * 40, " /* prod */ ", " /* a\n b */ ", "\r ", "  /* x */ /* y */  "]
    texts = [f'{left}{name}{right}{gap}{op} "{value}"' for name in names for left, right in (("", ""), ('"', '"'), ('s["', '"]'), ('"my ', ' of all"')) for gap in gaps for op in ("=", ":", ":=", "=>")]
    texts += ["private_key", "= key", f'x = "{value}"', "a: pwd", f'pwd: string = "{value}"', f'pwd # = "{value}"', f'pwd\n= "{value}"']
    gated = [secrets.findings(t) for t in texts]
    monkeypatch.setattr(secrets, "may_assign", lambda text: True)
    assert gated == [secrets.findings(t) for t in texts]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def odd_texts() -> list[str]:
    r = random.Random(2)
    parts = ["a", "b", "'", "s", "'ll", "'RE", " ", "\n", "é", "É", "é", "Σ", "ς", "ß", "İ", "1", "²", "!", "…", "\xa0", " ", "\x1c", "\x85", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "Ǆ", "̀", "क्", "\0", "the", "international"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", "a" * 700, "ab'" * 300, "日" * 400, "9" * 50, " 's'T'rE'VE'm'LL'd"]


def test_transducer_and_encoder(library, texts):
    batch = odd_texts() + [t or "" for t in texts]
    want = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
    counter = transducer.counter(queries.tokenizer_path())
    for chunk in (1 << 16, 5):
        assert counter.count(batch, chunk).tolist() == list(map(len, want))
    ids, sizes = tokenids.encoder(queries.tokenizer_path()).encode(*vectext.utf8(pa.array(batch)))
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_token_counts_and_ids(spark, docs, texts, library):
    counts = rows_of(tokencounts.token_counts(docs, queries.tokenizer_path(), keep=["doc_id"], limit=100))
    got = rows_of(tokenids.token_ids(docs, queries.tokenizer_path(), shard_tokens=500))
    start = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(counts[i]) == (i, len((t or "").encode()), len(ids), len(ids) > 100)
        ids.append(tokenids.END_ID)
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert tokenids.token_ids(docs.limit(0), queries.tokenizer_path()).count() == 0
    twice = tokenids.token_ids(docs.filter("doc_id < 3").unionAll(docs.filter("doc_id < 3")), queries.tokenizer_path()).collect()
    assert len(twice) == 6 and len({r["start"] for r in twice}) == 6


def test_wavelet():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([2], np.uint32), r.integers(0, 50_000, 3000).astype(np.uint32), np.repeat(7, 1024).astype(np.uint32), r.integers(0, 1 << 20, 600).astype(np.uint32)):
        m, names, bounds = wavelet.read_shard(wavelet.write_shard(ids, [5, None], np.array([0, len(ids) // 2, len(ids)])))
        assert (m.decode() == ids).all() and names == [5, None] and bounds.tolist() == [0, len(ids) // 2, len(ids)]
        if len(ids):
            at = r.integers(0, len(ids), 50)
            assert (m.access(at) == ids[at]).all()
        for token in {*ids[:5].tolist(), 49_999, 1 << 25}:
            assert m.count(token, 3) == (ids[3:] == token).sum() and m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()


def test_line_runs(spark, docs, texts):
    ordered, runs, gone = list(enumerate(texts)), {}, collections.defaultdict(set)
    for d, t in ordered:
        lines = (t or "").split("\n")
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += len(SPACE_WORD.findall(lines[j]))
                if total >= 20 and runs.setdefault(tuple(lines[i : j + 1]), (d, i)) < (d, i):
                    gone[d].update(range(i, j + 1))
    got = rows_of(linededup.without_repeats(docs, min_words=20))
    for d, t in ordered:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        assert (got[d]["text"], got[d]["n_deleted"]) == (kept, len(gone[d])), (d, t and t[:50])
    assert sum(map(len, gone.values())) > 5
    assert linededup.without_repeats(docs.limit(0)).count() == 0


def test_warc(spark):
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(["<p>é</p>", None, "", "<p>é</p>", "x" * 9000, "y", "y", "<p>é</p>"])] + [(20, None, "z"), (21, "http://h/\r\nEvil: 1", "q"), (22, "http://h/\x01é\x7f\t", "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    for least in (0, 3):
        path = fresh_path(spark, "warc")
        warc.write_archive(df, path, min_bytes=least)
        got, heads = rows_of(warc.read_archive(spark, path), "page_id"), {}
        for i, _, h in pages:
            raw = (h or "").encode()
            head = heads.setdefault(raw, i)
            revisit = head != i and len(raw) >= least
            r = got[i]
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", head if revisit else None)
            block = bytes(r["record"])
            assert block.endswith((b"" if revisit else raw) + b"\r\n\r\n") and b"Evil: 1\r\n" not in block.replace(b"%0D%0AEvil: 1\r\n", b"")
            assert f"Content-Length: {len(r['http'].encode()) + (0 if revisit else len(raw))}\r\n".encode() in block
        assert "WARC-Target-URI: http://h/%01é%7F%09\r\n" in got[22]["header"] and "WARC-Target-URI: http://h/%0D%0AEvil: 1\r\n" in got[21]["header"]
        assert spark.read.parquet(path + "/payloads").count() == len(heads)


def test_jaccard(spark, docs, texts):
    sets = []
    for t in texts:
        w = SPACE_WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows_of(jaccard.classes(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_empty(spark, docs):
    assert jaccard.classes(docs.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.classes(docs.filter("text = ''")).collect()][0][1] == 0


def test_pigeonhole_bound():
    bands = jaccard.Bands(75)
    lows = bands.upto(5000)
    for n in range(1, 3000, 7):
        band = int(np.searchsorted(lows, n, "right")) - 1
        for m in range(n, bands.most(n) + 1, max(1, n // 9)):
            least = -(-3 * (n + m) // 7)  # the smallest intersection of a similar pair
            assert n + m - 2 * least <= bands.differ(n, m) < bands.parts(band)


def test_mixing(spark, docs, texts):
    mixed = mixing.mix(docs, max_epochs=2.0)
    rows = mixed.collect()
    copies = collections.Counter(r["doc_id"] for r in rows)
    assert set(copies) == set(range(len(texts))) and max(copies.values()) <= 3
    tokens: dict = collections.Counter()
    emitted: dict = collections.Counter()
    for i, t in enumerate(texts):
        s = f"s{i % 3}" if i % 11 else None
        tokens[s] += len(SPACE_WORD.findall(t or ""))
        emitted[s] += copies[i] * len(SPACE_WORD.findall(t or ""))
    epochs = {s: emitted[s] / tokens[s] for s in tokens}
    assert min(epochs, key=epochs.get) == max(tokens, key=tokens.get) and abs(min(epochs.values()) - 1) < 1e-9
    assert max(epochs.values()) < 2 + 3000 / min(tokens.values())
    weights = {r["source"]: r["_weight"] for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-9
    flat = {r["source"]: r["_weight"] for r in mixing.mix(docs, max_epochs=None, target_entropy=np.log(4) - 1e-3).collect()}
    assert abs(-sum(w * np.log(w) for w in flat.values()) - (np.log(4) - 1e-3)) < 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0 and "n_words" in mixed.columns


def test_html(spark):
    menu = "<div><ul><li>Home<li>News</ul></div>"
    pages = [(i, "http://a.org/x", f"<body>{menu}<div>text {i}</div><p>more &amp; &eacute;</p><script>x('</p>')</script></body>") for i in range(8)]
    pages += [(20, "http://b.org", f"<body>{menu}<p>only</p></body>"), (21, None, None), (22, "", ""), (23, "http://a.org/y", "<article><h1>T</h1><p>a<br>b<p>c<div class='comments'>no</div></article><p>out"), (24, "http://a.org/z", "<b>cut <i")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"text {i} more & é" for i in range(8)} | {20: "Home News only", 21: "", 22: "", 23: "T a b c", 24: "cut"}
    # a paragraph that all pages of a host share stays: only elements around paragraphs are templates
    assert {k: v[0] for k, v in got.items()} == want and all(n == len(t) for t, n in got.values())


def page_texts(spark, pages, **options):
    """Texts by page id; pages are (page_id, url, html)."""
    return {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), **options).collect()}


def test_html_copies(spark):
    advert = lambda i: f"<div class='ad'>buy {i}</div>"
    wrapped = {f"http://w{k}.org/": page for k, page in enumerate(("<article><div class='body'><p>one<p>two</div></article>", "<article><section><ul><li>one<li>two</ul></section></article>", "<main><table><tr><td>one<td>two</table></main>", "<body><div><p>one</p><p>two</p></div></body>", "<p>one</p><p>two</p>"))}
    pages = [(100 * k + i, url, (advert(i) if i % 2 else "") + page) for k, (url, page) in enumerate(wrapped.items()) for i in range(12)]
    # copies among other pages of their host, with a menu and a notice that all pages share
    menu, notice = "<div><ul><li>Home<li>News</ul></div>", "<div><p>All rights</p></div>"
    pages += [(1000 + i, "http://m.org", f"{menu}<div><p>{'same text' if i < 20 else f'text {i}'}</p></div>") for i in range(26)]
    pages += [(2000 + i, "http://n.org", f"<article><div><p>{'same text' if i < 20 else f'text {i}'}</p></div>{notice}</article>") for i in range(26)]
    got = page_texts(spark, pages)
    assert {i: t for i, t in got.items() if i < 1000} == {i: "one two" for i, _, _ in pages if i < 1000}
    assert {i: t for i, t in got.items() if i >= 1000} == {1000 * n + i: "same text" if i < 20 else f"text {i}" for n in (1, 2) for i in range(26)}


def test_html_rotating_adverts(spark):
    menu, advert = "<div>Home News</div>", lambda i: f"<div><p>buy number {i}</p></div>"
    pages = [(i, "http://plain.org", f"{menu}<p>text {i}</p>{advert(i % 20)}") for i in range(120)]
    pages += [(200 + i, "http://art.org", f"<article><p>text {200 + i}</p>{advert(i % 20)}</article>") for i in range(120)]
    # 4 pages with one subtree are not enough at any size of the host; copies keep their text
    pages += [(400 + i, "http://plain.org", f"<p>rare</p><p>text {400 + i}</p>") for i in range(4)] + [(500 + i, "http://plain.org", "<p>copy</p>") for i in range(9)]
    want = {i: f"text {i}" for i, _, _ in pages if i < 400} | {400 + i: f"rare text {400 + i}" for i in range(4)} | {500 + i: "copy" for i in range(9)}
    assert page_texts(spark, pages) == want
    assert page_texts(spark, pages, broadcast_bytes=3) == want


def test_html_wrappers():
    text = lambda page: " ".join(html_extract.read(page).blocks)
    article = "<article><h1>T</h1><p>one</p></article>"
    for names in ("container no-sidebar", "has-sidebar", "menu-open", "modal", "sidebar", "page menu", "Login"):
        for inner in (article, f"<main>{article}</main>", article.replace("article", "main"), f"<div>{article}</div>"):
            assert text(f'<body><p>out</p><div class="{names}">{inner}</div></body>') == "T one", (names, inner)
    for names in ("modal", "sidebar", "page menu", "Login"):
        assert text(f'<main><p>first</p><div id="{names}">{article}</div></main>') == "first T one"
    for wrapper in ("form", "div hidden", "div style='display: none'", "div role=dialog", "div aria-hidden=true"):
        assert text(f"<{wrapper}>{article}</{wrapper.split()[0]}>") == "T one"
    for inside in ('<div class="entry-header"><h1>T</h1></div>', '<div class="social-science"><h1>T</h1></div>', '<h1 id="comment-ça">T</h1>', '<h1 class="my_menu no-ads">T</h1>'):
        assert text(f"<article>{inside}<p>one</p></article>") == text(f"<body>{inside}<p>one</p></body>") == "T one"
    # what holds other articles stays out
    for teaser in ("<aside>{}</aside>", "<div class='box related'>{}</div>", "<section id=comments>{}</section>", "<div class='menu'>{}</div>"):
        other = teaser.format("<article>other</article>")
        assert text(f"{article}{other}") == text(f"<main>{article}</main>{other}") == text(f"<article><h1>T</h1><p>one</p>{other}</article>") == "T one"
        if "menu" not in teaser:
            assert text(f"<main><p>one</p>{other}</main>") == text(f"<body><p>one</p>{other}</body>") == "one" and text(other) == "other"
    for name in ("ad", "AD", "x sidebar y", "site-footer", "cookie-banner", "comments"):
        assert text(f"<article><p>one</p><div class='{name}'>no</div></article>") == "one"
