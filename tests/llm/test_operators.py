"""Brute force, round trips and held-out accuracy of the operators, on small fixtures with odd rows."""

import hashlib
import html as references
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorframe.llm import embeddings, html, idcoder, jaccard, langid, mixing, packing, queries, substrings, suffixes, syncmers, tokens, toxicity
from anchorframe.llm.components import components
from conftest import SF_DIR

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long"
LINE = "a common line of well over fifty bytes that several documents share "
ODD = [
    (0, "the quick brown fox jumps over the lazy dog and runs away " * 4),
    (1, "the quick brown fox jumps over the lazy dog and runs away " * 4),  # a copy
    (2, LINE + "first ending"), (3, "some opening words " + LINE), (4, LINE + LINE + "é ü ñ"),
    (5, ""), (6, None), (7, "   \n\t "), (8, "x"), (9, "a  b\n\nc\td <|endoftext|>"), (10, "wörd " * 700), (11, "no spaces" * 30),
    (12, "12 34 !!"), (None, LINE), (13, "the quick brown fox jumps over the lazy cat and runs away " * 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "src1", 0, 7) for i, t in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def none(df):
    return df.limit(0)


# ---- tokens, packing, coder

@pytest.mark.parametrize("name", [queries.WORD_BPE, queries.BYTE_BPE])
def test_pieces_give_the_tokenizers_ids(name, texts):
    e = tokens.PieceEncoder(tokens.tokenizer_path(name), limit=50)
    some = [t for _, t in ODD] + list(texts.values())[:60] + ["don't, İx yß ÀÉ! ﬁ áb", "x\x1cy z", " a", "a \nb", "a　b c"]
    for text, got in zip(some, e.encode(some)):
        assert got == np.asarray(e.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_holds_every_id_once(odd, docs):
    path = tokens.tokenizer_path(queries.WORD_BPE)
    both = odd.select("doc_id", "text").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = packing.pack(both, path, 2, round_tokens=30_000).toPandas()
    encoder = tokens.PieceEncoder(path)
    for doc_id, text in [(i, t) for i, t in ODD if i is not None]:
        ids = next(iter(encoder.encode([text]))) + (2).to_bytes(4, "little")
        at = 0
        for p in got[got.doc_id == doc_id].sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + p.length)]) and p.doc_tokens == len(ids) // 4
            at += p.length
        assert at == len(ids) // 4
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() == s.tier.iloc[0] <= 4096
        assert s.tier.iloc[0] & (s.tier.iloc[0] - 1) == 0
    assert got.groupby("step_group").length.sum().max() <= 1 << 18
    assert packing.pack(none(odd), path, 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), rng.integers(0, 3, n), np.full(n, 50256)):
        block = idcoder.encode_block(ids.astype("<u4"), 50257)
        assert (idcoder.decode_block(block) == ids).all()
    if n == 5000:
        assert len(idcoder.encode_block(rng.integers(0, 3, n).astype("<u4"), 50257)) < 3 * n
        damaged = bytearray(block)
        damaged[-len(block) // 3] ^= 255
        with pytest.raises(ValueError):
            idcoder.decode_block(bytes(damaged))


def test_blocks_keep_their_format():
    ids = (np.arange(70_000) ** 2 // 7 % 5003 * (np.arange(70_000) % 3)).astype("<u4")
    assert hashlib.sha256(idcoder.encode_block(ids, 50257)).hexdigest() == "1e225c7e90cb91d0a2715eb38b9936eac286efaee0ed4f367d27bdcf8fea824b"


class Counted(dict):
    asked = 0

    def get(self, key, *default):
        Counted.asked += 1
        return super().get(key, *default)

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)


def test_texts_are_cut_together():
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(queries.BYTE_BPE))
    words = [f"{a}{b}na" for a in "bcdfghjk" for b in "aeiou"]
    texts = [" ".join(words[n % 7:]) + "." for n in range(300)]
    encoder.new = Counted()
    assert list(encoder.encode(texts)) == [encoder.whole(t) for t in texts]
    assert Counted.asked < 300  # a look-up for each distinct piece of all texts, not of each text


def test_groups_of_texts_keep_their_order(monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 40)
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(queries.BYTE_BPE))
    texts = ["one two", None, "", " a", "a ", "a  b", "a\n\nb", "a\nb c", "x\x01 y", "caf\u00e9 na\u00efve, \u65e5\u672c \U0001f600!", "it's 3rd, no?", "word", "a\tb c", "tw\u00f6,, tw\u00f6", "tw\u00f6"] * 5
    assert list(encoder.encode(iter(texts))) == [encoder.whole(t) if t else b"" for t in texts]
    assert list(encoder.encode([])) == []


def test_checksums_of_parts_join():
    assert idcoder.join_crc(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_files_give_back_all_ids(spark, odd, tmp_path):
    path = tokens.tokenizer_path(queries.BYTE_BPE)
    idcoder.write(odd, str(tmp_path / "ids"), path, 0, 50257, block_ids=100)  # long documents span blocks
    got = {r.doc_id: r for r in idcoder.read(spark, str(tmp_path / "ids")).collect()}
    encoder, start = tokens.PieceEncoder(path), 0
    for doc_id, text in sorted(ODD, key=lambda r: -1 if r[0] is None else r[0]):
        ids = next(iter(encoder.encode([text]))) + bytes(4)
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert idcoder.round_trip(none(odd), path, 0, 50257).count() == 0


# ---- pages

def test_article_without_its_frame(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav>m</nav><div class="cookie-notice">We use</div>'
            '<main><article><header><h1>Title</h1></header><p>A &lt;b&gt; c<b>d</b></p><aside>side</aside><div class="ad">buy</div><form><p>f</p></form>'
            '<p>x&nbsp; y<br>z<script>var t="</p>";</script></article><section id="comments"><article class="comment"><p>nice</p></article></section></main><footer>f</footer>')
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>one &amp; two"), (4, "x", "<script>y")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(rows).collect()}
    assert got == {1: ("Title\n\nA <b> cd\n\nx y z", 22), 2: ("", 0), 3: ("", 0), None: ("one & two", 9), 4: ("", 0)}
    assert html.extract(none(rows)).count() == 0


def test_pages_by_their_template(spark):
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside.replace("<br>", " "))]
        assert html.main_text(r.html) == "\n\n".join(b for b in blocks if b)


def test_unmarked_page_surges_and_dives():
    menu = "<ul>" + "".join(f"<li><a href={n}>item {n}</a></li>" for n in range(9)) + "</ul>"
    page = f"<body>{menu}<div><p>{'long text ' * 20}</p><p>short.</p><p>{'more text ' * 20}</p></div>{menu}"
    assert html.main_text(page).split("\n\n")[1] == "short." and "item" not in html.main_text(page)


def test_windows_choose_the_text_of_marked_pages():
    long = "".join(f"<p>{'long text of the page ' * 9}{n}</p>" for n in range(6))
    teaser = "<article><h3>More</h3><p>A teaser.</p></article>"
    links = "<ul>" + "".join(f"<li><a href={n}>item {n}</a></li>" for n in range(5)) + "</ul>"
    got = html.main_text(f"<body><div>{long}</div>{links}{teaser}").split("\n\n")
    assert len(got) == 6 and all(line.startswith("long text") for line in got)
    got = html.main_text(f"<body><p>a line outside</p><article>{long}</article><p>another one</p>").split("\n\n")
    assert len(got) == 6 and "outside" not in "".join(got)
    got = html.main_text(f"<body><article><h1>T</h1><p>x</p><p>y</p>{long}</article>{'<p>outside</p>' * 4}<article>A teaser.</article>").split("\n\n")
    assert got[:3] == ["T", "x", "y"] and len(got) == 9 and all(line.startswith("long text") for line in got[3:])


@pytest.mark.parametrize("body", [
    "<body class='has-sidebar'><div>{}</div>", "<body><div class='content-with-sidebar'>{}</div>", "<body><article class='post ad-free'>{}</article>",
    "<body id=social-page><div class='social-enabled'>{}</div>", "<html class='no-js cookie'><body><main class='share'>{}</main>", "<body><div class='social box'><div>{}</div></div>"])
def test_names_of_wrappers_do_not_empty_a_page(body):
    long = "".join(f"<p>{'long text of the page ' * 9}{n}</p>" for n in range(3))
    aside = "<div class='comments'><p>" + "nice " * 30 + "</p></div><div class='site-footer'>imprint</div><p class=ad>buy</p>"
    got = html.main_text(body.format(long + aside)).split("\n\n")
    assert len(got) == 3 and all(line.startswith("long text") for line in got)


def test_long_comments_stay_out():
    page = f"<body><div><p>{'the text ' * 30}</p></div><section id=comments><p>{'a comment ' * 200}</p></section>"
    assert html.main_text(page) == " ".join(["the text"] * 30)


# ---- language, toxicity

def test_languages_are_known_on_held_out_rows(spark, docs, odd):
    held = queries.fold(2, 4)
    model = langid.train(docs, ~held)
    got = langid.predict(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.95 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    odd_rows = {r.doc_id: r for r in langid.predict(odd, model, F.lit(False)).collect()}
    assert all(odd_rows[i].lang_pred == "und" and odd_rows[i].rejected for i in (5, 6, 7, 12))
    assert langid.keep_known(odd, model).columns == odd.columns and langid.predict(none(odd), model, F.lit(False)).count() == 0
    blank = langid.train(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, blank, F.lit(False)).collect()} == {"und"}


def test_string_kernel_by_enumeration():
    from itertools import combinations

    def weights(word):
        out = Counter()
        for at in combinations(range(len(word)), toxicity.ORDER):
            out["".join(word[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["\x02idiot\x03", "\x02id.iot\x03", "\x02banana\x03", "\x02ab\x03", "\x02stupid\x03"]
    got = toxicity.kernel(words, words)
    for a, x in zip(words, got):
        for b, k in zip(words, x):
            p, q = weights(a), weights(b)
            norm = (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5
            assert k == pytest.approx(sum(v * q[u] for u, v in p.items()) / norm, abs=1e-5)
    marks = toxicity.Landmarks(words)
    assert np.allclose(marks.sums(words, np.arange(5.0)), got @ np.arange(5.0), atol=1e-4)


def test_insults_with_gaps_are_found(spark):
    rng = np.random.default_rng(3)
    syllables = ["ka", "lo", "mi", "ren", "tus", "vel", "dor", "an", "pe", "shi"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for n in range(600):
        own = [word() for _ in range(30)]
        if n % 3 == 0:
            for _ in range(3):
                own.insert(int(rng.integers(30)), str(rng.choice(["wretched", "blockhead", "numbskull"])))
        rows.append((n, " ".join(own), int(n % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"), ~queries.fold(0, 5))
    got = toxicity.predict(d, model, queries.fold(0, 5)).join(d, "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.predicted == test.toxic).mean() > 0.97
    odd = spark.createDataFrame([(1, "ka lo block-head num.bskull wret*ched mi"), (2, None), (3, ""), (4, "ka lo mi"), (None, "x" * 5000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.predict(odd, model, F.lit(False)).collect()}
    assert scores[1] > 0.5 > scores[4] and scores[2] == scores[3] < 0.5 and len(scores) == 5
    alone = toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic").where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.predict(odd, alone, F.lit(False)).collect()} == {0.0}


def test_kernel_loses_no_character():
    letters = [chr(c) for c in (*range(0x61, 0x7b), *range(0x3b1, 0x3ca), *range(0x430, 0x450))]
    words = ["\x02" + "".join(letters[n:n + 6]) + "\x03" for n in range(len(letters) - 6)]
    marks = toxicity.Landmarks(words)
    got, want = marks.kernels(words + ["\x02abc\x03"]), toxicity.raw_kernel(toxicity._codes(words), toxicity._codes(words))
    size = toxicity.norms(toxicity._codes(words))
    assert np.allclose(got[:-1], want / size[:, None] / size, atol=1e-4) and np.allclose(np.diag(got), 1, atol=1e-4)
    assert np.allclose(marks.sums(words, np.arange(len(words)) / 9), got[:-1] @ (np.arange(len(words)) / 9), atol=1e-3)


def test_one_quoted_insult_does_not_strike_it(spark):
    rng = np.random.default_rng(5)
    syllables = ["ka", "lo", "mi", "ren", "tus", "vel", "dor", "an", "pe", "shi"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for n in range(600):
        own = [word() for _ in range(30)]
        if n % 3 == 0 or n in (1, 2, 4):  # the last three are clean texts that quote one each
            own[int(rng.integers(30))] = ["wretched", "blockhead", "numbskull"][n % 3 if n in (1, 2) else 0 if n == 4 else n // 3 % 3]
        rows.append((n, " ".join(own), int(n % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"), F.lit(True))
    got = toxicity.predict(d, model, F.lit(False)).join(d, "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.97 and got[got.toxic == 0].predicted.mean() < 0.05


# ---- fingerprints

def _anchors(data):
    import xxhash

    k, s = syncmers.K, syncmers.S
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(data[i:i + s], seed=42)) for i in range(max(0, len(data) - s + 1))]
    found = {xxhash.xxh64_intdigest(data[i:i + k], seed=42) >> 32 for i in range(len(data) - k + 1) if min(h[i:i + k - s + 1]) in (h[i], h[i + k - s])}
    return found or {xxhash.xxh64_intdigest(data, seed=42) >> 32}


def test_syncmers_by_brute_force(spark, odd):
    got = {r.doc_id: r for r in syncmers.fingerprints(odd).collect()}
    order = sorted(((i, t or "") for i, t in ODD if i is not None), reverse=True) + [(None, LINE)]
    sketch = lambda t: sorted(_anchors(t.encode()))[:64]

    def likeness(a, b):
        union = set(sorted(set(a) | set(b))[:64])
        return len(union & set(a) & set(b)) / len(union)

    for n, (doc_id, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:08x}" for x in sketch(text)) and r.edited_fingerprint == "".join(f"{x:08x}" for x in sketch(edited))
        assert r.near_edited == likeness(sketch(text), sketch(edited)) and r.near_next == likeness(sketch(text), sketch(after))
    assert got[0].fingerprint == got[1].fingerprint
    assert syncmers.fingerprints(none(odd)).count() == 0
    one = syncmers.fingerprints(odd.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# ---- joins

def _components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def _jaccard_components(texts, num, den, width):
    sets = {i: _shingles(t, width) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    return sets, _components(links, texts)


@pytest.mark.parametrize("num,width", [(85, 4), (80, 5)])
def test_jaccard_components_by_brute_force(docs, texts, num, width):
    sets, want = _jaccard_components(texts, num, 100, width)
    got = {r.doc_id: r for r in jaccard.link(docs, num, 100, width).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(got[i].n_shingles == len(sets[i]) for i in want)


def test_near_copies_that_only_their_origin_links(spark, odd):
    rng = np.random.default_rng(1)
    base = [f"w{n}" for n in rng.integers(0, 5000, 160)]
    rows = {}
    for n in range(60):
        own = list(base)
        for at in rng.choice(150, 0 if n == 30 else rng.integers(1, 5), replace=False):
            own[at] = f"x{n}_{at}"
        rows[n] = " ".join(own)
    sets, want = _jaccard_components(rows, 85, 100, 4)
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 1
    own = {r.doc_id: r for r in jaccard.link(odd).collect()}
    assert own[1].component_id == 0 and own[5].n_shingles == own[6].n_shingles == own[7].n_shingles == 0 and own[8].n_shingles == 1 and own[6].component_id == 6
    assert jaccard.link(none(odd)).count() == 0
    kept = jaccard.keep_first(odd, 80, 100, 5)
    assert kept.columns == odd.columns and 1 not in {r.doc_id for r in kept.collect()}


def test_hot_signatures_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    elements = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(3)]
    sets = [np.concatenate([elements[n % 3][n % 7:], rng.integers(0, 1 << 63, 2).astype(np.uint64)]) for n in range(90)]
    rows = [(5, n, n, len(s), bytearray(jaccard.parity(s).tobytes())) for n, s in enumerate(sets)]
    monkeypatch.setattr(jaccard, "_BLOCK", 8)
    dealt = jaccard._block_pairs(spark.createDataFrame(rows, "sig long, key long, component long, n long, bits binary"), spark.createDataFrame([(5, 90)], "sig long, sets long"))
    groups = dealt.groupBy("sig", "low", "high").count().collect()
    assert len(groups) == 12 * 13 // 2 and max(r["count"] for r in groups) < 45
    found = dealt.repartition(5, "sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(jaccard._crossing(85, 100), "a long, b long").distinct().collect()
    want = {(i, j) for j in range(90) for i in range(j) if not jaccard.far(jaccard.parity(sets[i]), jaccard.parity(sets[j]), len(sets[i]), len(sets[j]), 85, 100)
            and 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j]))}
    assert {(r.a, r.b) for r in found} == want and len(want) > 1000


def test_jaccard_links_of_every_row_by_brute_force(spark, odd, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{n}" for n in rng.integers(0, 5000, 160)]
    rows = [(n, t) for n, t in ODD if n is not None]
    for n in range(100, 220):
        own = base[:int(rng.integers(130, 161))]
        for at in rng.choice(len(own), rng.integers(0, 5), replace=False):
            own[at] = f"x{n % 40}_{at}"
        rows.append((n, " ".join(own)))
    rows += [(300 + n, t) for n, t in rows[-5:]]  # equal texts
    sets = {i: _shingles(t, 4) for i, t in rows}
    want = {i: sum(1 for j in sets if i != j and a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j])) for i, a in sets.items()}
    d = spark.createDataFrame([*rows, (None, rows[-1][1]), (None, rows[-1][1])], "doc_id long, text string").repartition(3)
    for i, a in sets.items():  # the two rows without an id link too
        want[i] += 2 * bool(a and 100 * len(a & sets[rows[-1][0]]) >= 85 * len(a | sets[rows[-1][0]]))
    monkeypatch.setattr(jaccard, "_TILE", 16)  # several blocks
    got = [(r.doc_id, r.n_links) for r in jaccard.link(d).collect()]
    assert {i: n for i, n in got if i is not None} == want and max(want.values()) > 30
    assert [n for i, n in got if i is None] == [want[rows[-1][0]]] * 2 and len(got) == len(rows) + 2


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in (1, 3, 7, 20, 90, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop, add = rng.integers(0, size // 12 + 1, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            if len(b) and jaccard.similar(a, b, 85, 100):
                assert len(np.intersect1d(jaccard.signatures(a, 85, 100), jaccard.signatures(b, 85, 100)))
                assert not jaccard.far(jaccard.parity(a), jaccard.parity(b), len(a), len(b), 85, 100)


def test_similar_sets_have_a_signature_left_when_each_gives_up_some():
    rng, given = np.random.default_rng(6), 0
    for num in (85, 80):
        for size in [*range(1, 40), 90, 400]:
            for _ in range(10):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                drop, add = rng.integers(0, size * (100 - num) // 100 + 1, 2)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
                if not len(b) or not jaccard.similar(a, b, num, 100):
                    continue
                both = np.intersect1d(jaccard.signatures(a, num, 100), jaccard.signatures(b, num, 100)) & np.uint64(1)
                bands = [jaccard.band_of(len(x), num, 100) for x in (a, b)]
                for instance in range(max(0, max(bands) - 1), min(bands) + 1):
                    most = max(jaccard.spared(x, num, 100)[instance & 1] for x in (a, b))
                    given += most
                    assert (both == instance & 1).sum() > most
    assert given


def test_sets_that_share_a_passage_are_no_candidates(spark):
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 200).astype(np.uint64)])) for _ in range(12)]
    sets.append(np.unique(np.concatenate([sets[0][4:], rng.integers(0, 1 << 63, 3).astype(np.uint64)])))  # similar to the first
    rows = [(int(sig), n) for n, x in enumerate(sets) for sig in jaccard.signatures(x, 85, 100).view(np.int64)]
    count = Counter(sig for sig, _ in rows)
    shared = [(sig, n, count[sig] - 1) for sig, n in rows if count[sig] > 1]
    sized = spark.createDataFrame([(n, len(x), *jaccard.spared(x, 85, 100)) for n, x in enumerate(sets)], "key long, n long, even long, odd long")
    kept = jaccard._kept(spark.createDataFrame(shared, "sig long, key long, others long"), sized).collect()
    assert {n for _, n, _ in shared} > {0, 12} and {r.key for r in kept} == {0, 12}


def test_signatures_are_gathered_by_part(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_GATHERED", 3000)
    texts = [" ".join(f"w{n * (m + 3) % 211}" for n in range(200)) for m in range(40)]
    texts += [None, "", texts[0]]
    sets = {jaccard.set_key(x): x for x in (jaccard.shingle_set(t, 4) for t in texts) if len(x)}
    want = sorted((int(sig), key) for key, x in sets.items() for sig in jaccard.signatures(x, 85, 100).view(np.int64))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = rows.mapInArrow(jaccard._signed_rows(4, 85, 100, 5), "part int, sig array<long>, key array<long>").collect()
    assert sorted(x for r in rows for x in zip(r.sig, r.key)) == want and 5 < len(rows) < 100
    assert all((sig % (1 << 64) >> 1) % 5 == r.part for r in rows for sig in r.sig)


def test_pairs_under_signatures_of_a_few_sets(spark):
    rows = [(1, 5, 5), (1, 7, 5), (1, 9, 9), (2, 9, 9), (2, 5, 5), (3, 4, 4)]
    found = jaccard._pairs_of_few(spark.createDataFrame(rows, "sig long, key long, component long")).collect()
    assert sorted((r.a, r.b) for r in found) == [(5, 9), (5, 9), (7, 9)]


def test_edges_of_words_are_cut_by_short_sets():
    odd = ["word", "(word)", "\u00abword\u00bb", "-a", "w\u00e9", "\u2026word!", "123word", "a" * 30 + ".", "...", "\u4e00word", "word\u4e00", "\U0001f600ab"]
    for token in odd:
        word = token.strip(toxicity._EDGE)
        assert [w[1:] for w in toxicity._plain(token)[:1]] in ([], [word[:16]], [word + toxicity._END])
    assert toxicity._ASCII_EDGE.isascii() and set(toxicity._ASCII_EDGE) == {c for c in toxicity._EDGE if c.isascii()}
    assert toxicity.words_of("a b x yz q r") == "a b x yz q r abx".split() and toxicity.words_of("a bc d e") == "a bc d e".split()


def test_packing_may_forget_its_pieces(spark, docs, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "own.json")  # an encoder that no other test has
    shutil.copy(tokens.tokenizer_path(queries.WORD_BPE), path)

    def held(batches):
        for got in batches:
            own = tokens._SHARED.get(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(own.new) + len(own.runs) if own else 0] * got.num_rows)], names=["n"])

    plain, forgot = (sorted(map(tuple, packing.pack(docs, path, 2, keep=keep).collect())) for keep in (True, False))
    assert plain == forgot
    other = str(tmp_path / "other.json")
    shutil.copy(path, other)
    path = other
    packing.pack(docs, path, 2, keep=False).collect()
    assert spark.range(0, 64, 1, 16).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{n: 0 for n in range(61)}, 100: 100, 101: 100}


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = []
    for n in range(400):
        v = base[n % 40] + rng.normal(size=16) * 0.05
        rows.append((n, [float(x) for x in v], n % 3))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, None, 0), (403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0), (405, rows[0][1], None), (406, [None] * 16, 1),
             (407, [1e-200] * 16, 1), (408, [1e200] * 16, 1), (409, [1.0] * 8, 1), (410, [float("inf")] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, tile=50).collect()}
    fit = [(i, np.array(v) / np.abs(v).max(), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for n, (i, v, x) in enumerate(fit):
        for j, w, y in fit[:n]:
            if x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((i, j))
    want, count = _components(links, [r[0] for r in rows]), Counter(n for p in links for n in p)
    assert {i: r.component_id for i, r in got.items()} == want and all(got[i].n_links == count[i] and got[i].kept == (want[i] == i) for i in want)
    assert embeddings.near_duplicates(none(d)).count() == 0


# ---- repeats

def test_suffix_order():
    rng = np.random.default_rng(0)
    for letters, n in ((2, 2000), (4, 3000), (1, 300)):
        text = np.concatenate([rng.integers(97, 97 + letters, n), np.zeros(60, int)]).astype(np.uint8)
        starts = np.arange(n - 50)
        order = suffixes.suffix_order(text, starts, 50, bucket=300)
        windows = [text[i:i + 50].tobytes() for i in starts[order]]
        assert windows == sorted(windows)
        assert suffixes.same_before(text, starts[order], 50).tolist() == [False] + [a == b for a, b in zip(windows[1:], windows[:-1])]


def _repeats(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        windows = [data[i:i + 50] for i in range(len(data) - 49)]
        gone = bytearray(len(data))
        for i, w in enumerate(windows):
            if w in seen:
                gone[i:i + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def test_repeats_by_brute_force(docs, texts, odd):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(docs).collect()}
    assert got == _repeats(texts.items())
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(odd).collect()}
    assert got.pop(None)[1] == 0 and got == _repeats([r for r in ODD if r[0] is not None])
    assert substrings.report(none(odd)).count() == 0
    left = {r.doc_id: r.text for r in substrings.removed(odd).collect()}
    assert 1 not in left and left[6] is None and LINE not in left[3] and left[0] == ODD[0][1] and 5 in left
    assert substrings.removed(odd).columns == odd.columns


def test_windows_of_hot_anchors_are_dealt_out(spark, odd, monkeypatch):
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    rule, ends = "=" * 10 + " end of the common part " + "=" * 12, [letters(60) for _ in range(7)]
    rows = [(n, letters(60) + rule + ends[n % 7] + rule + letters(int(rng.integers(60)))) for n in range(70)]
    rows += [(100, rows[3][1]), (101, rule * 3), (102, rule * 3 + "x")]
    d = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    largest = lambda: substrings.fragments_of(d, 50).where("fragment IS NOT NULL").groupBy("anchor").count().agg(F.max("count")).first()[0]
    before = largest()
    monkeypatch.setattr(substrings, "_HOT", 8)
    assert before > 60 and largest() <= 20
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(d.withColumnRenamed("doc", "doc_id")).collect()}
    assert got == _repeats(rows)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.report(odd).collect()}
    assert got.pop(None)[1] == 0 and got == _repeats([r for r in ODD if r[0] is not None])


# ---- mixing

def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "en", "x", 100), ("a", "en", "y", 10), ("a", "fr", "z", 50), ("b", "en", "u", 1000)]
    tree = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long")
    one = {level: F.lit(1) for level in mixing.LEVELS}
    got = {r.source: r.budget for r in mixing.budgets(tree, one, 300, 1).collect()}
    # a and b 150 each; fr can use 50 of its 75, so en has 100; y has 10, so x takes 90
    assert got == {"x": 90, "y": 10, "z": 50, "u": 150}
    got = {r.source: r.budget for r in mixing.budgets(tree, one, 1000, 1).collect()}
    assert got == {"x": 100, "y": 10, "z": 50, "u": 840}


def test_mixing_of_odd_rows(odd):
    target = queries.mix_target()
    all_of_it = mixing.mix(odd, **target, share=(2, 1), epochs=2).collect()
    assert Counter(r.doc_id for r in all_of_it) == {i: 2 for i, _ in ODD}
    assert mixing.mix(none(odd), **target, share=(1, 2)).count() == 0
    some = mixing.mixed_documents(odd, **target, share=(1, 2))
    assert some.columns == odd.columns and 0 < some.count() < len(ODD)
    nulls = odd.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    assert mixing.mix(nulls, **target, share=(1, 1), epochs=1).count() == len(ODD)
