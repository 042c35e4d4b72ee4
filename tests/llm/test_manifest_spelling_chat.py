"""Manifest, spelling variants and chat formatting against plain Python on small fixtures with odd rows, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorframe.llm import chat, manifest, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, idx long, word string, n long"


def frame(spark, rows, parts=3):
    """Documents (doc_id, text, lang, source, n_chars) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "g", 7, "w", 9) for r in rows], DOCS).repartition(parts)


# ---- manifest

def plain_manifest(rows, tampered):
    """The contract in a few lines: rows (doc_id, text, lang, source, n_chars)."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            first = i - i % 3
            out.append((level[first:i], level[i + 1:first + 3]))
            i //= 3
        return out

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in own]) for s, own in kept.items()}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(kept[s]):
            steps = way(trees[s], i) + way(top, n)
            node = leaf(r, r[1].replace("\n", "") if r[1] is not None and tampered(r[0]) else r[1])
            for left, right in steps:
                node = H(*left, node, *right)
            proof = H(*[x for left, right in steps for x in (*left, *right)])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def every_second(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def spark_manifest(df, step=6):
    got = manifest.manifest(df, step=step, tampered=(queries.fold(0, 2), {"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("step", [1, 2])
def test_manifest_equals_the_plain_trees(spark, step):  # small steps: several stored levels on few rows
    rnd = random.Random(step)
    rows = [(i, rnd.choice(["a\nb", "é\n", "", None, "same text"]), rnd.choice(["en", None]), rnd.choice(["hot", "hot", "hot", "b", "ü", None]), i % 5 or None) for i in range(90)]
    rows += [(500, "x\ny", "en", "lonely", 1), (None, "no id\n", "en", "hot", 1), (None, "no id\n", "en", "hot", 1), (3, "one id,\ntwo texts", "en", "hot", 2), rows[7], rows[7]]
    assert spark_manifest(frame(spark, rows), step) == plain_manifest(rows, every_second)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, f"t\n{i}", "en", "s", 1) for i in range(n)]
    assert spark_manifest(frame(spark, rows)) == plain_manifest(rows, every_second) if n else spark_manifest(frame(spark, rows)) == []


def test_manifest_of_a_long_text(spark):
    rows = [(i, "line\n" * 400_000 if i == 3 else "z", "en", "s", 1) for i in range(8)]
    assert spark_manifest(frame(spark, rows)) == plain_manifest(rows, every_second)


@given(st.integers(1, 60), st.data())
@settings(max_examples=40, deadline=None)
def test_paths_fold_to_the_top(n, data):
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    top = manifest.climb(nodes, True)[-1][0]
    i = data.draw(st.integers(0, n - 1))
    path = manifest.paths(nodes, True, b"")[i]
    assert manifest.fold(nodes[i], path) == top
    if n > 1:
        assert manifest.fold(b"\0" * 32, path) != top


# ---- spelling

def plain_variants(rows, least=6, times=5):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = [], {}
    for w in words:
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v)) if own else None
        form[w] = best if best and words[best] >= 5 * words[w] else None
        out.append((w, len(own)))
    rows = []
    for w, m in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], m, words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def words_of(seed, many=900):
    rnd = random.Random(seed)
    bases = ["separate", "definitely", "aaaaaa", "éclairés", "straße", "überall", "necessary"] + ["".join(rnd.choice("abeinrst") for _ in range(7)) for _ in range(12)]
    said = []
    for base in bases:
        said += [base] * 60
        for _ in range(6):
            i, c = rnd.randrange(len(base)), rnd.choice("aeéßz")
            said += [rnd.choice([base[:i] + base[i + 1:], base[:i] + c + base[i:], base[:i] + c + base[i + 1:]])] * rnd.choice([5, 8, 12, 40])
    rnd.shuffle(said)
    return [(i, " ".join(x.upper() if k % 7 == 0 else x for k, x in enumerate(said[i::many // 20])) + ", 12×3 ÷", "en", "s", 0) for i in range(many // 20)]


@pytest.mark.parametrize("leaf,pairs,wide", [(1, 3, 8), (16, 1 << 18, 32), (10_000, 50, 7)])
def test_trie_finds_all_pairs_once(monkeypatch, leaf, pairs, wide):
    monkeypatch.setattr(spelling, "_LEAF", leaf)
    monkeypatch.setattr(spelling, "_PAIRS", pairs)
    monkeypatch.setattr(spelling, "_WIDE", wide)
    monkeypatch.setattr(spelling, "_CELLS", 200)
    words = sorted({w for _, text, *_ in words_of(2) for w in spelling.RUN.findall(text.lower())} | {"long" * 12, "long" * 12 + "x", "lomg" + "long" * 11})
    trie = spelling.Trie(words, [1] * len(words))
    got = [frozenset((words[i], trie.words[j])) for own, found in trie.near(words) for i, j in zip(own, found)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for n, a in enumerate(words) for b in words[:n] if spelling.one_edit(a, b)} and len(got) > 100


@pytest.mark.parametrize("shard,depth", [(50_000, 2), (40, 4), (3, 15)])
def test_variants_equal_all_pairs(spark, monkeypatch, shard, depth):
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: near(words, shard, depth))
    rows = [*words_of(1), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "separate seperate " * 9, "en", "s", 0), (3, "separate " * 5, "en", "s", 0), (950, "chainin " * 5 + "chaining " * 30 + "chainings " * 160, "en", "s", 0)]
    got = spelling.variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == plain_variants(rows) and any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_variants_of_an_empty_table_and_a_long_text(spark):
    assert spelling.variants(frame(spark, [(1, "x", "en", "s", 0)]).limit(0)).count() == 0
    rows = [(1, "separate seperates " * 90_000 + "z" * 200 + " " + ("y" * 90 + ".") * 6 + ("y" * 91 + ".") * 6, "en", "s", 0)]
    assert sorted((tuple(r) for r in spelling.variants(frame(spark, rows)).collect()), key=str) == plain_variants(rows)


def test_slices_never_cut_a_run(monkeypatch):
    text = "Separate, Überall " * 50 + "z" * 300 + " end"
    monkeypatch.setattr(spelling, "_SLICE", 16)
    parts = list(spelling.runs(text))
    assert len(parts) > 20 and sum(parts, []) == spelling.RUN.findall(text.encode().lower().decode())


@given(st.text("abé", min_size=0, max_size=6), st.text("abé", min_size=0, max_size=6))
@settings(max_examples=300, deadline=None)
def test_one_edit_is_an_edit_distance_of_one(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        d, old = [i + 1], d
        for j, y in enumerate(b):
            d.append(min(old[j + 1] + 1, d[j] + 1, old[j] + (x != y)))
    assert spelling.one_edit(a, b) == (d[-1] == 1)


# ---- chat

CONV = "conv_id long, turn long, role string, text string, turns string, formatted string"
MARKS = chat.Marks()


def plain_chat(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    esc = lambda t: chat._plain(t, MARKS)
    out = []
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        text, before = "", None
        for *_, r, t in turns:
            text = text[:-len(MARKS.closing)] + MARKS.more + esc(t) + MARKS.closing if r == before else text + MARKS.opening + esc(r) + MARKS.says + esc(t) + MARKS.closing
            before = r
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text)))
    return sorted(out, key=str)


def spark_chat(spark, rows):
    return sorted((tuple(r) for r in chat.digests(spark.createDataFrame([(*r, "a", "b") for r in rows], CONV).repartition(3)).collect()), key=str)


def test_chat_reads_back_every_turn(spark):
    rnd = random.Random(5)
    bits = [*MARKS.every, "<", "<s", "[", "[INST", "/INST]", "\\", "\\\\", "s>", "$1", "é😀", "\n", "", " ", "<</s>", "<[INST]s>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "<s>odd\\", None]), "".join(rnd.choices(bits, k=rnd.randrange(8))) if rnd.random() < 0.9 else None) for c in range(40) for t in range(rnd.randrange(1, 12))]
    rows += [(100, 1, "user", "same turn"), (100, 1, "assistant", "same turn"), (100, None, "user", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 100_000)]
    rows += [(101, t, "assistant", f"row {t} </s>") for t in range(300)] + [(102, 0, "user", "twice"), (102, 0, "user", "twice"), (103, 5, "assistant", None)]
    assert spark_chat(spark, rows) == plain_chat(rows)


def test_chat_spans_hold_the_escaped_texts_only(spark):
    rows = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "more")], "conv_id long, turn long, role string, text string")
    got = chat.formatted(rows).first()
    under = [got.formatted[s.start:s.start + s.length] for s in got.loss]
    assert under == ["<\\/s>[\\INST] ok [\\/INST]", "more"]
    assert got.formatted.count("</s>") == 2 and got.formatted.count("[/INST]") == 1


def test_chat_of_an_empty_table(spark):
    assert spark_chat(spark, [(1, 0, "user", "x")])[0][3] == 0
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@given(st.text(alphabet=st.sampled_from("<s>/[INST]\\SY a"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaped_texts_hold_no_mark_and_come_back(text):
    out = chat._plain(text, MARKS)
    assert not any(mark in out for mark in MARKS.every)
    assert re.sub(r"\\(\\?)", r"\1", out) == text


@pytest.mark.parametrize("marks", [dict(opening="aa"), dict(says="x\\y"), dict(more="<s>[")])
def test_marks_that_could_be_misread_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Marks(**marks)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants", "op13_chat_format"])
def test_queries_equal_their_sql(spark, duck, name):
    from conftest import SF_DIR

    df = queries.QUERIES[name](spark, SF_DIR)
    rel = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
