"""Rows that share an id, columns with clashing names, texts beyond the slice sizes, and toxicity on the given tables."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from anchorframe.llm import html, jaccard, queries, substrings, syncmers, toxicity
from conftest import SF_DIR

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _starts string, _c_copy string, _gone string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "s", "c", "g") for i, t in rows], DOCS).repartition(3)


def kept_bytes(rows, length=50):
    """Each row's bytes that no string of a smaller id covers."""
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for other, more in rows:
            if doc is not None and other is not None and other < doc:
                known = {more.encode()[i:i + length] for i in range(len((more or "").encode()) - length + 1)}
                for i in range(len(data) - length + 1):
                    if data[i:i + length] in known:
                        gone[i:i + length] = [True] * length
        out.append((doc, bytes(b for b, g in zip(data, gone) if not g)))
    return out


A = "A passage that stands in several rows and is well over fifty bytes long, word after word. " * 3
ROWS = [(1, A), (2, A), (2, "".join(hashlib.sha256(bytes([n])).hexdigest() for n in range(5))), (4, "short opening " + A[:140]),
        (4, " ".join(hashlib.md5(bytes([n])).hexdigest() for n in range(9))), (4, A + "and its own end, which nobody else has written down before"), (5, A), (5, A), (None, A), (6, None), (7, "")]


def test_texts_of_one_id_lose_only_their_own_repeats(spark):
    want = sorted((i, len(k), hashlib.sha256(k).hexdigest()) for i, k in kept_bytes(ROWS) if i is not None)
    got = substrings.report(frame(spark, ROWS)).where("doc_id IS NOT NULL").collect()
    assert sorted((r.doc_id, r.n_bytes - r.n_removed, r.kept_sha256) for r in got) == want


def test_removed_keeps_unique_texts_and_all_columns(spark):
    df = frame(spark, ROWS)
    got = substrings.removed(df)
    assert got.columns == df.columns
    want = sorted((i, k.decode()) for (i, k), (_, t) in zip(kept_bytes(ROWS), ROWS) if i is not None and t and k.strip())
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id IS NOT NULL AND text <> ''").collect()) == want


def test_shared_ids_with_small_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_SLICE", 64)
    monkeypatch.setattr(substrings, "_HOT", 2)
    test_texts_of_one_id_lose_only_their_own_repeats(spark)


def test_keep_first_judges_rows_of_one_id_by_their_text(spark):
    words = " ".join(f"w{n}" for n in range(60))
    rows = [(1, words), (2, words), (2, " ".join(f"other{n}" for n in range(40))), (3, words + " end"), (None, words), (5, "")]
    got = jaccard.keep_first(frame(spark, rows), 80, 100, 5)
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id IS NOT NULL").collect()) == sorted([rows[0], rows[2], rows[5]])
    assert got.columns == frame(spark, rows).columns


def test_long_texts_cross_the_slices_of_word_hashes(spark, monkeypatch):
    text = " ".join(f"word{n % 977}" for n in range(4000))
    whole = jaccard.shingle_set(text, 4)
    monkeypatch.setattr(jaccard, "_SLICE", 100)
    assert (jaccard.shingle_set(text, 4) == whole).all()


def recall(spark, folder):
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, folder).join(truth, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    return n.get((1, 1), 0) / max(1, n.get((1, 1), 0) + n.get((1, 0), 0)), n.get((0, 1), 0) / max(1, n.get((0, 1), 0) + n.get((0, 0), 0))


# Of the 64 clean held-out documents of the smaller table two are wrong, 45 toxic ones being all that is learned from.
@pytest.mark.parametrize("folder,least,most", [("/root/testdata/sf0.01", 0.6, 0.04), ("/root/testdata/sf0.1", 0.85, 0.02)])
def test_toxicity_finds_held_out_toxic_documents(spark, folder, least, most):
    if not os.path.isdir(folder):
        pytest.skip("table not there")
    caught, wrong = recall(spark, folder)
    assert caught >= least and wrong <= most


def test_a_word_with_different_marks_counts_once_in_a_text(spark):
    texts = [(i, "is. (is) is, IS fine words here", 0) for i in range(40)] + [(100 + i, "is. (is) is, zorgblat words", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n) for i, _, n in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model, F.lit(False)).collect()}
    assert min(s for i, s in got.items() if i >= 100) > 0.5 > max(s for i, s in got.items() if i < 100)


def test_fingerprints_of_ids_wider_than_a_long(spark):
    rows = [(-2 ** 63, "first text of some length, twice over"), (2 ** 63 - 1, "last text of some length, twice over"), (0, "middle"), (5, None), (None, "none")]
    got = {r.doc_id: r for r in syncmers.fingerprints(frame(spark, rows)).collect()}
    whole = rows[1][1]
    assert len(got) == 5 and got[2 ** 63 - 1].n_chars == len(whole)
    assert got[2 ** 63 - 1].edited_sha256 == hashlib.sha256((whole[:len(whole) - len(whole) // 2] + "").encode()).hexdigest()  # the next one, of id 5, is null
    assert got[5].n_chars == 0


@pytest.mark.parametrize("page", [170_000 * "<a ", 170_000 * "<a \"", 100_000 * "<a \"><b '>", 250_000 * "<!-", 60_000 * "<script>", 3_000 * '<div class="ad">' + "text " * 40])
def test_hostile_pages_are_read_in_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 8


def test_what_is_open_at_the_end_of_a_page_stays_hidden():
    text = "A paragraph that is long enough to surge, as it has well over eighty-six characters in one line of text."
    for end in ("<!-- hidden > too", "<script>var a > b", "<!-- hidden", "<script", "<![CDATA[ x > y"):
        assert html.main_text(f"<article><p>{text}</p></article>{end}") == text
    assert html.main_text(f"<article><p>{text} 3 < 4</p></article>") == text + " 3 < 4"


def test_more_wrappers_than_readings_of_the_page():
    text = "A paragraph that is long enough to surge, as it has well over eighty-six characters in one line of text."
    page = "<div class='ad'>" * 40 + f"<p>{text}</p>" + "</div>" * 40
    assert html.main_text(page) == text
