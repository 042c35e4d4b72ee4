"""The pipeline's stages, each against plain Python on the rows its predecessor wrote, odd rows among them."""

import glob
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from anchorframe.llm import langid, queries, tokens
from anchorframe.session import shared_folder
from conftest import SF_DIR
from test_operators import ODD, _jaccard_components


def _without_repeats(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = text.encode()
        windows = [data[i:i + 50] for i in range(len(data) - 49)]
        gone = bytearray(len(data))
        for i, w in enumerate(windows):
            if w in seen:
                gone[i:i + 50] = b"\1" * 50
        seen.update(windows)
        left = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore") if any(gone) else text
        if left.strip() or not any(gone):
            out.append((doc_id, left))
    return out


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, "en", "src1", 0) for i, t in ODD if i is not None], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    known = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline/*"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    folder, = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/pipeline/*")) - known
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = [spark.read.parquet(f"{folder}/{n}_{name}") for n, (name, _) in enumerate(corpus_pipeline.STAGES)]
    assert all(s.columns == docs.columns for s in stage[:4])
    before = {r.doc_id: r for r in docs.collect()}
    rows = [{r.doc_id: r for r in s.collect()} for s in stage[:4]]
    assert all(len(r) == s.count() for r, s in zip(rows, stage))  # no row twice

    predicted = langid.predict(docs, langid.train(docs, F.lit(True)), F.lit(False)).collect()
    assert rows[0] == {r.doc_id: before[r.doc_id] for r in predicted if not r.rejected} and len(rows[0]) > 150

    _, component = _jaccard_components({i: r.text for i, r in rows[0].items()}, 80, 100, 5)
    assert rows[1] == {i: r for i, r in rows[0].items() if component[i] == i} and len(rows[1]) < len(rows[0])

    left = dict(_without_repeats([(i, r.text) for i, r in rows[1].items()]))
    assert {i: r.text for i, r in rows[2].items()} == left
    assert all(r.n_chars == len(r.text) and r.lang == before[i].lang and r.source == before[i].source for i, r in rows[2].items())

    con = duckdb.connect()
    con.execute(f"create view kept as select * from '{folder}/2_suffix_dedup/*.parquet'")
    want = {r[0] for r in con.execute(queries.mix_sql("kept", (4, 5), 1)).fetchall()}
    assert rows[3] == {i: rows[2][i] for i in want} and 0 < len(want) < len(rows[2])

    encoder = tokens.PieceEncoder(tokens.tokenizer_path(queries.WORD_BPE))
    assert set(packed.doc_id) == want
    for doc_id, pieces in packed.groupby("doc_id"):
        ids = np.frombuffer(next(iter(encoder.encode([rows[3][doc_id].text]))) + queries.WORD_END.to_bytes(4, "little"), "<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
