"""Registered queries of the pipeline's operators, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorframe.llm import chat, embeddings, html, idcoder, jaccard, langid, manifest, mixing, packing, spelling, substrings, syncmers, toxicity
from anchorframe.llm.tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE, WORD_END = "word_bpe_49k.json", 2
BYTE_BPE, BYTE_END = "byte_bpe_50k.json", 0


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(remainder: int, of: int) -> Column:
    """Whether crc32 of the document id as text leaves the remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in full windows of 512 to 4096 ids."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(WORD_BPE), WORD_END)


@query
def op4_id_coder(spark: SparkSession, folder: str) -> DataFrame:
    """Places and checksums of all documents' ids, read back from coded blocks."""
    return idcoder.round_trip(table(spark, folder, "documents"), tokenizer_path(BYTE_BPE), BYTE_END, 50257)


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs, ~fold(2, 4)), fold(2, 4))


@query
def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents whose 4-word shingle sets have similarity 0.85 or more."""
    return jaccard.link(table(spark, folder, "documents"))


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, folder, "pages"))


def mix_target() -> dict:
    """Tree, weights and token counts. Of the synthetic sources src0, src1, ... the number modulo 4 stands for a domain."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return {
        "path": {"domain": F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other")), "language": F.col("lang"), "source": F.col("source")},
        "weights": {"domain": F.expr("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"),
                    "language": F.expr("CASE language WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END"), "source": F.lit(1)},
        "tokens": F.expr("coalesce(octet_length(text), 0) div 4 + 1"),  # the usual estimate, and an end
    }


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents taken from three fifths of all tokens by weights, in up to two epochs."""
    return mixing.mix(table(spark, folder, "documents"), **mix_target(), share=(3, 5))


def _fill_sql(name: str, nodes: str, parents: str, node: str) -> str:
    part = f"PARTITION BY {parents}" if parents else ""
    keys = f"{parents}, {node}" if parents else node
    return f"""{name}_a AS (SELECT *, capacity / weight <= (budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {node}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({part} ORDER BY capacity / weight, {node}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sated FROM ({nodes})),
{name} AS (SELECT {keys}, CAST(CASE WHEN sated THEN capacity ELSE floor(weight * (budget - coalesce(sum(CASE WHEN sated THEN capacity END)
    OVER ({part}), 0)) / sum(CASE WHEN NOT sated THEN weight END) OVER ({part})) END AS BIGINT) AS budget FROM {name}_a)"""


def _mix_nodes(level: str, parents: str, weight: str, budget: str) -> str:
    keys = f"{parents}, {level}" if parents else level
    join = f" JOIN {budget} USING ({parents})" if parents else ""
    given = "budget" if parents else f"{budget} AS budget"
    return (f"SELECT n.*, {given} FROM (SELECT {keys}, CAST(sum(tokens) * 2 AS BIGINT) AS capacity, {weight} AS weight FROM leaves "
            f"GROUP BY {keys}) n{join}")


def mix_sql(docs: str, share: tuple[int, int], epochs: int, seed: int = 7) -> str:
    """DuckDB: the rows of ``docs`` taken in each epoch."""
    domain = "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"
    language = "CASE language WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END"
    budget = f"(SELECT CAST(sum(tokens) AS BIGINT) * {share[0]} // {share[1]} FROM leaves)"
    levels = ",\n".join(_fill_sql(name, _mix_nodes(level, parents, weight, given).replace("* 2 AS", f"* {epochs} AS"), parents, level) for name, level, parents, weight, given in (
        ("b1", "domain", "", domain, budget), ("b2", "language", "domain", language, "b1"), ("b3", "source", "domain, language", "1", "b2")))
    place = f"md5(concat_ws('|', '{seed}', CAST(epoch AS VARCHAR), CAST(doc_id AS VARCHAR)))"
    return f"""WITH plain AS (SELECT doc_id, coalesce('d' || CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR), 'other') AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source, coalesce(strlen(text), 0) // 4 + 1 AS tokens FROM {docs}),
leaves AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM plain GROUP BY ALL),
{levels},
takes AS (SELECT domain, language, source, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN b3 USING (domain, language, source)),
offered AS (SELECT p.*, whole, rest, unnest(range(whole + 1)) AS epoch FROM plain p JOIN takes USING (domain, language, source)),
ordered AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source, epoch ORDER BY {place}) AS upto FROM offered)
SELECT doc_id, domain, language, source, tokens, epoch FROM ordered WHERE epoch < whole OR upto <= rest"""


ORACLES["op7_mixing"] = mix_sql("documents", (3, 5), 2)


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What 50-byte strings of earlier documents leave of each document."""
    return substrings.report(table(spark, folder, "documents"))


@query
def op2_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.fingerprints(table(spark, folder, "documents"))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, folder, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, folder, "labels"), ~fold(0, 5)), fold(0, 5))


def _crc_sql(codes: str) -> str:
    """DuckDB: unsigned crc32 of a list of bytes."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def _codes_sql(text: str) -> str:
    """DuckDB: the UTF-8 bytes of a text of code points below 2048."""
    of_letter = "CASE WHEN unicode(l) < 128 THEN [unicode(l)::BIGINT] ELSE [192 + (unicode(l) >> 6), 128 + (unicode(l) & 63)]::BIGINT[] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda l: {of_letter}))"


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, proofs and folded roots of all documents; of every second hash the text's line feeds are missing when it is checked."""
    without = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    return manifest.manifest(table(spark, folder, "documents"), tampered=(fold(0, 2), without))


def merkle_sql(docs: str, levels: int = 14, source_levels: int = 10) -> str:
    """DuckDB: the rows of ``op11_merkle_manifest`` for at most 3 ** levels rows of a source and 3 ** source_levels sources."""
    def field(value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, first: str, keys: str, high: int) -> list[str]:
        # Of each level all nodes: place, digest, the run's digests in order and whether it is the only node.
        out = []
        for k in range(high):
            rows = first if k == 0 else f"SELECT {keys}, idx // 3 AS idx, CASE WHEN alone THEN node ELSE sha256(array_to_string(run, '')) END AS node FROM {name}{k - 1} WHERE idx % 3 = 0"
            out.append(f"""{name}{k} AS (SELECT *, list(node) OVER (PARTITION BY {keys}, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run,
    count(*) OVER (PARTITION BY {keys}) = 1 AS alone FROM ({rows}))""")
        return out

    def climb(name: str, first: str, keys: str, high: int, place: str) -> list[str]:
        # Of each leaf the digests beside its way up, and what its changed digest comes to.
        out = []
        for k in range(high):
            last = first if k == 0 else f"{name}_w{k - 1}"
            on = " AND ".join([*(f"t.{c} = w.{c}" for c in keys.split(", ")), f"t.idx = w.{place} // {3 ** k}"])
            out.append(f"""{name}_w{k} AS (SELECT w.* EXCLUDE (proof, folded), CASE WHEN t.alone THEN proof ELSE proof || array_to_string(list_filter(run, lambda x, i: i <> idx % 3 + 1), '') END AS proof,
    CASE WHEN t.alone THEN folded ELSE sha256(array_to_string(run[:idx % 3], '') || folded || array_to_string(run[idx % 3 + 2:], '')) END AS folded FROM {last} w JOIN {name}{k} t ON {on})""")
        return out

    crc = _crc_sql(_codes_sql("CAST(doc_id AS VARCHAR)"))
    changed = "replace(text, chr(10), '')"
    parts = [f"""made AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf(changed)} ELSE {leaf('text')} END AS folded FROM {docs})""",
             "named AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM made))",
             """leaves AS (SELECT doc_id, grp, leaf, folded, '' AS proof, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, 0 AS top
    FROM made m JOIN named n ON m.source IS NOT DISTINCT FROM n.source)""",
             *tree("t", "SELECT grp, place AS idx, leaf AS node FROM leaves", "grp", levels), *climb("t", "leaves", "grp", levels, "place"),
             *tree("s", f"SELECT 0 AS top, grp AS idx, node FROM t{levels - 1}", "top", source_levels), *climb("s", f"t_w{levels - 1}", "top", source_levels, "grp")]
    last = source_levels - 1
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts) + f"""
SELECT doc_id, leaf, t.node AS subroot, s.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s.node AS verified
FROM s_w{last} w JOIN t{levels - 1} t ON t.grp = w.grp JOIN s{last} s ON s.top = w.top"""


ORACLES["op11_merkle_manifest"] = merkle_sql("documents")


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, folder, "documents"))


def spelling_sql(docs: str) -> str:
    """DuckDB: the rows of ``op12_spelling_variants``; near words meet by what is left of them without one code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    crc = _crc_sql(_codes_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\u00C0-\u00FF]+')) AS run FROM {docs}),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, times, {crc} AS h FROM each),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT a.word, b.word, b.n FROM words a JOIN cuts b ON b.rest = a.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 5 * w.n THEN top.near END AS form, CASE WHEN -top.less >= 5 * w.n THEN -top.less END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
ways AS (SELECT word, word AS at FROM formed UNION SELECT w.word, f.form FROM ways w JOIN formed f ON f.word = w.at AND f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ways w ON w.word = f.word JOIN formed e ON e.word = w.at AND e.form IS NULL"""


ORACLES["op12_spelling_variants"] = spelling_sql("documents")


@query
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, and of one that speaks in control strings, read back from their formatted texts."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.digests(rows.unionByName(more))


def chat_sql(conversations: str) -> str:
    """DuckDB: the rows of ``op13_chat_format``."""
    marks = chat.Marks()

    def escaped(text: str) -> str:
        out = f"replace(coalesce({text}, ''), chr(92), chr(92) || chr(92))"
        for mark in marks.every:
            out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
        return out

    block, more = len(marks.opening + marks.says + marks.closing), len(marks.more)
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length({escaped('text')}) + CASE WHEN before = role THEN {more} ELSE {block} + length({escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id"""


ORACLES["op13_chat_format"] = chat_sql("conversations")
