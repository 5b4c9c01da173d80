"""The registered queries of the operators in this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm import bytecnn, chunks, covering, decontam, fptree, grammar, langid, manifest, maxscore, partenum, pieces, revisits, templates
from gavelspark.llm.rows import held_out
from gavelspark.session import shared_folder
from gavelspark.sources.tables import read_table

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plan(name: str, sql: str | None = None):
    def add(query):
        PLANS[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


@plan("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# Appended to the ids of every document.
END_ID = 2


@plan("op2_grammar_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-blocks")
    with open(WORD_TOKENIZER, "rb") as file:
        grammar.write(read_table(spark, sf_dir, "documents"), file.read(), END_ID, path)
    return grammar.read(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@plan("op3_benchmark_suffixes", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
     i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
     iw AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS win
            FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
     sizes AS (SELECT DISTINCT n FROM iw),
     dw AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS win
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes)),
     hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
     places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
     names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS joined
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), unnamed=True)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", "n_words", decontam.hit_words(F.col("matches")).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
    )


@plan("op4_revisits", r"""
WITH r AS (
  SELECT page_id * 3 AS record_id, url, page_id AS tick, 200 AS status, '"' || md5(html) || '"' AS etag,
         map {'content-type': 'text/html; charset=utf-8', 'content-length': CAST(octet_length(encode(html)) AS VARCHAR), 'etag': '"' || md5(html) || '"',
              'date': CAST(page_id AS VARCHAR), 'cache-control': 'max-age=60'} AS h
  FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
  UNION ALL BY NAME
  SELECT page_id * 3 + 1 AS record_id, url, page_id + 86400 AS tick, 304 AS status,
         CASE page_id % 4 WHEN 1 THEN '"changed"' WHEN 2 THEN NULL ELSE '"' || md5(html) || '"' END AS etag,
         map_concat(CASE page_id % 4 WHEN 1 THEN map {'etag': '"changed"'} WHEN 2 THEN map {} ELSE map {'etag': 'W/"' || md5(html) || '"'} END,
                    map {'date': CAST(page_id + 86400 AS VARCHAR), 'cache-control': 'max-age=3600', 'content-length': '0', 'connection': 'close'}) AS h
  FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
  UNION ALL BY NAME
  SELECT page_id * 3 + 2 AS record_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/robots.txt' AS url, page_id AS tick,
         CASE WHEN page_id % 50 = 0 THEN 200 ELSE 304 END AS status, '"r' || (page_id // 5000) || '"' AS etag,
         map_concat(CASE WHEN page_id % 50 = 0 THEN map {'content-type': 'text/plain'} ELSE map {} END,
                    map {'etag': '"r' || (page_id // 5000) || '"', 'date': CAST(page_id AS VARCHAR)}) AS h
  FROM pages),
u AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.|:(80|443)$', '', 'g')
             || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS page,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                                                   lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM r),
c AS (SELECT * REPLACE (page || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url) FROM u),
f AS (SELECT *, max(CASE WHEN status = 200 THEN struct_pack(tick := tick, record_id := record_id) END) OVER
             (PARTITION BY url ORDER BY tick, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM c),
j AS (SELECT f.*, s.h AS stored, s.record_id AS other, CASE WHEN f.status = 200 THEN 'full' WHEN s.record_id IS NULL THEN 'missing'
             WHEN f.etag IS NULL OR s.etag IS NULL OR f.etag = s.etag THEN 'resolved' ELSE 'changed' END AS outcome
      FROM f LEFT JOIN c s ON f.status = 304 AND s.status = 200 AND s.url = f.url AND s.record_id = f.latest.record_id),
e AS (SELECT record_id, url, outcome, CASE outcome WHEN 'resolved' THEN other WHEN 'full' THEN record_id ELSE -1 END AS payload_of, h, stored,
             CASE WHEN outcome = 'resolved' THEN list_concat(
               list_filter(map_entries(stored), lambda x: NOT list_contains(list_filter(map_keys(h), lambda k: k NOT IN ('connection', 'content-length', 'content-type')), x.key)),
               list_filter(map_entries(h), lambda x: x.key NOT IN ('connection', 'content-length', 'content-type'))) ELSE map_entries(h) END AS entries FROM j)
SELECT record_id, url, outcome, payload_of, sha256(array_to_string(list_sort(list_transform(entries, lambda x: x.key || ': ' || x.value)), chr(10))) AS headers_sha256 FROM e""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.crawl_of(read_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])))
    payload_of = F.when(F.col("outcome") == "full", F.col("record_id")).otherwise(F.coalesce("refers_to", F.lit(-1))).alias("payload_of")
    return found.select("record_id", "url", "outcome", payload_of, F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"))


# A document of this score or more counts as good.
GOOD_SCORE = 0.7


@plan("op5_byte_network")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    network = bytecnn.learn(docs, labels.filter(~held_out(F.col("doc_id"))), "quality")
    scored = bytecnn.predict(docs, network)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted")
    )


@plan("op6_line_templates", r"""
WITH l AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS number
           FROM (SELECT doc_id, text, string_split(regexp_replace(text, '[^\s]*[0-9][^\s]*', '<*>', 'g'), chr(10)) AS ls FROM documents)),
     k AS (SELECT doc_id, number, line, string_split(line, ' ') AS t, len(string_split(line, ' ')) AS n,
                  array_to_string(string_split(line, ' ')[1:3], ' ') AS lead FROM l WHERE trim(line, ' ') <> ''),
     leaf AS (SELECT n, lead FROM k GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 20),
     c AS (SELECT k.* FROM k JOIN leaf USING (n, lead)),
     kind AS (SELECT n, lead, line, any_value(t) AS t, count(DISTINCT doc_id) AS w FROM c GROUP BY n, lead, line),
     tok AS (SELECT n, lead, line, w, unnest(t) AS token, unnest(range(n)) AS position FROM kind),
     con AS (SELECT n, lead, position, token FROM tok WHERE token <> '<*>' GROUP BY ALL HAVING sum(w) >= 20),
     tpl AS (SELECT tok.n, tok.lead, line, string_agg(coalesce(con.token, '<*>'), ' ' ORDER BY tok.position) AS template
             FROM tok LEFT JOIN con ON tok.n = con.n AND tok.lead = con.lead AND tok.position = con.position AND tok.token = con.token
             GROUP BY tok.n, tok.lead, line HAVING count(con.token) >= ceil(CAST(0.6 AS DOUBLE) * count(*))),
     d AS (SELECT doc_id, number, template FROM c JOIN tpl USING (n, lead, line)),
     rec AS (SELECT template, min(struct_pack(doc_id := doc_id, number := number)) AS spot FROM d GROUP BY template HAVING count(DISTINCT doc_id) >= 20),
     p AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS number FROM documents),
     again AS (SELECT line, min(struct_pack(doc_id := doc_id, number := number)) AS spot FROM p WHERE regexp_matches(line, '[^\x09-\x0D\x20]')
               GROUP BY line HAVING count(DISTINCT text) >= 3),
     gone AS (SELECT doc_id, number FROM d JOIN rec USING (template) WHERE struct_pack(doc_id := doc_id, number := number) <> spot
              UNION SELECT doc_id, number FROM p JOIN again USING (line) WHERE struct_pack(doc_id := doc_id, number := number) <> spot)
SELECT p.doc_id, count(*) AS n_lines, count(gone.number) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p.number) FILTER (WHERE gone.number IS NULL), '')) AS text_sha256
FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.number = gone.number GROUP BY p.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = templates.dedup(docs)
    return left.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


@plan("op7_maxscore", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def encoded_digests(docs: DataFrame, model: bytes, *more: str, reuse: bool = True) -> DataFrame:
    """Encoded and decoded texts, each as a digest, and ``more`` of the columns."""
    both = pieces.encode(docs, model, decoded=True, reuse=reuse)
    return both.select(
        "doc_id", *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@plan("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(read_table(spark, sf_dir, "documents"), pieces.read_model(PIECE_MODEL))


@plan("op9_partenum", r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, k, k + 4) END AS shingle
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, l.y FROM r JOIN l ON r.reached = l.x)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(read_table(spark, sf_dir, "documents"))


@plan("op10_gear_chunks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = chunks.dedup(read_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), chunks.removed_bytes(F.col("removed")).alias("removed_bytes"),
        F.octet_length("text").cast("long").alias("kept_bytes"), (F.size("removed") > 0).alias("repeats"), F.sha2("text", 256).alias("text_sha256"),
    )


# crc32 of the decimal id, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(CAST(doc_id AS VARCHAR))),
    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""


# Levels of the SQL's trees: so many of a source (16 million leaves), so many of the sources.
_SQL_LEVELS, _SQL_TOP_LEVELS = 6, 3


def _manifest_sql() -> str:
    """One level after the other; a tree of which one node is left stays as it is."""

    def levels(name: str, first: str, key: str, count: int) -> str:
        out = [f"{name}0 AS ({first})"]
        for k in range(count):
            out.append(f"""{name}_n{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS width, pos // 16 AS run FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT {key}, run AS pos, CASE WHEN any_value(width) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
                FROM {name}_n{k} GROUP BY {key}, run)""")
            out.append(f"""{name}_s{k} AS (SELECT n.{key}, n.pos,
                coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (WHERE m.pos < n.pos), '') AS lo, coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (WHERE m.pos > n.pos), '') AS hi,
                any_value(n.width) > 1 AS inner_node
                FROM {name}_n{k} n JOIN {name}_n{k} m ON m.{key} = n.{key} AND m.run = n.run GROUP BY n.{key}, n.pos)""")
        return ",\n".join(out)

    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    proof, joins = [], []
    for name, key, count in (("l", "tree", _SQL_LEVELS), ("t", "one", _SQL_TOP_LEVELS)):
        place = "d.pos" if name == "l" else "q.pos"
        for k in range(count):
            a = f"{name}s{k}"
            joins.append(f"JOIN {name}_s{k} {a} ON {a}.{key} = {'d.tree' if name == 'l' else '1'} AND {a}.pos = {place} // {16**k}")
            proof.append(f"CASE WHEN {a}.inner_node THEN {a}.lo || {a}.hi ELSE '' END")
    steps = [f"{name}s{k}" for name, count in (("l", _SQL_LEVELS), ("t", _SQL_TOP_LEVELS)) for k in range(count)]
    folds, last = [], "p"
    for i, a in enumerate(steps):
        folds.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN {a}_in THEN sha256({a}_lo || folded || {a}_hi) ELSE folded END AS folded) FROM {last})")
        last = f"f{i}"
    columns = ", ".join(f"{a}.inner_node AS {a}_in, {a}.lo AS {a}_lo, {a}.hi AS {a}_hi" for a in steps)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
                  CASE WHEN {_CRC_SQL} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tampered FROM documents),
     o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
     {levels('l', 'SELECT tree, pos, leaf AS h FROM o', 'tree', _SQL_LEVELS)},
     q AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM l{_SQL_LEVELS}),
     {levels('t', 'SELECT 1 AS one, pos, h FROM q', 'one', _SQL_TOP_LEVELS)},
     p AS (SELECT d.doc_id, d.leaf, d.tampered AS folded, q.h AS subroot, r.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {columns}
           FROM o d JOIN q ON q.tree = d.tree JOIN t{_SQL_TOP_LEVELS} r ON true {' '.join(joins)}),
     {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"""


@plan("op11_time_forward_manifest", _manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    leaf = manifest.digest_of(*fields, F.col("text"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, manifest.digest_of(*fields, lower)).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf).select("doc_id", "source", "leaf", tampered.alias("tampered"))
    proved = manifest.prove(leaves)
    folded = proved.withColumn("folded_root", manifest.fold(F.col("tampered"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _ranked_sql() -> str:
    terms = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {terms} AS w FROM documents),
     q AS (SELECT item_id, row_number() OVER () AS i, unnest(list_distinct({terms})) AS term FROM benchmark),
     s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
     t AS (SELECT r, doc_id, CAST(any_value(len(w)) AS BIGINT) AS n, term, count(*) AS tf
           FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
     f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, s GROUP BY term, nn),
     x AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
           FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""


@plan("op12_document_fp_tree", _ranked_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = fptree.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return ranked.select("item_id", "rank", "doc_id", "score")


@plan("op13_covering_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", covering.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")
