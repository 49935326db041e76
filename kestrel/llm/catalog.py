"""The queries of this package, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, chat, decontamination, dedup, fingerprints, mixing, pii, quality, simhash, token_files, trie, urls, vafile
from kestrel.llm.common import table
from kestrel.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query()
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted in windows of 1024 tokens and read back."""
    control = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.windows(table(spark, sf_dir, "conversations").select(more.columns).unionByName(more), budget=1024))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data pseudonymised, and the kinds and pseudonyms of what was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pii.pseudonymised(docs, key=os.environ.get("PSEUDONYM_KEY", "key for the test tables"), out="clean_text")
    return made.select("doc_id", F.col("clean_text").alias("text"), F.size("found").cast("long").alias("n_found"),
                       F.transform("found", lambda f: f["kind"]).alias("kinds"), F.transform("found", lambda f: f["pseudonym"]).alias("pseudonyms"))


SKETCH = r"""(SELECT CASE WHEN len(low) >= 4 THEN {{'below': '4', 'hashes': low}}
                    WHEN len(hs) <= 4 THEN {{'below': 'g', 'hashes': hs}}
                    ELSE {{'below': hs[4] || '0', 'hashes': hs[1:4]}} END
             FROM (SELECT hs, list_filter(hs, lambda h: h < '4') AS low FROM (
               SELECT list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
                 lambda i: left(md5(array_to_string(ws[i:i + 4], ' ')), 16)) END)) AS hs
               FROM (SELECT list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws))))"""
LIKENESS = """(SELECT CASE WHEN len(u) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(u) END
  FROM (SELECT x, y, list_distinct(list_concat(x, y)) AS u FROM (
    SELECT list_filter({0}.hashes, lambda h: h < least({0}.below, {1}.below)) AS x, list_filter({1}.hashes, lambda h: h < least({0}.below, {1}.below)) AS y)))"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
     e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT text FROM d ORDER BY doc_id LIMIT 1)) AS nt FROM d),
     f AS (SELECT *, left(text, n - n // 4) || left(nt, n // 4) AS edited FROM e),
     s AS (SELECT doc_id, n AS n_chars, edited, {SKETCH.format('text')} AS a, {SKETCH.format('edited')} AS b, {SKETCH.format('nt')} AS c FROM f)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.below || ':' || array_to_string(a.hashes, ',') AS fingerprint,
       b.below || ':' || array_to_string(b.hashes, ',') AS edited_fingerprint,
       {LIKENESS.format('a', 'b')} AS near_edited, {LIKENESS.format('a', 'c')} AS near_next FROM s""")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts (5-word shingles), and how alike they and their successors are."""
    made = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"), width=5)
    return made.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, links at two or fewer bits."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, seed=42, limit=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled ones outside the held-out fold."""
    scored = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.withColumnRenamed("id", "doc_id")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
FITS = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR host LIKE '%.{r.split('/')[0]}') AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{{}}'"
                for _, r in sorted(RULES, key=lambda r: -len(r[1])))
SORTED_RULES = sorted(RULES, key=lambda r: -len(r[1]))
PRIOR = """(SELECT (1 - rho) / rho FROM (SELECT least(greatest(CASE WHEN n > g AND k > 0 AND k < n
  THEN ((kk - k / n * k) / (k / n * (1 - k / n)) - g) / (n - g) ELSE 0.001 END, 0.001), 0.5) AS rho
  FROM (SELECT count(*) AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k * k / n)::DOUBLE AS kk FROM {} WHERE n > 0)))"""


@query(rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
     t AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
     c AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l
           FROM u LEFT JOIN t ON page_id = doc_id GROUP BY host),
     h AS (SELECT host, n, k, CASE WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
                  CASE WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
           FROM (SELECT *, array_to_string(l[-2:], '.') IN {urls.TWO_LABEL_SUFFIXES} AS two FROM c)),
     d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
     s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
     sr AS (SELECT suffix, (k + {PRIOR.format('s')} * (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s)) / (n + {PRIOR.format('s')}) AS rate FROM s),
     dr AS (SELECT domain, d.suffix, (k + {PRIOR.format('d')} * rate) / (n + {PRIOR.format('d')}) AS rate FROM d JOIN sr USING (suffix)),
     ab AS (SELECT host, k + {PRIOR.format('h')} * rate AS a, n - k + {PRIOR.format('h')} * (1 - rate) AS b FROM h JOIN dr USING (domain, suffix)),
     r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, host, path, CASE {FITS.format(*[r for _, r in SORTED_RULES])} END AS rule,
       coalesce(CASE {FITS.format(*[v for v, _ in SORTED_RULES])} END, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN r USING (host)""")
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the rules, else by their host's reputation. The tables label documents, not pages: a label of the
    document with a page's id stands in for that page's outcome (good: of quality and not toxic)."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), good.alias("good"))
    return urls.judged(table(spark, sf_dir, "pages"), outcomes, RULES).withColumnRenamed("id", "page_id")


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 3, 1, 2 in turn, none above twice its size."""
    taken = mixing.mix(table(spark, sf_dir, "documents"), [3, 1, 2], share=1.5, most=2.0)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the word vocabulary and back; digests of the ids and of the decoded texts."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded="decoded"))


def token_digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query(r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
     g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (body)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by the stateful stream, with the full-byte check."""
    found = dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids of the byte vocabulary, id 0 after each, written to Huffman-coded files and read back."""
    path = work_dir(spark, "token-files")
    tokens = token_files.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, tallied=True)
    token_files.write(tokens, path)
    return token_files.read(spark, path).select(F.col("id").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                                                F.crc32("ids").alias("ids_crc32"))


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ord({0}[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query(f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     h AS (SELECT *, conv_id - conv_id % 5 AS base, ({CRC32.format('(conv_id::VARCHAR)')} % 9)::INT AS h FROM own),
     convs AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = base),
     steps AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM convs),
     nodes AS (SELECT depth, ts[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends FROM steps GROUP BY ALL),
     kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
     own_parts AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(prefix[depth].text) ELSE 0 END AS mine
                   FROM nodes LEFT JOIN kids USING (prefix)),
     ups AS (SELECT prefix[1:d] AS prefix, sum(mine) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
             FROM (SELECT prefix, mine, n_children, unnest(range(depth + 1)) AS d FROM own_parts) GROUP BY ALL)
SELECT p.conv_id, p.depth, up.conv_id AS parent_conv_id, p.n_convs, p.n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(p.ends) AS ends_sha256
FROM own_parts p JOIN ups USING (prefix) LEFT JOIN nodes up ON p.depth > 0 AND up.depth = p.depth - 1 AND up.prefix = p.prefix[1:p.depth - 1]""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its group's first."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query()
def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds, over a VA-file of 6 bits a dimension."""
    found = vafile.with_inertia(table(spark, sf_dir, "embeddings"), centroids=16, rounds=3, dims=64, bits=6)
    return found.withColumnRenamed("id", "vec_id")


CONTAMINATED = r"""
WITH w AS (SELECT {0}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {1})
SELECT {0}, ws, len(ws) AS n FROM w"""


@query(f"""
WITH items AS ({CONTAMINATED.format('item_id', 'benchmark')}), docs AS ({CONTAMINATED.format('doc_id', 'documents')}),
     tests AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
               FROM (SELECT item_id, ws, least(n, 10) AS k, unnest(range(1, n - least(n, 10) + 2)) AS i FROM items WHERE n > 0)),
     lengths AS (SELECT DISTINCT k FROM tests),
     hits AS (SELECT doc_id, i, k, item_id
              FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS gram
                    FROM (SELECT doc_id, ws, k, unnest(range(1, n - k + 2)) AS i FROM docs, lengths WHERE n >= k)) JOIN tests USING (k, gram)),
     words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
     found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the windows of 10 words of all benchmark items."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
